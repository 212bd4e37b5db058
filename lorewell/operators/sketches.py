"""Reports from sketches kept per day: accumulated once, combined for any span of days, estimated at the end.

A day of answers leaves one row; a report over a year reads 365 rows and never the answers again. Both sketches can be
combined in any order, so days may be added late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions.text import trim_controls

TRACKED = 10_000
SESSION_BITS = 14


def daily_sketches(answers: DataFrame, tracked: int = TRACKED, session_bits: int = SESSION_BITS) -> DataFrame:
    """(day, answers, questions, sessions): counts and sketches of each day of answers (created_time, question, session).

    ``tracked`` questions are followed per sketch; ``session_bits`` is the logarithm of the size of the session
    sketch. Null questions and sessions are not counted. Shrinks map-side, so a busy day is cheap.
    """
    text = trim_controls(F.col("question"))
    return answers.groupBy(F.to_date("created_time").alias("day")).agg(
        F.count("*").alias("answers"), F.call_function("approx_top_k_accumulate", text, F.lit(tracked)).alias("questions"),
        F.hll_sketch_agg("session", session_bits).alias("sessions"))


def between(sketches: DataFrame, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """The sketches of the days from ``first`` to ``last``, both included; open where None."""
    if first is not None:
        sketches = sketches.where(F.col("day") >= first)
    return sketches if last is None else sketches.where(F.col("day") <= last)


def frequent_questions_sketched(sketches: DataFrame, n: int, tracked: int = TRACKED) -> DataFrame:
    """(question, occurrences, off): about the ``n`` most frequent questions of the days given.

    ``off`` bounds how far an estimate may lie above or a left-out question's count below: 3.5 answers in every
    ``tracked``, none while the days have no more different questions than are followed.
    """
    whole = sketches.agg(
        F.call_function("approx_top_k_combine", F.col("questions"), F.lit(tracked)).alias("questions"), F.sum("answers").alias("answers"))
    top = whole.select(F.call_function("approx_top_k_estimate", F.col("questions"), F.lit(n)).alias("top"), "answers")
    rows = top.select(F.explode("top").alias("top"), F.ceil(F.col("answers") * F.lit(3.5) / F.lit(tracked)).alias("off"))
    return rows.select(F.col("top.item").alias("question"), F.col("top.count").alias("occurrences"), "off")


def sessions_sketched(sketches: DataFrame) -> DataFrame:
    """(sessions): about how many different sessions the days given had."""
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sessions")).alias("sessions"))
