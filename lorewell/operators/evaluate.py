"""Scoring answers against an evaluation set and gating a release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions.numbers import half_up, percentage
from lorewell.functions.text import is_blank, trim_controls
from lorewell.operators.retrieve import FALLBACK

# Points per check, release gates in percent and their failure texts.
POINTS = {"has_source": 35, "source_match": 30, "keyword_match": 25, "non_empty": 10}
GATES = (
    ("non_empty_rate", 98.0, "非空率低于 98%"),
    ("source_coverage", 95.0, "来源覆盖率低于 95%"),
    ("source_match_rate", 85.0, "来源匹配率低于 85%"),
    ("human_accuracy_rate", 90.0, "人工准确率低于 90%"),
)
NOT_REVIEWED = "人工准确率尚未完成复核"
NOTE_CHARS = 1000


def _contains_folded(text: Column, expected: Column) -> Column:
    return is_blank(expected) | F.contains(F.lower(text), F.lower(expected))


def score_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Four checks and a score for every question; questions without an answer score as empty.

    ``questions``: question_id, category, question, expected_source, expected_keywords.
    ``answers``: question_id, answer, sources (array of structs with title and source).
    """
    joined = questions.join(answers.select("question_id", "answer", "sources"), "question_id", "left")
    answer = F.coalesce("answer", F.lit(""))
    has_source = F.coalesce(F.size("sources") > 0, F.lit(False))
    match = F.exists("sources", lambda s: _contains_folded(
        F.concat(F.coalesce(s["title"], F.lit("null")), F.lit(" "), F.coalesce(s["source"], F.lit("null"))),
        F.col("expected_source")))
    non_empty = ~is_blank(answer) & (trim_controls(answer) != FALLBACK)
    keyword = F.exists("expected_keywords", lambda k: _contains_folded(answer, k))
    checked = joined.withColumns({
        "answer": answer, "expected_source": F.coalesce("expected_source", F.lit("")),
        "has_source": has_source, "source_match": has_source & F.coalesce(match, F.lit(False)),
        "non_empty": non_empty, "keyword_match": non_empty & F.coalesce(keyword, F.lit(False))})
    score = F.lit(0)
    for check, points in POINTS.items():
        score = score + F.when(F.col(check), F.lit(points)).otherwise(F.lit(0))
    return checked.withColumn("score", score)


def eval_report(results: DataFrame) -> DataFrame:
    """One row per run: total, mean score, rates in percent; human accuracy is null without reviews."""
    total = F.count("*")
    reviewed = F.count("human_accurate")
    return results.groupBy("run_id").agg(
        total.alias("total"), half_up(F.avg("score"), 1).alias("average_score"),
        percentage(F.count_if("has_source"), total).alias("source_coverage"),
        percentage(F.count_if("source_match"), total).alias("source_match_rate"),
        percentage(F.count_if("keyword_match"), total).alias("keyword_match_rate"),
        percentage(F.count_if("non_empty"), total).alias("non_empty_rate"),
        reviewed.alias("reviewed"),
        F.when(reviewed > 0, percentage(F.count_if("human_accurate"), reviewed)).alias("human_accuracy_rate"))


def report_by_run(results: DataFrame, run_id: str) -> DataFrame:
    return eval_report(results.where(F.col("run_id") == run_id))


def category_scores(results: DataFrame) -> DataFrame:
    """Mean score per run and category; ``first_id`` gives the first-seen order."""
    return results.groupBy("run_id", "category").agg(
        half_up(F.avg("score"), 1).alias("average_score"), F.min("id").alias("first_id"))


def gates(report: DataFrame) -> DataFrame:
    """Add ``gate_failures`` and ``passed``; a run nobody reviewed fails."""
    checks = []
    for column, minimum, text in GATES:
        if column == "human_accuracy_rate":
            checks.append(F.when(F.col(column).isNull(), F.lit(NOT_REVIEWED)))
        checks.append(F.when(F.col(column) < minimum, F.lit(text)))
    failures = F.filter(F.array(*checks), lambda c: c.isNotNull())
    return report.withColumn("gate_failures", failures).withColumn("passed", F.size("gate_failures") == 0)


def apply_reviews(results: DataFrame, reviews: DataFrame) -> DataFrame:
    """Overlay human reviews (id, accurate, note); blank notes become null, long ones are cut."""
    marks = reviews.select("id", F.col("accurate").alias("__accurate"), F.col("note").alias("__note"),
                           F.lit(True).alias("__seen"))
    note = F.when(~is_blank(F.col("__note")), F.substring(trim_controls(F.col("__note")), 1, NOTE_CHARS))
    seen = F.col("__seen").isNotNull()
    return (
        results.join(marks, "id", "left")
        .withColumn("human_accurate", F.when(seen, F.col("__accurate")).otherwise(F.col("human_accurate")))
        .withColumn("review_note", F.when(seen, note).otherwise(F.col("review_note")))
        .drop("__accurate", "__note", "__seen"))


def question_distribution(questions: DataFrame) -> DataFrame:
    return questions.groupBy("category").agg(F.count("*").alias("n"))
