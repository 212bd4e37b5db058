"""Answer quality and catalog reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions import rulesets as R
from lorewell.functions.numbers import half_up, percentage
from lorewell.functions.text import trim_controls
from lorewell.operators.classify import catalog_label
from lorewell.scale import side_by_side

LOW_CONFIDENCE = 70
TOP_QUESTIONS = 10
UNCATEGORISED = "未分类"


def is_low(confidence: Column) -> Column:
    """Below the threshold; an unknown confidence is not low."""
    return F.coalesce(confidence < LOW_CONFIDENCE, F.lit(False))


def _with_feedback(answers: DataFrame, feedback: DataFrame) -> DataFrame:
    marks = feedback.select(F.col("chat_history_id").alias("id"), "user_feedback")
    return answers.join(marks, "id", "left").withColumn(
        "incorrect", F.coalesce(F.col("user_feedback") == "INCORRECT", F.lit(False)))


def quality_totals(answers: DataFrame, feedback: DataFrame, approximate: bool = False) -> DataFrame:
    """One row of totals. All feedback counts; the low-and-incorrect figure needs an existing answer.

    ``approximate`` replaces the exact distinct session count by a sketch.
    """
    sessions = F.approx_count_distinct("session") if approximate else F.count_distinct("session")
    per_answer = answers.agg(
        F.count("*").alias("total_answers"), sessions.alias("unique_sessions"),
        F.count_if(is_low(F.col("confidence"))).alias("low_confidence_answers"))
    marks = feedback.agg(
        F.count_if(F.col("user_feedback") == "HELPFUL").alias("helpful"),
        F.count_if(F.col("user_feedback") == "INCORRECT").alias("incorrect"))
    low = answers.where(is_low(F.col("confidence"))).select("id")
    wrong = feedback.where(F.col("user_feedback") == "INCORRECT").select(F.col("chat_history_id").alias("id"))
    both = low.join(wrong, "id", "left_semi").agg(F.count("*").alias("low_confidence_incorrect"))
    count = F.col("helpful") + F.col("incorrect")
    return side_by_side(per_answer, marks, both).withColumns({
        "feedback_count": count, "helpful_rate": percentage(F.col("helpful"), count)})


def frequent_questions(answers: DataFrame, n: int = TOP_QUESTIONS) -> DataFrame:
    return (
        answers.groupBy(trim_controls(F.col("question")).alias("question")).agg(F.count("*").alias("occurrences"))
        .orderBy(F.desc("occurrences"), "question").limit(n))


def frequent_questions_approximate(answers: DataFrame, n: int = TOP_QUESTIONS, tracked: int = 10000) -> DataFrame:
    """Sketch-based variant for question logs whose distinct texts do not fit an exact aggregate."""
    top = answers.agg(F.call_function(
        "approx_top_k", trim_controls(F.col("question")), F.lit(n), F.lit(tracked)).alias("top"))
    return top.select(F.inline("top")).select(F.col("item").alias("question"), F.col("count").alias("occurrences"))


def low_quality_questions(answers: DataFrame, feedback: DataFrame, n: int = TOP_QUESTIONS) -> DataFrame:
    """Questions with low-confidence or incorrect answers; unknown confidence counts as 0 in the mean."""
    return (
        _with_feedback(answers, feedback).where(is_low(F.col("confidence")) | F.col("incorrect"))
        .groupBy(trim_controls(F.col("question")).alias("question"))
        .agg(F.count("*").alias("occurrences"), F.count_if("incorrect").alias("incorrect_count"),
             half_up(F.avg(F.coalesce("confidence", F.lit(0))), 1).alias("average_confidence"))
        .orderBy(F.desc("incorrect_count"), F.desc("occurrences"), "question").limit(n))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("user_feedback").agg(F.count("*").alias("n"))


def audit_latest(log: DataFrame, n: int = 100) -> DataFrame:
    """Newest audit rows with both texts trimmed and cut."""
    def cut(column: str, chars: int) -> Column:
        return F.substring(trim_controls(F.coalesce(column, F.lit(""))), 1, chars)

    return log.orderBy(F.desc("created_time"), F.desc("id")).limit(n).withColumns({
        "operation": cut("operation", 64), "target": cut("target", 1000)})


def catalog_search(catalog: DataFrame, text: str, label: str | None = None, name: str | None = None) -> DataFrame:
    """Rows whose title, source and file name contain the text, optionally under one label."""
    fields = F.lower(F.concat("title", "source", "filename"))
    found = catalog.where(F.contains(fields, F.lit(text.lower())))
    if label is None:
        return found
    return found.where(catalog_label(F.col("title"), F.col("source"), F.col("category"), name) == label)


def catalog_admin_search(catalog: DataFrame, text: str) -> DataFrame:
    """As above over file name, source and category code with label, or the uncategorised mark."""
    coded = F.lit(UNCATEGORISED)
    for code, shown in R.CATEGORY_LABELS.items():
        coded = F.when(F.col("category") == code, F.lit(code + shown)).otherwise(coded)
    return catalog.where(F.contains(F.lower(F.concat("filename", "source", coded)), F.lit(text.strip().lower())))


def catalog_metrics(catalog: DataFrame) -> DataFrame:
    status = F.col("status")
    return catalog.agg(
        F.count("*").alias("documents"), F.count_distinct("source").alias("sources"),
        F.count_if(status == "COMPLETED").alias("completed"),
        F.count_if(status.isin("PROCESSING", "UPLOADING")).alias("processing"),
        F.count_if(status == "FAILED").alias("failed"))
