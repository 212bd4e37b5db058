"""Conversations, answers and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.functions.text import is_blank, trim_controls
from lorewell.scale import first_per_key, following_row, top_per_key

# Title length and default, retention, the shape of a stored source.
TITLE_CHARS, ELLIPSIS, NEW_TITLE = 30, "…", "新对话"
RECENT = 6
RETENTION_DAYS = 90
SESSION_ID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"
SOURCES = T.ArrayType(T.StructType([
    T.StructField("title", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("page", T.IntegerType()), T.StructField("score", T.DoubleType()),
    T.StructField("source", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("category", T.StringType()),
]))


def session_history(answers: DataFrame, session: str, n: int | None = None) -> DataFrame:
    """Answers of one session, newest first; ``n=RECENT`` gives the short list."""
    own = answers.where(F.col("session") == session).orderBy(F.desc("created_time"), F.desc("id"))
    return own if n is None else own.limit(n)


def recent_answers(answers: DataFrame, n: int = RECENT) -> DataFrame:
    """The ``n`` newest answers of every session, as the short list shows them."""
    return top_per_key(answers, ["session"], [F.desc("created_time"), F.desc("id")], n)


def pair_turns(messages: DataFrame, slice_messages: int = 4096) -> DataFrame:
    """(conversation_id, ord, question, answer) from a user message and the assistant message after it.

    Looks ahead inside slices of a conversation and across their borders, so a single huge
    conversation does not end up in one task.
    """
    paired = following_row(
        messages, ["conversation_id"], "ord", F.floor(F.col("ord") / slice_messages), ["role", "content"], "__next")
    return paired.where((F.col("role") == "USER") & (F.col("__next")["role"] == "ASSISTANT")).select(
        "conversation_id", "ord", F.col("content").alias("question"), F.col("__next")["content"].alias("answer"))


def thread_view(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """Messages in time order with the confidence of the answer they link to."""
    linked = answers.select(F.col("id").alias("chat_history_id"), "confidence")
    # Messages without an answer get a key of their own: nulls must not share a task.
    none = messages.where(F.col("chat_history_id").isNull()).withColumn("confidence", F.lit(None).cast("int"))
    some = messages.where(F.col("chat_history_id").isNotNull()).join(linked, "chat_history_id", "left")
    return some.unionByName(none).orderBy("conversation_id", "ord")


def title_from(question: Column) -> Column:
    return F.when(F.length(question) <= TITLE_CHARS, question).otherwise(
        F.concat(F.substring(question, 1, TITLE_CHARS), F.lit(ELLIPSIS)))


def conversation_titles(messages: DataFrame) -> DataFrame:
    """Title of every conversation: its first question cut to size, or the default."""
    first = messages.groupBy("conversation_id").agg(
        F.min_by("content", F.when(F.col("role") == "USER", F.col("ord"))).alias("__first"))
    return first.select("conversation_id", F.coalesce(
        title_from(trim_controls(F.col("__first"))), F.lit(NEW_TITLE)).alias("title"))


def sources_from_json(text: Column) -> Column:
    return F.when(is_blank(text), F.array().cast(SOURCES)).otherwise(F.from_json(text, SOURCES))


def sources_to_json(sources: Column) -> Column:
    return F.to_json(sources, {"ignoreNullFields": "false"})


def visible_conversations(conversations: DataFrame, session: Column, now: Column) -> DataFrame:
    """Conversations of the session that have not expired."""
    return conversations.where((F.col("anonymous_session_id") == session) & (F.col("expire_time") >= now))


def retention_cleanup(conversations: DataFrame, messages: DataFrame, answers: DataFrame, now: Column,
                      days: int = RETENTION_DAYS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(conversations, messages, answers, one-row count) after removing what expired.

    Answers outside any conversation go once they are older than the retention.
    """
    expired = conversations.where(F.col("expire_time") < now).select("conversation_id").distinct()
    live = conversations.where(~(F.col("expire_time") < now) | F.col("expire_time").isNull())
    loose = answers.where(
        F.col("conversation_id").isNull() & (F.col("created_time") >= now - F.make_dt_interval(F.lit(days))))
    bound = answers.where(F.col("conversation_id").isNotNull()).join(expired, "conversation_id", "left_anti")
    return (live, messages.join(expired, "conversation_id", "left_anti"), bound.unionByName(loose.select(bound.columns)),
            expired.agg(F.count("*").alias("expired_count")))


def session_id(text: Column) -> Column:
    """Canonical lower-case session id, null when blank or malformed."""
    trimmed = trim_controls(text)
    return F.when(trimmed.rlike(SESSION_ID), F.lower(trimmed))


def feedback_upsert(events: DataFrame, answers: DataFrame) -> DataFrame:
    """Current feedback per answer: only the owner's, the last write wins, blank reasons are null.

    ``events``: chat_history_id, session, feedback, reason, seq.
    """
    owned = events.join(
        answers.select(F.col("id").alias("chat_history_id"), "session"), ["chat_history_id", "session"], "left_semi")
    latest = first_per_key(owned, ["chat_history_id"], [F.desc("seq")])
    reason = F.when(~is_blank(F.col("reason")), trim_controls(F.col("reason")))
    return latest.select("chat_history_id", F.col("feedback").alias("user_feedback"), reason.alias("reason"))
