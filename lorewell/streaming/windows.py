"""Windowed usage and session activity; the same code serves batch tables and streams."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.operators.dialogue import RETENTION_DAYS
from lorewell.operators.usage import usage_counters

RETENTION = timedelta(days=RETENTION_DAYS)


def with_lateness(rows: DataFrame, time: str, lateness: str | None) -> DataFrame:
    """Add a watermark; it needs a timestamp with zone, so the column becomes one."""
    if lateness is None:
        return rows
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)


def usage_per_window(usage: DataFrame, width: str = "1 day", by: Sequence[str] = (), lateness: str | None = None) -> DataFrame:
    """Usage counters per tumbling window. On a stream, ``lateness`` is the watermark."""
    return (
        with_lateness(usage, "created_time", lateness).groupBy(F.window("created_time", width), *by).agg(*usage_counters())
        .withColumn("window_start", F.col("window.start").cast("timestamp_ntz"))
        .withColumn("window_end", F.col("window.end").cast("timestamp_ntz")).drop("window"))


def session_activity(messages: DataFrame, gap: timedelta = RETENTION, lateness: str | None = None) -> DataFrame:
    """Activity periods of each session: every message extends the expiry by ``gap``.

    Messages of a table are first counted in buckets as wide as the gap: those of one bucket always
    belong together, so even a session with most of the rows shrinks before the shuffle, and
    only bucket summaries are ordered. Streams keep their sessions as state.
    """
    seconds = gap.total_seconds()
    if messages.isStreaming:
        return (
            with_lateness(messages, "created_time", lateness)
            .groupBy(F.session_window("created_time", f"{int(seconds * 1000)} milliseconds"), "session")
            .agg(F.count("*").alias("messages"))
            .select("session", F.col("session_window.start").cast("timestamp_ntz").alias("first_seen"),
                    F.col("session_window.end").cast("timestamp_ntz").alias("expires"), "messages"))
    micros = F.unix_micros(F.col("created_time").cast("timestamp"))
    width = F.make_dt_interval(secs=F.lit(seconds))
    buckets = messages.groupBy("session", F.floor(micros / F.lit(int(seconds * 1_000_000))).alias("bucket")).agg(
        F.min("created_time").alias("first"), F.max("created_time").alias("last"), F.count("*").alias("n"))
    order = Window.partitionBy("session").orderBy("bucket")
    starts = F.coalesce(F.col("first") >= F.lag("last").over(order) + width, F.lit(True)).cast("int")
    return (
        buckets.withColumn("starts", starts)
        .withColumn("period", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("session", "period")
        .agg(F.min("first").alias("first_seen"), (F.max("last") + width).alias("expires"), F.sum("n").alias("messages"))
        .drop("period"))
