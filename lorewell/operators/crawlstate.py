"""Crawl records and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions.numbers import half_up
from lorewell.scale import first_per_key, side_by_side

RECORD = ("title", "category", "content_hash", "etag", "last_modified", "last_status", "crawled_at", "indexed_at")
KEPT_WHEN_MISSING = ("etag", "last_modified", "indexed_at")


def merge_crawl_state(state: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by url: new values win, but a missing etag, modification or index time keeps the old.

    Both sides carry one row per url; use ``latest_record`` first when a batch repeats urls.
    """
    old = state.select("url", F.struct(*RECORD).alias("__old"))
    fresh = new.select("url", F.struct(*RECORD).alias("__new"))
    def merged(field: str) -> Column:
        kept = (F.coalesce(F.col("__new")[field], F.col("__old")[field])
                if field in KEPT_WHEN_MISSING else F.col("__new")[field])
        return F.when(F.col("__new").isNotNull(), kept).otherwise(F.col("__old")[field]).alias(field)

    return old.join(fresh, "url", "full_outer").select("url", *[merged(f) for f in RECORD])


def latest_record(new: DataFrame) -> DataFrame:
    return first_per_key(new, ["url"], [F.desc("crawled_at"), F.desc_nulls_last("content_hash")])


def failed_record(new: Column, old_hash: Column) -> Column:
    """A failed page clears title and category but keeps the old hash."""
    return F.when(new == "FAILED", old_hash)


def run_summary(events: DataFrame) -> DataFrame:
    """Counters per run from its page events (run_id, seq, status, fetched, error).

    ``fetched`` marks pages that were fetched and parsed; a later failure counts both ways.
    """
    status = F.col("status")
    return events.groupBy("run_id").agg(
        F.count("*").alias("total_pages"),
        F.count_if("fetched").alias("success_count"),
        F.count_if(status == "FAILED").alias("failed_count"),
        F.count_if(status.isin("CREATED", "UPDATED", "REINDEXED")).alias("indexed_count"),
        F.count_if(status == "UNCHANGED").alias("unchanged_count"),
        F.count_if(status == "ROBOTS_DENIED").alias("robots_denied_count"),
        F.max_by("error", F.when(status == "FAILED", F.col("seq"))).alias("last_error"),
    ).withColumn("status", F.when(F.col("failed_count") > 0, "COMPLETED_WITH_ERRORS").otherwise("COMPLETED"))


def crawl_status(runs: DataFrame, state: DataFrame) -> DataFrame:
    """Latest run, number of known pages and last finish time in one row."""
    latest = runs.agg(F.max_by(F.struct(*runs.columns), F.col("id")).alias("latest_run"))
    pages = state.agg(F.count("*").alias("total_webpages"))
    return side_by_side(pages, latest).withColumn("last_updated", F.col("latest_run")["finished_at"])


def run_rates(total: Column, success: Column, failed: Column, denied: Column) -> tuple[Column, Column]:
    """(success percent, progress percent); whole numbers, 0 without pages."""
    rate = F.when(total > 0, half_up(success * F.lit(100.0) / total).cast("int")).otherwise(F.lit(0))
    handled = success + failed + denied
    progress = F.when(total > 0, F.least(F.lit(100), half_up(handled * F.lit(100.0) / total).cast("int"))).otherwise(F.lit(0))
    return rate, progress
