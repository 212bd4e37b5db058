"""Streams over folders of new files; each one gives what its batch twin gives.

Every job is a file source with ``availableNow``: it works through what has arrived and stops, so
any scheduler can start it. Tables are kept in parts by a hash of their key; a batch reads and rewrites only the parts
its rows belong to. Changes carry the batch id, and a batch that runs again after a failure changes nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorewell import schemas as S
from lorewell.operators.dialogue import RETENTION_DAYS
from lorewell.operators.index import publish_index
from lorewell.operators.ratelimit import FULL, MINUTE
from lorewell.plans.crawl_ingest import WRITTEN, CrawlRules, assess_pages, next_catalog, next_state
from lorewell.plans.web_index import web_index_job
from lorewell.scale import first_per_key
from lorewell.sources.keyed import PARTS, finished, parts_of, read_keyed, update_keyed
from lorewell.streaming.windows import with_lateness


HORIZON = f"{RETENTION_DAYS} days"


def read_folder(spark: SparkSession, folder: str, ddl: str, files_per_batch: int = 1000, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.format(fmt).schema(ddl).option("maxFilesPerTrigger", files_per_batch).load(folder)


def run_batches(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_state(spark: SparkSession, root: str, only: list[int] | None = None) -> DataFrame:
    """The crawl records that ``stream_ingest`` keeps below ``root``."""
    return read_keyed(spark, f"{root}/state", S.CRAWL_RECORD_DDL, only)


def stored_catalog(spark: SparkSession, root: str, only: list[int] | None = None) -> DataFrame:
    """The catalog that ``stream_ingest`` keeps below ``root``."""
    return read_keyed(spark, f"{root}/catalog", S.CATALOG_DDL, only)


def stream_ingest(spark: SparkSession, pages: str, root: str, source_names: DataFrame, exclusions: DataFrame,
                  rules: CrawlRules, robots: DataFrame | None = None, files_per_batch: int = 1000, parts: int = PARTS) -> StreamingQuery:
    """Crawled pages into ``root``: outcomes per batch, then the catalog and crawl state that they change.

    The outcomes of a batch are stored before anything is derived from them, so a repeated batch reads the same
    outcomes again. Catalog and state are kept in ``parts`` by address.
    """
    def each(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        stored = f"{root}/outcomes/batch={number}"
        if not finished(session, stored):
            latest = first_per_key(batch, ["url"], [F.desc_nulls_last(c) for c in ("fetched_at", "etag", "last_modified", "html")])
            touched = parts_of(batch, F.col("url"), parts)
            state, catalog = stored_state(session, root, touched), stored_catalog(session, root, touched)
            assess_pages(latest, state, catalog, exclusions, source_names, robots, rules).write.mode("overwrite").parquet(stored)
        outcomes = session.read.schema(S.OUTCOME_DDL).parquet(stored)
        update_keyed(session, f"{root}/catalog", S.CATALOG_DDL, F.coalesce("source_url", F.col("id").cast("string")),
                     parts_of(outcomes.where(F.col("action").isNotNull()), F.col("source_url"), parts),
                     lambda now: next_catalog(now, outcomes, rules), f"batch {number}", parts)
        update_keyed(session, f"{root}/state", S.CRAWL_RECORD_DDL, F.col("url"), parts_of(outcomes, F.col("url"), parts),
                     lambda now: next_state(now, outcomes, rules), f"batch {number}", parts)

    return run_batches(read_folder(spark, pages, S.PAGE_DDL, files_per_batch), f"{root}/ingest-checkpoint", each)


def stream_index(spark: SparkSession, root: str, embed: Callable[[Column], Column] | None = None,
                 files_per_batch: int = 1000, parts: int = PARTS) -> StreamingQuery:
    """Index created and updated pages as their outcomes arrive; the index lives in ``root``/index."""
    def each(batch: DataFrame, number: int) -> None:
        changed = batch.where(F.col("action").isin(*WRITTEN)).withColumn("source_type", F.lit("OFFICIAL_WEBSITE"))
        latest = first_per_key(changed, ["source_url"], [F.desc("crawl_time"), F.desc("content_hash")])
        publish_index(f"{root}/index", web_index_job(latest, embed), f"batch {number}", parts)

    stream = read_folder(spark, f"{root}/outcomes/batch=*", S.OUTCOME_DDL, files_per_batch)
    return run_batches(stream, f"{root}/index-checkpoint", each)


def stream_dedupe(pages: DataFrame, time: str = "crawled_at", horizon: str = HORIZON) -> DataFrame:
    """Drop repeats of a page with unchanged content.

    A stream remembers a page for ``horizon`` after it was first seen, so its state is bounded: pages may arrive that
    much out of order, every repeat inside the horizon goes, one that comes later passes again. A table gives each
    page once.
    """
    if not pages.isStreaming:
        return pages.dropDuplicates(["url", "content_hash"])
    return (
        with_lateness(pages, time, horizon).dropDuplicatesWithinWatermark(["url", "content_hash"])
        .withColumn(time, F.col(time).cast("timestamp_ntz")))


def stream_rate_limit(requests: DataFrame, period: int = MINUTE) -> DataFrame:
    """(request_id, allowed) for a stream of (request_id, bucket_key, micros, capacity).

    Keyed state holds one number per bucket. Requests of a bucket have to arrive in time order from
    batch to batch; inside a batch they are sorted. The files per batch bound what one bucket
    can bring at once; logs at rest go through ``ratelimit.token_bucket``, which splits hot buckets.
    """
    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level = state.get[0] if state.exists else FULL
        rows = pd.concat(list(frames)).sort_values(["micros", "request_id"])
        allowed = []
        for t, c in zip(rows["micros"].tolist(), rows["capacity"].tolist()):
            level = min(level, c * period - c * t)
            passed = level >= period - c * t
            level -= period if passed else 0
            allowed.append(passed)
        state.update((level,))
        yield pd.DataFrame({"request_id": rows["request_id"], "allowed": allowed})

    return requests.groupBy("bucket_key").applyInPandasWithState(
        decide, "request_id long, allowed boolean", "level long", "append", GroupStateTimeout.NoTimeout)
