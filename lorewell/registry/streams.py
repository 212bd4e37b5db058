"""Registered queries that run real streams to their end, with the SQL of their batch twins."""

from __future__ import annotations

from datetime import datetime, timedelta
from uuid import uuid4

from pyspark.sql import functions as F

from lorewell import schemas as S
from lorewell.operators import embed
from lorewell.operators.index import read_index
from lorewell.plans.crawl_ingest import CrawlRules, assess_pages, next_catalog, next_state
from lorewell.plans.web_index import web_index_job
from lorewell.registry import views as V
from lorewell.registry.core import query
from lorewell.registry.rules_and_crawl import NOW
from lorewell.scale import cut_lineage, shared_folder
from lorewell.streaming import jobs, replay, windows


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


@query("stream_usage", V.with_views("""
    select date_trunc('day', created_time) usage_day, model, count(*) requests, count(*) filter (status = 'SUCCESS') successes, cast(sum(total_tokens) as bigint) total_tokens
    from v_usage group by 1, 2""", "v_usage"))
def stream_usage(spark, sf):
    """Usage per day as a stream: every batch updates the days it touches, and days two days back leave the state."""
    folder, usage = _folder(spark, "usage"), V.usage(spark, sf)
    replay.arrive(usage, "created_time", f"{folder}/in")
    stream = replay.arrivals(spark, f"{folder}/in", usage.schema)
    updates = replay.run_out(windows.usage_per_window(stream, "1 day", ["model"], "2 days"), folder, "update")
    rows = replay.last_update(updates, ["window_start", "window_end", "model"])
    return rows.select(F.col("window_start").alias("usage_day"), "model", "requests", "successes", "total_tokens")


@query("stream_session_activity", """
    with marked as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 12 hour then 0 else 1 end starts from events),
    grouped as (select *, sum(starts) over (partition by user_id order by ts rows unbounded preceding) grp from marked)
    select cast(user_id as varchar) session, min(ts) first_seen, max(ts) + interval 12 hour expires, count(*) messages from grouped group by user_id, grp""")
def stream_session_activity(spark, sf):
    """Activity periods as a stream: a period is given out, and leaves the state, once the watermark has passed its end."""
    folder = _folder(spark, "activity")
    rows = V.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session"), F.col("ts").alias("created_time"))
    replay.arrive(rows, "created_time", f"{folder}/in")
    replay.closed(rows, "created_time", "3 days", dict).write.parquet(f"{folder}/in/arrival=last")
    stream = replay.arrivals(spark, f"{folder}/in", rows.schema)
    periods = replay.run_out(windows.session_activity(stream, timedelta(hours=12), "1 day"), folder)
    return periods.where(F.col("session").isNotNull()).drop("batch")


@query("stream_dedupe", "select url, content_hash, count(*) n from (select distinct url, sha256(html) content_hash from pages) group by all")
def stream_dedupe(spark, sf):
    """Every page arrives twice, ten days apart, and passes once."""
    folder = _folder(spark, "dedupe")
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    pages = V.table(spark, sf, "pages").select(
        "url", F.sha2("html", 256).alias("content_hash"),
        (start + F.make_dt_interval(secs=F.pmod(F.col("page_id"), F.lit(86_400)).cast("decimal(18,6)"))).alias("crawled_at"))
    again = pages.withColumn("crawled_at", F.col("crawled_at") + F.expr("interval 10 days"))
    replay.arrive(pages.unionByName(again), "crawled_at", f"{folder}/in")
    passed = replay.run_out(jobs.stream_dedupe(replay.arrivals(spark, f"{folder}/in", pages.schema)), folder)
    return passed.groupBy("url", "content_hash").agg(F.count("*").alias("n"))


def _crawl(spark, sf):
    """(pages as they arrive, side tables, rules) of a crawl of the given pages, each address once."""
    pages = V.table(spark, sf, "pages").groupBy("url").agg(F.max("html").alias("html"), F.min("page_id").alias("page_id"))
    title = F.concat(F.lit("<html><head><meta name='date' content='2024-03-05'></head><body><h1>选课通知</h1><article>请办理选课手续"), F.col("html"), F.lit("</article></body></html>"))
    pages = pages.select(
        "url", F.lit(200).alias("http_status"), F.lit("text/html").alias("content_type"), F.lit(None).cast("string").alias("etag"),
        F.lit(None).cast("string").alias("last_modified"), title.alias("html"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("page_id").cast("int"))).alias("fetched_at"))
    names = spark.createDataFrame([], "host string, name string")
    return cut_lineage(pages), names, V.exclusions(spark, sf), CrawlRules(now=datetime.fromisoformat(NOW))


def _same(streamed, batch, key):
    """Per key whether both hold the same row."""
    columns = sorted(c for c in batch.columns)
    digest = lambda rows, name: rows.select(
        key, F.sha2(F.to_json(F.struct(*columns)), 256).alias(name))
    both = digest(streamed, "one").join(digest(batch, "two"), key, "full_outer")
    return both.select(key, F.coalesce(F.col("one") == F.col("two"), F.lit(False)).alias("same"))


@query("stream_ingest", "select url, true same from (select distinct url from pages)")
def stream_ingest(spark, sf):
    """The crawl state that a stream keeps in parts equals that of one batch run, page by page."""
    folder, (pages, names, barred, rules) = _folder(spark, "ingest"), _crawl(spark, sf)
    replay.arrive(pages, "fetched_at", f"{folder}/pages", 2)
    jobs.stream_ingest(spark, f"{folder}/pages/*", folder, names, barred, rules, files_per_batch=1, parts=4).awaitTermination()
    state, catalog = spark.createDataFrame([], S.CRAWL_RECORD_DDL), spark.createDataFrame([], S.CATALOG_DDL)
    outcomes = cut_lineage(assess_pages(pages, state, catalog, barred, names, None, rules))
    return _same(jobs.stored_state(spark, folder), next_state(state, outcomes, rules), "url")


@query("stream_index", "select url source_url, true same from (select distinct url from pages)")
def stream_index(spark, sf):
    """The index that follows the outcomes of a crawl, batch by batch, equals the index of the whole catalog."""
    folder, (pages, names, barred, rules) = _folder(spark, "index"), _crawl(spark, sf)
    state, catalog = spark.createDataFrame([], S.CRAWL_RECORD_DDL), spark.createDataFrame([], S.CATALOG_DDL)
    outcomes = cut_lineage(assess_pages(pages, state, catalog, barred, names, None, rules))
    for number in (0, 1):
        outcomes.where(F.pmod(F.xxhash64("url"), F.lit(2)) == number).hint("rebalance").write.parquet(f"{folder}/outcomes/batch={number}")
    jobs.stream_index(spark, folder, embed.hash_embedding(64), files_per_batch=8, parts=4).awaitTermination()
    batch = web_index_job(next_catalog(catalog, outcomes, rules), embed.hash_embedding(64))
    per_page = lambda rows: rows.groupBy("source_url").agg(
        F.sort_array(F.collect_list(F.struct("chunk_id", "content"))).alias("chunks"))
    return _same(per_page(read_index(spark, f"{folder}/index")), per_page(batch), "source_url")
