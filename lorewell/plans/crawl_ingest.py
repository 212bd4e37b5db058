"""From fetched pages to the next catalog and crawl state."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions.dates import http_date
from lorewell.functions.hashing import content_hash, iso_date_text
from lorewell.functions.urls import source_name
from lorewell.operators import catalog as C
from lorewell.operators.admission import admission_status, change_status, page_outcome
from lorewell.operators.classify import classify_page, static_list_page, trusted_evergreen
from lorewell.operators.crawlstate import merge_crawl_state
from lorewell.operators.html import parse_pages
from lorewell.operators.robots import robots_allowed
from lorewell.sources.tables import route_pages

WRITTEN = ("CREATED", "UPDATED", "REINDEXED")


@dataclass(frozen=True)
class CrawlRules:
    """What a crawl run is told: clock, date limit, names, permissions."""

    now: datetime
    since: datetime | None = None
    name: str | None = None
    library_host: str | None = None
    agent: str = "*"
    force: bool = False
    #: How much of a page's text is read for its class and its date; None reads all of it.
    body_chars: int | None = None
    date_chars: int | None = None


def moment(value: datetime | None) -> Column:
    """A clock value as timestamp without zone, independent of the session's zone."""
    return F.lit(None if value is None else value.isoformat()).cast("timestamp_ntz")


def known_facts(pages: DataFrame, state: DataFrame, catalog: DataFrame, exclusions: DataFrame, source_names: DataFrame,
                robots: DataFrame | None, rules: CrawlRules) -> DataFrame:
    """What is already known about each fetched url: permission, site name, old hashes, exclusion.

    All of it is joined to bare urls. A host with very many pages only skews rows of a few
    bytes here, and the pages themselves are shuffled once, when this table joins them.
    """
    urls = source_name(pages.select("url"), "url", source_names)
    if robots is not None:
        urls = robots_allowed(urls, "url", robots, rules.agent)
    else:
        urls = urls.withColumn("allowed", F.lit(True))
    records = state.select("url", F.col("content_hash").alias("old_hash"), F.col("indexed_at").alias("old_indexed_at"))
    listed = catalog.where(F.col("source_url").isNotNull()).select(
        F.col("source_url").alias("url"), F.col("content_hash").alias("catalog_hash"), F.lit(True).alias("in_catalog"))
    barred = exclusions.select(F.col("source_url").alias("url")).distinct().withColumn("barred", F.lit(True))
    return urls.join(records, "url", "left").join(listed, "url", "left").join(barred, "url", "left")


def assess_pages(pages: DataFrame, state: DataFrame, catalog: DataFrame, exclusions: DataFrame, source_names: DataFrame,
                 robots: DataFrame | None, rules: CrawlRules) -> DataFrame:
    """One outcome row per fetched page: parsed fields, ``status`` and, for admitted ones, ``action``.

    ``pages`` holds one row per url. Only pages that may and need to be read enter the Python stage;
    everything after the one join is a narrow stage.
    """
    facts = known_facts(pages, state, catalog, exclusions, source_names, robots, rules)
    routed = route_pages(pages).join(facts, "url")
    readable = F.col("allowed") & (F.col("route") == "PARSE")
    parsed = parse_pages(routed.withColumn("html", F.when(readable, F.col("html"))), rules.date_chars)
    parsed = parsed.withColumn("v", classify_page(
        F.col("title"), F.col("content"), F.col("url"), rules.name, rules.library_host, rules.body_chars))
    evergreen = trusted_evergreen(F.col("v"))
    now, since = moment(rules.now), moment(rules.since)
    judged = parsed.withColumns({
        "category": F.col("v.category"),
        "content_hash": content_hash(F.col("title"), F.col("content"), iso_date_text(F.col("published_time"))),
        "admission": F.when(F.col("allowed") & (F.col("route") == "FAILED"), "FAILED").otherwise(admission_status(
            F.col("allowed"), F.col("http_status"), F.col("v.category"), evergreen, F.col("published_time"), since,
            F.col("is_detail"), static_list_page(F.col("title"), F.col("v.category"), F.col("url"), rules.name),
            F.col("content"))),
        "crawl_time": now,
        "last_updated": F.coalesce("published_time", http_date(F.col("last_modified")), now),
        "source_url": F.col("url"), "fetched": readable | (F.col("allowed") & (F.col("route") == "UNCHANGED")),
    })
    change = change_status(F.col("http_status"), F.col("content_hash"), F.col("old_hash"), F.col("old_indexed_at"), rules.force)
    action = C.ingest_action(
        F.coalesce("in_catalog", F.lit(False)), F.col("content_hash"), F.col("catalog_hash"), F.col("barred"), rules.force)
    judged = judged.withColumns({"change": change, "action": action})
    unread = F.col("admission").isin("FAILED", "ROBOTS_DENIED")
    return judged.withColumns({
        "status": page_outcome(F.col("admission"), F.col("change"), F.col("action")),
        "action": F.when((F.col("admission") == "ADMITTED") & (F.col("change") == "CHANGED"), F.col("action")),
        "title": F.when(~unread, F.col("title")), "category": F.when(~unread, F.col("category")),
        "content_hash": F.when(F.col("admission") == "FAILED", F.col("old_hash"))
        .when(F.col("admission") != "ROBOTS_DENIED", F.col("content_hash")),
    }).select(
        "url", "source_url", "title", "content", "source", "category", "content_hash", "published_time", "crawl_time", "last_updated",
        "etag", "last_modified", "http_status", "fetched", "status", "action", "links", "content_links")


def next_catalog(catalog: DataFrame, outcomes: DataFrame, rules: CrawlRules) -> DataFrame:
    return C.apply_ingest(catalog, outcomes.where(F.col("action").isNotNull()), moment(rules.now))


def next_state(state: DataFrame, outcomes: DataFrame, rules: CrawlRules) -> DataFrame:
    """Crawl records after the run; a page answered with 304 keeps its record as it is."""
    now = moment(rules.now)
    read = F.col("status").isin("FAILED", "ROBOTS_DENIED")
    records = outcomes.where(~((F.col("status") == "UNCHANGED") & (F.col("http_status") == 304))).select(
        "url", "title", "category", "content_hash", F.when(~read, F.col("etag")).alias("etag"),
        F.when(~read, F.col("last_modified")).alias("last_modified"), F.col("status").alias("last_status"),
        now.alias("crawled_at"), F.when(F.col("action").isin(*WRITTEN), now).alias("indexed_at"))
    return merge_crawl_state(state, records)
