"""Crawl planning over a page snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions.urls import host, official_url, path
from lorewell.scale import cut_lineage, rows_of_keys, top_per_key

# Limits of a directory crawl.
MAX_HOSTS = 30
PAGES_PER_HOST = 50


def frontier(seeds: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth) of pages reachable from the seeds without leaving a host.

    Level by level, so every page gets its shortest depth. A crawler that pops pages while it
    discovers them may keep a longer first-queued depth; this result is a superset of that one.
    Each level joins the edges with the newest pages only and is checkpointed.
    """
    links = (
        edges.where(host(F.col("src")) == host(F.col("dst")))
        .select("src", "dst").distinct())
    if max_depth > 1:
        links = cut_lineage(links)
    level = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    reached = level
    for depth in range(1, max_depth + 1):
        found = (
            links.join(level.select(F.col("url").alias("src")), "src", "left_semi")
            .select(F.col("dst").alias("url")).distinct())
        level = found.join(reached.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth))
        if depth < max_depth:
            level = cut_lineage(level)
            if level.isEmpty():
                break
        reached = reached.unionByName(level)
    return reached


def page_budget(pages: DataFrame, per_host: int = PAGES_PER_HOST, total: int | None = None) -> DataFrame:
    """Pages to fetch: best ``per_host`` of each host, then ``total`` in host order.

    ``pages``: host_order, host, priority, depth, seq, url.
    """
    order = [F.col("priority"), F.col("depth"), F.col("seq")]
    kept = top_per_key(pages, ["host_order", "host"], order, per_host)
    if total is None:
        return kept
    return kept.orderBy("host_order", "priority", "depth", "seq").limit(total)


def discover_hosts(links: DataFrame, primary_host: str, suffixes: list[str], max_hosts: int = MAX_HOSTS,
                   known_hosts: int = 1) -> DataFrame:
    """Official sub-domains linked from the primary page, first seen first; each starts at depth 0.

    ``links``: pos, url. ``known_hosts`` hosts count towards the limit already.
    """
    name = host(F.col("url"))
    return (
        links.where(official_url(F.col("url"), suffixes=suffixes) & (name != primary_host))
        .groupBy(name.alias("host"))
        .agg(F.min("pos").alias("pos"), F.min_by("url", "pos").alias("seed_url"))
        .withColumn("depth", F.lit(0)).orderBy("pos").limit(max(0, max_hosts - known_hosts)))


def channel_candidates(links: DataFrame, seeds: DataFrame, url: str = "url") -> DataFrame:
    """Links worth following for list-page seeds.

    List pages below the seed's folder always; article pages of the seed's numeric channel, or
    any article page when the seed has no channel.

    Links and seeds meet by keys of host and folder, host and channel, or host and kind of page, never by the host alone;
    every different page is judged once.
    """
    def keyed(kind: str, site: Column, *parts: Column) -> Column:
        return F.concat_ws("\u0000", F.lit(kind), site, *parts)

    seed_path, seed_host = F.lower(path(F.col("url"))), host(F.col("url"))
    channel = F.regexp_extract(seed_path, r"/(\d+)/list\d*\.htm\z", 1)
    folder = F.concat(F.regexp_extract(seed_path, r"(?s)^(.*)/", 1), F.lit("/"))
    wanted = seeds.where(seed_host.isNotNull()).select(F.explode(F.array(
        keyed("list", seed_host, folder),
        F.when(channel != "", keyed("channel", seed_host, channel)).otherwise(keyed("article", seed_host)))).alias("__key"))

    page, site = F.lower(path(F.col(url))), host(F.col(url))
    marked = links.withColumns({"__host": site, "__page": page})
    pages = marked.where("__host is not null").select("__host", "__page").distinct()
    page, site = F.col("__page"), F.col("__host")
    parts = F.split(page, "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: keyed(
        "list", site, F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))))
    none = F.array().cast("array<string>")
    is_list = (F.size(parts) > 1) & F.element_at(parts, -1).rlike(r"^list\d*\.htm\z")
    number = F.regexp_extract(page, r"/c(\d+)a\d+/page\.htm\z", 1)
    keys = F.concat(
        F.when(is_list, above).otherwise(none), F.when(number != "", F.array(keyed("channel", site, number))).otherwise(none),
        F.when(page.endswith("/page.htm"), F.array(keyed("article", site))).otherwise(none))
    followed = rows_of_keys(pages.select("__host", "__page", F.explode(keys).alias("__key")), wanted, "__key")
    followed = followed.select("__host", "__page").distinct()
    return marked.join(followed, ["__host", "__page"], "left_semi").drop("__host", "__page")


def crawl_hosts(seeds: DataFrame, edges: DataFrame, hosts: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth, host, host_order, pos, priority) of the pages a run over configured hosts can reach.

    ``seeds``: url, pos. ``edges``: src, dst, pos (place of the link on its page), priority (of its anchor). ``hosts``:
    the configured hosts (host). Links lead from host to host as long as both are configured. A page has its shortest
    depth, and of the links that lead there from one level up the least priority and place. Hosts are ordered by
    their first discovery: seeds come first in their own order, then hosts by depth, priority and place of
    the first page found on them, ties by name. ``page_budget`` cuts the result per host and in all.
    """
    allowed = hosts.select(F.col("host").alias("__host")).distinct()
    links = rows_of_keys(edges.withColumn("__host", host(F.col("dst"))), allowed, "__host").drop("__host")
    links = links.groupBy("src", "dst").agg(F.min(F.struct("priority", "pos")).alias("way"))
    if max_depth > 1:
        links = cut_lineage(links)
    starts = rows_of_keys(seeds.withColumn("__host", host(F.col("url"))), allowed, "__host").drop("__host")
    level = starts.groupBy("url").agg(F.min("pos").alias("pos")).select(
        "url", F.lit(0).alias("depth"), "pos", F.lit(0).alias("priority"))
    reached = level = cut_lineage(level)
    for depth in range(1, max_depth + 1):
        found = links.join(level.select(F.col("url").alias("src")), "src").groupBy(F.col("dst").alias("url")).agg(F.min("way").alias("way"))
        level = found.join(reached.select("url"), "url", "left_anti").select(
            "url", F.lit(depth).alias("depth"), F.col("way.pos").alias("pos"), F.col("way.priority").alias("priority"))
        if depth < max_depth:
            level = cut_lineage(level)
            if level.isEmpty():
                break
        reached = reached.unionByName(level)
    pages = reached.withColumn("host", host(F.col("url")))
    # One row per configured host.
    first = pages.groupBy("host").agg(F.min(F.struct("depth", "priority", "pos")).alias("first"))
    order = first.withColumn("host_order", F.row_number().over(Window.orderBy("first", "host"))).drop("first")
    return pages.join(order, "host")


def reseed_known(seeds: DataFrame, state: DataFrame) -> DataFrame:
    """Seeds (depth 0, priority 0) and known pages (depth 1, priority 1), one row per url.

    ``crawled_at`` is kept for ordering, the newest known page first.
    """
    first = seeds.select("url", F.lit(0).alias("depth"), F.lit(0).alias("priority"),
                         F.lit(None).cast("timestamp_ntz").alias("crawled_at"))
    known = state.select("url", F.lit(1).alias("depth"), F.lit(1).alias("priority"), "crawled_at")
    return (
        first.unionByName(known).groupBy("url")
        .agg(F.min("depth").alias("depth"), F.min("priority").alias("priority"),
             F.max("crawled_at").alias("crawled_at")))


def link_edges(links: DataFrame) -> DataFrame:
    """Edges (src, dst, anchor, pos), each target once per page at its first position."""
    return links.groupBy("src", "dst").agg(F.min_by("anchor", "pos").alias("anchor"), F.min("pos").alias("pos"))
