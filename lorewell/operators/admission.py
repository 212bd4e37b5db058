"""Which fetched pages become documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions import rulesets as R

LIST_MINIMUM = 50
PAGE_MINIMUM = 120


def date_window(published: Column, evergreen: Column, since: Column) -> Column:
    """``DATE_UNKNOWN`` or ``OUT_OF_RANGE`` for pages that age; null for those that pass."""
    return (
        F.when(since.isNull() | evergreen, F.lit(None).cast("string"))
        .when(published.isNull(), F.lit("DATE_UNKNOWN"))
        .when(published < since, F.lit("OUT_OF_RANGE")))


def admission_status(allowed: Column, http_status: Column, category: Column, evergreen: Column,
                     published: Column, since: Column, detail: Column, static_list: Column,
                     content: Column) -> Column:
    """First reason to turn a page away, in fixed order; ``ADMITTED`` when there is none."""
    minimum = F.when(
        static_list | (evergreen & F.coalesce(category.isin(*R.STATIC_CATEGORIES), F.lit(False))),
        F.lit(LIST_MINIMUM)).otherwise(F.lit(PAGE_MINIMUM))
    dated = date_window(published, evergreen, since)
    return (
        F.when(~allowed, F.lit("ROBOTS_DENIED"))
        .when(http_status == 304, F.lit("UNCHANGED"))
        .when(category.isNull(), F.lit("UNCLASSIFIED"))
        .when(dated.isNotNull(), dated)
        .when(~detail & ~static_list & ~evergreen, F.lit("NON_CONTENT_PAGE"))
        .when(F.length(content) < minimum, F.lit("CONTENT_TOO_SHORT"))
        .otherwise(F.lit("ADMITTED")))


def change_status(http_status: Column, new_hash: Column, old_hash: Column, indexed_at: Column, force: bool = False) -> Column:
    """``UNCHANGED`` for an indexed page that answered 304 or has the hash it had, else ``CHANGED``."""
    same = indexed_at.isNotNull() & ((http_status == 304) | (new_hash == old_hash))
    return F.when(F.lit(not force) & F.coalesce(same, F.lit(False)), F.lit("UNCHANGED")).otherwise(F.lit("CHANGED"))


def detect_change(new: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """Add ``change``: ``UNCHANGED`` when an indexed page comes back the same, else ``CHANGED``.

    ``new``: url, http_status, content_hash. ``state``: url, content_hash, indexed_at; one row per url.
    """
    known = state.select("url", F.col("content_hash").alias("__old_hash"), F.col("indexed_at").alias("__indexed"))
    change = change_status(F.col("http_status"), F.col("content_hash"), F.col("__old_hash"), F.col("__indexed"), force)
    return (
        new.join(known, "url", "left").withColumn("change", change)
        .drop("__old_hash", "__indexed"))


def page_outcome(admission: Column, change: Column, action: Column) -> Column:
    """Status written to the crawl record: turned away, unchanged, or the catalog's answer."""
    return (
        F.when(admission != "ADMITTED", admission)
        .when(change == "UNCHANGED", change)
        .otherwise(action))
