"""Row checks with reasons, and default fills."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions import rulesets as R
from lorewell.functions.text import is_blank

# The allowed codes and limits of the catalog and the reports.
STATUSES = ("UPLOADING", "PROCESSING", "COMPLETED", "FAILED")
SOURCE_TYPES = ("UPLOADED_FILE", "OFFICIAL_WEBSITE", "CURATED_OFFICIAL")
FEEDBACK = ("HELPFUL", "INCORRECT")
ROLES = ("USER", "ASSISTANT")
HASH_PATTERN = r"^[a-f0-9]{64}\z"
RETENTION_DAYS = 90


def required(value: Column) -> Column:
    return is_blank(value)


def shorter_than(value: Column, chars: int) -> Column:
    return value.isNotNull() & (F.length(value) < chars)


def longer_than(value: Column, chars: int) -> Column:
    return value.isNotNull() & (F.length(value) > chars)


def not_one_of(value: Column, codes: tuple[str, ...]) -> Column:
    return value.isNotNull() & ~value.isin(*codes)


def outside(value: Column, low: float, high: float) -> Column:
    return value.isNotNull() & ~value.between(low, high)


def not_matching(value: Column, pattern: str) -> Column:
    return value.isNotNull() & ~value.rlike(pattern)


def crawled_document_rules() -> dict[str, Column]:
    """What a crawled document must satisfy before it enters the catalog."""
    c = F.col
    return {
        "title_missing": required(c("title")),
        "title_too_long": longer_than(c("title"), 255),
        "content_missing": required(c("content")),
        "content_too_long": longer_than(c("content"), 2_000_000),
        "source_missing": required(c("source")),
        "source_too_long": longer_than(c("source"), 128),
        "url_missing": required(c("source_url")),
        "url_too_long": longer_than(c("source_url"), 768),
        "category_missing": c("category").isNull(),
        "category_unknown": not_one_of(c("category"), R.CATEGORIES),
        "hash_malformed": c("content_hash").isNull() | not_matching(c("content_hash"), HASH_PATTERN),
    }


def mark_violations(df: DataFrame, rules: Mapping[str, Column], out: str = "reasons") -> DataFrame:
    """Add the ordered list of broken rules; each rule is a condition that is true when broken."""
    reasons = F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])
    return df.withColumn(out, F.filter(reasons, lambda r: r.isNotNull()))


def validate_rows(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with ``reasons``)."""
    marked = mark_violations(df, rules)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def backfill_evaluation(df: DataFrame) -> DataFrame:
    """Fill rows stored before runs existed: each becomes its own run named after its id."""
    old = F.col("run_id").isNull()
    fills = {
        "category": F.lit("UNKNOWN"),
        "expected_source": F.lit(""),
        "has_source": F.col("source_match"),
        "keyword_match": F.lit(False),
        "non_empty": F.col("answer") != "",
        "run_id": F.concat(F.lit("legacy-"), F.col("id").cast("string")),
    }
    return df.withColumns({c: F.when(old, fill).otherwise(F.col(c)) for c, fill in fills.items()})


def backfill_expiry(conversations: DataFrame, days: int = RETENTION_DAYS) -> DataFrame:
    """Conversations without an owner or an end get one counted from their last update."""
    incomplete = F.col("anonymous_session_id").isNull() | F.col("expire_time").isNull()
    return conversations.withColumn("expire_time", F.when(
        incomplete, F.col("updated_time") + F.make_dt_interval(F.lit(days))).otherwise(F.col("expire_time")))
