"""Token usage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions.dates import local_time
from lorewell.functions.numbers import half_up, percentage

# The report periods in days before today, the counters, the report zone.
PERIODS = {"today": 0, "7d": 6, "30d": 29, "all": None}
COUNTERS = ("prompt_tokens", "completion_tokens", "total_tokens", "cache_hit_tokens", "cache_miss_tokens")
REPORT_ZONE = "Asia/Shanghai"


def normalize_period(period: str | None) -> str:
    asked = (period or "today").strip().lower()
    return asked if asked in PERIODS else "today"


def period_start(period: str | None, today: Column) -> Column | None:
    """First day of the period, null for all time; unknown periods mean today."""
    days = PERIODS[normalize_period(period)]
    return None if days is None else F.date_sub(today, days)


def report_day(now_utc: Column) -> Column:
    return F.to_date(local_time(now_utc, REPORT_ZONE))


def usage_counters() -> list[Column]:
    status = F.col("status")
    return [
        F.count("*").alias("requests"), F.count_if(status == "SUCCESS").alias("successes"),
        F.count_if(status == "FAILED").alias("failures"),
        *[F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).cast("long").alias(c) for c in COUNTERS],
    ]


def usage_summary(usage: DataFrame, period: str | None, today: Column,
                  input_rate: float = 0.0, output_rate: float = 0.0) -> DataFrame:
    """One row of counters since the start of the period, success rate and estimated cost."""
    start = period_start(period, today)
    kept = usage if start is None else usage.where(F.col("created_time") >= start.cast("timestamp_ntz"))
    total = kept.agg(*usage_counters())
    return total.withColumns({
        "period": F.lit(normalize_period(period)),
        "success_rate": percentage(F.col("successes"), F.col("requests"), 2),
        "estimated_cost": estimated_cost(F.col("prompt_tokens"), F.col("completion_tokens"), input_rate, output_rate),
    })


def estimated_cost(prompt: Column, completion: Column, input_rate: float, output_rate: float) -> Column:
    """Price of the tokens at rates per million; negative rates count as 0."""
    million = F.lit(1_000_000.0)
    cost = prompt * F.lit(max(0.0, float(input_rate))) / million + completion * F.lit(max(0.0, float(output_rate))) / million
    return half_up(cost, 6)


def sanitize_usage(rows: DataFrame) -> DataFrame:
    """Usage rows as they are stored: no negative or missing numbers, safe error types on failures."""
    counters = {c: F.greatest(F.lit(0), F.coalesce(F.col(c), F.lit(0))) for c in (*COUNTERS, "latency_ms")}
    error = F.substring(F.regexp_replace(F.coalesce("error_type", F.lit("UNKNOWN")), "[^A-Z0-9_]", "_"), 1, 64)
    return rows.withColumns({
        **counters, "model": F.coalesce("model", F.lit("")),
        "error_type": F.when(F.col("status") == "FAILED", error)})
