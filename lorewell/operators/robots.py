"""Crawl permission from stored robots files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions.text import strip
from lorewell.functions.urls import origin


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """One row per origin: policy ``ALLOW``, ``DENY`` or ``RULES`` and its ordered rules.

    ``robots`` has origin, status (null when the fetch failed) and body. All windows run inside
    one file of one origin, so a partition never exceeds a robots file.
    """
    product = agent.split("/")[0].lower()
    parsed = (
        robots.where(F.col("status") < 400)
        .select("origin", F.posexplode(F.split("body", r"\r\n|\n|\r")).alias("line", "raw"))
        .withColumn("text", strip(F.regexp_replace("raw", r"#.*\z", "")))
        .withColumn("word", F.lower(strip(F.regexp_extract("text", r"^([^:]*):", 1))))
        .withColumn("value", strip(F.regexp_extract("text", r"^[^:]*:(.*)\z", 1)))
        .withColumn("kind", F.when(F.col("raw") == "", "blank")
                    .when(F.col("word") == "user-agent", "agent")
                    .when(F.col("word").isin("allow", "disallow"), "rule")
                    .when(F.col("word").isin("crawl-delay", "request-rate"), "setting"))
        .where(F.col("kind").isNotNull())
    )
    file_order = Window.partitionBy("origin").orderBy("line")
    so_far = file_order.rowsBetween(Window.unboundedPreceding, 0)
    previous = F.coalesce(F.lag("kind").over(file_order), F.lit("blank"))
    grouped = (
        parsed.withColumn("opens", ((F.col("kind") == "agent") & (previous != "agent")).cast("int"))
        .withColumn("grp", F.sum("opens").over(so_far))
        .withColumn("last_agent", F.max(F.when(F.col("kind") == "agent", F.col("line"))).over(so_far))
        .withColumn("last_blank", F.max(F.when(F.col("kind") == "blank", F.col("line"))).over(so_far))
        .withColumn("open", F.col("last_agent") > F.coalesce("last_blank", F.lit(-1)))
    )
    value = F.coalesce(F.try_url_decode("value"), F.col("value"))
    rule = F.struct(
        F.col("line"), F.coalesce(F.try_url_decode("value"), F.col("value")).alias("prefix"),
        ((F.col("word") == "allow") | (F.col("value") == "")).alias("allow"))
    groups = (
        grouped.groupBy("origin", "grp").agg(
            F.collect_list(F.when(F.col("kind") == "agent", F.lower(value))).alias("agents"),
            F.sort_array(F.collect_list(
                F.when((F.col("kind") == "rule") & F.col("open"), rule))).alias("rules"),
            F.max((F.col("kind").isin("rule", "setting") & F.col("open")).cast("int")).alias("used"),
        ).where(F.col("used") == 1)
        .withColumn("is_default", F.array_contains("agents", "*"))
        .withColumn("named", ~F.col("is_default") & F.exists(
            "agents", lambda a: F.contains(F.lit(product), a)))
        .where(F.col("named") | F.col("is_default"))
    )
    # The named group wins over the default one, the earlier over the later.
    chosen = groups.groupBy("origin").agg(
        F.min_by("rules", F.struct(~F.col("named"), F.col("grp"))).alias("rules"))
    policy = (
        F.when(F.col("status").isNull() | F.col("status").isin(401, 403), "DENY")
        .when(F.col("status") >= 400, "ALLOW").otherwise("RULES"))
    return robots.select("origin", policy.alias("policy")).join(chosen, "origin", "left")


def _allowed(path_and_query: Column) -> Column:
    hit = F.get(F.filter("rules", lambda r: (r["prefix"] == "*") | F.startswith(path_and_query, r["prefix"])), F.lit(0))
    return (
        F.when(F.col("policy") == "DENY", F.lit(False))
        .when(F.col("policy") == "RULES", F.coalesce(hit["allow"], F.lit(True)))
        .otherwise(F.lit(True)))


def robots_allowed(pages: DataFrame, url: str, robots: DataFrame, agent: str,
                   out: str = "allowed") -> DataFrame:
    """Add a flag: may ``agent`` fetch the page? Origins without a stored file are open."""
    rules = robots_rules(robots, agent).withColumnRenamed("origin", "__origin")
    raw = F.regexp_extract(F.col(url), r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(.*)\z", 1)
    target = F.coalesce(F.try_url_decode(raw), raw)
    target = F.when(target == "", F.lit("/")).otherwise(target)
    return (
        pages.withColumn("__origin", origin(F.col(url))).join(rules, "__origin", "left")
        .withColumn(out, _allowed(target)).drop("__origin", "policy", "rules"))
