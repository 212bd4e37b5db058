"""Joins and connected components that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.scale import cut_lineage

#: A key with more than this share of all rows is dealt over several tasks; there are at most 2,000 such keys.
SHARE = 2000
LINKS_A_TASK = 200_000


def meet(rows: DataFrame, facts: DataFrame, keys: Sequence[str], weight: str, total: int) -> DataFrame:
    """``rows`` with the columns of the one row of ``facts`` that has their keys; other rows go.

    ``facts`` says in ``weight`` how many rows each key has, out of ``total``. Keys above a share of 1/2,000 of the
    total (and 64 rows) are dealt over several tasks by a hash of the row. Only those keys are broadcast: at most
    2,000, or one for every 64 rows of a small table.
    """
    limit = max(64, total // SHARE)
    parts = F.ceil(F.col(weight) / limit).cast("int")
    hot = facts.where(F.col(weight) > limit).select(*keys, parts.alias("__parts"))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.coalesce("__parts", F.lit(1))).cast("int")
    rows = rows.join(F.broadcast(hot), [*keys], "left").withColumn("__salt", salt).drop("__parts")
    facts = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return rows.join(facts.drop(weight), [*keys, "__salt"]).drop("__salt")


def few(df: DataFrame, rows: int, per: int = LINKS_A_TASK) -> DataFrame:
    """The rows in no more partitions than their number asks for, so that small tables don't make many small files."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per)))


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, component) of every linked id: the smallest id reachable.

    Large and small stars alternate until nothing moves. The centre of a large star is one key with most of the links:
    it is dealt over several tasks.
    """
    links = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u > v").distinct()
    links = cut_lineage(links)
    state, count = None, links.count()
    while True:
        links = few(links, count)
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("weight"))
        large = meet(both.where("v > u"), least, ["u"], "weight", 2 * count)
        large = few(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), count)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("weight"))
        small = meet(large, least, ["u"], "weight", count).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        small = small.where("u > v").union(least.select("u", F.col("m").alias("v"))).distinct()
        links = cut_lineage(few(small, count))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            own = links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(own)
        state = now


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the links (a, b) that join two components, one after the other."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out = []
    for n, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append(n)
    return np.array(out, np.int64)
