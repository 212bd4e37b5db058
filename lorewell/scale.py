"""Building blocks that keep results exact when one key holds a large share of the rows.

Window functions put every row of a key in one task. The helpers here avoid that:
selections are written as aggregates or as limited ranks (both shrink before the shuffle),
and running values are computed in order-preserving slices of a key whose summaries are
combined afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; below the warehouse, which all machines share too, where that is unset."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    return (folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(table: DataFrame) -> DataFrame:
    """A freshly read table over at least as many partitions as there are cores.

    For row work that is heavy (parsing, chunking, embedding) on tables stored in few files. Large
    tables already have more partitions and pass through untouched. Not for derived plans.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each key. Spark limits the groups before and after the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``; shrinks map-side, so a hot key is cheap."""
    return top_per_key(df, keys, order, 1, "__rank").drop("__rank")


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[Column], slice_of: Column,
                  value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the key (the row itself not counted).

    ``slice_of`` must grow with ``order``. Only one slice of a key meets in a task; the
    slice totals are added up by a window over one row per slice.
    """
    keys = list(keys)
    sliced = df.withColumn("__slice", slice_of).withColumn("__value", value)
    before_slice = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "__slice").agg(F.sum("__value").alias("__total"))
        .withColumn("__before", F.coalesce(F.sum("__total").over(before_slice), F.lit(0)))
        .drop("__total")
    )
    inside = Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sliced.join(offsets, [*keys, "__slice"])
        .withColumn(name, F.col("__before") + F.coalesce(F.sum("__value").over(inside), F.lit(0)))
        .drop("__slice", "__value", "__before")
    )


def following_row(df: DataFrame, keys: Sequence[str], order: str, slice_of: Column,
                  columns: Sequence[str], name: str) -> DataFrame:
    """Struct of ``columns`` taken from the next row of the key, across slice borders too."""
    keys = list(keys)
    sliced = df.withColumn("__slice", slice_of)
    payload = F.struct(*columns)
    next_slice = Window.partitionBy(*keys).orderBy("__slice")
    heads = (
        sliced.groupBy(*keys, "__slice").agg(F.min_by(payload, F.col(order)).alias("__head"))
        .withColumn("__head", F.lead("__head").over(next_slice))
    )
    inside = Window.partitionBy(*keys, "__slice").orderBy(order)
    return (
        sliced.join(heads, [*keys, "__slice"])
        .withColumn(name, F.coalesce(F.lead(payload).over(inside), F.col("__head")))
        .drop("__slice", "__head")
    )


PIECE_ROWS, PIECE_WEIGHT = 1024, 1 << 20


def in_pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The same values in short pieces, for functions whose results are larger than what they read.

    A piece ends after ``PIECE_ROWS`` values, or with the value that brings it to ``PIECE_WEIGHT`` characters (or tokens). So a
    Python worker holds the results of one piece, however many rows Spark sends at once.
    """
    for batch in batches:
        first = weight = 0
        for place, value in enumerate(batch, 1):
            weight += 0 if value is None else len(value)
            if place - first >= PIECE_ROWS or weight >= PIECE_WEIGHT or place == len(batch):
                yield batch.iloc[first:place]
                first, weight = place, 0
        if not len(batch):
            yield batch


def side_by_side(*single_rows: DataFrame) -> DataFrame:
    """One-row frames with different columns as one row; a union and an aggregate, no join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), single_rows)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def rows_of_keys(table: DataFrame, keys: DataFrame, key: str, limit: int = 1_000_000) -> DataFrame:
    """The rows of ``table`` whose key is among ``keys``.

    Up to ``limit`` keys are counted first and broadcast, so a large table is filtered where it is read; beyond that
    both sides meet by key. The table's rows come out once each either way.
    """
    wanted = keys.select(key).distinct()
    if wanted.limit(limit + 1).count() <= limit:
        wanted = F.broadcast(wanted)
    return table.join(wanted, key, "left_semi")


def join_short(rows: DataFrame, table: DataFrame, key: str, limit: int = 1_000_000) -> DataFrame:
    """``rows`` with the columns of ``table``, which are short, by ``key``.

    Up to ``limit`` rows of the table are broadcast, so many rows stay where they are; beyond that both sides meet by key.
    """
    return rows.join(F.broadcast(table) if table.limit(limit + 1).count() <= limit else table, key)
