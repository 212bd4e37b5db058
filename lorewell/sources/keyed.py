"""Tables kept in parts by a hash of the key: a change rewrites the parts it touches and leaves all other files alone.

A change is first written beside the table and only then swapped in, part by part, by the plain Parquet writer. A job that
fails while computing changes nothing; one that fails while swapping is finished by running the same change again,
because the finished stage is found and swapped in anew. A reader that comes during a swap may see some parts before and
some after it. One writer per table.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = 64
PART = "part"


def part_of(key: Column, parts: int = PARTS) -> Column:
    """The part of a key; a null key has one of its own like any other value."""
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _folder(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The rows below a folder, None where there is no such folder."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _schema(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def read_keyed(spark: SparkSession, root: str, schema: str | T.StructType, only: list[int] | None = None) -> DataFrame:
    """The table below ``root``, or an empty one; ``only`` names the parts to read."""
    schema = _schema(schema)
    stored = _folder(spark, f"{root}/table", T.StructType([*schema.fields, T.StructField(PART, T.IntegerType())]))
    if stored is None:
        return spark.createDataFrame([], schema)
    if only is not None:
        stored = stored.where(F.col(PART).isin(only))
    return stored.select(*schema.names)


def _numbers(parts: DataFrame) -> list[int]:
    """At most one number per part."""
    return sorted(r[0] for r in parts.select(PART).distinct().collect())


def parts_of(rows: DataFrame, key: Column, parts: int = PARTS) -> list[int]:
    """The parts that hold the keys of ``rows``."""
    return _numbers(rows.select(part_of(key, parts).alias(PART)))


def finished(spark: SparkSession, folder: str) -> bool:
    """Whether a job that writes ``folder`` has run to its end."""
    try:
        spark.read.text(f"{folder}/_SUCCESS")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def update_keyed(spark: SparkSession, root: str, schema: str | T.StructType, key: Column, touched: list[int],
                 build: Callable[[DataFrame], DataFrame], change: str | None = None, parts: int = PARTS) -> None:
    """Replace the rows of the ``touched`` parts by ``build(their present rows)``.

    ``build`` may only return rows of these parts. ``change`` names the change: running it again after it was staged
    swaps the same rows in again. Two stages are kept, so a change can be repeated until the next one has begun.
    """
    if not touched:
        return
    schema = _schema(schema)
    change = change or uuid4().hex
    slots = [f"{root}/stage/{slot}" for slot in ("a", "b")]
    names = [_change(spark, slot) for slot in slots]
    if change in names:
        stage = slots[names.index(change)]
    else:
        stage = slots[names.index(None) if None in names else _older(spark, slots)]
        rows = build(read_keyed(spark, root, schema, touched)).select(*schema.names)
        rows = rows.withColumn(PART, part_of(key, parts)).hint("rebalance", PART)
        rows.write.mode("overwrite").partitionBy(PART).parquet(f"{stage}/rows")
        order = 1 + max((_order(spark, slot) for slot in slots), default=0)
        mark = spark.range(1).select(F.lit(change).alias("change"), F.lit(order).cast("long").alias("number"))
        mark.coalesce(1).write.mode("overwrite").json(f"{stage}/change")
    staged = _folder(spark, f"{stage}/rows", T.StructType([*schema.fields, T.StructField(PART, T.IntegerType())]))
    present = _numbers(staged)
    if present:
        (staged.hint("rebalance", PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(PART).parquet(f"{root}/table"))
    for number in set(touched) - set(present):  # parts that have lost all their rows
        spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(f"{root}/table/{PART}={number}")


def _stage_mark(spark: SparkSession, slot: str):
    marks = _folder_json(spark, f"{slot}/change") if finished(spark, f"{slot}/change") else None
    return marks.first() if marks is not None else None


def _folder_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("change string, number long").json(path)


def _change(spark: SparkSession, slot: str) -> str | None:
    mark = _stage_mark(spark, slot)
    return None if mark is None else mark["change"]


def _order(spark: SparkSession, slot: str) -> int:
    mark = _stage_mark(spark, slot)
    return 0 if mark is None else mark["number"]


def _older(spark: SparkSession, slots: list[str]) -> int:
    return min(range(len(slots)), key=lambda n: _order(spark, slots[n]))
