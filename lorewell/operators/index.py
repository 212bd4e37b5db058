"""The chunk index: replace, delete, summarize."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.functions.hashing import chunk_id
from lorewell.functions.text import is_blank
from lorewell.scale import cut_lineage, rows_of_keys
from lorewell.schemas import CHUNK_DDL
from lorewell.sources.keyed import PARTS, parts_of, read_keyed, update_keyed


def with_chunk_id(chunks: DataFrame, metadata: list[str]) -> DataFrame:
    """Add ``chunk_id``, a digest of version, document, position, text and metadata."""
    return chunks.withColumn("chunk_id", chunk_id(
        F.col("document_id"), F.col("chunk_index"), F.col("content"), metadata))


def replace_index(index: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """Index in which the new chunks stand for their documents and addresses.

    Rows of the same document or of the same (non-blank) address go out. Which documents lose rows by their address is
    found from the two key columns alone; then one join by document decides about every row, so an index stored in
    buckets by document (``store_bucketed``) is rewritten without moving a text or a vector.
    """
    urls = new_chunks.where(~is_blank(F.col("source_url"))).select("source_url").distinct()
    narrow = index.where(~is_blank(F.col("source_url"))).select("document_id", "source_url").distinct()
    by_url = rows_of_keys(narrow, urls, "source_url")
    whole = new_chunks.select("document_id", F.lit(None).cast("string").alias("source_url")).distinct()
    leaving = whole.unionByName(by_url).where(F.col("document_id").isNotNull()).groupBy("document_id").agg(
        F.bool_or(F.col("source_url").isNull()).alias("__whole"), F.collect_set("source_url").alias("__urls"))
    stays = F.col("__whole").isNull() | (~F.col("__whole") & ~F.coalesce(F.array_contains("__urls", F.col("source_url")), F.lit(False)))
    kept = index.where(F.col("document_id").isNotNull()).join(leaving, "document_id", "left").where(stays)
    nameless = index.where(F.col("document_id").isNull()).join(
        by_url.where(F.col("document_id").isNull()).select("source_url").distinct(), "source_url", "left_anti")
    return kept.select(*new_chunks.columns).unionByName(nameless.select(*new_chunks.columns)).unionByName(new_chunks)


def store_bucketed(index: DataFrame, name: str, path: str, by: str = "document_id", buckets: int | None = None) -> DataFrame:
    """Write the index as the table ``name`` in ``buckets`` by a key, by default as many as there are shuffle partitions.

    Joins and look-ups by that key then move the other side to the buckets and read the index where it is.
    """
    spark = index.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    index.write.mode("overwrite").bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(name)
    return spark.table(name)


def delete_index_rows(index: DataFrame, document_ids: DataFrame) -> DataFrame:
    return index.join(document_ids.select("document_id").distinct(), "document_id", "left_anti")


def index_summary(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(
        F.min("filename").alias("filename"), F.count("*").alias("chunks_indexed"), F.min("category").alias("category"))


def _home() -> Column:
    """What decides the part of an index row: its address, or its document where it has none."""
    return F.when(is_blank(F.col("source_url")), F.col("document_id").cast("string")).otherwise(F.col("source_url"))


def publish_index(root: str, new_chunks: DataFrame, change: str | None = None, parts: int = PARTS) -> None:
    """Replace rows of the index stored below ``root``; a failure while computing leaves the old ones.

    The index is kept in ``parts`` by address (by document for rows without one). Only parts that get new rows or
    lose old ones are rewritten; which ones lose rows is found from the two key columns alone. ``change`` names the change
    for a repeated run.
    """
    spark = new_chunks.sparkSession
    new_chunks = cut_lineage(new_chunks)  # embedded once, used for the parts and for the rows
    keys = new_chunks.select("document_id", "source_url").distinct()
    stored = read_keyed(spark, root, new_chunks.schema)
    narrow = stored.select("document_id", "source_url").distinct()
    leaving = narrow.join(keys.select("document_id").distinct(), "document_id", "left_semi").unionByName(
        narrow.join(keys.where(~is_blank(F.col("source_url"))).select("source_url").distinct(), "source_url", "left_semi"))
    touched = sorted({*parts_of(keys, _home(), parts), *parts_of(leaving, _home(), parts)})
    update_keyed(spark, root, new_chunks.schema, _home(), touched, lambda now: replace_index(now, new_chunks), change, parts)


def read_index(spark: SparkSession, root: str, schema: str | T.StructType = CHUNK_DDL) -> DataFrame:
    """The index stored below ``root``; empty where there is none yet."""
    return read_keyed(spark, root, schema)
