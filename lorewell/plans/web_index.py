"""From catalog rows with text to index rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions.hashing import web_document_id
from lorewell.functions.text import strip, trim_controls
from lorewell.operators.chunks import chunk_text, enrich_text, number_single_pages
from lorewell.operators.embed import hash_embedding
from lorewell.operators.index import with_chunk_id

METADATA = [
    "filename", "source", "upload_time", "page", "document_id", "source_url", "category", "last_updated",
    "crawl_time", "content_hash", "source_type", "chunk_index",
]


def index_rows(numbered: DataFrame, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Give chunks their id and vector."""
    embed = embed or hash_embedding()
    return with_chunk_id(numbered, METADATA).withColumn("vector", embed(F.col("content")))


def web_index_job(documents: DataFrame, embed: Callable[[Column], Column] | None = None,
                  split: Callable[[Column], Column] | None = None) -> DataFrame:
    """Index rows of web and curated catalog rows.

    A page is one document of one page, so its chunks are numbered in place: the whole job is
    one narrow stage and needs no shuffle.
    """
    split = split or chunk_text()
    time = F.date_format("crawl_time", "yyyy-MM-dd'T'HH:mm:ss")
    title = trim_controls(F.col("title"))
    pages = documents.select(
        web_document_id(F.col("source_url"), F.col("content_hash")).alias("document_id"),
        title.alias("filename"), trim_controls(F.col("source")).alias("source"), "source_url", "source_type",
        "category", F.lit(1).alias("page"), time.alias("upload_time"), time.alias("crawl_time"),
        F.date_format("last_updated", "yyyy-MM-dd'T'HH:mm:ss").alias("last_updated"), "content_hash",
        split(enrich_text(title, trim_controls(F.col("source")), F.col("category"), F.lit(1), strip(F.col("content")))).alias("chunks"))
    return index_rows(number_single_pages(pages).drop("start"), embed)
