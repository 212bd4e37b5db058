"""From uploaded files to index rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions.hashing import upload_document_id
from lorewell.functions.text import source_or_default
from lorewell.operators.chunks import chunk_text, enrich_text, number_chunks
from lorewell.operators.classify import classify_upload
from lorewell.plans.web_index import index_rows
from lorewell.scale import first_per_key
from lorewell.sources.documents import Extractor, read_documents, unfold_pages, unreadable


def upload_index_job(files: DataFrame, extractors: dict[str, Extractor] | None = None, name: str | None = None,
                     embed: Callable[[Column], Column] | None = None, split: Callable[[Column], Column] | None = None,
                     page_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(index rows, rejected rows with ``error``) of checked uploads.

    ``files``: path, filename, extension, content, rejected, source, upload_time. The same file under several paths is
    indexed once. ``page_chars`` may limit what of the first page is read for its class.
    """
    split = split or chunk_text()
    usable = files.where(F.col("rejected").isNull()).withColumn("source", source_or_default(F.col("source"))).withColumn(
        "document_id", upload_document_id(F.col("content"), F.col("filename"), F.col("source")))
    read = read_documents(usable.drop("rejected"), extractors)
    # One file of each document, judged by its first page before the pages go their own ways.
    single = first_per_key(read.where(F.size("pages") > 0), ["document_id"], [F.col("path")])
    judged = classify_upload(single.withColumn("first_page", F.col("pages")[0]["text"]), "filename", "first_page", name, page_chars)
    pages = unfold_pages(judged.withColumn("category", F.col("verdict.category")).drop("verdict", "first_page"))
    empty = F.lit(None).cast("string")
    chunked = pages.select(
        "document_id", "filename", "source", empty.alias("source_url"), F.lit("UPLOADED_FILE").alias("source_type"), "category", "page",
        "upload_time", empty.alias("crawl_time"), empty.alias("last_updated"), empty.alias("content_hash"),
        split(enrich_text(F.col("filename"), F.col("source"), F.col("category"), F.col("page"), F.col("text"))).alias("chunks"))
    rejected = files.where(F.col("rejected").isNotNull()).select("path", F.col("rejected").alias("error"))
    return index_rows(number_chunks(chunked).drop("start"), embed), rejected.unionByName(unreadable(read))
