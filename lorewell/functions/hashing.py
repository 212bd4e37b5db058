"""Content identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorewell.functions.text import strip


def join_bytes(*parts: Column) -> Column:
    """Byte parts with one zero byte between them."""
    joined = parts[0].cast("binary")
    for part in parts[1:]:
        joined = F.concat(joined, F.expr("X'00'"), part.cast("binary"))
    return joined


def content_hash(title: Column, content: Column, published: Column) -> Column:
    """``published`` is the date already written as text, empty when unknown."""
    return F.sha2(F.concat_ws("\n", strip(title), strip(content), F.coalesce(published, F.lit(""))), 256)


def iso_date_text(published: Column, seconds: bool = True) -> Column:
    """Date text inside the hash; crawled pages write seconds, curated rows leave ``:00`` out."""
    return F.date_format(published, "yyyy-MM-dd'T'HH:mm:ss" if seconds else "yyyy-MM-dd'T'HH:mm")


def upload_document_id(content: Column, filename: Column, source: Column) -> Column:
    return F.sha2(join_bytes(content, filename, source), 256)


def web_document_id(source_url: Column, digest: Column) -> Column:
    return F.sha2(join_bytes(source_url, digest), 256)


def chunk_id(document_id: Column, chunk_index: Column, content: Column, metadata: list[str],
             version: str = "2") -> Column:
    """Digest over every field of a chunk; any change yields a new id."""
    fields = [F.lit(version).alias("schema_version"), document_id.alias("document_id"),
              chunk_index.alias("index"), content.alias("page_content"),
              F.struct(*sorted(metadata)).alias("metadata")]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
