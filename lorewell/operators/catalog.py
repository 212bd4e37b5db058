"""Catalog maintenance keyed by source address.

The catalog holds one row per address, and a batch of new rows must too (``newest_per_url``).
Uploaded files have no address; they bypass the joins so that their nulls never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions import rulesets as R
from lorewell.functions.hashing import content_hash, iso_date_text, upload_document_id, web_document_id
from lorewell.functions.text import is_blank, trim_controls
from lorewell.scale import first_per_key

FIELDS = (
    "id", "title", "filename", "source", "type", "content", "status", "storage_path", "file_size", "content_type",
    "source_type", "source_url", "category", "crawl_time", "last_updated", "content_hash", "vector_document_id",
    "created_time",
)
BUSY = ("PROCESSING", "UPLOADING")


def newest_per_url(new: DataFrame, order: str = "crawl_time") -> DataFrame:
    return first_per_key(new, ["source_url"], [F.desc(order), F.desc_nulls_last("content_hash")])


def ingest_action(exists: Column, new_hash: Column, old_hash: Column, barred: Column, force: bool = False) -> Column:
    """What the catalog does with a crawled document."""
    return (
        F.when(barred, "EXCLUDED")
        .when(exists & (new_hash == old_hash) & F.lit(not force), "UNCHANGED")
        .when(~exists, "CREATED")
        .otherwise("REINDEXED" if force else "UPDATED"))


def ingest_actions(new: DataFrame, catalog: DataFrame, exclusions: DataFrame, force: bool = False) -> DataFrame:
    """Add ``action`` (and the matched ``catalog_id``) to crawled documents."""
    known = catalog.where(F.col("source_url").isNotNull()).select(
        "source_url", F.col("id").alias("catalog_id"), F.col("content_hash").alias("__hash"))
    barred = exclusions.select("source_url").distinct().withColumn("__barred", F.lit(True))
    action = ingest_action(F.col("catalog_id").isNotNull(), F.col("content_hash"), F.col("__hash"), F.col("__barred"), force)
    return (
        new.join(known, "source_url", "left").join(barred, "source_url", "left")
        .withColumn("action", action).drop("__hash", "__barred"))


def _upsert(catalog: DataFrame, changes: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Full outer merge of the catalog with ``changes`` on the address."""
    uploads = catalog.where(F.col("source_url").isNull()).select(*FIELDS)
    old = catalog.where(F.col("source_url").isNotNull()).select("source_url", F.struct(*FIELDS).alias("old"))
    merged = old.join(changes.select("source_url", F.struct(*changes.columns).alias("new")), "source_url", "full_outer")
    return merged.select(*[
        F.col("source_url") if f == "source_url" else fields.get(f, F.col("old")[f]).alias(f) for f in FIELDS
    ]).unionByName(uploads)


def apply_ingest(catalog: DataFrame, actions: DataFrame, now: Column) -> DataFrame:
    """Next catalog after the actions of ``ingest_actions``.

    Changed rows take the publication time as their update time; unchanged ones take the
    payload's own value. Excluded rows change nothing.
    """
    old, new = F.col("old"), F.col("new")
    changed = F.coalesce(new["action"].isin("CREATED", "UPDATED", "REINDEXED"), F.lit(False))
    seen = changed | F.coalesce(new["action"] == "UNCHANGED", F.lit(False))
    title = trim_controls(new["title"])

    def replaced(field: str, value: Column) -> Column:
        return F.when(changed, value).otherwise(old[field])

    fields = {
        "id": F.coalesce(old["id"], F.xxhash64("source_url")),
        "title": replaced("title", title), "filename": replaced("filename", title),
        "source": replaced("source", trim_controls(new["source"])), "type": replaced("type", F.lit("HTML")),
        "content": replaced("content", trim_controls(new["content"])),
        "status": replaced("status", F.lit("PROCESSING")),
        "storage_path": replaced("storage_path", F.lit(None).cast("string")),
        "file_size": replaced("file_size", F.octet_length(new["content"]).cast("long")),
        "content_type": replaced("content_type", F.lit("text/html;charset=UTF-8")),
        "source_type": replaced("source_type", F.lit("OFFICIAL_WEBSITE")),
        "category": replaced("category", new["category"]),
        "content_hash": replaced("content_hash", new["content_hash"]),
        "crawl_time": F.when(seen, new["crawl_time"]).otherwise(old["crawl_time"]),
        "last_updated": F.when(changed, F.coalesce(new["published_time"], new["last_updated"]))
        .when(seen, new["last_updated"]).otherwise(old["last_updated"]),
        "created_time": F.coalesce(old["created_time"], now),
    }
    return _upsert(catalog, actions.where(F.col("action") != "EXCLUDED"), fields)


def curated_hash(title: Column, content: Column, published: Column) -> Column:
    return content_hash(title, content, iso_date_text(published, seconds=False))


def curated_upsert(rows: DataFrame, catalog: DataFrame, exclusions: DataFrame,
                   now: Column) -> tuple[DataFrame, DataFrame]:
    """(next catalog, next exclusions) after adding reviewed rows.

    ``rows``: source_url, title, content, source, category, published_time, verified_time. A row
    lifts the exclusion of its address. A completed curated row with the same hash only gets
    new times; everything else is reset for indexing.
    """
    staged = rows.withColumns({
        "title": trim_controls(F.col("title")), "content": trim_controls(F.col("content")), "source": trim_controls(F.col("source")),
    }).withColumn("content_hash", curated_hash(F.col("title"), F.col("content"), F.col("published_time")))
    old, new = F.col("old"), F.col("new")
    given = new.isNotNull()
    same = (
        (old["source_type"] == "CURATED_OFFICIAL") & (old["content_hash"] == new["content_hash"])
        & (old["status"] == "COMPLETED"))
    changed = given & ~F.coalesce(same, F.lit(False))

    def replaced(field: str, value: Column) -> Column:
        return F.when(changed, value).otherwise(old[field])

    fields = {
        "id": F.coalesce(old["id"], F.xxhash64("source_url")),
        "title": replaced("title", new["title"]), "filename": replaced("filename", new["title"]),
        "source": replaced("source", new["source"]), "type": replaced("type", F.lit("TEXT")),
        "content": replaced("content", new["content"]), "status": replaced("status", F.lit("PROCESSING")),
        "storage_path": replaced("storage_path", F.lit(None).cast("string")),
        "file_size": replaced("file_size", F.octet_length(new["content"]).cast("long")),
        "content_type": replaced("content_type", F.lit("text/plain;charset=UTF-8")),
        "source_type": replaced("source_type", F.lit("CURATED_OFFICIAL")),
        "category": replaced("category", new["category"]),
        "content_hash": replaced("content_hash", new["content_hash"]),
        "vector_document_id": replaced("vector_document_id", F.lit(None).cast("string")),
        "crawl_time": F.when(given, new["verified_time"]).otherwise(old["crawl_time"]),
        "last_updated": F.when(given, F.coalesce(new["published_time"], new["verified_time"]))
        .otherwise(old["last_updated"]),
        "created_time": F.coalesce(old["created_time"], now),
    }
    lifted = exclusions.join(staged.select("source_url"), "source_url", "left_anti")
    return _upsert(catalog, staged, fields), lifted


def delete_documents(catalog: DataFrame, index: DataFrame, exclusions: DataFrame, ids: DataFrame,
                     suppress: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(catalog, index, exclusions, refused) after deleting the rows named in ``ids`` (id).

    Rows still being processed are refused. ``catalog`` carries ``vector_document_id`` already
    resolved. With ``suppress`` the address is barred from coming back.
    """
    wanted = ids.select("id").distinct()
    named = catalog.join(wanted, "id", "left_semi")
    refused = named.where(F.col("status").isin(*BUSY))
    doomed = named.where(~F.col("status").isin(*BUSY))
    remaining = catalog.join(doomed.select("id"), "id", "left_anti")
    gone = doomed.where(F.col("vector_document_id").isNotNull()).select(F.col("vector_document_id").alias("document_id"))
    remaining_index = index.join(gone.distinct(), "document_id", "left_anti")
    if suppress:
        fresh = doomed.where(~is_blank(F.col("source_url"))).select(
            "source_url", F.concat(F.lit("管理员删除："), F.col("title")).alias("reason"))
        fresh = fresh.join(exclusions.select("source_url"), "source_url", "left_anti")
        exclusions = exclusions.select("source_url", "reason").unionByName(fresh)
    return remaining, remaining_index, exclusions, refused


def select_reindex(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """Uploaded documents with ``decision`` SCHEDULED or SKIPPED; ``files`` lists existing paths."""
    present = files.select(F.col("path").alias("storage_path")).distinct().withColumn("__present", F.lit(True))
    uploads = catalog.where(F.col("source_type") == "UPLOADED_FILE")
    # Rows without a path get a key of their own, so nulls do not pile up in the join.
    keyed = uploads.withColumn("__path", F.coalesce("storage_path", F.concat(F.lit("\u0000"), F.col("id").cast("string"))))
    joined = keyed.join(present.withColumnRenamed("storage_path", "__path"), "__path", "left")
    ready = (F.col("status") == "COMPLETED") & ~is_blank(F.col("storage_path")) & F.col("__present")
    return joined.withColumn("decision", F.when(ready, "SCHEDULED").otherwise("SKIPPED")).drop("__path", "__present")


def reindex_counts(decisions: DataFrame) -> DataFrame:
    return decisions.agg(
        F.count_if(F.col("decision") == "SCHEDULED").alias("scheduled_count"),
        F.count_if(F.col("decision") == "SKIPPED").alias("skipped_count"))


def resolve_vector_id(stored: Column, status: Column, source_type: Column, source_url: Column, digest: Column,
                      file_bytes: Column, filename: Column, source: Column) -> Column:
    """Index id of a catalog row: the stored one, or the one its content implies when completed."""
    from_web = F.when(~is_blank(source_url) & ~is_blank(digest), web_document_id(source_url, digest))
    from_file = F.when(file_bytes.isNotNull(), upload_document_id(file_bytes, filename, source))
    implied = F.when(source_type == "UPLOADED_FILE", from_file).otherwise(from_web)
    return F.when(~is_blank(stored), stored).when(status == "COMPLETED", implied)


def apply_index_results(catalog: DataFrame, results: DataFrame) -> DataFrame:
    """Write indexing results (id, document_id, category, error) back to the catalog.

    A blank category clears the stored one, an unknown one keeps it. Errors and legacy DOC
    files end as FAILED. Web rows keep their category.
    """
    marks = results.select("id", F.col("document_id").alias("__doc"), F.col("category").alias("__category"),
                           F.col("error").alias("__error"), F.lit(True).alias("__seen"))
    seen = F.col("__seen").isNotNull()
    upload = F.col("source_type") == "UPLOADED_FILE"
    failed = F.col("__error").isNotNull() | (upload & (F.upper("type") == "DOC"))
    done = seen & ~failed
    category = (
        F.when(done & upload & is_blank(F.col("__category")), F.lit(None).cast("string"))
        .when(done & upload & trim_controls(F.col("__category")).isin(*R.CATEGORIES), trim_controls(F.col("__category")))
        .otherwise(F.col("category")))
    return (
        catalog.join(marks, "id", "left")
        .withColumn("category", category)
        .withColumn("vector_document_id", F.when(done, F.col("__doc")).otherwise(F.col("vector_document_id")))
        .withColumn("status", F.when(done, "COMPLETED").when(seen, "FAILED").otherwise(F.col("status")))
        .drop("__doc", "__category", "__error", "__seen"))
