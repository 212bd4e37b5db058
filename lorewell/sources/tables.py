"""Reading stored tables, page snapshots, uploads, question sets and alias dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell import schemas as S

MAX_UPLOAD_BYTES = 50 * 1024 * 1024
# Leading bytes of the accepted upload formats.
PDF_MAGIC, ZIP_MAGIC = "25504446", "504B0304"


def catalog_scan(catalog: DataFrame) -> DataFrame:
    """All documents without their text, newest first."""
    return catalog.drop("content").orderBy(F.desc("created_time"), "id")


def catalog_detail(catalog: DataFrame, document_id: int) -> DataFrame:
    return catalog.where(F.col("id") == document_id)


def read_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).parquet(path)


def page_snapshot(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return route_pages(spark.read.format(fmt).schema(S.PAGE_DDL).load(path))


def route_pages(pages: DataFrame) -> DataFrame:
    """Add ``route``: PARSE, UNCHANGED (304) or FAILED (an error, or not a web page)."""
    status = F.col("http_status")
    is_html = F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("html"))
    return pages.withColumn("route", F.when(status == 304, "UNCHANGED").when(
        status.isNull() | (status >= 400) | ~is_html, "FAILED").otherwise("PARSE"))


def read_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Checked files of a folder tree; the reader itself already leaves out empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return check_uploads(files)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of existing files, without reading them; local paths lose their scheme."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_replace("path", r"^file:(?://)?", "").alias("path"))


def check_uploads(files: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Add filename, extension and ``rejected`` (null for usable files) to (path, length, content)."""
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    name = F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)
    extension = F.lower(F.regexp_extract(F.col("filename"), r"\.([^.]*)\z", 1))
    return files.withColumn("filename", name).withColumn("extension", extension).withColumn(
        "rejected", upload_problem(F.col("extension"), F.col("length"), F.col("content"), max_bytes))


def upload_problem(extension: Column, length: Column, content: Column, max_bytes: int = MAX_UPLOAD_BYTES) -> Column:
    head = F.hex(F.substring(content, 1, 4))
    return (
        F.when(~extension.isin("pdf", "docx"), "unsupported_type")
        .when(length == 0, "empty")
        .when(length > max_bytes, "too_large")
        .when((extension == "pdf") & (head != PDF_MAGIC), "content_mismatch")
        .when((extension == "docx") & (head != ZIP_MAGIC), "content_mismatch"))


def question_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.QUESTION_DDL).option("multiLine", True).json(path)


def alias_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(canonical, alias, category, seq); a canonical term is an alias of itself.

    ``seq`` is (file, term, alias) in file order, so it stays unique and ordered over any number of files and aliases.
    """
    return explode_aliases(spark.read.schema(S.ALIAS_FILE_DDL).option("multiLine", True).json(path))


def explode_aliases(files: DataFrame) -> DataFrame:
    terms = files.select(F.input_file_name().alias("file"), F.posexplode("terms").alias("term_no", "term"))
    every = F.concat(F.array("term.canonical"), F.coalesce("term.aliases", F.array().cast("array<string>")))
    return (
        terms.select("file", "term_no", "term", F.posexplode(every).alias("alias_no", "alias"))
        .select(F.col("term.canonical").alias("canonical"), "alias", F.col("term.category").alias("category"),
                F.struct("file", "term_no", "alias_no").alias("seq")))


def dry_run(changed: DataFrame, execute: bool = True) -> DataFrame:
    """Run a plan without writing: rows get the action DRY_RUN and go to the no-op sink."""
    planned = changed.withColumn("action", F.lit("DRY_RUN"))
    if execute:
        planned.write.format("noop").mode("overwrite").save()
    return planned
