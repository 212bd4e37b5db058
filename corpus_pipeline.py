"""Documents to packed training sequences, stage by stage."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import langid
from lorewell.llm.decontaminate import contamination
from lorewell.llm.linededup import dedup_lines
from lorewell.llm.neardup import near_duplicates
from lorewell.llm.packing import pack
from lorewell.llm.queries import tokenizer_file
from lorewell.scale import first_per_key


def aside(docs: DataFrame, *used: str) -> DataFrame:
    """The rows with all columns but the used ones under names of their own, so that no stage overwrites them."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in used else f"__{n}") for n, c in enumerate(docs.columns)])


def back(rows: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of ``docs`` again, and no others, after ``aside``."""
    return rows.select(*[F.col(c if c in used else f"__{n}").alias(c) for n, c in enumerate(docs.columns)])


def in_a_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without any letter and unclear ones go.

    Where no document names its language there is none to recognise, and only documents without a letter go. Repeated
    rows are judged alike, an empty table stays empty, and columns of any name pass through as they are.
    """
    model = langid.train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = langid.identify(aside(docs, "text"), model).where(langid.accepted())
    return back(judged, docs, "text")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that repeat over documents; n_chars follows the text.

    Null texts become empty, an empty table stays empty, and columns of any other name pass through as they are.
    """
    kept = back(dedup_lines(aside(docs, "doc_id", "text")), docs, "doc_id", "text")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest id, and every row without an id.

    Rows are judged by their own text, whatever other rows have their id: each different (id, text) stands for itself under
    a 64-bit number. Numbers are given anew until no two rows that differ in a 128-bit digest share one. Of
    rows that repeat id and text one stays. Null and blank texts are unlike all others; an empty table stays empty.
    """
    plain = aside(docs, "doc_id", "text")
    known = F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce(F.concat(F.lit("t"), "text"), F.lit("")))
                   .cast("binary"), 256)
    seed = 0
    while True:
        named = plain.where(F.col("doc_id").isNotNull()).withColumn("__row", F.xxhash64(F.lit(seed), "doc_id", "text"))
        shared = named.groupBy("__row").agg(F.min(F.substring(known, 1, 32)).alias("one"), F.max(F.substring(known, 1, 32)).alias("two"))
        if shared.where("one <> two").isEmpty():
            break
        seed += 1
    judged = near_duplicates(named.select("__row", "doc_id", "text"), "__row", keep=["doc_id"])
    kept = judged.groupBy("component_id").agg(F.min(F.struct("doc_id", "__row")).alias("first")).select("first.*")
    others = [c for c in plain.columns if c not in ("doc_id", "text")]
    single = first_per_key(named, ["doc_id", "__row"], [F.xxhash64(*others) if others else F.lit(0)])
    single = single.join(kept, ["doc_id", "__row"], "left_semi").drop("__row")
    return back(single.unionByName(plain.where(F.col("doc_id").isNull())), docs, "doc_id", "text")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage worth mentioning.

    Null and empty texts hold none. Repeated rows are judged alike, an empty table stays empty, and columns of any name
    pass through as they are.
    """
    benchmark = spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet"))
    clean = contamination(aside(docs, "text"), benchmark).where("not contaminated")
    return back(clean, docs, "text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of equal capacity."""
    return pack(docs, tokenizer_file())


STAGES = [("language id", in_a_known_language), ("line dedup", without_repeated_lines), ("near dedup", one_of_each_group),
          ("decontamination", without_benchmark), ("packing", packed)]
#: A trained model and a token vocabulary cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
