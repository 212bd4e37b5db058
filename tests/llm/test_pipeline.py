"""The corpus pipeline stage by stage."""

import os

import pytest

import corpus_pipeline
from lorewell.llm import batches

SF = os.environ.get("LOREWELL_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_stages_over_files(spark, tmp_path):
    docs = spark.read.parquet(os.path.join(SF, "documents.parquet"))
    columns, total = docs.columns, docs.count()
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
            counts.append(docs.count())
    assert total >= counts[0] == counts[1] > counts[2] >= counts[3] > 0
    kept = spark.read.parquet(str(tmp_path / "3"))
    assert docs.select("doc_id").distinct().count() == kept.count()
    assert kept.where("n_chars <> length(text)").count() == 0


def test_hard_rows_pass_through(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "12 34"), (4, "some words in here"), (5, "some words in here")])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert {r.doc_id for r in docs.collect()} == {4}


def test_one_row_of_each_group(spark):
    long = " ".join(f"word{k}" for k in range(40))
    rows = [
        (None, long), (None, long), (None, "nobody knows the id of this one"),  # null ids all stay
        (2, long), (2, long), (3, long), (3, long + " tail"),  # repeated rows and copies: one row
        (5, long), (5, "a text that stands nowhere else at all"),  # one text of the id is a copy, the other is not
        (7, "the very same id has"), (7, "two quite unrelated texts here"), (8, None), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.one_of_each_group(spark, docs, SF)
    assert out.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    expected = [rows[k] for k in (0, 1, 2, 3, 8, 9, 10, 11, 13)]
    assert found == sorted(expected, key=repr)


def test_no_known_language(spark):
    rows = [(1, "some words in here", None), (2, "12 34 !", None), (3, "слова", None), (4, None, None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = corpus_pipeline.in_a_known_language(spark, docs, SF)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {1, 3}


def test_sample_of_every_language(spark):
    rows = spark.range(1200).selectExpr("id", "concat('language', id) lang").union(spark.sql("select -1L, cast(null as string)"))
    assert batches.hash_sample(rows, ["id"], 3, "lang").count() == 1200


def test_columns_of_any_name_pass_through(spark):
    text = "these are some words of a plain sentence that says little number "
    rows = [(i, text + str(i), "en", i / 7, f"lang{i}", f"lines{i}", f"items {i}", i, True, f"n{i}") for i in range(40)]
    rows += [(50, None, "en", 0.5, "x", "y", "z", 1, False, None), (51, "", None, 0.5, "x", "y", "z", 1, False, None)]
    names = "doc_id long, text string, lang string, score double, lang_pred string, n_lines string, items string, __row int, contaminated boolean, kept string"
    docs = spark.createDataFrame(rows, names)
    want = {r[0]: r for r in rows}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.dtypes == spark.createDataFrame([], names).dtypes, name
        for r in docs.collect():
            assert (r[0], *r[2:]) == (want[r.doc_id][0], *want[r.doc_id][2:]), name
    assert spark.createDataFrame([], names).count() == 0


def test_empty_table_passes_every_stage(spark, make_docs):
    docs = make_docs([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
