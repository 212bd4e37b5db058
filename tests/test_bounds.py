"""What Python stages hold, how many batches a replay makes, how often an intent is looked for."""

import io
from contextlib import redirect_stdout

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorewell.operators import chunks, classify, embed
from lorewell.operators import html as H
from lorewell.operators import question as Q
from lorewell.scale import PIECE_ROWS, PIECE_WEIGHT, in_pieces
from lorewell.streaming import replay


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("extended")
    return out.getvalue()


def test_pieces_hold_all_values_and_end_early():
    values = ["x" * 10] * 3000 + [None, "", "y" * (2 * PIECE_WEIGHT), "z"]
    parts = list(in_pieces(iter([pd.Series(values), pd.Series([], dtype=object)])))
    assert [v for p in parts for v in p] == values
    assert max(map(len, parts)) <= PIECE_ROWS
    assert max(sum(len(v or "") for v in p[:-1]) for p in parts if len(p)) < PIECE_WEIGHT


@pytest.mark.parametrize("udf", [
    chunks.chunk_text(500, 50), embed.external_embedding(lambda texts: [[float(len(t))] for t in texts]), H.read_markup])
def test_results_of_a_large_batch_leave_in_pieces(udf):
    sizes = [len(out) for out in udf.func(iter([pd.Series(["some text "] * 5000)]))]
    assert sum(sizes) == 5000 and max(sizes) <= PIECE_ROWS


def test_all_shards_of_keywords_are_one_python_stage(spark):
    words = spark.createDataFrame([("ab", 1), ("bc", 2), ("cd", 3), ("ab", 4)], "keyword string, n int")
    texts = spark.createDataFrame([(1, "abc"), (2, None), (3, "xcdx")], "id int, text string")
    found = classify.keyword_matches(texts, "text", words, "hits", shard=1)
    assert plan_of(found).split("== Physical Plan ==")[1].count("ArrowEvalPython") == 1
    got = {r.id: sorted((h.keyword, h.n) for h in r.hits) for r in found.collect()}
    assert got == {1: [("ab", 1), ("ab", 4), ("bc", 2)], 2: [], 3: [("cd", 3)]}


def test_arrivals_of_few_rows_are_few_files(spark, tmp_path):
    rows = spark.range(200).repartition(16).select("id", F.timestamp_seconds("id").cast("timestamp_ntz").alias("at"))
    replay.arrive(rows, "at", str(tmp_path / "in"), 2)
    assert len(list((tmp_path / "in").rglob("*.parquet"))) == 2
    assert spark.read.parquet(str(tmp_path / "in")).select("id").distinct().count() == 200


def test_an_intent_is_looked_for_once(spark):
    asked = spark.createDataFrame([("请问从甲专业转到乙学院有什么条件？",)], "q string")
    once, planned = (plan_of(asked.select(c)).split("== Analyzed")[0].count("regexp_extract") for c in (
        Q.transfer_intent(F.col("q")), Q.planned_question(F.col("q"), Q.transfer_intent(F.col("q")))))
    assert 0 < planned == once
