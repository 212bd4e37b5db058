"""Searches of many questions: the index travels, a question leaves k rows whatever the number of tasks."""

import io
from contextlib import redirect_stdout

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorewell.operators import lsh
from lorewell.operators import retrieve as R


@pytest.fixture(scope="module")
def vectors(spark):
    """600 rows with text ids, many of them with equal vectors, in five categories, some in none."""
    rng = np.random.default_rng(8)
    held = rng.integers(-2, 3, (200, 6)).astype(float)
    rows = [(f"{i * 7919 % 600:064d}", [float(x) for x in held[i % 200]], None if i % 11 == 0 else str(i % 5)) for i in range(600)]
    return spark.createDataFrame(rows, "chunk_key string, vector array<double>, category string").repartition(6).cache()


def asked_of(vectors):
    return vectors.select(F.col("chunk_key").alias("query_id"), F.col("vector").alias("query_vector"), "category")


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("index_bytes", [R.INDEX_BYTES, 48 * 150])
def test_both_ways_find_the_same(spark, vectors, monkeypatch, index_bytes):
    sent = R.vector_candidates(asked_of(vectors), vectors, 7, (False, True))
    monkeypatch.setattr(R, "INDEX_BYTES", index_bytes)
    met = R.vector_candidates(asked_of(vectors), vectors, 7, (False, True), max_query_bytes=48 * 20)
    assert sorted(map(tuple, sent.collect())) == sorted(map(tuple, met.collect()))


def test_many_questions_merge_nothing(spark, vectors):
    found = R.vector_candidates(asked_of(vectors), vectors, 7, (False,), max_query_bytes=48 * 20)
    assert "Window" not in plan_of(found) and "Union" not in plan_of(found)  # one reading, no candidates of many tasks to merge


def test_merged_candidates_read_the_index_once(spark, vectors, monkeypatch):
    from lorewell.registry.core import QUERIES
    from lorewell.registry.index_and_search import merge_candidates

    asked, read, real = asked_of(vectors), [], R.vector_candidates
    apart = R.merge_candidates(R.vector_topk_filtered(asked, vectors, 7), R.vector_topk(asked, vectors, 7), identity="chunk_key")
    at_once = R.merged_candidates(asked, vectors, 7, max_query_bytes=48 * 20)
    assert sorted(map(tuple, at_once.select(apart.columns).collect())) == sorted(map(tuple, apart.collect()))
    monkeypatch.setattr(R, "vector_candidates", lambda queries, index, k, modes, *rest, **more: read.append(modes) or real(
        queries, index, k, modes, *rest, **more))
    assert "merge_candidates" in QUERIES and merge_candidates(spark, "/root/testdata/sf0.001").columns == ["query_id", "chunk_key", "distance", "preferred"]
    assert read == [(False, True)]


def test_both_modes_are_merged_where_they_are_found(spark, vectors, monkeypatch):
    asked = asked_of(vectors)
    want = R.merged_candidates(asked, vectors, 7)  # a few questions: merged behind the search
    got = R.merged_candidates(asked, vectors, 7, max_query_bytes=48 * 20)
    assert "Aggregate" in plan_of(want) and "Aggregate" not in plan_of(got)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    twice = vectors.union(vectors.limit(5))  # an id that stands twice is still one row of a question
    rows = [(r.query_id, r.chunk_key) for r in R.merged_candidates(asked, twice, 7, max_query_bytes=48 * 20).collect()]
    assert len(rows) == len(set(rows))
    # Rows are ordered alike with and without packed numbers.
    rng = np.random.default_rng(3)
    held, groups, places = rng.integers(-2, 3, (900, 5)).astype(float), rng.integers(0, 4, 900), np.arange(900)
    ids, found = pa.array(places), []
    for bits in (0, 63):
        monkeypatch.setattr(R, "KEY_BITS", bits)
        block = R.Block(held[:50], groups[:50], 9, (False, True))
        block.read(R.Rows(held, groups, places))
        found.append([b.to_pylist() for b in block.emit(ids, ids, ["q", "i", "d", "g"])])
    assert found[0] == found[1]


def test_rows_without_a_direction_hide_no_others():
    held = np.random.default_rng(4).standard_normal((500, 4))
    held[20:480, 0] = np.inf
    block = R.Block(held[:5], None, 50, (False,))
    block.read(R.Rows(held, None, np.arange(500)))
    ids = pa.array(np.arange(500))
    rows = [r for b in block.emit(ids, ids, ["q", "i", "d", "g"]) for r in b.to_pylist()]
    assert len(rows) == 5 * 40 and {r["i"] for r in rows} <= {*range(20), *range(480, 500)}


def test_nearest_of_a_block_leave_in_small_batches():
    vectors = np.random.default_rng(2).standard_normal((1500, 4))
    ids, places = R.by_id(pa.array([f"{i:064d}" for i in range(1500)]))
    block = R.Block(vectors, None, 100, (False,))
    block.read(R.Rows(vectors, None, places))
    sizes = [b.num_rows for b in block.emit(ids, ids, ["q", "i", "d", "g"])]
    assert sum(sizes) == 150_000 and max(sizes) <= R.ROWS_OUT


def test_buckets_are_visited_without_copies_of_the_questions(spark, vectors, monkeypatch):
    stored, asked = lsh.with_bucket(vectors, 3), asked_of(vectors)
    want = lsh.vector_topk_lsh(asked, stored, 5, 3, 4)
    monkeypatch.setattr(lsh, "VISIT_BYTES", 0)
    got = lsh.vector_topk_lsh(asked, stored, 5, 3, 4)
    assert "CoGroup" not in plan_of(got)
    rows = lambda df: sorted((r.query_id, r.chunk_key, r.distance, r["rank"]) for r in df.collect())
    assert rows(got) == rows(want)


@pytest.mark.parametrize("twice", [False, True])
def test_a_large_index_is_read_where_it_is_stored(spark, vectors, monkeypatch, twice):
    """No block of it passes the driver and no candidates of several blocks are merged, whatever its size."""
    asked, index = asked_of(vectors), vectors.union(vectors.limit(5)) if twice else vectors
    want = R.merged_candidates(asked, index, 7, max_query_bytes=48 * 20)
    monkeypatch.setattr(R, "INDEX_BYTES", 48 * 150)
    monkeypatch.setattr(R, "PACKED_ROWS", 20)
    monkeypatch.setattr(R, "_scan_queries", lambda *_: pytest.fail("the index was sent as one block"))
    noted = index.withColumn("note", F.concat(F.lit("n"), F.col("chunk_key")))
    got = R.merged_candidates(asked, noted, 7, max_query_bytes=48 * 20, along=["note"])
    assert ("note" in got.columns) == (not twice) and "Window" not in plan_of(got)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    if not twice:
        assert got.where("note = concat('n', chunk_key)").count() == want.count()


def test_a_large_index_has_vectors_of_one_length(spark, monkeypatch):
    monkeypatch.setattr(R, "INDEX_BYTES", 8)
    rows = spark.createDataFrame([(i, [1.0] * (2 + i % 2), "a") for i in range(40)], "chunk_key long, vector array<float>, category string")
    with pytest.raises(Exception, match="vectors of different lengths"):
        R.vector_topk(asked_of(rows), rows, 3, max_query_bytes=1).collect()
