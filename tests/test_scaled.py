"""Indexes searched in part, plans that must not move texts, sketches, runs over many hosts, rules from a folder."""

import io
import json
from contextlib import redirect_stdout
from datetime import datetime

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lorewell.functions import rulesets
from lorewell.operators import classify, frontier, index, lsh, sketches
from lorewell.operators import retrieve as R
from lorewell.operators.embed import native_hash_embedding
from lorewell.scale import rows_of_keys


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def vectors(spark):
    """3,000 vectors in 60 groups."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 16))
    rows = [(i, [float(x) for x in centres[i % 60] + 0.3 * rng.standard_normal(16)], str(i % 6)) for i in range(3000)]
    return spark.createDataFrame(rows, "chunk_key long, vector array<double>, category string").repartition(8).cache()


def questions_of(vectors, step):
    return vectors.where(F.col("chunk_key") % step == 0).select(
        F.col("chunk_key").alias("query_id"), F.col("vector").alias("query_vector"), "category")


def test_probes_come_nearest_first():
    rng = np.random.default_rng(1)
    unit = R.unit(rng.standard_normal((50, 16)))
    order = lsh.probe_order(unit, 5, 32)
    own, away = lsh._sides(unit, 5)
    assert (order[:, 0] == own).all() and all(sorted(o) == list(range(32)) for o in order.tolist())
    cost = [[sum(away[q, b] ** 2 for b in range(5) if (p ^ own[q]) >> b & 1) for p in order[q]] for q in range(50)]
    assert all(c == sorted(c) for c in cost)


def test_lsh_finds_most_with_few_buckets(spark, vectors, tmp_path):
    k, bits = 20, 7
    probes = lsh.lsh_probes(vectors, k, bits, 0.95, queries=200)
    assert probes < 64  # of 128 buckets
    lsh.store_lsh_index(vectors, str(tmp_path / "lsh"), bits)
    stored = spark.read.schema(lsh.bucketed_schema(vectors.schema)).parquet(str(tmp_path / "lsh"))
    asked = questions_of(vectors, 20)
    found = {(r.query_id, r.chunk_key): r.distance for r in lsh.vector_topk_lsh(asked, stored, k, bits, probes, slice_rows=50, block_queries=10).collect()}
    true = {(r.query_id, r.chunk_key): r.distance for r in R.vector_topk(asked, vectors, k).collect()}
    hits = found.keys() & true.keys()
    assert len(hits) >= 0.9 * len(true)
    assert all(found[h] == pytest.approx(true[h], abs=2e-6) for h in hits)


def test_lsh_with_all_buckets_is_exact(spark, vectors):
    asked, few = questions_of(vectors, 300), vectors.where("chunk_key < 500")
    got = lsh.vector_topk_lsh(asked, lsh.with_bucket(few, 3), 7, 3, 8)
    want = R.vector_topk(asked, few, 7)
    assert {(r.query_id, r.chunk_key) for r in got.collect()} == {(r.query_id, r.chunk_key) for r in want.collect()}


def test_lsh_odd_rows(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, None, "a"), (3, [], "a"), (4, [0.0, 0.0], "a"), (5, [1.0, 0.0], "a")]
    stored = spark.createDataFrame(rows, "chunk_key long, vector array<double>, category string")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, query_vector array<double>")
    got = lsh.vector_topk_lsh(asked, lsh.with_bucket(stored, 2), 2, 2, 4)
    assert sorted((r.query_id, r.chunk_key, r.distance) for r in got.collect()) == [(1, 1, 0.0), (1, 5, 0.0)]
    assert lsh.lsh_probes(stored.limit(0), 5, 2) == 1


def test_a_task_reads_a_part(spark, vectors):
    """The largest group of rows and questions that meets in a task stays within a slice and a block."""
    bucketed = lsh.with_bucket(vectors, 2)
    sizes = bucketed.groupBy("bucket").count().collect()
    assert max(r["count"] for r in sizes) > 200
    got = lsh.vector_topk_lsh(questions_of(vectors, 20), bucketed, 3, 2, 4, slice_rows=100)
    plan = plan_of(got)
    assert "FlatMapCoGroupsInArrow" in plan and "hashpartitioning(bucket" in plan and "CartesianProduct" not in plan


def test_only_folders_of_asked_categories_are_read(spark, vectors, tmp_path):
    folder = str(tmp_path / "by-category")
    vectors.write.partitionBy("category").parquet(folder)
    stored = spark.read.schema(vectors.schema).parquet(folder)
    asked = questions_of(vectors, 20).where("category in ('1', '4')")
    found = R.vector_topk_filtered(asked, stored, 5)
    assert "dynamicpruning" in plan_of(found)
    want = R.vector_topk_filtered(asked, vectors, 5)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_candidates_do_not_grow_with_files(spark, vectors):
    many, asked = vectors.repartition(64), questions_of(vectors, 100)
    rows = R.vector_candidates(asked, many, 5, (False,), merge_groups=3)
    assert "Coalesce" in plan_of(rows)
    local, shipped = R._scan(asked.select("query_id", "query_vector"), many.select("chunk_key", "vector").coalesce(3), 5, (False,),
                             "query_id", "query_vector", "chunk_key", "vector", None)
    assert local.count() <= 3 * 5 * asked.count()
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, R.vector_candidates(asked, vectors, 5, (False,)).collect()))


def test_look_ups_leave_the_stored_index_where_it_is(spark, tmp_path):
    old = spark.range(400).selectExpr("cast(id as string) document_id", "0 chunk_index", "concat('u', id) source_url", "repeat('x', 50) content")
    stored = index.store_bucketed(old, "stored_index_test", str(tmp_path / "t"), buckets=8)
    try:
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        keys = spark.range(0, 400, 7).selectExpr("cast(id as string) document_id")
        for df, rows in ((rows_of_keys(stored, keys, "document_id", limit=0), 58),
                         (index.replace_index(stored, keys.selectExpr("document_id", "0 chunk_index", "' ' source_url", "'new' content")), 400)):
            plan = plan_of(df)
            moved = [line for line in plan.split("\n") if line.startswith("Input") and "content" in line]
            exchanges = plan.split("Exchange\nInput")[1:]
            assert moved and not any("content" in e.split("\n")[0] for e in exchanges)
            assert df.count() == rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.sql("drop table stored_index_test")


def test_replace_index_of_rows_without_document(spark):
    ddl = "document_id string, chunk_index int, source_url string, content string"
    old = spark.createDataFrame([(None, 0, "u1", "a"), (None, 0, None, "b"), ("d", 0, "u1", "c"), ("d", 1, "u2", "e")], ddl)
    new = spark.createDataFrame([("n", 0, "u1", "new")], ddl)
    assert sorted(r.content for r in index.replace_index(old, new).collect()) == ["b", "e", "new"]


def test_sketches_combine_over_days(spark):
    rows = [(f"q{i % 7}" if i % 3 else " often ", f"s{i % 200}", datetime(2024, 1, 1 + i % 5)) for i in range(3000)]
    answers = spark.createDataFrame([*rows, (None, None, datetime(2024, 1, 9))], "question string, session string, created_time timestamp_ntz")
    daily = sketches.daily_sketches(answers, 100)
    assert daily.count() == 6
    some = sketches.between(daily, F.lit("2024-01-02").cast("date"), F.lit("2024-01-04").cast("date"))
    inside = [r for r in rows if 2 <= r[2].day <= 4]
    top = sketches.frequent_questions_sketched(some, 3, 100).collect()
    assert (top[0].question, top[0].occurrences) == ("often", sum(r[0] == " often " for r in inside))
    assert abs(sketches.sessions_sketched(some).first().sessions - len({r[1] for r in inside})) <= 5


def test_native_embedding_equals_its_definition(spark):
    texts = ["Hello 世界, hello again", "选 课 a1 通知", "", "!!!", None, "a b c " * 300]
    from lorewell.functions.tokens import hash_tokens

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        hash_tokens(F.col("t")).alias("tokens"), native_hash_embedding(64)(F.col("t")).alias("v")).collect()
    for row in rows:
        want = np.zeros(64)
        for token in row.tokens or []:
            number = xxhash.xxh64_intdigest(token.encode(), 42)
            number -= (1 << 64) if number >> 63 else 0
            want[number % 64] += 1 if number % 2 else -1
        norm = np.sqrt((want ** 2).sum())
        assert row.v == pytest.approx(want / norm if norm else want, abs=1e-6)


def test_channel_candidates(spark):
    seeds = spark.createDataFrame([("https://a.example/news/12/list.htm",), ("https://b.example/x/list2.htm",), (None,)], "url string")
    follow = ["https://a.example/news/12/list3.htm", "https://a.example/news/12/deep/er/LIST.htm", "https://a.example/2024/c12a7/page.htm",
              "https://b.example/any/c9a1/page.htm", "https://b.example/page.htm", "https://b.example/x/list.htm"]
    leave = ["https://a.example/news/list3.htm", "https://a.example/2024/c13a7/page.htm", "https://a.example/page.htm", "https://c.example/x/list.htm",
             "https://b.example/list.htm", "https://b.example/x/listing.htm", "https://b.example/x/page.html", None]
    links = spark.createDataFrame([(n, u) for n, u in enumerate([*follow, *follow, *leave])], "n int, url string")
    got = frontier.channel_candidates(links, seeds)
    assert got.columns == ["n", "url"] and sorted(r.n for r in got.collect()) == list(range(12))


def test_hosts_in_order_of_discovery(spark):
    a, b, c, d = (f"https://{h}.example" for h in "abcd")
    edges = spark.createDataFrame([
        (f"{a}/", f"{c}/1", 2, 0), (f"{a}/", f"{b}/1", 5, -1), (f"{a}/", f"{d}/", 1, -9), (f"{c}/1", f"{c}/2", 1, 0), (f"{b}/1", f"{c}/2", 1, -3),
        (f"{c}/2", f"{a}/", 1, 0), (f"{c}/2", f"{a}/deep", 1, 0)], "src string, dst string, pos int, priority int")
    seeds = spark.createDataFrame([(f"{a}/", 0), (f"{d}/", 1)], "url string, pos int")
    hosts = spark.createDataFrame([("a.example",), ("b.example",), ("c.example",)], "host string")
    rows = {r.url: (r.depth, r.host_order, r.priority) for r in frontier.crawl_hosts(seeds, edges, hosts, 3).collect()}
    assert rows == {f"{a}/": (0, 1, 0), f"{b}/1": (1, 2, -1), f"{c}/1": (1, 3, 0), f"{c}/2": (2, 3, -3), f"{a}/deep": (3, 1, 0)}


def test_rules_from_a_folder(spark, tmp_path):
    shipped = rulesets.load_rules()
    keywords = dict(shipped.keywords, page_rules=[{"category": "LIFE", "any": ["tea", "{name} house"]}], past_event_signals=["was held"],
                    student_action_signals=["apply"])
    steps = {"steps": [
        {"any": {"title": "past_event_signals"}, "none": {"corpus": "student_action_signals"}, "category": None, "page_type": "RETROSPECTIVE",
         "confidence": 0.95, "signals": {"title": "past_event_signals"}},
        {"rules": "page_rules", "in": "title", "page_type": "CONTENT_DETAIL", "confidence": 0.8},
        {"category": None, "page_type": "UNKNOWN", "confidence": 0.0}], "evergreen": []}
    (tmp_path / "keywords.json").write_text(json.dumps(keywords), encoding="utf-8")
    (tmp_path / "page.json").write_text(json.dumps(steps), encoding="utf-8")
    rules = rulesets.load_rules(str(tmp_path))
    assert rules.upload == shipped.upload
    rows = [("tea was held", "x"), ("tea was held", "apply now"), ("green house", ""), ("blue house", ""), ("none", "tea")]
    verdicts = spark.createDataFrame(rows, "t string, c string").select(classify.classify_page(
        F.col("t"), F.col("c"), F.lit("https://h.example/"), name="green", rules=rules).alias("v")).select("v.*").collect()
    assert [(v.category, v.page_type) for v in verdicts] == [
        (None, "RETROSPECTIVE"), ("LIFE", "CONTENT_DETAIL"), ("LIFE", "CONTENT_DETAIL"), (None, "UNKNOWN"), (None, "UNKNOWN")]
    assert verdicts[0].matched_signals == ["was held"] and verdicts[2].matched_signals == ["green house"]
