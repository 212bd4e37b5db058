import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.functions.text import nfkc_lower
from lorewell.operators import retrieve as R

COLUMNS = "query_id int, identity string, distance double, preferred boolean, filename string, source_type string, content string"


def ranked(spark, question, rows, top_k=5):
    df = spark.createDataFrame([(1, *r) for r in rows], COLUMNS).withColumn("question", F.lit(question))
    df = df.withColumn("searchable", nfkc_lower(R.search_text(F.col("filename"), F.col("content")))).withColumn("folded", nfkc_lower("question"))
    scored = df.withColumns({
        "filename_bonus": R.filename_bonus(F.col("question"), F.col("filename")),
        "lexical_bonus": R.lexical_bonus(F.col("folded"), F.col("searchable")),
        "curated_bonus": R.curated_bonus(F.col("source_type")),
        "target_bonus": R.target_bonus(F.col("question"), F.col("filename"), F.col("content"))})
    return R.hybrid_rerank(scored, top_k).orderBy("rank").collect()


def names(rows):
    return [r.identity for r in rows]


def test_weak_category_hits_hold_no_places(spark):
    weak = [(f"weak{i}", 0.81 + i / 100, True, "其他.pdf", None, "无") for i in range(3)]
    strong = [("science", 0.48, True, "理学院转专业方案.html", None, "无"), ("radio", 0.51, True, "通信学院转专业方案.html", None, "无"),
              ("robots", 0.52, True, "25自动化转专业.pdf", None, "无")]
    assert set(names(ranked(spark, "自动化专业转专业条件", weak + strong))[:3]) == {"science", "radio", "robots"}


def test_category_moves_a_row_but_not_its_score(spark):
    rows = ranked(spark, "q", [("a", 0.40, False, "f", None, "c"), ("b", 0.42, True, "f", None, "c")])
    assert names(rows) == ["b", "a"] and [round(r.score, 6) for r in rows] == [0.58, 0.6]


def test_curated_rows_rise(spark):
    rows = ranked(spark, "缓考如何办理", [("raw", 0.40, False, "缓考原文.html", None, "x"), ("kept", 0.43, False, "缓考办理知识", "CURATED_OFFICIAL", "x")])
    assert names(rows)[0] == "kept"


def test_class_marker(spark):
    hit = ("hit", 0.70, False, "创新创业竞赛目录.pdf", None, "大赛 Ａ 类 学院")
    other = ("other", 0.70, False, "图书馆开放时间.pdf", None, "借书")
    rows = {r.identity: r for r in ranked(spark, "示大A类竞赛有哪些", [hit, other])}
    assert rows["hit"].lexical_bonus >= 0.10 and rows["hit"].score > 0.35
    assert rows["other"].lexical_bonus == 0.0


def test_target_of_a_transfer_comes_first(spark):
    rows = [("auto", 0.58, True, "25自动化转专业.pdf", None, "x"), ("econ", 0.49, True, "25经济转专业.pdf", None, "x"),
            ("view", 0.46, False, "自动化学院：教务", "CURATED_OFFICIAL", "x")]
    plan = "原问题：经济转自动化\n转专业目标：自动化\n来源专业：经济"
    assert names(ranked(spark, plan, rows))[0] == "auto"
    pair = [("auto", 0.5, False, "25自动化转专业.pdf", None, "x"), ("econ", 0.5, False, "25经济转专业.pdf", None, "x")]
    assert names(ranked(spark, "转专业目标：自动化\n来源专业：数字经济", pair))[0] == "auto"
    assert names(ranked(spark, "转专业目标：数字经济\n来源专业：自动化", pair))[0] == "econ"


def test_confidence_steps(spark):
    scores = [0.9, 0.85, 0.8499, 0.7, 0.6999, 0.585, 0.355, 0.0]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)] + [(9, None)], "i int, s double")
    assert [r[0] for r in df.orderBy("i").select(R.confidence(F.col("s"))).collect()] == [95, 95, 85, 85, 59, 59, 36, 0, 0]


def test_cut_keeps_order_before_counting(spark):
    rows = [(1, i, s) for i, s in enumerate([0.2, 0.5, 0.4, 0.1, 0.9, 0.36, 0.35, 0.8], 1)]
    df = spark.createDataFrame(rows, "query_id int, rank int, score double")
    kept = R.relevance_cut(df).orderBy("rank").collect()
    assert [(r["rank"], r.score) for r in kept] == [(1, 0.5), (2, 0.4), (3, 0.9), (4, 0.36), (5, 0.35)]


@pytest.mark.parametrize("budget", [R.QUERY_BYTES, 8 * 4 * 3])
def test_vector_search_against_brute_force(spark, budget):
    rng = np.random.default_rng(3)
    index = [(int(i), [float(x) for x in rng.integers(-2, 3, 4)], str(rng.integers(0, 3))) for i in range(300)]
    asked = [(int(q), [float(x) for x in rng.normal(size=4)], [None, "0", "1", "7"][q % 4]) for q in range(20)]
    rows = R.vector_candidates(
        spark.createDataFrame(asked, "query_id int, query_vector array<float>, category string"),
        spark.createDataFrame(index, "chunk_key long, vector array<float>, category string").repartition(7), 5, (False, True),
        max_query_bytes=budget).collect()

    def cosine(a, b):
        a, b = np.float32(a).astype(float), np.float32(b).astype(float)
        norm = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
        return float((a * b).sum() / norm) if norm else 0.0

    expected = set()
    for q, v, c in asked:
        for grouped in (False, True):
            near = sorted((round(1 - cosine(v, w), 6), i) for i, w, k in index if not grouped or k == c)[:5]
            expected |= {(q, i, d + 0.0, grouped) for d, i in near}
    got = {(r.query_id, r.chunk_key, r.distance, r.grouped) for r in rows}
    assert {(q, i, g) for q, i, _, g in got} == {(q, i, g) for q, i, _, g in expected}
    assert len(rows) == len(got)
