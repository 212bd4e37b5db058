"""The whole search over small indexes, against ranks and scores worked out on paper."""

import pytest
from pyspark.sql import functions as F

from lorewell.operators.embed import hash_embedding
from lorewell.plans.search import answer_job, search_job, understand
from lorewell.plans.web_index import web_index_job

TOPICS = ["选课", "转专业", "图书馆", "宿舍", "奖学金", "就业", "校园卡", "军训"]
QUESTIONS = [(0, "选课办法是什么"), (1, "图书馆A类开放时间"), (2, "金融转软件条件"), (3, "hello world"), (4, "军训校园卡宿舍")]


@pytest.fixture(scope="module")
def index(spark):
    rows = []
    for i in range(60):
        topic, other = TOPICS[i % 8], TOPICS[(i * 3 + 1) % 8]
        title = f"{'25软件转专业' if i % 13 == 0 else topic + '说明'}{i}"
        rows.append((f"https://h.example.org/{i}", title, f"{topic}与{other}的规定 {'A 类 ' if i % 7 == 0 else ''}hello {i}。" * (1 + i % 3), "处",
                     ["LIFE", "ACADEMIC", "MAJOR"][i % 3], f"{i:064d}", "CURATED_OFFICIAL" if i % 5 == 0 else "OFFICIAL_WEBSITE"))
    df = spark.createDataFrame(rows, "source_url string, title string, content string, source string, category string, content_hash string, source_type string")
    for c in ("crawl_time", "last_updated"):
        df = df.withColumn(c, F.lit("2026-01-01").cast("timestamp_ntz"))
    return web_index_job(df, hash_embedding(64)).withColumn("chunk_key", F.col("chunk_id")).cache()


STORED = [
    # key, vector, category, file name, kind, content
    ("r1", [0.6, 0.8], "MAJOR", "图书馆简介", "OFFICIAL_WEBSITE", "无"),
    ("r2", [0.6, 0.8], "LIFE", "通知", "OFFICIAL_WEBSITE", "A 类 开放时间"),
    ("r3", [0.8, 0.6], "MAJOR", "其他", "CURATED_OFFICIAL", "无"),
    ("r4", [0.0, 1.0], "MAJOR", "x", "OFFICIAL_WEBSITE", "无"),
    ("t1", [0.28, 0.96], "MAJOR", "软件转专业细则", "OFFICIAL_WEBSITE", "无"),
    ("t2", [0.6, 0.8], "MAJOR", "转专业管理办法", "OFFICIAL_WEBSITE", "无"),
]
# Worked out on paper: similarity, two name pairs and two text pairs (r1), three text pairs and a class marker (r2), the curated
# bonus (r3); for the transfer question name pairs, text pairs and the target (t1) or the general rules (t2).
RANKED = {
    1: [("r3", 0.95), ("r2", 0.775), ("r1", 0.69), ("t2", 0.6), ("t1", 0.28), ("r4", 0.0)],
    2: [("r3", 0.95), ("t2", 0.77), ("t1", 0.765), ("r1", 0.6), ("r2", 0.6), ("r4", 0.0)],
}


@pytest.mark.parametrize("k", [2, 6])
def test_ranks_and_scores_on_paper(spark, k):
    stored = spark.createDataFrame(STORED, "chunk_key string, vector array<double>, category string, filename string, source_type string, content string")
    stored = stored.withColumns({"page": F.lit(1), "source": F.lit("s"), "source_url": F.lit("u")})
    questions = spark.createDataFrame(
        [(1, [1.0, 0.0], "LIFE", "图书馆 A类 开放时间"), (2, [1.0, 0.0], "ACADEMIC", "转专业目标：软件")],
        "query_id int, query_vector array<double>, category string, planned string")
    found = search_job(questions, stored, k).orderBy("query_id", "rank").collect()
    for query_id, expected in RANKED.items():
        mine = [(r.chunk_key, r.score) for r in found if r.query_id == query_id]
        assert [key for key, _ in mine] == [key for key, _ in expected[:k]]
        assert [score for _, score in mine] == pytest.approx([score for _, score in expected[:k]], abs=1e-9)


def test_hits_far_behind_in_a_text_count(spark):
    row = ("r", [0.6, 0.8], "LIFE", "转专业", "OFFICIAL_WEBSITE", "字" * 5000 + "软件时间")
    stored = spark.createDataFrame([row], "chunk_key string, vector array<double>, category string, filename string, source_type string, content string")
    stored = stored.withColumns({"page": F.lit(1), "source": F.lit("s"), "source_url": F.lit("u")})
    asked = spark.createDataFrame([(1, [1.0, 0.0], None, "转专业目标：软件")], "query_id int, query_vector array<double>, category string, planned string")
    whole = search_job(asked, stored).first().score
    limited = search_job(asked, stored, lexical_chars=4000, target_chars=1600).first().score
    # similarity 0.6, two name pairs 0.04, three text pairs 0.075, target 0.35: more than the most; cut short 0.6 + 0.04 + 0.05 + 0.02
    assert whole == 1.0 and limited == pytest.approx(0.71, abs=1e-9)


def test_texts_and_words_are_not_ordered(spark, index, monkeypatch):
    """Candidates are bounded and ranked as numbers; texts only meet them in passing, and of the answers only the prompts read them."""
    from lorewell.operators import retrieve as R
    from lorewell.plans import search

    seen, kept, cut = {}, [], search.cut_lineage
    for name in ("drop_hopeless", "hybrid_rerank"):
        def watched(rows, *rest, name=name, real=getattr(R, name), **more):
            seen[name] = set(rows.columns)
            return real(rows, *rest, **more)
        monkeypatch.setattr(R, name, watched)
    questions = understand(spark.createDataFrame(QUESTIONS, "query_id int, question string"))
    results = search_job(questions, index, 10, hash_embedding(64))
    wide = {"content", "searchable", "filename", "__planned", "__names", "__words", "__markers", "__goal"}
    assert seen.keys() == {"drop_hopeless", "hybrid_rerank"} and not wide & (seen["drop_hopeless"] | seen["hybrid_rerank"])
    monkeypatch.setattr(search, "cut_lineage", lambda df: kept.append(df.columns) or cut(df))
    assert answer_job(questions, results).count() == len(QUESTIONS) and "content" not in kept[0]


def test_candidates_of_many_questions_are_read_once(spark, index, monkeypatch):
    """They go from the search into their bounds and are not stored before; those of a few questions choose the index rows to read."""
    from functools import reduce

    from lorewell.plans import search

    cut, stored = search.cut_lineage, reduce(lambda a, b: a.union(b), [index.withColumn("chunk_key", F.concat(
        F.lit(str(n)), F.col("chunk_key"))) for n in range(5)])
    questions = understand(spark.createDataFrame(QUESTIONS, "query_id int, question string"))
    kept, found = [], {}
    monkeypatch.setattr(search, "cut_lineage", lambda df: kept.append(df.columns) or cut(df))
    for name, asked in (("many", questions), ("few", questions.where("query_id = 1"))):
        kept.clear()
        found[name] = search_job(asked, stored, 10, hash_embedding(64)).where("query_id = 1").select("rank", "chunk_key", "score").collect()
        assert any("distance" in c and "filename_bonus" not in c for c in kept) == (name == "few")
    assert len(found["few"]) == 10 and sorted(found["few"]) == sorted(found["many"])


def test_pairs_of_a_file_name_give_its_bonus(spark):
    from lorewell.functions.tokens import gap_closed_bigrams
    from lorewell.operators import retrieve as R

    rows = [("图书 馆开放时间", "图书馆简介"), ("图书馆", "a"), ("图书馆", None), (None, "图书馆"), (None, "a"), ("转专业转专业", "转专业"), ("abc", ""),
            ("一二三四五六七八", "一二三四五六七八"), ("图馆", "图书馆"), ("\U00020000\U00020001图书", "\U00020000\U00020001图书")]
    df = spark.createDataFrame(rows, "question string, filename string")
    for symbol in (R.HAN_COMMON, r"[\x{20000}-\x{2ffff}]", "[a-e]"):
        names = gap_closed_bigrams(F.col("question"), symbol)
        mine = R.filename_bonus_of_pairs(names, R.filename_pairs(F.col("filename"), symbol))
        assert df.where(~mine.eqNullSafe(R.filename_bonus_of(names, F.col("filename")))).count() == 0


def test_hopeless_rows_are_found_in_one_window(spark):
    import io
    from contextlib import redirect_stdout

    from lorewell.operators.retrieve import drop_hopeless

    rows = [(1, "a", 0.9, 0.9), (1, "b", 0.5, 0.5), (1, "c", 0.4, 0.5), (1, "d", 0.4, 0.49), (2, "e", 0.1, 0.1)]
    kept = drop_hopeless(spark.createDataFrame(rows, "query_id int, chunk_key string, floor double, ceiling double"), 2)
    assert sorted(map(tuple, kept.collect())) == [(1, "a"), (1, "b"), (1, "c"), (2, "e")]
    out = io.StringIO()
    with redirect_stdout(out):
        kept.explain("formatted")
    assert out.getvalue().count("Window (") == 2  # once in the tree, once in the list


def test_plain_texts_go_only_where_a_target_is_looked_for(spark, index, monkeypatch):
    from lorewell.operators import retrieve as R
    from lorewell.plans import search

    seen, real = [], R.hybrid_rerank
    monkeypatch.setattr(R, "hybrid_rerank", lambda rows, *rest, **more: seen.append(rows) or real(rows, *rest, **more))
    questions = understand(spark.createDataFrame(QUESTIONS, "query_id int, question string"))
    search.search_job(questions, index, 10, hash_embedding(64)).count()
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "THEN content" in plan and seen[0].where("target_bonus > 0").count() > 0


def test_names_go_with_plain_texts(spark, index, monkeypatch):
    from lorewell.operators import retrieve as R
    from lorewell.plans import search

    seen, real = [], R.hybrid_rerank
    monkeypatch.setattr(R, "hybrid_rerank", lambda rows, *rest, **more: seen.append(rows) or real(rows, *rest, **more))
    search.search_job(understand(spark.createDataFrame(QUESTIONS, "query_id int, question string")), index, 10, hash_embedding(64)).count()
    assert "THEN filename" in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_stored_text_gives_the_same(spark, index):
    from lorewell.functions.text import nfkc_lower
    from lorewell.operators.retrieve import search_text

    questions = understand(spark.createDataFrame(QUESTIONS, "query_id int, question string"))
    stored = index.withColumn("searchable", nfkc_lower(search_text(F.col("filename"), F.col("content"))))
    plain, quick = (search_job(questions, i, 10, hash_embedding(64)).select("query_id", "rank", "chunk_key", "score") for i in (index, stored))
    assert sorted(plain.collect()) == sorted(quick.collect())


def test_answers(spark, index):
    questions = understand(spark.createDataFrame(QUESTIONS + [(9, "zzz")], "query_id int, question string"))
    rows = {r.query_id: r for r in answer_job(questions, search_job(questions, index, 20, hash_embedding(64))).collect()}
    assert rows[2].category == "ACADEMIC" and rows[2].answerable and "转专业目标：软件" not in rows[2].prompt
    assert rows[0].confidence > 0 and 0 < len(rows[0].sources) <= 5 and rows[0].prompt.endswith("当前问题：\n选课办法是什么")
    assert not rows[9].answerable and rows[9].confidence == 0 and rows[9].sources == [] and "暂无相关信息" in rows[9].fallback


def test_texts_are_read_for_questions_that_look_for_something(spark, index, monkeypatch):
    from lorewell.plans import search

    read, real = [], search.rows_of_keys
    monkeypatch.setattr(search, "rows_of_keys", lambda table, keys, key, *rest: read.append((table.columns, keys)) or real(table, keys, key, *rest))
    twice = index.union(index.limit(3))  # a key that stands twice is a candidate of every question as often
    asked = understand(spark.createDataFrame(QUESTIONS + [(9, "zzz")], "query_id int, question string"))
    for stored in (index, twice):
        read.clear()
        found = search.search_job(asked, stored, 10, hash_embedding(64)).collect()
        texts = [keys for columns, keys in read if "content" in columns and "page" not in columns]
        assert {r.query_id for r in texts[0].select("query_id").distinct().collect()} == {0, 1, 2, 4}
        assert {r.query_id for r in found} == {0, 1, 2, 3, 4, 9}


def test_short_columns_may_come_with_the_candidates(spark, index, monkeypatch):
    """Those of a large index do, so its rows are not looked for a second time; ranks and scores stay."""
    from lorewell.operators import retrieve as R
    from lorewell.plans import search

    asked = understand(spark.createDataFrame(QUESTIONS, "query_id int, question string"))
    want = search_job(asked, index, 10, hash_embedding(64)).select("query_id", "rank", "chunk_key", "score").collect()
    monkeypatch.setattr(R, "INDEX_BYTES", 64 * 8 * 10)
    monkeypatch.setattr(search, "candidates", lambda queries, rows, k: R.merged_candidates(
        queries, rows, R.candidate_count(k), along=list(search.SHORT), max_query_bytes=1))
    monkeypatch.setattr(search, "join_short", lambda *_: pytest.fail("short columns were joined"))
    got = search_job(asked, index, 10, hash_embedding(64), retrieve=search.candidates).select("query_id", "rank", "chunk_key", "score").collect()
    assert sorted(got) == sorted(want)


def test_answer_job_reads_a_stored_index(spark, monkeypatch):
    import os

    from lorewell.plans import search
    from lorewell.registry.index_and_search import answer_job as registered

    folder = os.environ.get("LOREWELL_TEST_SF", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("test tables are not here")
    seen = []
    monkeypatch.setattr(search, "search_job", lambda questions, rows, **more: seen.append(rows) or search_job(questions, rows, **more))
    assert registered(spark, folder).columns == ["query_id", "category", "answerable", "confidence", "sources"]
    assert seen[0].inputFiles() and all(f.endswith(".parquet") for f in seen[0].inputFiles())  # by columns, not whole rows
