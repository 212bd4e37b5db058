import io
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorewell import schemas as S
from lorewell.operators import catalog as catalog_ops
from lorewell.operators import dialogue, evaluate
from lorewell.operators.index import publish_index, read_index, replace_index
from lorewell.operators.ratelimit import token_bucket
from lorewell.plans.crawl_ingest import CrawlRules, assess_pages, next_catalog, next_state
from lorewell.plans.upload_index import upload_index_job
from lorewell.plans.web_index import web_index_job
from lorewell.operators.embed import hash_embedding
from lorewell.scale import cut_lineage
from lorewell.sources import keyed
from lorewell.sources.tables import catalog_detail, catalog_scan, check_uploads, dry_run, list_files, question_set, read_uploads
from lorewell.streaming import jobs, windows

RULES = CrawlRules(now=datetime(2026, 7, 1), since=datetime(2024, 1, 1), agent="bot")
TEXT = "关于选课的说明。学生应在规定时间内完成选课，请办理相关手续。" * 6


def page(name, title, body, status=200, tag="article", kind="text/html", etag="e1", when="2025-05-05", fetched=1):
    html = f"<html><head><meta name='date' content='{when}'></head><body><h1>{title}</h1><{tag}>{body}</{tag}></body></html>"
    return (f"https://h.example.org/{name}", status, kind, etag, None, html, datetime(2026, 6, fetched))


FIRST = [
    page("ok/page.htm", "选课通知", TEXT), page("old/page.htm", "选课通知", TEXT, when="2020-01-01"), page("nodate", "选课通知", TEXT, when=""),
    page("short/page.htm", "选课通知", "请办理"), page("list.htm", "选课通知", TEXT, tag="div"), page("none/page.htm", "随笔", "风景" * 80),
    page("err", "x", "y", status=500), page("img", "x", "y", kind="image/png"), page("closed/page.htm", "选课通知", TEXT),
    page("barred/page.htm", "选课通知", TEXT), page("org/list2.htm", "组织机构", "机构" * 30, tag="div", when=""),
]
EXPECTED = {
    "ok/page.htm": "CREATED", "old/page.htm": "OUT_OF_RANGE", "nodate": "DATE_UNKNOWN", "short/page.htm": "CONTENT_TOO_SHORT",
    "list.htm": "NON_CONTENT_PAGE", "none/page.htm": "UNCLASSIFIED", "err": "FAILED", "img": "FAILED", "closed/page.htm": "ROBOTS_DENIED",
    "barred/page.htm": "EXCLUDED", "org/list2.htm": "CREATED",
}


def side_tables(spark):
    robots = spark.createDataFrame([("https://h.example.org", 200, "User-agent: *\nDisallow: /closed")], S.ROBOTS_DDL)
    names = spark.createDataFrame([("h.example.org", "Site H")], "host string, name string")
    barred = spark.createDataFrame([("https://h.example.org/barred/page.htm", "no")], S.EXCLUSION_DDL)
    return robots, names, barred


def crawl(spark, pages, state, catalog):
    robots, names, barred = side_tables(spark)
    outcomes = cut_lineage(assess_pages(spark.createDataFrame(pages, S.PAGE_DDL), state, catalog, barred, names, robots, RULES))
    return outcomes, cut_lineage(next_state(state, outcomes, RULES)), cut_lineage(next_catalog(catalog, outcomes, RULES))


def statuses(outcomes):
    return {r.url.split("example.org/")[1]: r.status for r in outcomes.select("url", "status").collect()}


def test_crawl_runs(spark):
    state, catalog = spark.createDataFrame([], S.CRAWL_RECORD_DDL), spark.createDataFrame([], S.CATALOG_DDL)
    outcomes, state, catalog = crawl(spark, FIRST, state, catalog)
    assert statuses(outcomes) == EXPECTED
    assert {r.source_url[-8:]: (r.category, r.status, r.source) for r in catalog.collect()} == {
        "page.htm": ("ACADEMIC", "PROCESSING", "Site H"), "ist2.htm": ("ORGANIZATION", "PROCESSING", "Site H")}
    second = [page("ok/page.htm", "选课通知", TEXT, status=304, etag=None), page("org/list2.htm", "组织机构", "机构" * 30 + "新增", tag="div", when="", etag=None)]
    outcomes, state2, catalog2 = crawl(spark, second, state, catalog)
    assert statuses(outcomes) == {"ok/page.htm": "UNCHANGED", "org/list2.htm": "UPDATED"}
    records = {r.url.split("example.org/")[1]: r for r in state2.collect()}
    assert records["ok/page.htm"].last_status == "CREATED" and records["org/list2.htm"].etag == "e1"
    third = [page("ok/page.htm", "选课通知", TEXT), page("org/list2.htm", "x", "y", status=503)]
    outcomes, state3, _ = crawl(spark, third, state2, catalog2)
    assert statuses(outcomes) == {"ok/page.htm": "UNCHANGED", "org/list2.htm": "FAILED"}
    failed = {r.url.split("example.org/")[1]: r for r in state3.collect()}["org/list2.htm"]
    assert failed.title is None and failed.content_hash == records["org/list2.htm"].content_hash and failed.indexed_at is not None


def test_stream_matches_batch(spark, tmp_path):
    pages, root = tmp_path / "pages", str(tmp_path / "root")
    robots, names, barred = side_tables(spark)
    spark.createDataFrame(FIRST[:6], S.PAGE_DDL).coalesce(1).write.parquet(str(pages / "a"))
    state, catalog = spark.createDataFrame([], S.CRAWL_RECORD_DDL), spark.createDataFrame([], S.CATALOG_DDL)
    _, state, catalog = crawl(spark, FIRST[:6], state, catalog)
    folder = str(pages / "*")
    jobs.stream_ingest(spark, folder, root, names, barred, RULES, robots).awaitTermination(120)
    spark.createDataFrame(FIRST[6:], S.PAGE_DDL).coalesce(1).write.parquet(str(pages / "b"))
    outcomes, state, catalog = crawl(spark, FIRST[6:], state, catalog)
    jobs.stream_ingest(spark, folder, root, names, barred, RULES, robots).awaitTermination(120)
    for stored, expected in ((jobs.stored_state(spark, root), state), (jobs.stored_catalog(spark, root), catalog)):
        assert sorted(map(str, stored.select(*expected.columns).collect())) == sorted(map(str, expected.collect()))
    jobs.stream_index(spark, root, hash_embedding(64)).awaitTermination(120)
    stored = read_index(spark, f"{root}/index")
    batch = web_index_job(catalog, hash_embedding(64))
    assert sorted(r.chunk_id for r in stored.collect()) == sorted(r.chunk_id for r in batch.collect())


INDEX = "document_id string, chunk_index int, source_url string, content string"


def files_of(folder):
    return {str(f.relative_to(folder)): f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}


def contents(spark, root):
    return sorted(r.content for r in read_index(spark, root, INDEX).collect())


def test_index_changes(spark, tmp_path):
    def rows(*items):
        return spark.createDataFrame(list(items), INDEX)

    old = rows(("a", 0, None, "x"), ("a", 1, None, "y"), ("w1", 0, "u1", "z"), ("k", 0, "", "k"))
    new = rows(("a", 0, None, "x2"), ("w2", 0, "u1", "z2"))
    assert sorted(r.content for r in replace_index(old, new).collect()) == ["k", "x2", "z2"]
    root = str(tmp_path / "index")
    assert contents(spark, root) == []
    publish_index(root, old)
    publish_index(root, new)
    assert contents(spark, root) == ["k", "x2", "z2"]
    broken = new.withColumn("content", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception):
        publish_index(root, broken)
    assert contents(spark, root) == ["k", "x2", "z2"]
    # a document that moves to another address leaves its old part, even if nothing else is left there
    publish_index(root, rows(("w2", 0, "u7", "moved")))
    assert contents(spark, root) == ["k", "moved", "x2"]
    publish_index(root, rows())
    assert contents(spark, root) == ["k", "moved", "x2"]


def test_a_change_rewrites_only_its_parts(spark, tmp_path):
    root = tmp_path / "index"
    publish_index(str(root), spark.createDataFrame([(f"d{i}", 0, f"u{i}", f"c{i}") for i in range(200)], INDEX), parts=16)
    before = files_of(root / "table")
    publish_index(str(root), spark.createDataFrame([("e7", 0, "u7", "new")], INDEX), parts=16)
    after = files_of(root / "table")
    changed = {f.split("/")[0] for f in before.keys() ^ after.keys()}
    assert len(changed) == 1 and len({f.split("/")[0] for f in after}) == 16
    assert all(before[f] == after[f] for f in before if f.split("/")[0] not in changed)
    assert contents(spark, str(root)) == sorted([f"c{i}" for i in range(200) if i != 7] + ["new"])


def test_a_staged_change_is_swapped_in_again(spark, tmp_path):
    root, key = str(tmp_path / "t"), F.col("k")
    rows = lambda *items: spark.createDataFrame(list(items), "k long, v string")
    add = lambda new: lambda now: now.join(new, "k", "left_anti").unionByName(new)
    first, second = rows((1, "a"), (2, "b")), rows((2, "c"), (3, "d"))
    for name, new in (("one", first), ("two", second)):
        keyed.update_keyed(spark, root, "k long, v string", key, keyed.parts_of(new, key, 4), add(new), name, 4)
    want = [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, keyed.read_keyed(spark, root, "k long, v string").collect())) == want

    def unused(now):
        raise AssertionError("computed again")

    keyed.update_keyed(spark, root, "k long, v string", key, keyed.parts_of(second, key, 4), unused, "two", 4)
    assert sorted(map(tuple, keyed.read_keyed(spark, root, "k long, v string").collect())) == want
    gone = keyed.parts_of(rows((1, "")), key, 4)
    keyed.update_keyed(spark, root, "k long, v string", key, gone, lambda now: now.where("k <> 1"), "three", 4)
    assert sorted(map(tuple, keyed.read_keyed(spark, root, "k long, v string").collect())) == want[1:]


def docx(paragraphs, rows):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>" for row in rows)
    body = "".join(map(p, paragraphs)) + f"<w:tbl>{table}</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_uploads(spark, tmp_path):
    (tmp_path / "培养方案 a+b.docx").write_bytes(docx(["标题", "正文"], [["甲", "乙"]]))
    (tmp_path / "empty.pdf").write_bytes(b"")
    (tmp_path / "fake.pdf").write_bytes(b"hello")
    (tmp_path / "blank.docx").write_bytes(docx([" "], []))
    (tmp_path / "notes.txt").write_bytes(b"x")
    (tmp_path / "again").mkdir()
    (tmp_path / "again" / "培养方案 a+b.docx").write_bytes(docx(["标题", "正文"], [["甲", "乙"]]))
    (tmp_path / "broken.docx").write_bytes(b"PK\x03\x04oops")
    files = read_uploads(spark, str(tmp_path)).withColumns({"source": F.lit(" "), "upload_time": F.lit("t")})
    rows, rejected = upload_index_job(files, embed=hash_embedding(64))
    row = rows.collect()
    assert len(row) == 1 and row[0].filename == "培养方案 a+b.docx" and row[0].category == "MAJOR" and row[0].source == "未知来源"
    assert row[0].content.endswith("正文：\n标题\n正文\n甲 | 乙") and row[0].source_type == "UPLOADED_FILE"
    problems = {r.path.rsplit("/", 1)[1]: r.error.split(":")[0] for r in rejected.collect()}
    assert problems == {"fake.pdf": "content_mismatch", "blank.docx": "no_text", "notes.txt": "unsupported_type", "broken.docx": "BadZipFile"}
    assert check_uploads(files.drop("filename", "extension", "rejected"), max_bytes=4).where("rejected = 'too_large'").count() == 5


def test_question_file_and_scores(spark, tmp_path):
    (tmp_path / "q.json").write_text(
        '[{"question": "a?", "category": "LIFE", "expected_source": "Lib", "expected_keywords": ["OPEN"]},\n'
        ' {"question": "b?", "category": "LIFE", "expected_source": " ", "expected_keywords": []},\n'
        ' {"question": "c?", "category": "CAREER", "expected_source": "x", "expected_keywords": null}]', encoding="utf-8")
    questions = question_set(spark, str(tmp_path / "q.json")).withColumn("question_id", F.col("question"))
    answers = spark.createDataFrame(
        [("a?", "It is open", [("The library", "s")]), ("b?", "知识库中暂无相关信息，请咨询相关部门。 ", [("t", "s")])],
        "question_id string, answer string, sources array<struct<title:string,source:string>>")
    rows = {r.question_id: r.score for r in evaluate.score_answers(questions, answers).collect()}
    assert rows == {"a?": 100, "b?": 65, "c?": 0}


def test_sources_json_round_trip(spark):
    text = '[{"title":"t","page":2,"score":0.5,"unknown":1}]'
    row = spark.range(1).select(dialogue.sources_from_json(F.lit(text)).alias("s"), dialogue.sources_from_json(F.lit(" ")).alias("e")).first()
    assert row.s[0].title == "t" and row.s[0].page == 2 and row.s[0].url is None and row.e == []


def test_reindex_needs_the_file(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    path = str(tmp_path / "a.pdf")
    rows = [(1, "COMPLETED", "UPLOADED_FILE", path), (2, "COMPLETED", "UPLOADED_FILE", path + "x"), (3, "FAILED", "UPLOADED_FILE", path),
            (4, "COMPLETED", "UPLOADED_FILE", None), (5, "COMPLETED", "OFFICIAL_WEBSITE", path)]
    df = spark.createDataFrame(rows, "id int, status string, source_type string, storage_path string")
    decided = catalog_ops.select_reindex(df, list_files(spark, str(tmp_path)))
    assert {r.id: r.decision for r in decided.collect()} == {1: "SCHEDULED", 2: "SKIPPED", 3: "SKIPPED", 4: "SKIPPED"}
    assert tuple(catalog_ops.reindex_counts(decided).first()) == (1, 3)


def test_lists_and_dry_run(spark):
    rows = [(1, "b", datetime(2024, 1, 1)), (2, "b", datetime(2024, 1, 3)), (3, "a", datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "id int, session string, created_time timestamp_ntz").withColumn("content", F.lit("text"))
    assert [r.id for r in dialogue.session_history(df, "b").collect()] == [2, 1]
    assert [r.id for r in dialogue.session_history(df, "b", 1).collect()] == [2]
    assert [r.id for r in catalog_scan(df).collect()] == [2, 3, 1] and "content" not in catalog_scan(df).columns
    assert catalog_detail(df, 3).first().content == "text"
    assert {r.action for r in dry_run(df).collect()} == {"DRY_RUN"}


def events(spark, n=60):
    rows = [(i, f"k{i % 3}", i * 400 + (i % 5), 2) for i in range(n)]
    return spark.createDataFrame(rows, "request_id long, bucket_key string, micros long, capacity int")


def drain(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def test_rate_limit_stream(spark, tmp_path):
    data = events(spark)
    for i in range(3):
        data.where(F.floor(F.col("request_id") / 20) == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    drain(jobs.stream_rate_limit(stream, 5000), "limits")
    assert sorted(spark.table("limits").collect()) == sorted(token_bucket(data, 5000).collect())


def test_window_streams(spark, tmp_path):
    rows = [(i, "m", "SUCCESS" if i % 3 else "FAILED", i, i, i, i, i, 0, None, datetime(2024, 1, 1 + i // 10, i % 10)) for i in range(40)]
    usage = spark.createDataFrame(rows, S.USAGE_DDL)
    usage.coalesce(1).write.parquet(str(tmp_path / "usage"))
    stream = spark.readStream.schema(S.USAGE_DDL).parquet(str(tmp_path / "usage"))
    drain(windows.usage_per_window(stream, "1 day", ["model"], "1 hour"), "usage_stream", "complete")
    assert sorted(map(str, spark.table("usage_stream").collect())) == sorted(map(str, windows.usage_per_window(usage, "1 day", ["model"]).collect()))
    seen = usage.select(F.col("model").alias("session"), "created_time")
    drain(windows.session_activity(stream.select(F.col("model").alias("session"), "created_time"), timedelta(hours=5), "1 hour"), "activity", "complete")
    assert sorted(map(str, spark.table("activity").collect())) == sorted(map(str, windows.session_activity(seen, timedelta(hours=5)).collect()))


def test_dedupe_stream(spark, tmp_path):
    rows = [(f"u{i % 4}", f"h{i % 2}", datetime(2024, 1, 1, 0, i)) for i in range(20)]
    data = spark.createDataFrame(rows, "url string, content_hash string, crawled_at timestamp_ntz")
    data.coalesce(1).write.parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "d"))
    drain(jobs.stream_dedupe(stream), "once")
    batch = data.dropDuplicates(["url", "content_hash"]).select("url", "content_hash")
    assert sorted(spark.table("once").select("url", "content_hash").collect()) == sorted(batch.collect())


def test_newest_fetch_of_a_url_counts(spark, tmp_path):
    pages, root = tmp_path / "pages", tmp_path / "root"
    robots, names, barred = side_tables(spark)
    twice = [page("ok/page.htm", "选课通知", TEXT, etag="z", fetched=1), page("ok/page.htm", "选课须知", TEXT, etag="a", fetched=2)]
    spark.createDataFrame(twice, S.PAGE_DDL).coalesce(1).write.parquet(str(pages / "a"))
    jobs.stream_ingest(spark, str(pages / "*"), str(root), names, barred, RULES, robots).awaitTermination(120)
    assert [r.title for r in jobs.stored_catalog(spark, str(root)).collect()] == ["选课须知"]


def test_repeated_batch_changes_nothing(spark, tmp_path):
    pages, root = tmp_path / "pages", tmp_path / "root"
    robots, names, barred = side_tables(spark)
    spark.createDataFrame(FIRST[:2], S.PAGE_DDL).coalesce(1).write.parquet(str(pages / "a"))
    jobs.stream_ingest(spark, str(pages / "*"), str(root), names, barred, RULES, robots).awaitTermination(120)
    before = files_of(root / "state" / "stage"), files_of(root / "catalog" / "stage")
    rows = [sorted(map(str, t.collect())) for t in (jobs.stored_state(spark, str(root)), jobs.stored_catalog(spark, str(root)))]
    for marker in (root / "ingest-checkpoint" / "commits").iterdir():
        marker.unlink()  # as if the job had died before the batch was committed
    jobs.stream_ingest(spark, str(pages / "*"), str(root), names, barred, RULES, robots).awaitTermination(120)
    assert (files_of(root / "state" / "stage"), files_of(root / "catalog" / "stage")) == before
    assert [sorted(map(str, t.collect())) for t in (jobs.stored_state(spark, str(root)), jobs.stored_catalog(spark, str(root)))] == rows
    assert {r.last_status for r in jobs.stored_state(spark, str(root)).collect()} == {"CREATED", "OUT_OF_RANGE"}


def test_a_batch_leaves_other_parts_alone(spark, tmp_path):
    pages, root = tmp_path / "pages", tmp_path / "root"
    robots, names, barred = side_tables(spark)
    many = [page(f"ok/{i}/page.htm", "选课通知", TEXT) for i in range(60)]
    spark.createDataFrame(many, S.PAGE_DDL).coalesce(1).write.parquet(str(pages / "a"))
    jobs.stream_ingest(spark, str(pages / "*"), str(root), names, barred, RULES, robots, parts=8).awaitTermination(120)
    before = {t: files_of(root / t / "table") for t in ("catalog", "state")}
    spark.createDataFrame([page("ok/3/page.htm", "选课须知", TEXT, etag="e2", fetched=2)], S.PAGE_DDL).coalesce(1).write.parquet(str(pages / "b"))
    jobs.stream_ingest(spark, str(pages / "*"), str(root), names, barred, RULES, robots, parts=8).awaitTermination(120)
    for name, old in before.items():
        new = files_of(root / name / "table")
        assert len({f.split("/")[0] for f in old.keys() ^ new.keys()}) == 1
    titles = {r.source_url: r.title for r in jobs.stored_catalog(spark, str(root)).collect()}
    assert len(titles) == 60 and titles["https://h.example.org/ok/3/page.htm"] == "选课须知"
