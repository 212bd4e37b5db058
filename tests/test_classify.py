import pytest
from pyspark.sql import functions as F

from lorewell.operators import classify as C

# title, body, url -> category, page type
PAGES = [
    ("新生报到须知", "入学需带材料", "", "NEW_STUDENT", "CONTENT_DETAIL"),
    ("本学期选课安排", "考试时间另行通知", "", "ACADEMIC", "CONTENT_DETAIL"),
    ("图书馆开放时间", "欢迎同学", "", "LIFE", "EVERGREEN_STATIC"),
    ("软件专业介绍", "说明", "", "MAJOR", "CONTENT_DETAIL"),
    ("秋季校园招聘", "单位名单", "", "CAREER", "CONTENT_DETAIL"),
    ("老师的项目", "做了一个实验", "", None, "UNKNOWN"),
    ("校训", "新生入学 教务管理", "", "SCHOOL_OVERVIEW", "EVERGREEN_STATIC"),
    ("示大精神", "新生入学", "", "SCHOOL_OVERVIEW", "EVERGREEN_STATIC"),
    ("党政群部门一览", "科研成果", "", "ORGANIZATION", "EVERGREEN_STATIC"),
    ("学术报告安排", "无", "", "RESEARCH", "CONTENT_DETAIL"),
    ("学院成功举办师德大讲堂", "老师们参加会议", "", None, "RETROSPECTIVE"),
    ("关于举办竞赛的报名通知", "截止时间前提交申请", "", "ACADEMIC", "CONTENT_DETAIL"),
    ("本馆简介", "丰富的馆藏", "", "LIFE", "EVERGREEN_STATIC"),
    ("本馆简介", "一个展览的建设过程", "https://x.example.org/1/list.htm", None, "UNKNOWN"),
    ("本馆简介", "一个展览的建设过程", "https://lib.example.org/1/list.htm", "LIFE", "EVERGREEN_STATIC"),
    ("学院简介", "设有多个本科专业", "", "MAJOR", "EVERGREEN_STATIC"),
    ("部门职责", "协调工作", "", "ORGANIZATION", "EVERGREEN_STATIC"),
    ("学科简介", "研究方向", "", "RESEARCH", "EVERGREEN_STATIC"),
    ("服务指南", "宿舍维修", "", "LIFE", "EVERGREEN_STATIC"),
    ("服务指南", "学籍异动", "", "ACADEMIC", "EVERGREEN_STATIC"),
    ("通知", "请办理校园卡", "", "NEW_STUDENT", "CONTENT_DETAIL"),
    ("通知", "校园卡", "", None, "UNKNOWN"),
    ("通知", "字" * 1200 + "请办理校园卡", "", None, "UNKNOWN"),
]
# file, first page -> category, page type, signals
UPLOADS = [
    ("自动化转专业.pdf", "工作方案", "ACADEMIC", "CONTENT_DOCUMENT", "转专业"),
    ("通知.pdf", "无关" * 700 + "就业招聘", None, "UNKNOWN", ""),
    ("学校章程.pdf", "新生入学 教务", "SCHOOL_OVERVIEW", "STATIC_KNOWLEDGE", "学校章程"),
    ("本馆简介.pdf", "图书馆馆藏", "LIFE", "EVERGREEN_STATIC", "本馆简介,图书馆上下文"),
    ("本馆简介.pdf", "页面建设过程", None, "UNKNOWN", ""),
    ("部门职责.pdf", "协调", "ORGANIZATION", "EVERGREEN_STATIC", "部门职责"),
    ("智能专业培养计划（原DOCX转换）.pdf", "选课 科研平台", "MAJOR", "CONTENT_DOCUMENT", "专业培养计划"),
    ("1-定稿（原DOC转换）.docx", "封面\n智能专业培养方案\n选课 重点实验室", "MAJOR", "CONTENT_DOCUMENT", "培养方案"),
    ("2-网络（原XLSX转换）.pdf", "专业教学进程计划\n专业课程设置安排表", "MAJOR", "CONTENT_DOCUMENT", "专业教学进程计划,专业课程设置安排表"),
    ("转专业实施细则.docx", "本科人才培养方案适用范围", "ACADEMIC", "CONTENT_DOCUMENT", "转专业,实施细则"),
    ("重点实验室简介.pdf", "本科人才培养方案\n科研", "RESEARCH", "EVERGREEN_STATIC", "实验室简介"),
    ("附件.pdf", "食堂 宿舍 招聘", "LIFE", "CONTENT_DOCUMENT", "食堂,宿舍"),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, t, b, u) for i, (t, b, u, _, _) in enumerate(PAGES)], "i int, t string, b string, u string")
    verdict = C.classify_page(F.col("t"), F.col("b"), F.col("u"), name="示大", library_host="lib.example.org", body_chars=1200)
    rows = df.select("i", verdict.alias("v")).orderBy("i").collect()
    assert [(r.v.category, r.v.page_type) for r in rows] == [(c, p) for *_, c, p in PAGES]


def test_whole_body_is_read_by_default(spark):
    df = spark.createDataFrame([("通知", "字" * 1200 + "请办理校园卡")], "t string, b string")
    row = df.select(C.classify_page(F.col("t"), F.col("b"), F.lit("")).alias("v")).first()
    assert row.v.category == "NEW_STUDENT"
    late = spark.createDataFrame([("通知.pdf", "无关" * 700 + "就业招聘")], "f string, p string")
    assert C.classify_upload(late, "f", "p").first().verdict.category == "CAREER"


def test_uploads(spark):
    df = spark.createDataFrame([(i, f, p) for i, (f, p, *_) in enumerate(UPLOADS)], "i int, f string, p string")
    rows = C.classify_upload(df, "f", "p", page_chars=1200).orderBy("i").collect()
    assert [(r.verdict.category, r.verdict.page_type, ",".join(r.verdict.matched_signals)) for r in rows] == [u[2:] for u in UPLOADS]


def test_score_confidence_is_capped(spark):
    df = spark.createDataFrame([("a" * 50,), ("b",)], "t string")
    rules = [("X", ["a" * k for k in range(1, 12)]), ("Y", ["b"])]
    rows = df.select(C.classify_scored(F.col("t"), rules).alias("v")).collect()
    assert [(r.v.category, round(r.v.confidence, 4)) for r in rows] == [("X", 0.9), ("Y", 0.56)]


@pytest.mark.parametrize("shard", [2, 100])
def test_keyword_hits(spark, shard):
    texts = ["abcabc", "xyz", "", "héllo wörld", "aaa", "x" * 5000 + "abc"]
    words = ["abc", "bca", "llo", "örl", "aaaa", "aa", "z", "abc"]
    df = spark.createDataFrame([*enumerate(texts), (None, None), (99, None)], "id int, t string")
    keywords = spark.createDataFrame([*[(w, i) for i, w in enumerate(words)], ("", 98), (None, 99)], "keyword string, n int")
    rows = C.keyword_hits(df, "id", "t", keywords, shard).collect()
    expected = sorted((i, w, n) for i, t in enumerate(texts) for n, w in enumerate(words) if w in t)
    assert sorted((r.id, r.keyword, r.n) for r in rows) == expected
