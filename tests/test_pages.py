from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorewell.functions import dates, text, urls
from lorewell.operators.html import parse_pages
from lorewell.operators.robots import robots_allowed

NOTICE = """<!doctype html><html><head><title>选课通知 - 某学院</title></head><body><nav>首页 机构设置 <a href="/about">关于</a></nav>
<main><h1>第一学期
 选课通知</h1><div class="meta">发布时间：2026-06-10</div><div class="x wp_articlecontent"><p>选课前请阅读<b>网上选课指南</b>，</p><p>更多</p>
<p>正式选课时间和补改选时间以学院通知为准，选课完成后请进入教务系统核对已选课程，如有问题请联系老师处理。</p><p>重复行</p><p>重复行</p>
<p>学生应在规定时间内完成选课，逾期系统关闭不再补选，退课同样在系统内办理并在截止之前确认结果。</p>
<a href="../c1a2/page.htm?utm_source=x&amp;b=1#top">下一篇</a><a href="/files/a.PDF">附件</a></div></main>
<footer>版权所有</footer><script>var a = "<p>no</p>"</script></body></html>"""


def test_notice_page(spark):
    df = spark.createDataFrame([("https://a.example.org/2026/0611/c1a1/page.htm", NOTICE)], "url string, html string")
    row = parse_pages(df).first()
    assert row.title == "第一学期 选课通知"
    assert row.published_time == datetime(2026, 6, 11)  # the date sits outside the content block
    assert "网上选课指南" in row.content and "版权" not in row.content and "机构设置" not in row.content
    assert row.content.split("\n").count("重复行") == 1 and "更多" not in row.content.split("\n")
    assert row.is_detail
    assert [tuple(k) for k in row.links] == [
        ("https://a.example.org/about", "关于"), ("https://a.example.org/2026/0611/c1a2/page.htm?b=1", "下一篇")]
    assert [k.url for k in row.content_links] == ["https://a.example.org/2026/0611/c1a2/page.htm?b=1"]


def test_page_fallbacks(spark):
    pages = [
        ("u1", "<html><head><meta property='og:title' content=' A  B '></head><body>short<main>x</main></body></html>"),
        ("u2", "<title>Name_of | site</title><p>text 2023/13/40 and 2024年5月6日"),
        ("u3", ""),
        ("u4", "<body><main>" + "word " * 40 + "</main><meta name='date' content='2022-01-02'></body>"),
    ]
    df = spark.createDataFrame([(f"https://h.example.org/{u}", h) for u, h in pages], "url string, html string")
    rows = {r.url[-2:]: r for r in parse_pages(df).collect()}
    assert [rows[u].title for u in ("u1", "u2", "u3", "u4")] == ["A B", "Name", "未命名网页", "未命名网页"]
    assert rows["u1"].content == "short\nx" and not rows["u4"].is_detail
    assert rows["u2"].published_time is None  # the first date is the one that counts
    assert rows["u4"].published_time == datetime(2022, 1, 2)


@pytest.mark.parametrize("raw, expected", [
    ("HTTPS://WWW.Example.ORG/A?utm_source=1&b=2&c=&from=x#t", "https://www.example.org/A?b=2&c="),
    ("http://h.example.org", "http://h.example.org/"), ("ftp://h.example.org/", None), ("https:///x", None),
    ("https://h.example.org/a.Docx?x=1", None), ("mailto:a@b", None), ("https://h.example.org/?a=1+2&b=%E4%BD%A0", "https://h.example.org/?a=1+2&b=%E4%BD%A0"),
    ("https://h.example.org/p?flag", "https://h.example.org/p?flag="),
])
def test_normalize_url(spark, raw, expected):
    assert spark.range(1).select(urls.normalize_url(F.lit(raw))).first()[0] == expected


@pytest.mark.parametrize("href, expected", [
    ("b", "https://h.example.org/d/b"), ("/b", "https://h.example.org/b"), ("../b", "https://h.example.org/b"), ("?q=1", "https://h.example.org/d/a?q=1"),
    ("//o.example.org/x", "https://o.example.org/x"), ("#t", "https://h.example.org/d/a?z=1#t"), ("http://x.org/y", "http://x.org/y"),
    ("./c/./d/../e", "https://h.example.org/d/c/e"),
])
def test_resolve_url(spark, href, expected):
    base = "https://h.example.org/d/a?z=1"
    assert spark.range(1).select(urls.resolve_url(F.lit(base), F.lit(href))).first()[0] == expected


@pytest.mark.parametrize("url, expected", [
    ("https://a.example.org/x", True), ("https://example.org/x", False), ("http://a.example.org/", False), ("https://u:p@a.example.org/", False),
    ("https://a.example.org:443/", True), ("https://a.example.org:8443/", False), ("https://listed.net/", True), (None, False),
])
def test_official_url(spark, url, expected):
    column = urls.official_url(F.lit(url).cast("string"), ["listed.net"], ["example.org"])
    assert spark.range(1).select(column).first()[0] is expected


def test_text_cleaning(spark):
    def one(column):
        return spark.range(1).select(column).first()[0]

    assert one(text.clean_document_text(F.lit("a\x00b \t c\r\n \n\n\n　d "))) == "a b c\n\n　d"
    assert one(text.strip(F.lit("　 x\x1f\n"))) == "x"
    assert one(text.drop_extension(F.lit("a.b.pdf"))) == "a.b" and one(text.drop_extension(F.lit(".env"))) == ".env"
    assert one(text.filename_stem(F.lit("Ａ计划 的副本（原XLSX转换）.pdf"))) == "a计划"


def test_dates(spark):
    def one(column):
        return spark.range(1).select(column).first()[0]

    assert one(dates.http_date(F.lit("Wed, 21 Oct 2015 07:28:00 GMT"))) == datetime(2015, 10, 21, 7, 28)
    assert one(dates.http_date(F.lit("soon"))) is None
    leap = F.lit("2024-02-29 10:11:12").cast("timestamp_ntz")
    assert one(dates.years_before(leap, 1)) == datetime(2023, 2, 28, 10, 11, 12)
    assert one(dates.local_time(F.lit("2024-01-01 20:00:00").cast("timestamp_ntz"))) == datetime(2024, 1, 2, 4)


def test_robots(spark):
    body = ("# c\nUser-agent: other\nUser-agent: Named\nDisallow: /x\nAllow: /\n\nUser-agent: *\nDisallow:\n\nDisallow: /ignored\n"
            "User-agent: late\n\nUser-agent: *\nDisallow: /second")
    robots = spark.createDataFrame(
        [("https://a", 200, body), ("https://b", 403, ""), ("https://c", 404, ""), ("https://d", None, None), ("https://e", 200, "User-agent: *\nDisallow: /p%20q\nDisallow: /w")],
        "origin string, status int, body string")
    cases = [("https://a/x1", False), ("https://a/ignored", True), ("https://b/", False), ("https://c/", True), ("https://d/", False),
             ("https://e/p q", False), ("https://e/ok", True), ("https://e/w?x", False), ("https://unknown/", True)]
    df = spark.createDataFrame([(u,) for u, _ in cases], "url string")
    rows = {r.url: r.allowed for r in robots_allowed(df, "url", robots, "NamedBot/1.0").collect()}
    assert rows == dict(cases)
    rows = {r.url: r.allowed for r in robots_allowed(df, "url", robots, "someone").collect()}
    assert rows["https://a/x1"]
