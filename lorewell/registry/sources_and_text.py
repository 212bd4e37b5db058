"""Registered queries: sources, row checks, addresses, text and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell.functions import dates, hashing, numbers, text, urls
from lorewell.operators import admission, html, validate
from lorewell.registry import views as V
from lorewell.registry.core import query
from lorewell.sources import tables

BLANKS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_ENDS = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def sql_strip(value: str) -> str:
    return f"regexp_replace({value}, '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g')"


def sql_fold(value: str) -> str:
    return sql_strip(f"regexp_replace({value}, '[{BLANKS}]+', ' ', 'g')")


def sql_blank(value: str) -> str:
    return f"({value} is null or not regexp_matches({value}, '[^{BLANKS}]'))"


def sql_trim(value: str) -> str:
    return f"regexp_replace({value}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


@query("catalog_scan", V.with_views(
    "select id, title, filename, source, status, source_type, source_url, category, content_hash, created_time from v_catalog",
    "v_catalog"))
def catalog_scan(spark, sf):
    return tables.catalog_scan(V.catalog(spark, sf)).select(
        "id", "title", "filename", "source", "status", "source_type", "source_url", "category", "content_hash", "created_time")


@query("page_snapshot", """
    select page_id, case when status = 304 then 'UNCHANGED' when status >= 400 or not contains(kind, 'html') then 'FAILED' else 'PARSE' end route
    from (select page_id, case when url like 'http://%' then 304 when url like '%#top' then 503 else 200 end status,
        case when contains(url, '?') then 'application/json' else 'text/html' end kind from pages)""")
def page_snapshot(spark, sf):
    url = F.col("url")
    pages = V.table(spark, sf, "pages").select(
        "page_id",
        F.when(url.startswith("http://"), 304).when(url.endswith("#top"), 503).otherwise(200).alias("http_status"),
        F.when(url.contains("?"), "application/json").otherwise("Text/HTML; charset=utf-8").alias("content_type"))
    return tables.route_pages(pages).select("page_id", "route")


@query("upload_scan", """
    select doc_id, concat('doc ', cast(doc_id as varchar), '.', ext) filename, coalesce(case
        when ext = 'txt' then 'unsupported_type' when bytes > 8000 then 'too_large'
        when ext = 'docx' and n_chars <= 2000 then 'content_mismatch' end, 'ok') rejected
    from (select doc_id, n_chars, case lang when 'en' then 'docx' when 'de' then 'pdf' else 'txt' end ext,
        strlen(text) + case when lang = 'de' or lang = 'en' and n_chars > 2000 then 4 else 0 end bytes from documents)""")
def upload_scan(spark, sf):
    lang = F.col("lang")
    extension = F.when(lang == "en", "docx").when(lang == "de", "pdf").otherwise("txt")
    head = F.when(lang == "de", F.expr("X'25504446'")).when((lang == "en") & (F.col("n_chars") > 2000), F.expr("X'504B0304'")) \
        .otherwise(F.expr("X''"))
    content = F.concat(head, F.col("text").cast("binary"))
    files = V.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("file:/in/doc%20"), F.col("doc_id").cast("string"), F.lit("."), extension).alias("path"),
        content.alias("content")).withColumn("length", F.octet_length("content").cast("long"))
    return tables.check_uploads(files, max_bytes=8000).select(
        "doc_id", "filename", F.coalesce("rejected", F.lit("ok")).alias("rejected"))


@query("alias_dictionary", """
    select p_brand canonical, p_brand as alias, 'LIFE' category from part group by all
    union all select distinct p_brand, p_type, 'LIFE' from part""")
def alias_dictionary(spark, sf):
    terms = V.table(spark, sf, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("types")).select(
        F.array(F.struct(F.col("p_brand").alias("canonical"), F.col("types").alias("aliases"),
                         F.lit("LIFE").alias("category"))).alias("terms"))
    return tables.explode_aliases(terms).select("canonical", "alias", "category")


@query("dry_run", V.with_views("""
    select c.url, 'DRY_RUN' as action from v_crawled c left join v_state s using (url)
    where not coalesce(s.indexed_at is not null and (c.http_status = 304 or c.content_hash = s.content_hash), false)""",
    "v_crawled", "v_state"))
def dry_run(spark, sf):
    changed = admission.detect_change(V.crawled(spark, sf), V.crawl_state(spark, sf)).where("change = 'CHANGED'")
    return tables.dry_run(changed.select("url"), execute=False)


@query("validate_rows", V.with_views(f"""
    select id, concat_ws(',', case when {sql_blank('title')} then 'title_missing' end, case when length(title) > 255 then 'title_too_long' end,
        case when {sql_blank('content')} then 'content_missing' end, case when length(content) > 2000000 then 'content_too_long' end,
        case when {sql_blank('source')} then 'source_missing' end, case when length(source) > 128 then 'source_too_long' end,
        case when {sql_blank('source_url')} then 'url_missing' end, case when length(source_url) > 768 then 'url_too_long' end,
        case when category is null then 'category_missing' end, case when category not in ('NEW_STUDENT', 'ACADEMIC', 'LIFE', 'MAJOR', 'CAREER',
            'SCHOOL_OVERVIEW', 'ORGANIZATION', 'RESEARCH') then 'category_unknown' end,
        case when not regexp_matches(content_hash, '^[a-f0-9]{{64}}$') then 'hash_malformed' end) reasons from v_catalog""", "v_catalog"))
def validate_rows(spark, sf):
    valid, quarantine = validate.validate_rows(V.catalog(spark, sf), validate.crawled_document_rules())
    return valid.select("id", F.lit("").alias("reasons")).unionByName(
        quarantine.select("id", F.array_join("reasons", ",").alias("reasons")))


@query("backfill_defaults", """
    select doc_id id, case when lang = 'en' then 'run' else concat('legacy-', cast(doc_id as varchar)) end run_id,
        case when lang = 'en' then lang else 'UNKNOWN' end category, case when lang = 'en' then source else '' end expected_source,
        quality = 1 has_source, lang = 'en' and toxic = 1 keyword_match, text <> '' non_empty
    from documents join labels using (doc_id)""")
def backfill_defaults(spark, sf):
    known = F.col("lang") == "en"
    rows = V.table(spark, sf, "documents").join(V.table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"), F.when(known, "run").alias("run_id"), F.when(known, F.col("lang")).alias("category"),
        F.when(known, F.col("source")).alias("expected_source"), F.when(known, F.col("quality") == 1).alias("has_source"),
        (F.col("quality") == 1).alias("source_match"), F.when(known, F.col("toxic") == 1).alias("keyword_match"),
        F.when(known, F.lit(True)).alias("non_empty"), F.col("text").alias("answer"))
    return validate.backfill_evaluation(rows).drop("answer", "source_match")


@query("backfill_expiry", """
    select event_id conversation_id, case when event_type in ('view', 'error') then ts + interval 90 day else timestamp '2030-01-01' end expire_time
    from events""")
def backfill_expiry(spark, sf):
    kind = F.col("event_type")
    rows = V.table(spark, sf, "events").select(
        F.col("event_id").alias("conversation_id"), F.when(kind != "view", F.lit("s")).alias("anonymous_session_id"),
        F.col("ts").alias("updated_time"), F.when(kind != "error", F.lit("2030-01-01").cast("timestamp_ntz")).alias("expire_time"))
    return validate.backfill_expiry(rows).select("conversation_id", "expire_time")


@query("normalize_url", r"""
    select page_id, case when regexp_matches(lower(path), '\.(jpg|jpeg|png|gif|svg|zip|rar|7z|mp4|mp3|doc|docx|xls|xlsx|ppt|pptx|pdf)$') then null
        else concat(lower(scheme), '://', lower(authority), case when path = '' then '/' else path end,
            case when len(kept) = 0 then '' else concat('?', array_to_string(kept, '&')) end) end normalized
    from (select page_id, scheme, authority, path, list_filter(string_split(query, '&'), lambda q:
            q <> '' and not regexp_matches(lower(q), '^(utm_|from|spm)')) kept
        from (select page_id, regexp_extract(url, '^([a-zA-Z]+)://', 1) scheme, regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) authority,
            regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) path, regexp_extract(url, '\?([^#]*)', 1) query from pages))""")
def normalize_url(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("normalized"))


@query("official_url", r"""
    select page_id, url like 'https://%' and (host = 'blog.tionsh.example.net' or host like '%.example.org') official
    from (select page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) host from pages)""")
def official_url(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", urls.official_url(
        F.col("url"), ["blog.tionsh.example.net"], ["example.org"]).alias("official"))


@query("official_url_by_table", r"""
    select page_id from (select page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) host from pages) p
    where url like 'https://%' and (host like '%.example.org' or host in (
        select regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) from pages where contains(url, '?')))""")
def official_url_by_table(spark, sf):
    pages = V.table(spark, sf, "pages")
    hosts = pages.where(F.contains("url", F.lit("?"))).select(urls.host(F.col("url")).alias("host"))
    return urls.keep_official(pages.select("page_id", "url"), "url", hosts, ["example.org"]).select("page_id")


@query("published_time", r"""
    select event_id, case event_type when 'view' then date_trunc('day', ts) when 'click' then date_trunc('day', ts)
        when 'signup' then date_trunc('day', ts) when 'purchase' then date_trunc('day', ts) end published from events""")
def published_time(spark, sf):
    kind, ts = F.col("event_type"), F.col("ts")
    meta = F.when(kind == "view", F.date_format(ts, "yyyy年M月d日")).when(kind == "signup", "2024-13-40")
    content = F.when(kind == "click", F.concat(F.lit("on "), F.date_format(ts, "yyyy/M/d"))).when(
        kind == "signup", F.concat(F.lit("x "), F.date_format(ts, "yyyy.MM.dd"))).otherwise("none 1999-01-01")
    url = F.when(kind == "purchase", F.concat(F.lit("https://h.example/"), F.date_format(ts, "yyyy/MMdd"), F.lit("/p.htm"))) \
        .otherwise("https://h.example/2024/9999/")
    rows = V.table(spark, sf, "events").select("event_id", meta.alias("meta"), content.alias("content"), url.alias("url"))
    return rows.select("event_id", dates.published_time(
        [F.col("meta")], F.col("content"), F.col("url"), None).alias("published"))


@query("last_updated", r"""
    select event_id, case event_type when 'view' then ts when 'click' then date_trunc('second', ts) else timestamp '2024-12-31' end updated,
        timestamp '2021-02-28 10:00:00' since from events""")
def last_updated(spark, sf):
    kind, ts = F.col("event_type"), F.col("ts")
    header = F.when(kind == "click", F.date_format(ts, "E, dd MMM yyyy HH:mm:ss 'GMT'")).when(kind == "error", "not a date")
    rows = V.table(spark, sf, "events").select(
        "event_id", F.when(kind == "view", ts).alias("published"), header.alias("header"),
        F.lit("2024-02-29 10:00:00").cast("timestamp_ntz").alias("leap"))
    return rows.select(
        "event_id", dates.last_updated(F.col("published"), F.col("header"), F.lit("2024-12-31").cast("timestamp_ntz")).alias("updated"),
        dates.years_before(F.col("leap"), 3).alias("since"))


@query("clean_lines", f"""
    select doc_id, array_to_string(list_filter(kept, lambda line, i: i = 1 or line <> kept[i - 1]), chr(10)) cleaned
    from (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '{LINE_ENDS}'), lambda x: {sql_fold('x')}),
        lambda x: x <> '' and x not in ('首页', '更多', '返回', '关闭')) kept from documents)""")
def clean_lines(spark, sf):
    return V.table(spark, sf, "documents", heavy=True).select("doc_id", text.clean_lines(F.col("text")).alias("cleaned"))


@query("clean_document_text", "select doc_id, " + sql_strip(
    "regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(0), ' '), chr(13) || chr(10), chr(10)), "
    "'[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')") + " cleaned from documents")
def clean_document_text(spark, sf):
    return V.table(spark, sf, "documents", heavy=True).select("doc_id", text.clean_document_text(F.col("text")).alias("cleaned"))


@query("is_detail", r"""
    select page_id, contains(html, '<article>') or contains(lower(url), '/page.htm') or regexp_matches(url, '/20\d{2}/\d{4}/') is_detail from pages""")
def is_detail(spark, sf):
    return V.table(spark, sf, "pages").select(
        "page_id", urls.is_detail_page(F.contains("html", F.lit("<article>")), F.col("url")).alias("is_detail"))


@query("content_hash", V.with_views(f"""
    select id, sha256(concat({sql_strip('title')}, chr(10), {sql_strip('content')}, chr(10), strftime(last_updated, '%Y-%m-%dT%H:%M:%S'))) digest
    from v_catalog""", "v_catalog"))
def content_hash(spark, sf):
    return V.catalog(spark, sf, heavy=True).select("id", hashing.content_hash(
        F.col("title"), F.col("content"), hashing.iso_date_text(F.col("last_updated"))).alias("digest"))


@query("source_name", r"""
    with hosts as (select page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) host from pages),
    names as (select host, concat('site ', host) as name from hosts group by host having count(*) > 1)
    select page_id, coalesce(name, concat('官方站点（', host, '）')) source from hosts left join names using (host)""")
def source_name(spark, sf):
    pages = V.table(spark, sf, "pages").select("page_id", "url")
    names = pages.groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n")).where("n > 1").select(
        "host", F.concat(F.lit("site "), F.col("host")).alias("name"))
    return urls.source_name(pages, "url", names).select("page_id", "source")


@query("display_title", V.with_views(f"""
    select id, coalesce(case when length(title) <= 60 and not {sql_blank('title')} then {sql_trim('title')} end,
        concat('doc-', cast(id as varchar))) shown, case when status = 'FAILED' then '未知来源' else source end source from v_catalog""", "v_catalog"))
def display_title(spark, sf):
    return V.catalog(spark, sf).select(
        "id", text.display_title(F.when(F.length("title") <= 60, F.col("title")), F.col("filename")).alias("shown"),
        text.source_or_default(F.when(F.col("status") == "FAILED", F.lit(" \t")).otherwise(F.col("source"))).alias("source"))


@query("filename_stem", "select doc_id, concat(source, ' ', lang, ' v1.', cast(doc_id as varchar)) stem from documents")
def filename_stem(spark, sf):
    name = F.concat(F.upper("source"), F.lit(" "), F.col("lang"), F.lit(" ｖ１."), F.col("doc_id").cast("string"),
                    F.lit("的副本 (原 DOCX 文件转换 ).docx"))
    return V.table(spark, sf, "documents", heavy=True).select("doc_id", text.filename_stem(name).alias("stem"))


@query("first_page_heading", f"""
    select doc_id, substr(array_to_string(list_slice(list_filter(list_transform(regexp_split_to_array(text, '{LINE_ENDS}'),
        lambda x: {sql_strip('x')}), lambda x: x <> ''), 1, 6), chr(10)), 1, 480) heading from documents""")
def first_page_heading(spark, sf):
    return V.table(spark, sf, "documents", heavy=True).select("doc_id", text.first_lines(F.col("text")).alias("heading"))


@query("file_size_label", """
    select doc_id, case when n < 1048576 then concat(printf('%.1f', floor(greatest(n / 1024.0::double, 0.1) * 10 + 0.5) / 10), ' KB')
        else concat(printf('%.1f', floor(n / 1048576.0::double * 10 + 0.5) / 10), ' MB') end size_label
    from (select doc_id, case when lang = 'en' then n_chars * 700 else n_chars end n from documents)""")
def file_size_label(spark, sf):
    size = F.when(F.col("lang") == "en", F.col("n_chars") * 700).otherwise(F.col("n_chars"))
    return V.table(spark, sf, "documents").select("doc_id", numbers.file_size_label(size).alias("size_label"))


def sql_unescape(value: str) -> str:
    for entity, character in (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©")):
        value = f"replace({value}, '{entity}', '{character}')"
    return f"regexp_replace({value}, '&amp;?', '&', 'g')"


# The pages keep their text in one article; a short one gives way to the body without its frame.
def _sql_pieces(source: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array({source}, '<[^>]*>'), lambda p: {sql_strip(sql_unescape('p'))}), "
            "lambda p: p <> '')")


_BODY = "regexp_extract(html, '(?s)<body[^>]*>(.*)', 1)"
for _frame in ("<!--.*?-->", "<nav.*?</nav>", "<footer.*?</footer>", "<script.*?</script>", "<style.*?</style>"):
    _BODY = f"regexp_replace({_BODY}, '(?s){_frame}', '<br>', 'g')"
_ARTICLE_SQL = f"""
    with parts as (select page_id, html, {_sql_pieces("regexp_extract(html, '(?s)<article>(.*)</article>', 1)")} article from pages),
    chosen as (select page_id, html, length(array_to_string(article, ' ')) >= 80 selected,
        case when length(array_to_string(article, ' ')) >= 80 then article else {_sql_pieces(_BODY)} end pieces from parts),
    lines as (select page_id, html, selected, list_filter(list_transform(flatten(list_transform(pieces, lambda p: regexp_split_to_array(p, '{LINE_ENDS}'))),
        lambda x: {sql_fold('x')}), lambda x: x <> '') kept from chosen),
    body as (select page_id, html, selected, array_to_string(list_filter(kept, lambda line, i: i = 1 or line <> kept[i - 1]), chr(10)) content from lines)"""


@query("extract_title", _ARTICLE_SQL + f"""
    select page_id, substr({sql_fold(sql_unescape("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))}, 1, 255) title, selected is_detail from body""")
def extract_title(spark, sf):
    return html.parse_pages(V.table(spark, sf, "pages", heavy=True)).select("page_id", "title", "is_detail")


@query("extract_main_text", _ARTICLE_SQL + r"""
    select page_id, sha256(content) digest, length(content) chars, try_cast(regexp_replace(regexp_extract(content, '20\d{2}[-./年]\d{1,2}[-./月]\d{1,2}'),
        '^(\d+).(\d+).(\d+)$', '\1-\2-\3') as timestamp) published_time from body""")
def extract_main_text(spark, sf):
    return html.parse_pages(V.table(spark, sf, "pages", heavy=True), content_chars=None).select(
        "page_id", F.sha2("content", 256).alias("digest"), F.length("content").alias("chars"), "published_time")


@query("extract_links", r"""
    with found as (select page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) href,
        generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) pos from pages)
    select page_id, dst, row_number() over (partition by page_id order by pos) - 1 pos from (
        select page_id, concat(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), href) dst, min(pos) pos from found group by 1, 2)""")
def extract_links(spark, sf):
    parsed = html.parse_pages(V.table(spark, sf, "pages", heavy=True))
    return parsed.select("page_id", F.posexplode_outer("links").alias("pos", "link")).where("link is not null").select(
        "page_id", F.col("link")["url"].alias("dst"), "pos")
