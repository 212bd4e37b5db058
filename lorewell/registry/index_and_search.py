"""Registered queries: chunks, embeddings, index upkeep, question understanding, retrieval."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from uuid import uuid4
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.functions import hashing, tokens
from lorewell.operators import chunks as C
from lorewell.operators import classify, embed, index
from lorewell.operators import question as Q
from lorewell.operators import retrieve as R
from lorewell.plans import search, upload_index, web_index
from lorewell.registry import views as V
from lorewell.registry.core import query
from lorewell.registry.rules_and_crawl import TEST_RULES, TEST_RULES_SQL
from lorewell.registry.sources_and_text import sql_blank, sql_strip
from lorewell.scale import cut_lineage, in_pieces, join_short, rows_of_keys, shared_folder
from lorewell.sources import tables
from lorewell.sources.documents import WORDS


@query("enrich_text", V.with_views("""
    select id, sha256(concat('文件名：', filename, chr(10), '来源：', source, chr(10), '分类：', coalesce(category, '未分类'), chr(10), '页码：', 3, chr(10),
        '正文：', chr(10), content)) digest from v_catalog""", "v_catalog"))
def enrich_text(spark, sf):
    return V.catalog(spark, sf).select("id", F.sha2(C.enrich_text(
        F.col("filename"), F.col("source"), F.col("category"), F.lit(3), F.col("content")), 256).alias("digest"))


@query("chunk_text", "select doc_id, true within_size, true offsets_match, true nothing_lost from documents")
def chunk_text(spark, sf):
    """Every chunk within the size and found at its offset; no visible character outside all chunks."""
    split = C.chunk_text(500, 50)
    rows = V.table(spark, sf, "documents", heavy=True).select("doc_id", "text", split(F.col("text")).alias("chunks"))
    ends = F.transform("chunks", lambda c: c["start"] + F.length(c["text"]))
    gaps = F.transform(F.sequence(F.lit(0), F.size("chunks")), lambda i: F.substring(
        F.col("text"), F.coalesce(F.get(ends, i - 1), F.lit(0)) + 1,
        F.greatest(F.lit(0), F.coalesce(F.get("chunks", i)["start"], F.length("text")) - F.coalesce(F.get(ends, i - 1), F.lit(0)))))
    return rows.select(
        "doc_id", F.forall("chunks", lambda c: F.length(c["text"]) <= 500).alias("within_size"),
        F.forall("chunks", lambda c: F.substring(F.col("text"), c["start"] + 1, F.length(c["text"])) == c["text"]).alias("offsets_match"),
        F.forall(gaps, lambda g: ~g.rlike(r"[^\s\x{1c}-\x{1f}\x{85}\x{a0}]")).alias("nothing_lost"))


@query("chunk_overlap", """
    select doc_id, case when n <= 500 then '0' else array_to_string(list_transform(range(0, cast(ceil((n - 500) / 400.0) as bigint) + 1),
        lambda i: i * 400), ',') end starts, least(n, 500) first_length, n covered
    from (select doc_id, length(text) n from documents) where n > 0""")
def chunk_overlap(spark, sf):
    """Texts of the same lengths without any separator: every chunk but the last is full and repeats 100 characters."""
    split = C.chunk_text(500, 100)
    rows = V.table(spark, sf, "documents", heavy=True).select("doc_id", split(F.regexp_replace("text", "(?s).", "x")).alias("chunks"))
    last = F.element_at("chunks", -1)
    return rows.where(F.size("chunks") > 0).select(
        "doc_id", F.array_join(F.transform("chunks", lambda c: c["start"].cast("string")), ",").alias("starts"),
        F.length(F.get("chunks", F.lit(0))["text"]).alias("first_length"), (last["start"] + F.length(last["text"])).alias("covered"))


@query("number_chunks", """
    select conv_id document_id, turn page, row_number() over (partition by conv_id order by turn, pos) - 1 chunk_index, content
    from (select conv_id, turn, unnest(string_split(text, chr(10))) content, generate_subscripts(string_split(text, chr(10)), 1) pos from conversations)""")
def number_chunks(spark, sf):
    pages = V.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("document_id"), F.col("turn").alias("page"),
        F.transform(F.split("text", "\n"), lambda t: F.struct(t.alias("text"), F.lit(0).alias("start"))).alias("chunks"))
    return C.number_chunks(pages, slice_pages=2).drop("start")


@query("document_id", V.with_views("""
    select id, sha256(content || chr(0) || filename || chr(0) || source) upload_id, sha256(source_url || chr(0) || content_hash) web_id from v_catalog""",
    "v_catalog"))
def document_id(spark, sf):
    return V.catalog(spark, sf).select(
        "id", hashing.upload_document_id(F.col("content"), F.col("filename"), F.col("source")).alias("upload_id"),
        hashing.web_document_id(F.col("source_url"), F.col("content_hash")).alias("web_id"))


@query("chunk_id", """
    select count(*) chunks, count(distinct (conv_id, turn, role, text)) ids from conversations""")
def chunk_id(spark, sf):
    rows = V.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("document_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"), "role")
    return index.with_chunk_id(rows, ["role"]).agg(
        F.count("*").alias("chunks"), F.count_distinct("chunk_id").alias("ids"))


def index_versions(spark, sf):
    """The old index holds all documents (Spanish ones without address). Labelled documents come
    back: good ones under a new id, the others under their own id with another address."""
    documents = V.catalog(spark, sf)
    old = documents.select(
        F.col("id").cast("string").alias("document_id"), F.lit(0).alias("chunk_index"),
        F.when(F.col("category").isNotNull(), F.col("source_url")).alias("source_url"), F.lit("old").alias("content"))
    labels = V.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    good = F.col("quality") == 1
    new = documents.join(labels, "id").select(
        F.when(good, F.concat(F.lit("n"), F.col("id").cast("string"))).otherwise(F.col("id").cast("string")).alias("document_id"),
        F.lit(0).alias("chunk_index"), F.when(good, F.col("source_url")).otherwise(" ").alias("source_url"), F.lit("new").alias("content"))
    return old, new


@query("replace_index", V.with_views("""
    , l as (select * from v_catalog join labels using (doc_id))
    select cast(id as varchar) document_id, case when category is not null then source_url end source_url, 'old' content from v_catalog
    where doc_id not in (select doc_id from l where quality = 0) and not (category is not null and doc_id in (select doc_id from l where quality = 1))
    union all select case when quality = 1 then concat('n', cast(id as varchar)) else cast(id as varchar) end,
        case when quality = 1 then source_url else ' ' end, 'new' from l""", "v_catalog"))
def replace_index(spark, sf):
    old, new = index_versions(spark, sf)
    return index.replace_index(old, new).select("document_id", "source_url", "content")


@query("delete_index_rows", V.with_views("select chunk_key from v_chunks where document_id not in (select doc_id from labels)", "v_chunks"))
def delete_index_rows(spark, sf):
    gone = V.table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"))
    return index.delete_index_rows(V.chunks(spark, sf), gone).select("chunk_key")


@query("hash_embedding", """
    select doc_id, case when regexp_matches(lower(text), '[a-z0-9]') then 1.0 else 0.0 end norm, 128 dimensions from documents""")
def hash_embedding(spark, sf):
    vector = embed.hash_embedding(128)(F.col("text"))
    rows = V.table(spark, sf, "documents", heavy=True).select("doc_id", vector.alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.select("doc_id", F.round(norm, 4).alias("norm"), F.size("v").alias("dimensions"))


@query("hash_tokens", """
    select doc_id, sha256(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) digest, len(regexp_extract_all(lower(text), '[a-z0-9]+')) n
    from documents""")
def hash_tokens(spark, sf):
    rows = V.table(spark, sf, "documents", heavy=True).select("doc_id", tokens.hash_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.sha2(F.array_join("t", " "), 256).alias("digest"), F.size("t").alias("n"))


@query("index_summary", V.with_views("""
    select document_id, concat('f', cast(document_id as varchar)) filename, count(*) chunks_indexed, min(category) category from v_chunks group by 1, 2""",
    "v_chunks"))
def index_summary(spark, sf):
    return index.index_summary(V.chunks(spark, sf).withColumn("filename", F.concat(F.lit("f"), F.col("document_id").cast("string"))))


@query("web_index_job", V.with_views(
    "select sha256(source_url || chr(0) || content_hash) document_id, title filename, category, true has_vectors from v_catalog", "v_catalog"))
def web_index_job(spark, sf):
    rows = web_index.web_index_job(V.catalog(spark, sf, heavy=True).withColumn("title", F.regexp_replace("title", r"[\x00-\x20]+", " ")), embed.hash_embedding(64))
    return rows.groupBy("document_id").agg(
        F.min("filename").alias("filename"), F.min("category").alias("category"), F.bool_and(F.size("vector") == 64).alias("has_vectors"))


@F.pandas_udf(T.BinaryType())
def _docx(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Texts as word-processor files, one paragraph per line."""
    def pack(text: str) -> bytes:
        paragraphs = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            archive.writestr(zipfile.ZipInfo("word/document.xml"), f'<w:document xmlns:w="{WORDS}"><w:body>{paragraphs}</w:body></w:document>')
        return out.getvalue()

    for texts in in_pieces(batches):
        yield texts.map(pack)


@query("upload_index_job", f"""
    select case when lang = 'fr' then concat('/in/', cast(doc_id as varchar), '.txt') when {sql_blank('text')} then concat('/in/', cast(doc_id as varchar), '.docx')
        else concat(cast(doc_id as varchar), '.docx') end id,
        case when lang = 'fr' then 'unsupported_type' when {sql_blank('text')} then 'no_text' else 'indexed' end outcome from documents
    union all select concat('/in/again/', cast(doc_id as varchar), '.docx'), 'no_text' from documents where lang = 'en' and {sql_blank('text')}""")
def upload_index_job(spark, sf):
    """Documents as word-processor files; French ones have the wrong type, English ones are there twice."""
    documents = V.table(spark, sf, "documents", heavy=True)
    twice = F.when(F.col("lang") == "en", F.array(F.lit("/in/"), F.lit("/in/again/"))).otherwise(F.array(F.lit("/in/")))
    extension = F.when(F.col("lang") == "fr", ".txt").otherwise(".docx")
    files = documents.select("doc_id", "source", "lang", _docx("text").alias("content"), F.explode(twice).alias("folder")).select(
        F.concat("folder", F.col("doc_id").cast("string"), extension).alias("path"), "content", "source", F.lit("2024-01-01").alias("upload_time"))
    files = cut_lineage(files)  # stands for the stored files
    checked = tables.check_uploads(files.withColumn("length", F.octet_length("content").cast("long")))
    rows, rejected = upload_index.upload_index_job(checked, embed=embed.hash_embedding(64))
    return rows.where("chunk_index = 0").select(F.col("filename").alias("id"), F.lit("indexed").alias("outcome")).unionByName(
        rejected.select(F.col("path").alias("id"), F.col("error").alias("outcome")))


# --- questions -------------------------------------------------------------------------------

@query("validate_aliases", """
    select distinct p_type as alias, 'category_invalid' problem from part where p_size > 40
    union all select p_type, 'alias_conflict' from part group by p_type having count(distinct p_brand) > 1""")
def validate_aliases(spark, sf):
    rows = V.table(spark, sf, "part").select(
        F.col("p_brand").alias("canonical"), F.col("p_type").alias("alias"), F.when(F.col("p_size") > 40, "ODD").otherwise("LIFE").alias("category"))
    return Q.alias_violations(rows)


ALIASES = [("tion", "ation"), ("tion", "ati"), ("there", "the"), ("und", "und"), ("lich", "licht"), ("que", "qu")]


def _aliases(spark):
    return spark.createDataFrame([(c, a, i) for i, (c, a) in enumerate(ALIASES)], "canonical string, alias string, seq long")


_ALIAS_SQL = """
    with found as (select doc_id, text, list_filter([{'c': 'tion', 'a': 'ation'}, {'c': 'lich', 'a': 'licht'}, {'c': 'tion', 'a': 'ati'},
        {'c': 'there', 'a': 'the'}, {'c': 'und', 'a': 'und'}, {'c': 'que', 'a': 'qu'}], lambda m: contains(text, m.a)) m from documents),
    visible as (select doc_id, text, list_filter(m, lambda x, i: len(list_filter(m[1:i - 1], lambda y: contains(y.a, x.a))) = 0) m from found),
    terms as (select doc_id, text, list_transform(list_filter(m, lambda x: x.a <> x.c and not contains(text, x.c)), lambda x: x.c) t from visible)
    select doc_id, array_to_string(u, ',') terms, sha256(case when len(u) = 0 then text else
        concat(text, chr(10), '检索规范词：', array_to_string(u, '、')) end) digest from
        (select doc_id, text, list_filter(t, lambda x, i: list_position(t, x) = i) u from terms)"""


def _expanded(rows):
    return rows.select("doc_id", F.array_join("canonical_terms", ",").alias("terms"), F.sha2("retrieval_question", 256).alias("digest"))


@query("expand_aliases", _ALIAS_SQL)
def expand_aliases(spark, sf):
    return _expanded(Q.expand_aliases(V.table(spark, sf, "documents", heavy=True), "text", _aliases(spark)))


@query("expand_aliases_by_join", _ALIAS_SQL)
def expand_aliases_by_join(spark, sf):
    """The same with a dictionary cut into shards of one alias."""
    return _expanded(Q.expand_aliases(V.table(spark, sf, "documents", heavy=True), "text", _aliases(spark), shard=1))


def _event_questions(spark, sf):
    kind, k = F.col("event_type"), V.payload_number().cast("string")
    text = (F.when(kind == "view", F.concat(F.lit("请问从甲"), k, F.lit("专业转到乙"), k, F.lit("学院有什么条件？")))
            .when(kind == "click", F.concat(F.lit("丙"), k, F.lit("转专业政策")))
            .when(kind == "signup", F.concat(F.lit("学校转专业政策 "), k))
            .when(kind == "purchase", F.concat(F.lit("转账给丁"), k, F.lit("怎么转"))).otherwise("食堂几点开门"))
    return V.table(spark, sf, "events").select("event_id", "event_type", text.alias("question"))


_K = "json_extract_string(props, '$.k')"


@query("transfer_intent", f"""
    select event_id, case event_type when 'view' then concat('甲', {_K}) end source,
        case event_type when 'view' then concat('乙', {_K}) when 'click' then concat('丙', {_K}) end target from events""")
def transfer_intent(spark, sf):
    return _event_questions(spark, sf).withColumn("i", Q.transfer_intent(F.col("question"))).select("event_id", "i.source", "i.target")


@query("planned_question", f"""
    select event_id, case event_type when 'view' then concat('原问题：', q, chr(10), '转专业目标：乙', k, chr(10), '来源专业：甲', k, chr(10), '检索重点：乙', k, tail1, '甲', k, tail2)
        when 'click' then concat('原问题：', q, chr(10), '转专业目标：丙', k, chr(10), '来源专业：未指定', chr(10), '检索重点：丙', k, tail1, '未指定', tail2)
        else q end planned, case when event_type in ('view', 'click', 'signup') then 'ACADEMIC' when event_type = 'error' then 'LIFE' end category
    from (select event_id, event_type, {_K} k, case event_type when 'view' then concat('请问从甲', {_K}, '专业转到乙', {_K}, '学院有什么条件？') when 'click' then concat('丙', {_K}, '转专业政策')
        when 'signup' then concat('学校转专业政策 ', {_K}) when 'purchase' then concat('转账给丁', {_K}, '怎么转') else '食堂几点开门' end q,
        '专业或所属学院当期转专业接收条件、专业要求、名额、学业表现、笔试、面试和考核办法；补充学校统一转专业规定；仅在存在明确转出限制时参考' tail1, '的转出规则。' tail2
        from events)""")
def planned_question(spark, sf):
    planned = Q.planned_question(F.col("question"), Q.transfer_intent(F.col("question")))
    return _event_questions(spark, sf).withColumn("planned", planned).select(
        "event_id", "planned", Q.classify_question(F.col("planned")).alias("category"))


@query("classify_question", f"""
    select doc_id, case when {sql_blank('text')} then null else (select category from {TEST_RULES_SQL} where contains(text, kw) order by ord limit 1) end category
    from documents""")
def classify_question(spark, sf):
    return V.table(spark, sf, "documents").select(
        "doc_id", Q.classify_question(F.col("text"), rules=TEST_RULES).alias("category"))


_HISTORY_SQL = """h as (select conversation_id, ord, role, case when length(content) > left_over then right(content, cast(left_over as bigint)) else content end content from (
    select *, 400 - coalesce(sum(length(content)) over (partition by conversation_id order by ord desc rows between unbounded preceding and 1 preceding), 0) left_over,
        row_number() over (partition by conversation_id order by ord desc) age from v_messages) where age <= 3 and left_over > 0)"""


@query("bounded_history", V.with_views(f", {_HISTORY_SQL} select * from h", "v_messages"))
def bounded_history(spark, sf):
    return Q.bounded_history(V.messages(spark, sf), 3, 400)


@query("contextualize", V.with_views(f"""
    , {_HISTORY_SQL}, last as (select conversation_id, arg_max(content, ord) c from h where role = 'USER' group by 1)
    select m.conversation_id, m.ord, sha256(case when {sql_blank('c')} then content else concat(c, chr(10), '后续问题：', content) end) digest
    from v_messages m left join last using (conversation_id)""", "v_messages"))
def contextualize(spark, sf):
    history = Q.bounded_history(V.messages(spark, sf), 3, 400)
    return Q.contextualize(V.messages(spark, sf).withColumnRenamed("content", "question"), history).select(
        "conversation_id", "ord", F.sha2("question_in_context", 256).alias("digest"))


# --- retrieval -------------------------------------------------------------------------------

PAIRS_SQL = """pairs as (select q.vec_id query_id, q.label ql, c.*, round(1 - list_cosine_similarity(cast(q.embedding as double[]), cast(c.vector as double[])), 6) distance
    from embeddings q, v_chunks c),
    general as (select * from (select *, row_number() over (partition by query_id order by distance, chunk_key) rn from pairs) where rn <= 100),
    inside as (select * from (select *, row_number() over (partition by query_id order by distance, chunk_key) rn from pairs where cast(ql as varchar) = category) where rn <= 100)"""


@query("vector_topk", V.with_views(f", {PAIRS_SQL} select query_id, chunk_key, distance from general", "v_chunks"))
def vector_topk(spark, sf):
    return R.vector_topk(V.vector_questions(spark, sf), V.chunks(spark, sf), R.candidate_count(20))


@query("vector_topk_filtered", V.with_views(f", {PAIRS_SQL} select query_id, chunk_key, distance from inside", "v_chunks"))
def vector_topk_filtered(spark, sf):
    return R.vector_topk_filtered(V.vector_questions(spark, sf), V.chunks(spark, sf), R.candidate_count(20))


@query("vector_topk_many_queries", V.with_views(f", {PAIRS_SQL} select query_id, chunk_key, distance from inside", "v_chunks"))
def vector_topk_many_queries(spark, sf):
    """The block-by-shard plan that serves query sets too large to broadcast."""
    return R.vector_topk_filtered(
        V.vector_questions(spark, sf), V.chunks(spark, sf), R.candidate_count(20), max_query_bytes=64 * 8 * 200)


_MERGED_SQL = """merged as (select query_id, chunk_key, min(distance) distance, bool_or(preferred) preferred from (
    select query_id, chunk_key, distance, false preferred from general union all select query_id, chunk_key, distance, true from inside) group by 1, 2)"""


@query("merge_candidates", V.with_views(f", {PAIRS_SQL}, {_MERGED_SQL} select * from merged", "v_chunks"))
def merge_candidates(spark, sf):
    """Both searches in one reading of the index, their candidates merged where they are found."""
    return R.merged_candidates(V.vector_questions(spark, sf), V.chunks(spark, sf), R.candidate_count(20))


@query("chunk_identity", """
    select event_id, case event_type when 'view' then sha256(props) when 'click' then concat(cast(user_id as varchar), ':')
        when 'signup' then concat(':', cast(user_id as varchar)) else concat(cast(user_id as varchar), ':', cast(event_id as varchar)) end identity from events""")
def chunk_identity(spark, sf):
    kind = F.col("event_type")
    doc = F.when(kind.isin("click", "purchase", "error"), F.col("user_id"))
    pos = F.when(kind == "signup", F.col("user_id")).when(kind.isin("purchase", "error"), F.col("event_id"))
    return V.table(spark, sf, "events").select("event_id", R.chunk_identity(doc, pos, F.col("props")).alias("identity"))


def _turn_pairs(spark, sf):
    """Each message with the one before it in its conversation."""
    m = V.table(spark, sf, "conversations")
    earlier = m.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    return m.join(earlier, ["conv_id", "turn"])


_TURNS_SQL = "(select m.conv_id, m.turn, m.text, e.text question from conversations m join conversations e on e.conv_id = m.conv_id and e.turn = m.turn - 1)"
_BIGRAMS = "list_distinct(list_transform(range(1, len({s})), lambda i: {s}[i] || {s}[i + 1]))"


@query("filename_bonus", f"""
    select conv_id, turn, least(0.10::double, len(list_filter({_BIGRAMS.format(s='s')}, lambda b: contains(text, b))) * 0.02::double) bonus
    from (select conv_id, turn, text, regexp_extract_all(question, '[A-Z]') s from {_TURNS_SQL})""")
def filename_bonus(spark, sf):
    return _turn_pairs(spark, sf).select(
        "conv_id", "turn", R.filename_bonus(F.col("question"), F.col("text"), "[A-Z]").alias("bonus"))


@query("lexical_bonus", f"""
    select conv_id, turn, least(0.12::double, len(list_filter(list_distinct(flatten(list_transform(s, lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2))))),
        lambda b: contains(text, b))) * 0.025::double) bonus
    from (select conv_id, turn, text, regexp_extract_all(question, '[x-z]{{2,}}') s from {_TURNS_SQL})""")
def lexical_bonus(spark, sf):
    return _turn_pairs(spark, sf).select(
        "conv_id", "turn", R.lexical_bonus(F.col("question"), F.col("text"), "[x-z]").alias("bonus"))


@query("target_bonus", """
    select event_id, case event_type when 'view' then 0.35 when 'click' then 0.3 when 'signup' then 0.08 when 'purchase' then 0.02 else 0.0 end::double bonus from events""")
def target_bonus(spark, sf):
    kind = F.col("event_type")
    k = V.payload_number().cast("string")
    name = (F.when(kind == "view", F.concat(F.lit("转专业细则"), k)).when(kind == "click", F.lit("计算学院转专业"))
            .when(kind == "signup", F.lit("转专业管理办法")).when(kind == "purchase", F.lit("转专业")).otherwise("其他"))
    asked = F.concat(F.lit("原问题\n转专业目标：计算机"), k, F.lit("专业\n来源"))
    content = F.when(kind == "view", F.concat(F.lit("接收计算机"), k)).otherwise("无")
    return V.table(spark, sf, "events").select("event_id", R.target_bonus(asked, name, content).alias("bonus"))


def _scored(rows):
    source_type = F.when(F.col("chunk_category").isin("1", "3"), "CURATED_OFFICIAL")
    return rows.withColumns({
        "filename_bonus": F.when(F.col("chunk_category") == "2", F.lit(0.04)).otherwise(F.lit(0.0)), "lexical_bonus": F.lit(0.025),
        "curated_bonus": R.curated_bonus(source_type), "target_bonus": F.lit(0.0)})


_RANKED_SQL = f"""{PAIRS_SQL}, {_MERGED_SQL},
    scored as (select m.query_id, m.chunk_key, c.document_id, c.category, m.preferred, m.distance, greatest(0, least(1, 1 - m.distance)) raw,
        case when c.category = '2' then 0.04 else 0 end::double + case when c.category in ('1', '3') then 0.15 else 0 end::double + 0.025::double bonus
        from merged m join v_chunks c using (chunk_key)),
    ranked as (select query_id, chunk_key, document_id, category, rank, round(greatest(0, least(1, raw + bonus)), 9) score from (
        select *, row_number() over (partition by query_id order by round(raw + bonus + case when preferred then 0.03 else 0 end::double, 9) desc, raw desc,
            preferred desc, distance, chunk_key) rank from scored) where rank <= 20)"""


def _ranked(spark, sf):
    chunks = V.chunks(spark, sf).select("chunk_key", "document_id", F.col("category").alias("chunk_category"))
    found = search.candidates(V.vector_questions(spark, sf), V.chunks(spark, sf), 20)
    return R.hybrid_rerank(_scored(join_short(found, chunks, "chunk_key")), 20, identity="chunk_key")


@query("hybrid_rerank", V.with_views(f", {_RANKED_SQL} select query_id, chunk_key, rank, score from ranked", "v_chunks"))
def hybrid_rerank(spark, sf):
    return _ranked(spark, sf).select("query_id", "chunk_key", "rank", "score")


PLANNED_SQL = f"""{PAIRS_SQL}, {_MERGED_SQL},
    told as (select vec_id, label, coalesce(text, '') content, split_part(coalesce(text, ''), chr(10), 1) line,
        split_part(split_part(coalesce(text, ''), chr(10), 1), ' ', 1) word from embeddings left join documents on vec_id = doc_id),
    named as (select vec_id chunk_key, case when label = 2 then '转专业' else '' end || word filename, content,
        case when label in (1, 3) then 0.15 else 0 end::double curated from told),
    planned as (select vec_id query_id, case when label = 1 then line || chr(10) || '转专业目标：' || word else line end planned,
        case when label = 1 then trim(regexp_extract(word, '^[^；;]+')) else '' end goal from told),
    asked as (select query_id, goal, list_distinct(list_transform(range(1, len(s)), lambda i: s[i] || s[i + 1])) names,
        list_distinct(flatten(list_transform(r, lambda x: list_transform(range(1, length(x)), lambda i: substr(x, i, 2))))) words,
        list_transform(range(1, length(goal)), lambda i: substr(goal, i, 2)) halves
        from (select *, regexp_extract_all(planned, '[a-e]') s, regexp_extract_all(lower(planned), '[x-z]{{2,}}') r from planned)),
    scored as (select m.query_id, m.chunk_key, filename, m.preferred, m.distance, greatest(0, least(1, 1 - m.distance)) raw, curated,
        least(0.10::double, len(list_filter(names, lambda b: contains(filename, b))) * 0.02::double) by_name,
        least(0.12::double, len(list_filter(words, lambda b: contains(lower(filename || chr(10) || content), b))) * 0.025::double) lexical,
        case when goal = '' or not contains(filename, '转专业') then 0.0 when contains(filename || chr(10) || content, goal) then 0.35
            when len(list_filter(halves, lambda b: contains(filename, b))) > 0 then 0.30 else 0.02 end::double target
        from merged m join named using (chunk_key) join asked using (query_id)),
    ranked as (select query_id, chunk_key, filename, rank, round(greatest(0, least(1, raw + by_name + curated + target + lexical)), 9) score from (
        select *, row_number() over (partition by query_id order by round(raw + case when preferred then 0.03 else 0 end::double + by_name + curated + target + lexical, 9)
            desc, raw desc, preferred desc, distance, chunk_key) rank from scored) where rank <= 20)"""


@query("search_plan", V.with_views(f", {PLANNED_SQL} select query_id, chunk_key, rank, score from ranked", "v_chunks"))
def search_plan(spark, sf):
    """The whole search with every bonus at work: documents behind the vectors, their first lines as questions."""
    return planned_search(spark, sf)[1].select("query_id", "chunk_key", "rank", "score")


def planned_search(spark, sf, only_inputs=False):
    """(questions, results) of that search, or (questions, stored index)."""
    vectors = V.table(spark, sf, "embeddings")
    texts = rows_of_keys(V.table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text"), vectors, "vec_id")
    # Stands for the stored index: built once, then read by columns.
    folder = f"{shared_folder(spark)}/told-{uuid4().hex}"
    vectors.join(texts, "vec_id", "left").withColumn("content", F.coalesce("text", F.lit(""))).drop("text").write.parquet(folder)
    told = spark.read.parquet(folder)
    line = F.split("content", "\n")[0]
    word = F.split(line, " ")[0]
    label = F.col("label").cast("string")
    stored = told.select(
        F.col("vec_id").alias("chunk_key"), F.col("embedding").alias("vector"), label.alias("category"), "content",
        F.concat(F.when(label == "2", "转专业").otherwise(""), word).alias("filename"), F.lit(1).alias("page"), F.lit("s").alias("source"),
        F.lit("u").alias("source_url"), F.when(label.isin("1", "3"), "CURATED_OFFICIAL").otherwise("").alias("source_type"))
    goal = F.concat(line, F.lit("\n转专业目标："), word)
    questions = told.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), label.alias("category"),
                            F.when(label == "1", goal).otherwise(line).alias("planned"))
    if only_inputs:
        return questions, stored
    return questions, search.search_job(questions, stored, name_symbol="[a-e]", text_symbol="[x-z]")


@query("project_results", """
    select event_id, case when event_type = 'view' then '未知文件' else event_type end filename, case when user_id < 1 then 1 else user_id end page,
        case when event_type = 'click' then '未知来源' else 's' end source, case when event_type = 'error' then null else 'u' end source_url,
        case when event_type = 'signup' then null else 't' end source_type, case when event_type = 'purchase' then null else 'c' end category from events""")
def project_results(spark, sf):
    kind = F.col("event_type")
    rows = V.table(spark, sf, "events").select(
        "event_id", F.when(kind != "view", kind).alias("filename"), F.when(kind != "nothing", F.col("user_id")).alias("page"),
        F.when(kind != "click", "s").alias("source"), F.when(kind != "error", "u").otherwise("").alias("source_url"),
        F.when(kind != "signup", "t").otherwise("").alias("source_type"), F.when(kind != "purchase", "c").alias("category"))
    return R.project_results(rows)


_CUT_SQL = f"""{_RANKED_SQL}, kept as (select * exclude (rank), row_number() over (partition by query_id order by rank) rank from ranked where score >= 0.35
    qualify row_number() over (partition by query_id order by rank) <= 5)"""


@query("relevance_cut", V.with_views(f", {_CUT_SQL} select query_id, chunk_key, rank, score from kept", "v_chunks"))
def relevance_cut(spark, sf):
    return R.relevance_cut(_ranked(spark, sf)).select("query_id", "chunk_key", "rank", "score")


@query("confidence", V.with_views(f"""
    , {_CUT_SQL}, best as (select query_id, max(score) s from kept where score < 0.99 group by 1)
    select e.vec_id query_id, case when s is null then 0 when s >= 0.85 then 95 when s >= 0.7 then 85 else least(59, cast(floor(s * 100 + 0.5) as int)) end confidence
    from embeddings e left join best on best.query_id = e.vec_id""", "v_chunks"))
def confidence(spark, sf):
    kept = R.relevance_cut(_ranked(spark, sf)).where("score < 0.99")
    return R.answer_confidence(V.vector_questions(spark, sf).select("query_id"), kept)


@query("citations", V.with_views(f"""
    , {_CUT_SQL} select query_id, string_agg(concat(filename, ':', cast(chunk_index as varchar)), ';' order by rank) cited from (
        select query_id, concat('f', cast(document_id as varchar)) filename, min(rank) rank, 1 chunk_index from kept group by 1, 2) group by 1""", "v_chunks"))
def citations(spark, sf):
    kept = R.relevance_cut(_ranked(spark, sf)).withColumns({
        "filename": F.concat(F.lit("f"), F.col("document_id").cast("string")), "page": F.lit(1), "source": F.lit("s"),
        "source_url": F.lit("u"), "source_type": F.lit(""), "category": F.col("chunk_category")})
    cited = R.citations(kept)
    return cited.select("query_id", F.array_join(F.transform(
        "sources", lambda s: F.concat(s["title"], F.lit(":"), s["page"].cast("string"))), ";").alias("cited"))


@query("prompt_rows", V.with_views(f"""
    , {_HISTORY_SQL}, {_CUT_SQL} select e.vec_id query_id, sha256(concat('<knowledge_context>', chr(10), coalesce(c, ''), '</knowledge_context>', chr(10), chr(10), '<conversation_history>', chr(10),
        coalesce(h, ''), '</conversation_history>', chr(10), chr(10), '当前问题：', chr(10), 'q', cast(e.vec_id as varchar))) digest
    from embeddings e left join (select query_id, string_agg(concat('[片段 ', cast(rank as varchar), ']', chr(10), '文件：f', cast(chunk_key as varchar), chr(10), '页码：1', chr(10),
        '来源部门：s', chr(10), '内容：', category, chr(10), chr(10)), '' order by rank) c from kept group by 1) k on k.query_id = e.vec_id
    left join (select conversation_id, string_agg(concat(role, '：', {sql_strip('content')}, chr(10)), '' order by ord) h from h group by 1) m on m.conversation_id = e.vec_id""",
    "v_chunks", "v_messages"))
def prompt_rows(spark, sf):
    kept = R.relevance_cut(_ranked(spark, sf)).withColumns({
        "filename": F.concat(F.lit("f"), F.col("chunk_key").cast("string")), "page": F.lit(1), "source": F.lit("s"),
        "content": F.concat(F.lit(" "), "chunk_category", F.lit("\n"))})
    questions = V.vector_questions(spark, sf).select("query_id", F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("question"))
    history = Q.bounded_history(V.messages(spark, sf), 3, 400).withColumnRenamed("conversation_id", "query_id")
    return R.prompt_rows(questions, kept, history).select("query_id", F.sha2("prompt", 256).alias("digest"))


@query("answerability", V.with_views(f"""
    , {_CUT_SQL}, fit as (select query_id, count(*) n from kept where score < 0.6 group by 1)
    select vec_id query_id, n is not null answerable, case when n is null then '知识库中暂无相关信息，请咨询相关部门。' end fallback, coalesce(n, 0) sources
    from embeddings left join fit on query_id = vec_id""", "v_chunks"))
def answerability(spark, sf):
    kept = R.relevance_cut(_ranked(spark, sf)).where("score < 0.6").withColumns({
        "filename": F.col("chunk_key").cast("string"), "page": F.lit(1), "source": F.lit("s"), "source_url": F.lit("u"),
        "source_type": F.lit(""), "category": F.col("chunk_category")})
    rows = R.answerability(V.vector_questions(spark, sf).select("query_id"), R.citations(kept))
    return rows.withColumn("sources", F.size("sources"))


@query("search_job", V.with_views(f"""
    , {_CUT_SQL} select k.query_id, k.rank, k.chunk_key, k.category, k.score, case when b >= 0.85 then 95 when b >= 0.7 then 85 else least(59, cast(floor(b * 100 + 0.5) as int)) end confidence
    from kept k join (select query_id, max(score) b from kept group by 1) using (query_id)""", "v_chunks"))
def search_job(spark, sf):
    """Candidates, merge, re-ranking, cut and confidence for every vector asked as a question."""
    kept = cut_lineage(R.relevance_cut(_ranked(spark, sf)))
    questions = V.vector_questions(spark, sf).select("query_id")
    return kept.join(R.answer_confidence(questions, kept), "query_id").select(
        "query_id", "rank", "chunk_key", F.col("chunk_category").alias("category"), "score", "confidence")


@query("answer_job", None)
def answer_job(spark, sf):
    """User messages answered from the documents: aliases, intent, category, embedding, search, citations."""
    # Stands for the stored index: built once, then read by columns for the search and for the display join.
    folder = f"{shared_folder(spark)}/answers-{uuid4().hex}"
    web_index.web_index_job(V.catalog(spark, sf, heavy=True), embed.hash_embedding(128)).write.option("compression", "zstd").parquet(folder)
    index_rows = spark.read.parquet(folder).withColumn("chunk_key", F.col("chunk_id"))
    users = V.messages(spark, sf).where("role = 'USER'")
    questions = users.select(
        F.concat_ws("-", F.col("conversation_id").cast("string"), F.col("ord").cast("string")).alias("query_id"), "conversation_id",
        F.col("content").alias("question"))
    understood = search.understand(questions, _aliases(spark))
    results = search.search_job(understood, index_rows, embed=embed.hash_embedding(128))
    rows = search.answer_job(understood, results)
    return rows.select("query_id", "category", "answerable", "confidence", F.size("sources").alias("sources"))
