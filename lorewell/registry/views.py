"""The given tables seen as catalog, pages, conversations, usage and chunks.

Every view covers its whole table; it is written once for Spark (a DataFrame) and once as SQL
(a common table expression used by the comparison queries).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.scale import spread

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def table(spark: SparkSession, sf: str, name: str, heavy: bool = False) -> DataFrame:
    """A given table; ``heavy`` spreads it over all cores for costly row work."""
    rows = spark.read.parquet(os.path.join(sf, f"{name}.parquet"))
    return spread(rows) if heavy else rows


def payload_number() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def usage(spark: SparkSession, sf: str) -> DataFrame:
    """Model calls: one per event; error events are failed calls."""
    prompt, completion = F.floor("value").cast("int"), payload_number()
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("model"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("status"),
        prompt.alias("prompt_tokens"), completion.alias("completion_tokens"),
        (prompt + completion).alias("total_tokens"), F.least(prompt, completion).alias("cache_hit_tokens"),
        (prompt - F.least(prompt, completion)).alias("cache_miss_tokens"),
        F.floor(F.col("value") * 10).cast("long").alias("latency_ms"), F.col("ts").alias("created_time"))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers: every event but page views; sign-ups carry no confidence."""
    return table(spark, sf, "events").where(F.col("event_type") != "view").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("session"),
        F.concat(F.lit(" "), "event_type", F.lit(" "), payload_number().cast("string")).alias("question"),
        F.when(F.col("event_type") != "signup", F.least(F.lit(100), F.floor("value").cast("int"))).alias("confidence"),
        F.col("ts").alias("created_time"))


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Feedback: purchases are helpful, errors and (orphaned) views are incorrect."""
    return table(spark, sf, "events").where(F.col("event_type").isin("purchase", "error", "view")).select(
        F.col("event_id").alias("chat_history_id"),
        F.when(F.col("event_type") == "purchase", "HELPFUL").otherwise("INCORRECT").alias("user_feedback"))


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").where(F.col("role") != "system").select(
        F.col("conv_id").alias("conversation_id"), F.col("turn").alias("ord"), F.upper("role").alias("role"),
        F.col("text").alias("content"))


def catalog(spark: SparkSession, sf: str, heavy: bool = False) -> DataFrame:
    """Documents as catalog rows: the language gives the status, the length the kind of source."""
    lang, n = F.col("lang"), F.col("n_chars")
    return table(spark, sf, "documents", heavy).select(
        F.col("doc_id").alias("id"), F.split("text", "\n")[0].alias("title"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        "source", F.lit("HTML").alias("type"), F.col("text").alias("content"),
        F.when(lang == "en", "COMPLETED").when(lang == "de", "PROCESSING").when(lang == "fr", "UPLOADING")
        .otherwise("FAILED").alias("status"),
        F.when(n < 500, F.concat(F.lit("/files/"), F.col("doc_id").cast("string"))).alias("storage_path"),
        n.alias("file_size"), F.lit("text/plain").alias("content_type"),
        F.when(n < 500, "UPLOADED_FILE").when(n < 2000, "OFFICIAL_WEBSITE").otherwise("CURATED_OFFICIAL").alias("source_type"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), lang, F.lit("/"), F.col("doc_id").cast("string")).alias("source_url"),
        F.when(lang == "en", "LIFE").when(lang == "de", "MAJOR").when(lang == "fr", "CAREER").alias("category"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("crawl_time"),
        (F.lit("2023-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("last_updated"),
        F.sha2("text", 256).alias("content_hash"), F.lit(None).cast("string").alias("vector_document_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("created_time"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings", heavy=True).select(
        F.col("vec_id").alias("chunk_key"), F.floor(F.col("vec_id") / 5).alias("document_id"),
        (F.col("vec_id") % 5).cast("int").alias("chunk_index"), F.col("label").cast("string").alias("category"),
        F.col("embedding").alias("vector"))


def vector_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector asked as a question, in its label's category."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"),
        F.col("label").cast("string").alias("category"))


def crawl_state(spark: SparkSession, sf: str) -> DataFrame:
    """Earlier crawl of the labelled documents: good ones unchanged since, the others not; toxic
    ones never indexed. Benchmark passages are pages that are gone now."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    empty = F.lit(None).cast("string")
    seen = docs.select(
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.lit("old").alias("title"), F.lit("LIFE").alias("category"),
        F.when(F.col("quality") == 1, F.sha2("text", 256)).otherwise(F.sha2("lang", 256)).alias("content_hash"),
        F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("etag"), F.lit("m").alias("last_modified"),
        F.lit("CREATED").alias("last_status"), F.lit("2023-06-01").cast("timestamp_ntz").alias("crawled_at"),
        F.when(F.col("toxic") == 0, F.lit("2023-06-01").cast("timestamp_ntz")).alias("indexed_at"))
    gone = table(spark, sf, "benchmark").select(
        F.concat(F.lit("https://gone.example.org/"), F.col("item_id").cast("string")).alias("url"), F.lit("gone").alias("title"),
        F.lit("CAREER").alias("category"), F.sha2("text", 256).alias("content_hash"), empty.alias("etag"),
        empty.alias("last_modified"), F.lit("CREATED").alias("last_status"),
        F.lit("2023-05-01").cast("timestamp_ntz").alias("crawled_at"), F.lit("2023-05-01").cast("timestamp_ntz").alias("indexed_at"))
    return seen.unionByName(gone)


def crawled(spark: SparkSession, sf: str) -> DataFrame:
    """The new crawl: all documents; German pages answer 304, French ones carry no etag."""
    lang = F.col("lang")
    return table(spark, sf, "documents").select(
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), lang, F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.split("text", "\n")[0].alias("title"), F.lit("MAJOR").alias("category"), F.sha2("text", 256).alias("content_hash"),
        F.when(lang != "fr", F.concat(F.lit("n"), F.col("doc_id").cast("string"))).alias("etag"),
        F.lit(None).cast("string").alias("last_modified"), F.lit("UPDATED").alias("last_status"),
        F.lit("2024-06-01").cast("timestamp_ntz").alias("crawled_at"),
        F.when(lang == "en", F.lit("2024-06-01").cast("timestamp_ntz")).alias("indexed_at"),
        F.when(lang == "de", 304).otherwise(200).alias("http_status"), F.col("text").alias("content"), "source", "doc_id", "lang")


def exclusions(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of toxic documents are barred."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").where("toxic = 1"), "doc_id")
    return docs.select(
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("source_url"),
        F.lit("toxic").alias("reason"))


def evaluation(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(questions, answers): labelled documents, with the words of their own source as expectations."""
    docs = table(spark, sf, "documents")
    questions = docs.select(
        F.col("doc_id").alias("question_id"), F.col("lang").alias("category"), F.split("text", "\n")[0].alias("question"),
        F.when(F.col("lang") == "es", F.lit(None)).when(F.col("lang") == "fr", F.lit("SRC1")).otherwise(F.upper("source")).alias("expected_source"),
        F.when(F.col("lang") != "de", F.array(F.lit("QUE"), F.lit("tion"))).alias("expected_keywords"))
    given = docs.join(table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").alias("question_id"), F.when(F.col("toxic") == 1, F.lit("  ")).otherwise(F.col("text")).alias("answer"),
        F.when(F.col("quality") == 1, F.array(F.struct(F.col("lang").alias("title"), F.col("source").alias("source"))))
        .otherwise(F.array().cast("array<struct<title:string,source:string>>")).alias("sources"))
    return questions, given


_URL = "concat('https://', source, '.example.org/', lang, '/', cast(doc_id as varchar))"
_NUM = "cast(json_extract_string(props, '$.k') as int)"

SQL = {
    "v_usage": f"""select event_id id, event_type model, case when event_type = 'error' then 'FAILED' else 'SUCCESS' end status,
        cast(floor(value) as int) prompt_tokens, {_NUM} completion_tokens, cast(floor(value) as int) + {_NUM} total_tokens,
        least(cast(floor(value) as int), {_NUM}) cache_hit_tokens,
        cast(floor(value) as int) - least(cast(floor(value) as int), {_NUM}) cache_miss_tokens,
        cast(floor(value * 10) as bigint) latency_ms, ts created_time from events""",
    "v_answers": f"""select event_id id, cast(user_id as varchar) session, concat(' ', event_type, ' ', cast({_NUM} as varchar)) question,
        case when event_type <> 'signup' then least(100, cast(floor(value) as int)) end confidence, ts created_time
        from events where event_type <> 'view'""",
    "v_feedback": """select event_id chat_history_id, case when event_type = 'purchase' then 'HELPFUL' else 'INCORRECT' end user_feedback
        from events where event_type in ('purchase', 'error', 'view')""",
    "v_messages": """select conv_id conversation_id, turn ord, upper(role) role, text content from conversations where role <> 'system'""",
    "v_catalog": f"""select doc_id id, split_part(text, chr(10), 1) title, concat('doc-', cast(doc_id as varchar), '.txt') filename, source,
        text content, case lang when 'en' then 'COMPLETED' when 'de' then 'PROCESSING' when 'fr' then 'UPLOADING' else 'FAILED' end status,
        case when n_chars < 500 then concat('/files/', cast(doc_id as varchar)) end storage_path, n_chars file_size,
        case when n_chars < 500 then 'UPLOADED_FILE' when n_chars < 2000 then 'OFFICIAL_WEBSITE' else 'CURATED_OFFICIAL' end source_type,
        {_URL} source_url, case lang when 'en' then 'LIFE' when 'de' then 'MAJOR' when 'fr' then 'CAREER' end category,
        timestamp '2024-01-01' + to_minutes(doc_id) crawl_time, timestamp '2023-01-01' + to_minutes(doc_id) last_updated,
        sha256(text) content_hash, timestamp '2024-01-01' + to_minutes(doc_id) created_time, lang, doc_id from documents""",
    "v_chunks": """select vec_id chunk_key, cast(floor(vec_id / 5) as bigint) document_id, cast(vec_id % 5 as int) chunk_index,
        cast(label as varchar) category, embedding vector from embeddings""",
    "v_state": f"""select {_URL} url, 'old' title, 'LIFE' category, case when quality = 1 then sha256(text) else sha256(lang) end content_hash,
        concat('e', cast(doc_id as varchar)) etag, 'm' last_modified, 'CREATED' last_status, timestamp '2023-06-01' crawled_at,
        case when toxic = 0 then timestamp '2023-06-01' end indexed_at from documents join labels using (doc_id)
        union all select concat('https://gone.example.org/', cast(item_id as varchar)), 'gone', 'CAREER', sha256(text), null, null, 'CREATED',
        timestamp '2023-05-01', timestamp '2023-05-01' from benchmark""",
    "v_crawled": f"""select {_URL} url, split_part(text, chr(10), 1) title, 'MAJOR' category, sha256(text) content_hash,
        case when lang <> 'fr' then concat('n', cast(doc_id as varchar)) end etag, cast(null as varchar) last_modified, 'UPDATED' last_status,
        timestamp '2024-06-01' crawled_at, case when lang = 'en' then timestamp '2024-06-01' end indexed_at,
        case when lang = 'de' then 304 else 200 end http_status, text content, source, doc_id, lang from documents""",
    "v_exclusions": f"""select {_URL} source_url, 'toxic' reason from documents join labels using (doc_id) where toxic = 1""",
    "v_scored": """select q.doc_id id, q.lang category, q.has_source, q.has_source and (q.expected is null or trim(q.expected) = ''
            or contains(lower(concat(q.lang, ' ', q.source)), lower(q.expected))) source_match, q.non_empty,
            q.non_empty and q.lang <> 'de' and (contains(lower(q.answer), 'que') or contains(lower(q.answer), 'tion')) keyword_match,
            q.quality, q.toxic, q.labelled, q.answer
        from (select d.doc_id, d.lang, d.source, case d.lang when 'es' then null when 'fr' then 'SRC1' else upper(d.source) end expected,
            coalesce(l.quality = 1, false) has_source, l.doc_id is not null labelled, l.quality, l.toxic,
            case when l.doc_id is null then '' when l.toxic = 1 then '  ' else d.text end answer,
            l.doc_id is not null and l.toxic = 0 and regexp_matches(d.text, '[^\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}]') non_empty
            from documents d left join labels l using (doc_id)) q""",
}


def with_views(body: str, *names: str) -> str:
    """``body`` over the named views; a body that starts with a comma adds more of them."""
    return "with " + ",\n".join(f"{n} as ({SQL[n]})" for n in names) + "\n" + body.strip()
