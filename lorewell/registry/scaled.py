"""Registered queries: indexes that are stored to be searched in part, sketches, token chunks, runs over many hosts."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from lorewell.operators import chunks as C
from lorewell.operators import embed, frontier, index, lsh, sketches
from lorewell.operators import retrieve as R
from lorewell.plans import search
from lorewell.registry import views as V
from lorewell.registry.core import query
from lorewell.registry.index_and_search import PAIRS_SQL, PLANNED_SQL, index_versions, planned_search
from lorewell.registry.sources_and_text import sql_trim
from lorewell.scale import shared_folder, side_by_side
from lorewell.sources import tables

TOP = 20


@query("vector_topk_lsh", "select count(*) questions, count(*) * 20 rows, true recall_reached, true exact_distances from embeddings")
def vector_topk_lsh(spark, sf):
    """Approximate search: at least nine in ten of the true neighbours, each with its exact distance.

    The given vectors have no groups, so most buckets are needed (all 8 at sf0.01): the row checks the path, not a saving.
    """
    questions, rows = V.vector_questions(spark, sf), V.chunks(spark, sf)
    folder, bits = f"{shared_folder(spark)}/lsh-{uuid4().hex}", lsh.lsh_bits(rows.count(), 64)
    lsh.store_lsh_index(rows, folder, bits)
    stored = spark.read.schema(lsh.bucketed_schema(rows.schema)).parquet(folder)
    found = lsh.vector_topk_lsh(questions, stored, TOP, bits, lsh.lsh_probes(rows, TOP, bits, 0.95))
    true = R.vector_topk(questions, rows, TOP).withColumnRenamed("distance", "true_distance")
    both = found.join(true, ["query_id", "chunk_key"], "left").agg(
        F.count("*").alias("rows"), F.count_distinct("query_id").alias("questions"), F.count("true_distance").alias("hits"),
        F.count_if(F.abs(F.col("distance") - F.col("true_distance")) > 1e-5).alias("wrong"))
    return both.select("questions", "rows", (F.col("hits") >= F.col("rows") * 0.9).alias("recall_reached"),
                       (F.col("wrong") == 0).alias("exact_distances"))


@query("vector_topk_by_category", V.with_views(f", {PAIRS_SQL} select query_id, chunk_key, distance from inside", "v_chunks"))
def vector_topk_by_category(spark, sf):
    """The search inside a category over an index with one folder per category; others are not opened."""
    rows, folder = V.chunks(spark, sf), f"{shared_folder(spark)}/by-category-{uuid4().hex}"
    rows.write.partitionBy("category").parquet(folder)
    stored = spark.read.schema(rows.schema).parquet(folder)
    return R.vector_topk_filtered(V.vector_questions(spark, sf), stored, R.candidate_count(20))


@query("replace_index_bucketed", V.with_views("""
    , l as (select * from v_catalog join labels using (doc_id))
    select cast(id as varchar) document_id, case when category is not null then source_url end source_url, 'old' content from v_catalog
    where doc_id not in (select doc_id from l where quality = 0) and not (category is not null and doc_id in (select doc_id from l where quality = 1))
    union all select case when quality = 1 then concat('n', cast(id as varchar)) else cast(id as varchar) end,
        case when quality = 1 then source_url else ' ' end, 'new' from l""", "v_catalog"))
def replace_index_bucketed(spark, sf):
    """As ``replace_index`` over an index stored in buckets by document."""
    old, new = index_versions(spark, sf)
    name = f"index_{uuid4().hex}"
    stored = index.store_bucketed(old, name, f"{shared_folder(spark)}/{name}")
    return index.replace_index(stored, new).select("document_id", "source_url", "content")


@query("chunk_tokens", """
    select doc_id, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 0 has_chunks, true within_size, true within_overlap, true offsets_match
    from documents where text is not null""")
def chunk_tokens(spark, sf):
    """Chunks of at most 500 tokens that share at most 100 with the one before, counted in the given vocabulary."""
    import public_tokenizers

    split = C.chunk_tokens(public_tokenizers.path("byte_bpe_50k.json"), 500, 100)
    docs = V.table(spark, sf, "documents", heavy=True).where("text is not null")
    rows = docs.select("doc_id", "text", split(F.col("text")).alias("chunks"))
    return rows.select(
        "doc_id", (F.size("chunks") > 0).alias("has_chunks"), F.forall("chunks", lambda c: c["tokens"] <= 500).alias("within_size"),
        F.forall("chunks", lambda c: c["shared"] <= 100).alias("within_overlap"),
        F.forall("chunks", lambda c: F.substring(F.col("text"), c["start"] + 1, F.length(c["text"])) == c["text"]).alias("offsets_match"))


@query("frequent_questions_by_day", V.with_views(f"""
    select {sql_trim('question')} question, count(*) occurrences from v_answers group by 1""", "v_answers"))
def frequent_questions_by_day(spark, sf):
    """Question counts from combined daily sketches; exact, as every question is followed."""
    found = sketches.frequent_questions_sketched(sketches.daily_sketches(V.answers(spark, sf)), 10_000)
    return found.select("question", "occurrences")


@query("frequent_questions_within_error", "select event_type question, true within_error from events group by event_type having count(*) filter (user_id % 3 > 0) > 0")
def frequent_questions_within_error(spark, sf):
    """A sketch that follows far fewer questions than there are: the frequent ones are found, within the stated error."""
    tail = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("-"), F.col("event_id").cast("string"))).otherwise("")
    answers = V.table(spark, sf, "events").select(
        F.concat("event_type", tail).alias("question"), F.col("user_id").cast("string").alias("session"), F.col("ts").alias("created_time"))
    rough = sketches.frequent_questions_sketched(sketches.daily_sketches(answers, 256), 5, 256)
    true = answers.groupBy("question").agg(F.count("*").alias("true_count"))
    return rough.join(true, "question").where(~F.contains("question", F.lit("-"))).select(
        "question", (F.abs(F.col("occurrences") - F.col("true_count")) <= F.col("off")).alias("within_error"))


@query("sessions_by_day", V.with_views("select count(distinct session) > 0 counted, true near from v_answers", "v_answers"))
def sessions_by_day(spark, sf):
    """Different sessions from combined daily sketches, within a twentieth of the exact number."""
    answers = V.answers(spark, sf)
    rough = sketches.sessions_sketched(sketches.daily_sketches(answers))
    both = side_by_side(rough, answers.agg(F.count_distinct("session").alias("exact")))
    return both.select((F.col("sessions") > 0).alias("counted"), (F.abs(F.col("sessions") - F.col("exact")) <= F.col("exact") * 0.05).alias("near"))


@query("hash_embedding_native", """
    select doc_id, case when regexp_matches(lower(text), '[a-z0-9]') then 1.0 else 0.0 end norm, 64 dimensions from documents""")
def hash_embedding_native(spark, sf):
    vector = embed.native_hash_embedding(64)(F.col("text"))
    rows = V.table(spark, sf, "documents", heavy=True).select("doc_id", vector.alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.select("doc_id", F.round(norm, 4).alias("norm"), F.size("v").alias("dimensions"))


@query("external_embedding", "select doc_id, length(text) length, len(string_split(text, 'a')) - 1 letters from documents")
def external_embedding(spark, sf):
    """Any batch model in the place of the embedder."""
    model = embed.external_embedding(lambda texts: [[float(len(t)), float(t.count("a"))] for t in texts])
    rows = V.table(spark, sf, "documents").select("doc_id", model(F.col("text")).alias("v"))
    return rows.select("doc_id", F.col("v")[0].cast("long").alias("length"), F.col("v")[1].cast("long").alias("letters"))


@query("question_set", "select doc_id id, lang category, text question, source expected_source, [lang, source] expected_keywords from documents")
def question_set(spark, sf):
    """Documents written as files of JSON arrays and read back as a question set."""
    folder = f"{shared_folder(spark)}/questions-{uuid4().hex}"
    rows = V.table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 500).alias("file"), F.struct(
            F.concat_ws("\u0001", F.col("doc_id").cast("string"), "text").alias("question"), F.col("lang").alias("category"),
            F.col("source").alias("expected_source"), F.array("lang", "source").alias("expected_keywords")).alias("row"))
    arrays = rows.groupBy("file").agg(F.to_json(F.collect_list("row")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(folder)
    read = tables.question_set(spark, folder)
    parts = F.split("question", "\u0001", 2)
    return read.select(parts[0].cast("long").alias("id"), "category", parts[1].alias("question"), "expected_source", "expected_keywords")


_HOSTS_SQL = """people as (select c_custkey, lower(c_mktsegment) seg, concat('https://', lower(c_mktsegment), '.example.org/c/', cast(c_custkey as varchar)) url from customer),
    e as (select a.url src, b.url dst, min((-(n.o_orderkey % 3), o.o_orderkey)) way from orders o join orders n on n.o_orderkey = o.o_orderkey + 1
        join people a on a.c_custkey = o.o_custkey join people b on b.c_custkey = n.o_custkey where b.seg <> 'machinery' group by 1, 2),
    seeds as (select arg_min(url, c_custkey) url, 1 pos from people where seg = 'building'),
    walk(url, depth) as (select url, 0 from seeds union select e.dst, depth + 1 from walk join e on e.src = walk.url where depth < 4),
    near as (select url, min(depth) depth from walk group by url),
    pages as (select near.url, near.depth, case when near.depth = 0 then (0, 1) else min(e.way) end way
        from near left join (select e.dst, e.way, n.depth d from e join near n on n.url = e.src) e on e.dst = near.url and e.d = near.depth - 1 group by 1, 2),
    told as (select url, depth, way, split_part(split_part(url, '//', 2), '/', 1) host from pages),
    ranked as (select host, row_number() over (order by first, host) host_order from (select host, min((depth, way)) first from told group by 1))"""


@query("crawl_hosts", f"""with recursive {_HOSTS_SQL}, listed as (select told.*, host_order, row_number() over (partition by host order by way[1], depth, way[2], url) rn
    from told join ranked using (host)) select url, depth, host, host_order from listed where rn <= 50""")
def crawl_hosts(spark, sf):
    """A run over four of the five configured hosts from one seed: hosts in the order of their discovery, 50 pages of each."""
    orders = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    people = V.table(spark, sf, "customer").select("c_custkey", F.concat(
        F.lit("https://"), F.lower("c_mktsegment"), F.lit(".example.org/c/"), F.col("c_custkey").cast("string")).alias("url"), "c_mktsegment")
    following = orders.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("next"))
    edges = (
        orders.join(following, "o_orderkey")
        .join(people.select(F.col("c_custkey").alias("o_custkey"), F.col("url").alias("src")), "o_custkey")
        .join(people.select(F.col("c_custkey").alias("next"), F.col("url").alias("dst")), "next")
        .select("src", "dst", F.col("o_orderkey").alias("pos"), (-((F.col("o_orderkey") + 1) % 3)).alias("priority")))
    hosts = people.select(F.concat(F.lower("c_mktsegment"), F.lit(".example.org")).alias("host")).distinct().where("host not like 'machinery%'")
    seeds = people.where("c_mktsegment = 'BUILDING'").agg(F.min_by("url", "c_custkey").alias("url")).withColumn("pos", F.lit(1).cast("long"))
    pages = frontier.crawl_hosts(seeds, edges, hosts, 4)
    kept = frontier.page_budget(pages.withColumn("seq", F.struct("pos", "url")), 50)
    return kept.select("url", "depth", "host", "host_order")


@query("answer_plan", V.with_views(f""", {PLANNED_SQL},
    kept as (select *, row_number() over (partition by query_id order by rank) place from ranked where score >= 0.35
        qualify row_number() over (partition by query_id order by rank) <= 5),
    told_by as (select query_id, max(score) best, count(distinct case when trim(filename) = '' then '未知文件' else filename end) sources from kept group by 1)
    select vec_id query_id, best is not null answerable, case when best is null then 0 when best >= 0.85 then 95 when best >= 0.7 then 85
            else least(59, cast(floor(best * 100 + 0.5) as int)) end confidence,
        coalesce(sources, 0) sources, case when best is null then '知识库中暂无相关信息，请咨询相关部门。' end fallback
    from embeddings left join told_by on query_id = vec_id""", "v_chunks"))
def answer_plan(spark, sf):
    """Search and answer in one: sources, confidence and fallback of every question of the whole search."""
    questions, found = planned_search(spark, sf)
    rows = search.answer_job(questions.withColumn("question", F.col("planned")), found)
    return rows.select("query_id", "answerable", "confidence", F.size("sources").alias("sources"), "fallback")


@query("search_with_own_retrieval", "select vec_id query_id, vec_id chunk_key, 1 rank from embeddings")
def search_with_own_retrieval(spark, sf):
    """Any retrieval in the place of the vector search: here every question finds the row of its own number."""
    def own(queries, stored, top_k):
        return queries.select("query_id", F.col("query_id").alias("chunk_key"), F.lit(0.0).alias("distance"), F.lit(False).alias("preferred"))

    questions, stored = planned_search(spark, sf, only_inputs=True)
    return search.search_job(questions, stored, retrieve=own).select("query_id", "chunk_key", "rank")
