"""Answering batches of questions over the chunk index."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions.text import nfkc_lower, strip
from lorewell.functions.tokens import HAN, HAN_COMMON
from lorewell.operators import question as Q
from lorewell.operators import retrieve as R
from lorewell.operators.embed import hash_embedding
from lorewell.scale import cut_lineage, join_short, rows_of_keys

# What the bounds of a candidate need of its index row.
SHORT = ("__pairs", "__topic", "curated_bonus")


def understand(questions: DataFrame, aliases: DataFrame | None = None, name: str | None = None,
               institution: Sequence[str] = (), history: DataFrame | None = None) -> DataFrame:
    """Add ``planned`` (the retrieval text) and ``category`` to (query_id, question) rows.

    With ``history`` (bounded messages) the questions carry a conversation_id.
    """
    asked = questions.withColumn("__text", F.col("question"))
    if history is not None:
        asked = Q.contextualize(asked, history, "question", "__text")
    if aliases is not None:
        asked = Q.expand_aliases(asked, "__text", aliases).withColumn("__text", F.col("retrieval_question")) \
            .drop("canonical_terms", "retrieval_question")
    asked = asked.withColumn("__intent", Q.transfer_intent(F.col("__text"), institution))
    return asked.withColumn("planned", Q.planned_question(F.col("__text"), F.col("__intent"))).withColumn(
        "category", Q.classify_question(F.col("planned"), name, institution)).drop("__text", "__intent")


def candidates(queries: DataFrame, index: DataFrame, top_k: int) -> DataFrame:
    """Nearest rows overall and inside the query's category, one row per chunk, from one scan.

    ``queries``: query_id, query_vector, category. ``index``: chunk_key, vector, category. Its ``SHORT`` columns may come along.
    """
    return R.merged_candidates(queries, index, R.candidate_count(top_k), along=[c for c in SHORT if c in index.columns])


def search_job(questions: DataFrame, index: DataFrame, top_k: int = R.CANDIDATE_K,
               embed: Callable[[Column], Column] | None = None,
               retrieve: Callable[[DataFrame, DataFrame, int], DataFrame] = candidates,
               lexical_chars: int | None = None, target_chars: int | None = None, name_symbol: str = HAN_COMMON,
               text_symbol: str = HAN) -> DataFrame:
    """Ranked results of understood questions (query_id, planned, category and, if ready, query_vector).

    ``index`` rows need chunk_key, vector, category and the display columns filename, page,
    source, source_url, source_type, content, and may carry ``searchable`` (the folded text of
    the lexical bonus). ``retrieve`` is the retrieval strategy. Only ids and vectors take part in
    the search; short columns join the candidates after it or come along, texts only those that can be ranked and whose question
    looks for something in them, and again the ranked ones where they are shown. Whole texts are scored unless ``lexical_chars`` or ``target_chars`` limit what the bonuses read. The symbol classes say
    which characters make up words in file names and in texts.
    """
    embed = embed or hash_embedding()
    folded = nfkc_lower("planned")
    # The understood texts feed the search and the scoring; settle them once.
    questions = cut_lineage(questions.withColumn("__folded", folded))
    queries = questions
    if "query_vector" not in questions.columns:
        # Measured, shipped and searched below: embed once.
        queries = cut_lineage(questions.withColumn("query_vector", embed(strip(F.col("planned")))))
    offered = index.withColumns({
        "__pairs": R.filename_pairs(F.col("filename"), name_symbol), "__topic": R.is_topic(F.col("filename")),
        "curated_bonus": R.curated_bonus(F.col("source_type"))})
    found = retrieve(queries, offered, top_k)
    # What the bonuses ask for is read from each question once; it meets the candidates twice.
    asked = cut_lineage(questions.select(
        "query_id", R.target_of(F.col("planned")).alias("__goal"), R.gap_closed_bigrams(F.col("planned"), name_symbol).alias("__names"),
        R.lexical_words(F.col("__folded"), text_symbol).alias("__words"), R.class_markers(F.col("__folded")).alias("__markers")).withColumn(
            "__plain", F.coalesce((F.size("__words") == 0) & (F.size("__markers") == 0) & (F.col("__goal") == ""), F.lit(False))))
    # First the short columns: they bound what the texts can still change. Only numbers are ordered, no names or words.
    by_text = F.least(F.lit(R.LEXICAL_TOTAL), F.least(F.lit(R.LEXICAL_CAP), F.size("__words") * F.lit(R.LEXICAL_STEP)) + F.when(
        F.size("__markers") > 0, F.lit(R.MARKER_BONUS)).otherwise(F.lit(0.0)))
    by_target = F.when(F.col("__aimed") & F.col("__topic"), F.lit(R.TARGET_MOST)).otherwise(F.lit(0.0))
    carried = set(SHORT) <= set(found.columns)  # then no key of the index stands twice
    if not carried:
        short = offered.select("chunk_key", *SHORT)
        # Candidates of many questions reach all of the index: they are read once, where they are found. A few are settled and tell which rows to read.
        if questions.count() * R.candidate_count(top_k) < index.count():
            found = cut_lineage(found)
            short = rows_of_keys(short, found, "chunk_key")
        found = join_short(found, short, "chunk_key")
    # A task holds its part of the questions, so the many candidates are sorted only once, for their bar.
    bounded = found.join(asked.select(
        "query_id", (F.col("__goal") != "").alias("__aimed"), "__names", by_text.alias("__by_text")).hint("shuffle_hash"), "query_id") \
        .withColumn("filename_bonus", R.filename_bonus_of_pairs(F.col("__names"), F.col("__pairs")))
    floor = (R.similarity(F.col("distance")) + R.category_bonus(F.col("preferred")) + F.col("filename_bonus") + F.col("curated_bonus"))
    bounded = bounded.withColumn("floor", floor).withColumn("ceiling", F.col("floor") + F.col("__by_text") + by_target)
    rows = R.drop_hopeless(bounded.drop("__aimed", "__topic", "__names", "__pairs", "__by_text"), top_k)
    # What is looked for in texts joins the few rows left where they are, by their question.
    sought = ["__goal", "__words", "__markers", "__plain"]
    rows = cut_lineage(rows.join(asked.select("query_id", *sought).hint("shuffle_hash"), "query_id"))
    # Texts are folded once each, then every candidate whose question looks for something in them meets its own; what comes out is numbers again.
    read = rows.where(~F.col("__plain"))
    stored = "searchable" in index.columns
    texts = rows_of_keys(index.select("chunk_key", "filename", "content", *(["searchable"] if stored else [])), read, "chunk_key")
    if not stored:
        texts = texts.withColumn("searchable", nfkc_lower(R.search_text(F.col("filename"), F.col("content"), lexical_chars)))
    # The folded text goes to all candidates; the plain one and its name only where a target is looked for in them.
    aimed = R.is_topic(F.col("filename"))
    texts = texts.withColumns({c: F.when(aimed, F.col(c)) for c in ("filename", "content")})
    numbers = [c for c in rows.columns if c not in sought]
    scored = read.join(texts, "chunk_key").select(
        *numbers, R.lexical_bonus_of(F.col("__words"), F.col("__markers"), F.col("searchable")).alias("lexical_bonus"),
        R.target_bonus_of(F.col("__goal"), F.col("filename"), F.col("content"), target_chars).alias("target_bonus"))
    # No text changes a candidate of the other questions. A key that stands twice in the index counts as often as where texts are read.
    plain = rows.where("__plain").select(*numbers)
    if not carried:
        plain = plain.join(index.select("chunk_key"), "chunk_key")
    scored = scored.unionByName(plain.withColumns({"lexical_bonus": F.lit(0.0), "target_bonus": F.lit(0.0)}))
    ranked = cut_lineage(R.hybrid_rerank(scored, top_k, identity="chunk_key"))
    shown = index.select("chunk_key", "filename", "page", "source", "source_url", "source_type", "category", "content")
    return R.project_results(ranked.join(rows_of_keys(shown, ranked, "chunk_key"), "chunk_key"))


def answer_job(questions: DataFrame, results: DataFrame, history: DataFrame | None = None,
               minimum: float = R.MIN_SCORE, k: int = R.TOP_K) -> DataFrame:
    """One row per question: prompt, sources, confidence, and the fallback text when nothing fits."""
    # A few rows per question, read three times below: settle them so the search runs once. Their texts join the prompts only.
    kept = cut_lineage(R.relevance_cut(results.drop("content").withColumn("__place", F.col("rank")), minimum, k))
    texts = results.select("query_id", F.col("rank").alias("__place"), "content")
    prompts = R.prompt_rows(questions, kept.join(texts, ["query_id", "__place"]), history)
    answered = R.answerability(prompts, R.citations(kept))
    return R.answer_confidence(answered, kept)
