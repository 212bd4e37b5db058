"""Registered queries of this package: each applies one operator to its whole table, with SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import langid, secretscan, toxicity, urlfilter
from lorewell.llm.ann import nearest
from lorewell.llm.batches import fold
from lorewell.llm.decontaminate import contamination
from lorewell.llm.htmltext import extract_text
from lorewell.llm.linededup import dedup_lines
from lorewell.llm.neardup import near_duplicates
from lorewell.llm.packing import pack
from lorewell.llm.phrases import collocations
from lorewell.llm.prefixtrie import prefix_trie
from lorewell.llm.simhash import simhash_groups

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_best_fit_packing")
def op1(spark, sf):
    packed = pack(table(spark, sf, "documents").select("doc_id", "text"), tokenizer_file())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op2_nearest_neighbours")
def op2(spark, sf):
    return nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op3_html_extraction")
def op3(spark, sf):
    return extract_text(table(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")


@query("op7_secret_scan")
def op7(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    model = secretscan.train(secretscan.labelled_findings(spark))
    found = secretscan.scan(docs, model, path="source", keep=["doc_id"])
    return found.select("doc_id", "nth", "word", F.length("value").alias("n_chars"),
                        F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "score", "is_secret")


@query("op8_url_filter")
def op8(spark, sf):
    judged = urlfilter.judge_urls(table(spark, sf, "pages").select("page_id", "url"), urlfilter.train())
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


@query("op5_toxicity")
def op5(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(True))
    model = toxicity.train(docs.where(~held_out).join(labels, "doc_id"))
    scored = toxicity.toxicity(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op9_language_id")
def op9(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(True))
    model = langid.train(docs.where(~held_out))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DECONTAMINATE_SQL = f"""
with d as (
  select doc_id, unnest(w) word, generate_subscripts(w, 1) i, len(w) n from (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents)),
b as (
  select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                                           '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark),
win as (
  select distinct item, array_to_string(w[i:i + 12], ' ') win, least(13, len(w)) n
  from (select item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) i from b where len(w) > 0)),
runs as (
  select doc_id, i, n, list(word) over (partition by doc_id order by i rows between current row and 12 following) l from d),
sized as (
  select doc_id, i, s.n, array_to_string(l[1:s.n], ' ') win from runs, (select distinct n from win) s where len(l) >= s.n),
hits as (select doc_id, i, sized.n, item from sized join win using (win) where sized.n = win.n),
words as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hits) group by 1),
found as (
  select doc_id, count(*) n_items, string_agg(item, ',' order by item) items
  from (select distinct doc_id, item from hits) group by 1),
sizes as (select doc_id, count(*) n_words from d group by 1)
select documents.doc_id, coalesce(n_words, 0) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(items, '')) items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= coalesce(n_words, 0) contaminated
from documents left join sizes using (doc_id) left join words using (doc_id) left join found using (doc_id)
"""


@query("op4_benchmark_decontamination", DECONTAMINATE_SQL)
def op4(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    marked = contamination(docs, table(spark, sf, "benchmark"))
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


LINES_SQL = f"""
with l as (
  select doc_id, unnest(x) line, generate_subscripts(x, 1) i
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) x from documents)),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') key from l),
c as (select key, max(doc_id) keeper from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
j as (select k.*, c.key is not null and doc_id <> keeper gone from k left join c using (key))
select doc_id, count(*) n_lines, cast(sum(gone::int) as bigint) n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) kept_sha256
from j group by doc_id
"""


@query("op6_line_dedup", LINES_SQL)
def op6(spark, sf):
    kept = dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


NEAR_SQL = f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') w from documents),
s as (
  select distinct doc_id, array_to_string(w[i:i + 3], ' ') || ' ' || least(len(w), 4) g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) i from w where len(w) > 0)),
n as (select doc_id, count(*) n from s group by 1),
p as (select x.doc_id a, y.doc_id b, count(*) c from s x join s y using (g) where x.doc_id <> y.doc_id group by 1, 2),
e as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 80 * (x.n + y.n - c)),
r as (select doc_id, doc_id to_id from documents union select r.doc_id, e.b from r join e on r.to_id = e.a),
m as (select doc_id, min(to_id) component_id from r group by 1)
select doc_id, coalesce(n, 0) n_shingles, component_id, doc_id = component_id kept
from m left join n using (doc_id)
"""


@query("op10_minhash_near_dedup", NEAR_SQL)
def op10(spark, sf):
    return near_duplicates(table(spark, sf, "documents").select("doc_id", "text"), shingle=4)


TRIE_SQL = """
with ids as (
  select distinct conv_id, conv_id - conv_id % 5 base,
         xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(cast(conv_id as varchar), ''), lambda x: ascii(x)::bigint)),
             lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) % 9 h
  from conversations where conv_id is not null),
own as (
  select conv_id, coalesce(role, '') role, coalesce(text, '') txt,
         row_number() over (partition by conv_id order by turn nulls first,
                            sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) i
  from conversations where conv_id is not null),
rebuilt as (
  select ids.conv_id, 0 part, i, role, txt from ids join own on own.conv_id = ids.base and i <= h
  union all select ids.conv_id, 1, i, role, txt from ids join own on own.conv_id = ids.conv_id and i > h),
seqs as (
  select ids.conv_id, coalesce(list({'r': role, 't': txt} order by part, i) filter (where i is not null), []) s
  from ids left join rebuilt using (conv_id) group by 1),
firsts as (select conv_id, d, s[1:d] path, s[d].t last, len(s) = d ends from (select *, unnest(range(0, len(s) + 1)) d from seqs)),
nodes as (
  select d, path, min(conv_id) conv_id, count(*) n, case when d = 0 then 0 else octet_length(encode(any_value(last))) end bytes,
         sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '')) ends
  from firsts group by d, path),
kids as (select path[1:d - 1] path, count(*) k from nodes where d > 0 group by 1),
sized as (select nodes.*, coalesce(k, 0) k from nodes left join kids using (path)),
subtree as (
  select above.path, sum((below.k = 0)::int) leaves, sum((below.n - 1) * below.bytes) saved
  from sized below, lateral (select unnest(range(0, below.d + 1)) up) u join nodes above on above.path = below.path[1:u.up] group by 1)
select sized.conv_id, sized.d depth, parent.conv_id parent_conv_id, sized.n n_convs, sized.k n_children,
       cast(leaves as bigint) n_leaves, cast(saved as bigint) saved_tokens, sized.ends ends_sha256
from sized join subtree using (path) left join nodes parent on sized.d > 0 and parent.path = sized.path[1:sized.d - 1]
"""


@query("op11_conversation_prefix_trie", TRIE_SQL)
def op11(spark, sf):
    return prefix_trie(table(spark, sf, "conversations"))


@query("op12_simhash_near_dedup")
def op12(spark, sf):
    return simhash_groups(table(spark, sf, "documents").select("doc_id", "text"))


PHRASES_SQL = f"""
with t as (
  select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) piece
  from documents),
p as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') w from t),
i as (select lang, w, unnest(range(1, len(w) + 1)) i from p),
f as (
  select lang, k n, array_to_string(w[i:i + k - 1], ' ') phrase, count(*) a
  from i, (select unnest([1, 2, 3, 4]) k) where i + k - 1 <= len(w) group by 1, 2, 3),
c as (select lang, n, phrase, a, string_split(phrase, ' ') w from f where n > 1 and a >= 30),
cuts as (select *, unnest(range(1, n)) k from c),
s as (
  select cuts.*, x.a l, y.a r, 2000000::hugeint * cuts.a // (x.a + y.a) score
  from cuts join f x on x.lang = cuts.lang and x.n = k and x.phrase = array_to_string(w[1:k], ' ')
  join f y on y.lang = cuts.lang and y.n = cuts.n - k and y.phrase = array_to_string(w[k + 1:cuts.n], ' ')),
lowest as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_parts as (
  select lang, array_to_string(w[b:e], ' ') phrase, max(a) a
  from (select lang, w, n, a, unnest(range(1, n)) b from c where n > 2), (select unnest([2, 3, 4]) e)
  where e > b and e <= n and e - b + 1 < n group by 1, 2),
kept as (
  select lowest.* from lowest left join inner_parts x using (lang, phrase)
  where x.a is null or 100::hugeint * x.a < 80::hugeint * lowest.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from kept),
sizes as (select lang, sum(a) words from f where n = 1 group by 1)
select lang, rank, phrase, a, l, r, cast(words as bigint) n, cast(score as bigint) score from ranked join sizes using (lang) where rank <= 2000
"""


@query("op13_phrase_collocations", PHRASES_SQL)
def op13(spark, sf):
    return collocations(table(spark, sf, "documents"))


def load():
    """(queries, comparison SQL) of this package."""
    return QUERIES, ORACLES
