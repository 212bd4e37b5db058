"""Edge cases of each operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorewell.llm import ann, batches, htmltext, langid, neardup, packing, secretscan, toxicity, urlfilter
from lorewell.llm.decontaminate import contamination
from lorewell.llm.linededup import LineRuns, dedup_lines, line_keys
from lorewell.llm.queries import tokenizer_file

LONG = " ".join(f"w{i}" for i in range(30_000))
HARD = [None, "", "   ", "\n\n", "a", "é ß 漢字  x", "don't  stop\tnow", LONG, LONG]


def hard(make_docs):
    return make_docs([*enumerate(HARD), (None, "null id"), (3, "a second row with id three")])


# words and hashes


def test_words_end_at_text_borders():
    data, offsets = batches.text_bytes(pa.array(["ab", None, "cd e", "", "éf"]))
    starts, ends, first = batches.word_spans(batches.LOWER[data], offsets, batches.ALNUM)
    words = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    assert words == ["ab", "cd", "e", "éf"]
    assert first.tolist() == [0, 1, 1, 3, 3, 4]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    data, offsets = batches.text_bytes(pa.array(["tree " * 3, "a tree", "x" * 3_000_000 + " tree"]))
    starts, ends, first = batches.word_spans(data, offsets, batches.ALNUM)
    hashes = batches.span_hashes(data, starts, ends)
    assert len({int(hashes[k]) for k in (0, 1, 2, 4, 6)}) == 1
    assert len(set(hashes.tolist())) == 3


def test_blocks_cut_no_text():
    batch = pa.record_batch({"text": ["x" * 10, "y" * 1000, "", "z"]})
    assert [b.num_rows for b in batches.blocks(batch, "text", 50)] == [1, 1, 2]


# 1 packing


def test_every_length_is_placed_once():
    rng = np.random.default_rng(3)
    counts = np.bincount(rng.integers(1, 65, 5000), minlength=65)
    packed = packing.pack_lengths(counts)
    again = np.zeros(65, int)
    for key, times in packed:
        assert sum(key) <= 64
        for size in key:
            again[size] += times
    assert (again == counts).all()
    total = int((counts * np.arange(65)).sum())
    assert sum(t for _, t in packed) <= 1.01 * -(-total // 64)


def test_only_large_lengths_cannot_share():
    counts = np.zeros(11, int)
    counts[7] = 5
    assert packing.pack_lengths(counts) == [((7,), 5)]
    assert packing.pack_lengths(np.zeros(11, int)) == []


@pytest.mark.parametrize("text", ["", " ", "it's  two   blanks ", "tabs\t\t\nlines\n\n\nend", "äöüß 漢字 \U0001f600", "x" * 5000, "<|endoftext|> inside",
                                  "123 4567 $%&", "a b c", "\r\n\x0b\x0c mixed ​"])
def test_encoder_equals_the_files_own_library(text):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_file())
    assert packing.encoder(tokenizer_file()).fast is not None
    assert packing.encoder(tokenizer_file()).ids(text) == own.encode(text, add_special_tokens=False).ids


def test_pack_handles_everything(spark, make_docs):
    docs = hard(make_docs).withColumn("sequence_id", F.lit("clash")).withColumn("rank", F.lit(1))
    got = packing.pack(docs, tokenizer_file()).collect()
    assert sum(r.piece == 0 for r in got) == docs.count()
    empty = [r for r in got if r.doc_id == 0]
    assert [(r.start, r.length, r.ids_crc32) for r in empty] == [(0, 1, zlib.crc32(bytes(4)))]
    for doc in (7, 8):
        pieces = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == doc)
        assert all(length == 2048 for _, _, length in pieces[1:])
        assert [s for _, s, _ in pieces] == [sum(x[2] for x in pieces[:k]) for k in range(len(pieces))]
    assert packing.pack(docs.limit(0), tokenizer_file()).collect() == []


# 2 nearest neighbours


def test_neighbours_skip_unusable_vectors_and_break_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]),
            (7, [float("inf"), 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, [-1.0, 0.0]), (1, [0.5, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = ann.nearest(table, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 1, 0.5), (0, 4, 9, -1.0)]
    assert ann.nearest(table.limit(0), F.col("vec_id") == 0).collect() == []


def test_many_equal_vectors_give_the_smallest_ids(spark):
    table = spark.range(500).select(F.col("id").alias("vec_id"), F.array(F.lit(0.6), F.lit(0.8)).alias("embedding"))
    got = ann.nearest(table, F.col("vec_id") == 20, k=5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4]


def test_query_blocks_change_nothing(spark):
    rng = np.random.default_rng(0)
    table = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    whole = ann.nearest(table, F.col("vec_id") % 3 == 0, k=4).collect()
    parts = ann.nearest(table, F.col("vec_id") % 3 == 0, k=4, query_rows=30, block_rows=64).collect()
    assert len(set(whole) & set(parts)) >= 0.95 * len(whole)


def test_neighbours_of_each_length(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0, 1.0]), (4, [0.0, 0.0, 2.0]), (5, [9.0] * 7), (2, [5.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for blocks in ({}, {"query_rows": 1, "block_rows": 2}):
        got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(table, F.lit(True), **blocks).collect()}
        assert got == {(0, 1): (1, 2.0), (0, 2): (2, 1.0), (1, 1): (0, 2.0), (1, 2): (2, 2.0), (2, 1): (1, 2.0), (2, 2): (0, 1.0),
                       (3, 1): (4, 2.0), (4, 1): (3, 2.0)}


def test_chi_square():
    assert abs(ann.chi_square_quantile(8, 0.95) - 15.5073) < 1e-3


# 3 page text

PAGE = """<html><head><title>no</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a>Home</a></nav>
<div class="cookie-notice">We use cookies</div><div class="content"><h2>Fish &amp; chips</h2><p>%s<p>Short&nbsp;one.<br>Next</div>
<aside>More</aside><div id="comments"><p>%s</p></div><form>Mail <input></form><footer>(c)</footer><script>var a = "</p>";</script>"""


def test_article_region_is_kept_whole():
    words = "plain words of the article " * 10
    assert htmltext.main_text(PAGE % (words, "I do not agree " * 30)) == f"Fish & chips {' '.join(words.split())} Short one. Next"


def test_pages_without_article(spark):
    pages = spark.createDataFrame([(0, None), (1, ""), (2, "<nav>x</nav>"), (3, "bare text"), (4, "<p>a<b>b</p><p>c"), (5, "<<>&&;")],
                                  "page_id int, html string").withColumn("text", F.lit(1))
    got = {r.page_id: r.text for r in htmltext.extract_text(pages).collect()}
    assert got[0] == got[1] == got[2] == ""
    assert (got[3], got[4]) == ("bare text", "ab c")


def test_all_sections_of_pages_without_article():
    long, menu = "many plain words of a story " * 180, "".join(f"<a href='/{k}'>link {k}</a> " for k in range(12))
    pages = [
        f"<section><h2>First</h2><p>{long}</p></section><section><h2>Second</h2><p>{'short tail ' * 36}</p></section>",
        f"<body><h1>Title</h1><div><p>{long}</p></div></body>",
        "<body>" + "".join(f"<div>Paragraph {k}. {'word ' * k}</div>" for k in range(40)) + "</body>",
        f"<article><p>{long}</p></article><article><p>Brief.</p></article><article><p>Also brief.</p></article>",
        f"<body><div><p>{long * 40}</p></div><div><p>Two words.</p></div><div><p>x</p></div><div><p>A last one.</p></div></body>",
        f"<table><tr><td>{long}</td><td>Cell.</td></tr></table>",
        f"<div class='content with-sidebar'><div class='entry-header'><h1>Title</h1></div><p>{long}</p></div>",
        f"<article><div class='has-sidebar'><div class='header'><h1>T</h1></div><p>{long}</p></div></article>",
        f"<div class='layout-sidebar'><p>{long}</p></div>"]
    for page in pages:
        whole = " ".join(re.sub("<[^>]*>", " ", page).split())
        assert htmltext.main_text(f"<nav>{menu}</nav>{page}<div>{menu}</div><div class='site-footer'><p>(c)</p></div>") == whole


# 4 decontamination


def test_windows_items_and_blocks(spark, make_docs):
    item = " ".join(f"b{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (2, "Short ITEM"), (3, None), (4, "..."), (1, "lone"), (None, "nameless one")], "item_id long, text string")
    docs = make_docs([(1, "x " * 5 + item + " y"), (2, " ".join(f"b{i}" for i in range(12))), (3, "a short-item, here"), (4, None), (5, ""),
                      (6, " ".join(f"b{i}" for i in range(3, 16)) + " z"), (7, "the lone nameless one"), (8, "w " * 400 + "short item"), (None, "lone")])
    expected = {1: (26, 20, ["1"], True), 2: (12, 0, [], False), 3: (4, 2, ["2"], True), 4: (0, 0, [], False), 5: (0, 0, [], False),
                6: (14, 13, ["1"], True), 7: (4, 3, ["", "1"], True), 8: (402, 2, ["2"], False), None: (1, 1, ["1"], True)}
    for limit in (50_000, 3):
        got = contamination(docs.withColumn("n_hit", F.lit("clash")), bench, block_windows=limit).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in got} == expected
    assert not contamination(docs, bench.limit(0)).where("contaminated").count()
    assert contamination(docs.limit(0), bench).count() == 0


# 5 toxicity


def labelled_texts(spark, n=300):
    random.seed(5)
    harmless = ["".join(random.choice(["ta", "ri", "no", "sel", "mu", "ve"]) for _ in range(random.randint(1, 3))) for _ in range(200)]
    rows = []
    for i in range(n):
        words = [random.choice(harmless) for _ in range(40)]
        toxic = int(i % 5 == 0)
        for k in range(0, 40 * toxic, 8):
            words[k] = random.choice(["idiot", "moron", "scumbag"])
        rows.append((i, ". ".join(" ".join(words[k:k + 8]) for k in range(0, 40, 8)), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_insults_with_gaps_and_insertions(spark):
    model = toxicity.train(labelled_texts(spark))
    cases = ["you idiot", "you id-i*ot there", "i d i o t", "such an idxiot", "tari nosel", "", None, "...", LONG, "x" * 50_000]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string").withColumn("score", F.lit("clash"))
    got = [r.predicted for r in toxicity.toxicity(docs, model).orderBy("doc_id").collect()]
    assert got == [1, 1, 1, 1, 0, 0, 0, 0, 0, 0]


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string, toxic int")
    model = toxicity.train(none)
    assert toxicity.toxicity(spark.createDataFrame([(1, "idiot")], "doc_id int, text string"), model).first().predicted == 0


def test_kernel_equals_its_definition():
    def plain(s, t):
        def features(word):
            word, out = f"^{word}$", {}
            for i in range(len(word)):
                for j in range(i + 1, len(word)):
                    for k in range(j + 1, len(word)):
                        u = word[i] + word[j] + word[k]
                        out[u] = out.get(u, 0) + toxicity.DECAY ** (k - i + 1)
            return out

        a, b = features(s), features(t)
        return sum(v * b.get(u, 0) for u, v in a.items())

    for s, t in (("idiot", "idxiot"), ("aab", "abab"), ("scum", "tree")):
        assert abs(toxicity.kernel(toxicity.codes([s]), toxicity.codes([t]))[0] - plain(s, t)) < 1e-9
        want = plain(s, t) / (plain(s, s) * plain(t, t)) ** 0.5
        assert abs(toxicity.similarities([s], [t])[0, 0] - want) < 1e-5


# 6 line dedup


def test_common_lines_stay_in_the_largest_id(spark, make_docs):
    common = "This line is common to many"
    docs = make_docs([(1, f"{common}\none"), (2, f"  {common.upper()}\t\ntwo\n{common}"), (3, common), (4, "short\nshort"), (5, "short"), (6, "short"),
                      (7, None), (8, ""), (9, "This line is in two docs only\n"), (10, "this line is in two docs only\n"), (None, common)])
    docs = docs.withColumn("n_lines", F.lit("clash"))
    want = {1: ("one", 2, 1), 2: ("two", 3, 2), 3: (common, 1, 0), 4: ("short\nshort", 2, 0), 5: ("short", 1, 0), 6: ("short", 1, 0), 7: ("", 1, 0),
            8: ("", 1, 0), 9: ("This line is in two docs only\n", 2, 0), 10: ("this line is in two docs only\n", 2, 0), None: ("", 1, 1)}
    for batches in (1, 4, 7):
        got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in dedup_lines(docs, batches=batches, fan_in=2).collect()}
        assert got == want
    assert dedup_lines(docs.limit(0)).count() == 0


def test_rows_of_one_id_are_one_document(make_docs):
    line = "twenty characters or more"
    docs = make_docs([(1, line), (1, line), (2, line)])
    assert [r.n_dropped for r in dedup_lines(docs).collect()] == [0, 0, 0]


def test_length_counts_code_points(make_docs):
    docs = make_docs([(i, "ä" * 19) for i in range(3)] + [(i, "ä" * 20) for i in range(10, 13)])
    got = {r.doc_id: r.n_dropped for r in dedup_lines(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 10: 1, 11: 1, 12: 0}


def test_runs_tell_fresh_lines_and_compact(make_docs):
    runs = LineRuns(fan_in=2)
    fresh = []
    for first in range(4):
        docs = make_docs([(first, f"a line of its own number {first}\nthe line that all documents share")])
        fresh.append(runs.add(line_keys(docs, "doc_id", "text", 20)).count())
    assert fresh == [2, 1, 1, 1]
    assert [len(level) for level in runs.levels] == [0, 0, 1] and len(runs.updates) == 3
    assert runs.levels[2][0].count() == 5
    assert [r.keeper for r in runs.common(4).collect()] == [3] and runs.common(5).count() == 0


def test_rows_without_an_id_lose_their_own_lines(make_docs):
    line, other = "a line that many documents share", "another line that they all share"
    docs = make_docs([(None, f"{line}\nx"), (None, f"{other}\ny"), (None, f"{line}\n{other}"), (1, line), (2, line), (1, other), (2, other)])
    got = sorted(((r.doc_id or 0, r.text, r.n_dropped) for r in dedup_lines(docs).collect()))
    assert got == [(0, "", 2), (0, "x", 1), (0, "y", 1), (1, "", 1), (1, "", 1), (2, line, 0), (2, other, 0)]


def test_very_long_lines(make_docs):
    long = "word " * 400_000
    docs = make_docs([(i, f"{long}{'!' * (i == 9)}\nnumber {i}") for i in (1, 2, 3, 9)])
    assert {r.doc_id: r.n_dropped for r in dedup_lines(docs).collect()} == {1: 1, 2: 1, 3: 0, 9: 0}


# 7 secrets


def test_secrets_and_look_alikes(spark):
    model = secretscan.train(secretscan.labelled_findings(spark))
    texts = [None, "", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962", "card 6223346007190433",
             "no candidates here", 'api_key: "Zk3Qm8vT1xY7bN2cR5wS9dF4gH6jK0lP"']
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("nth", F.lit("clash"))
    got = {r.doc_id: r.is_secret for r in secretscan.scan(docs, model).collect()}
    assert got == {2: True, 3: False, 4: False, 6: True}
    assert secretscan.scan(docs.limit(0), model).count() == 0


def test_secret_candidates_with_a_late_digit(spark):
    values = ["a" * 200 + "7" + "b" * 20, "c" * 100_000 + "dE", "f" * 200]
    docs = spark.createDataFrame([(i, f"token = {v} end") for i, v in enumerate(values)], "doc_id int, text string")
    got = secretscan.candidates(docs, "text", None, ["doc_id"]).select("doc_id", "word", "value").collect()
    assert sorted(map(tuple, got)) == [(0, "token", values[0]), (1, "token", values[1])]



# 8 urls


def test_url_rules_and_parts(spark):
    assert urlfilter.split_url("HTTP://A.b.Org?x=/y") == ("a.b.org", "")
    assert urlfilter.split_url("no scheme") == urlfilter.split_url(None) == ("", "")
    rules = {("org", "/"): "allow", ("a.org", "/x/"): "block"}
    assert urlfilter.matching_rule("b.a.org", "/x/1", rules) == ("a.org/x/", "block")
    assert urlfilter.matching_rule("ba.org", "/x/1", rules) == ("org/", "allow")
    assert urlfilter.matching_rule("a.org", "", rules) == (None, None)
    model = urlfilter.train()
    wrong = [u for u, label in urlfilter.LABELLED if (model.score(*urlfilter.split_url(u)) >= 0.5) != label]
    assert not wrong
    assert urlfilter.train([]).score("x", "/") < 0.5
    pages = spark.createDataFrame([(1, None), (2, "x"), (3, "http://a.com/de/1"), (3, "http://a.com/de/1")], "page_id int, url string").withColumn("host", F.lit(1))
    got = urlfilter.judge_urls(pages, model).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule) for r in got] == [("", "", None), ("", "", None), ("a.com", "/de/1", "com/de/"), ("a.com", "/de/1", "com/de/")]


# 9 languages


def test_languages_and_texts_without_letters(spark):
    words = {"x": ["alpha", "beta", "gama"], "y": ["zorro", "quix", "wolk"]}
    random.seed(1)
    rows = [(i, " ".join(random.choice(words[lang]) for _ in range(12)), lang) for i in range(80) for lang in "xy"] + [(999, "12", "x"), (1000, None, "y"), (1001, "q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.languages == ["x", "y"]
    cases = spark.createDataFrame([(0, "alpha gama"), (1, "QUIX WOLK"), (2, None), (3, "12 34 !"), (4, "")], "k int, text string").withColumn("score", F.lit("clash"))
    got = langid.identify(cases, model).orderBy("k").collect()
    assert [r.lang_pred for r in got] == ["x", "y", "und", "und", "und"]
    assert all(0 <= r.score <= 1 for r in got)
    unknown = langid.identify(cases, langid.train(docs.limit(0)))
    assert {r.lang_pred for r in unknown.collect()} == {"und"}


# 10 near duplicates


def brute_force(texts, size, threshold):
    def words(text):
        return (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ")

    sets = {}
    for i, text in texts:
        w = [x for x in words(text) if x]
        sets[i] = {tuple(w[k:k + size]) for k in range(max(len(w) - size, 0) + 1)} if w else set()
    label = {i: i for i, _ in texts}
    changed = True
    while changed:
        changed = False
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and len(a & b) >= threshold * len(a | b) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_duplicates_against_all_pairs(make_docs):
    random.seed(2)
    texts = [(0, None), (1, ""), (2, " \n "), (3, "one"), (4, "ONE"), (5, "one two")]
    for group in range(4):
        base = [f"g{group}w{k}" for k in range(60)]
        for n in range(40):
            copy = list(base)
            for _ in range(random.randint(0, 5)):
                copy[random.randrange(60)] = f"e{random.randrange(10**6)}"
            texts.append((10 + group * 40 + n, " ".join(copy)))
    texts.append((500, texts[20][1]))
    docs = make_docs(texts).withColumn("component_id", F.lit("clash"))
    want = brute_force(texts, 4, 0.8)
    for chunk in (256, 7):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, shingle=4, chunk=chunk).collect()}
        assert got == want


def test_near_duplicates_of_odd_rows(make_docs):
    docs = make_docs([(None, "a b c d e"), (1, "a b c d e"), (1, "other words with this id"), (2, "other words with this id"), (3, LONG), (4, LONG)])
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == sorted([("None", "None", True), ("1", "1", True), ("1", "1", True), ("2", "1", False), ("3", "3", True), ("4", "3", False)])
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_fewest_matches_bounds_the_miss():
    least = neardup.fewest_matches(128, 0.8, 1e-9)
    assert 60 < least < 90 and neardup.fewest_matches(128, 0.8, 1e-3) > least


# odd texts and markup at length


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" + " \t" * 1_000_000 + "b", "x" * 2_000_000])
def test_very_long_runs_are_encoded(text):
    encoder = packing.encoder(tokenizer_file())
    ids = encoder.ids(text)
    assert ids == encoder.own.encode(text, add_special_tokens=False).ids


def test_pack_takes_very_long_runs(spark, make_docs):
    docs = make_docs([(1, " " * 2_000_000), (2, "\n" * 2_000_000), (3, "x" * 2_000_000), (4, "short")])
    rows = packing.pack(docs, tokenizer_file()).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4} and max(r.length for r in rows) <= 2048


STORY = "<p>The first sentence of the story is long enough to count. The second one follows it, and it is long too.</p><p>Third.</p>"
OUTSIDE = "Words outside of the story are many, and they go on for quite a while. " * 12


@pytest.mark.parametrize("story", ["<article>%s</article>", "<div class='post'>%s</div>", "<main>%s</main>", "<div>%s</div>"])
@pytest.mark.parametrize("side", [
    "<div class='comment-list'><p>%s</p></div>", "<div class='user-comments'><div><p>%s</p></div></div>", "<div class='legal'><p>%s</p></div>",
    "<div id='imprint'>%s</div>", "<section class='post-comments'>%s</section>"])
def test_comments_and_notices_never_come_back(story, side):
    text = htmltext.main_text(f"<html><body><h1>Title</h1>{story % STORY}{side % OUTSIDE}</body></html>")
    assert text == "Title The first sentence of the story is long enough to count. The second one follows it, and it is long too. Third."


def test_wrappers_named_after_comments_keep_their_article():
    page = f"<body><div class='has-comments'><div class='comments-open'>{STORY}</div></div></body>"
    assert htmltext.main_text(page).endswith("Third.")


def test_only_marked_regions_and_their_heading():
    page = f"<body><h2>Elsewhere</h2><div>{OUTSIDE}</div><h1>Title</h1><article>{STORY}</article><article><p>More.</p></article><p>After.</p></body>"
    text = htmltext.main_text(page)
    assert text.startswith("Title The first") and text.endswith("Third. More.")


def test_ratios_decide_in_unmarked_regions():
    links = "<div>" + "".join(f"<a href='{i}'>Link {i}</a> " for i in range(60)) + "</div>"
    page = f"<body>{links}<div>{STORY * 5}</div>{links}</body>"
    assert "Link" not in htmltext.main_text(page)


@pytest.mark.parametrize("tag", ["div", "b", "p", "article", "div class='ad-box'", "div class='comment-list'", "section class='promo-x'"])
def test_deep_markup_takes_seconds(tag):
    import time

    start = time.perf_counter()
    htmltext.main_text(f"<{tag}>" * 50_000 + "words" + "</span>" * 50_000)
    htmltext.main_text(f"<p>{'<b>' * 20_000}" + "<div>x</div>" * 20_000)
    assert time.perf_counter() - start < 20
