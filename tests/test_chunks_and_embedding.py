import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorewell.functions import tokens
from lorewell.functions.hashing import chunk_id
from lorewell.operators import chunks as C
from lorewell.operators.embed import external_embedding, hash_embedding


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 。\n.,", max_size=400), st.integers(5, 40), st.integers(0, 4))
def test_split_invariants(text, size, overlap):
    parts = C.split_text(text, size, overlap, len)
    covered = 0
    for part in parts:
        assert 0 < len(part["text"]) <= size
        assert text[part["start"]:part["start"] + len(part["text"])] == part["text"]
        assert not text[covered:part["start"]].strip()
        covered = max(covered, part["start"] + len(part["text"]))
    assert not text[covered:].strip()


def test_long_sentence_and_overlap(spark):
    text = "这是一个完整的句子。" * 400
    split = C.chunk_text(500, 50)
    rows = spark.createDataFrame([(text,)], "t string").select(F.explode(split(F.col("t"))).alias("c")).select("c.*").collect()
    assert len(rows) > 1 and all(len(r.text) <= 500 for r in rows)
    assert all(b.start < a.start + len(a.text) for a, b in zip(rows, rows[1:]))


def test_overlap_without_separators():
    parts = C.split_text("x" * 2000, 500, 100, len)
    assert [p["start"] for p in parts] == [0, 400, 800, 1200, 1600]
    assert [len(p["text"]) for p in parts] == [500, 500, 500, 500, 400]


def word_ends(text):
    return np.array([m.end() for m in re.finditer(r"\w+|\s+|[^\w\s]", text)], np.int64)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 。\n.,", max_size=400), st.integers(5, 40), st.integers(0, 4))
def test_token_chunks_keep_size_and_overlap(text, size, overlap):
    ends = word_ends(text)
    covered, last = 0, 0
    for part in C.split_tokens(text, size, overlap, ends):
        start, end = part["start"], part["start"] + len(part["text"])
        inside = int(((ends > start) & (ends <= end)).sum())
        shared = int(((ends > start) & (ends <= last)).sum())
        assert text[start:end] == part["text"] and part["tokens"] == inside <= size
        assert part["shared"] == shared <= overlap
        assert not text[covered:start].strip()
        covered, last = max(covered, end), end
    assert not text[covered:].strip()


def test_tokens_overlap_at_sentences():
    text = "".join(f"Sentence number {i} has a few words in it.\n" for i in range(60))
    parts = C.split_tokens(text, 60, 25, word_ends(text))
    assert len(parts) > 5
    for before, after in zip(parts, parts[1:]):
        assert 10 <= after["shared"] <= 25  # a whole sentence of the chunk before opens the next one
        assert after["text"].startswith("Sentence") and after["start"] < before["start"] + len(before["text"])


def test_tokens_of_a_vocabulary(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    texts = ["转专业的办法是什么？" * 300, "Plain words, one after the other. " * 400, "", None, "x" * 9000, "🙂" * 3000]
    split = C.chunk_tokens(path, 500, 100)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", split(F.col("t")).alias("c")).collect()
    for row in rows:
        if not row.t:
            assert row.c == []
            continue
        ends = np.array([b for _, b in own.encode(row.t, add_special_tokens=False).offsets])
        assert len(row.c) > 1 and row.c[-1].start + len(row.c[-1].text) == len(row.t.rstrip())
        for chunk in row.c:
            end = chunk.start + len(chunk.text)
            assert chunk.tokens == ((ends > chunk.start) & (ends <= end)).sum() <= 500 and chunk.shared <= 100
        assert all(a.shared > 0 for a in row.c[1:])


def test_limits():
    with pytest.raises(ValueError):
        C.chunk_text(499, 0)
    with pytest.raises(ValueError):
        hash_embedding(63)


# Places and values of the vectors' components: one eighth of the squared length per token, "hello" twice.
VECTORS = {
    "Hello 世界, hello again": {13: 0.353553, 14: -0.353553, 67: 0.353553, 123: 0.353553, 125: 0.707107},
    "选 课 a1 通知": {10: -0.353553, 23: 0.353553, 27: 0.353553, 79: 0.353553, 89: 0.353553, 109: 0.353553, 119: 0.353553, 122: -0.353553},
    "": {},
    "!!!": {},
    "一": {114: -1.0},
}


def test_hash_embedding(spark):
    df = spark.createDataFrame([(t,) for t in VECTORS], "t string")
    rows = [r[0] for r in df.select(hash_embedding(128)(F.col("t"))).collect()]
    for expected, vector in zip(VECTORS.values(), rows):
        assert len(vector) == 128
        assert {i: round(v, 6) for i, v in enumerate(vector) if v} == pytest.approx(expected, abs=2e-6)


def test_external_embedding(spark):
    embed = external_embedding(lambda texts: [[float(len(t)), 1.0] for t in texts])
    df = spark.createDataFrame([("abc",)], "t string")
    assert df.select(embed(F.col("t"))).first()[0] == [3.0, 1.0]


def test_bigrams(spark):
    def one(column):
        return spark.range(1).select(column).first()[0]

    assert one(tokens.hash_tokens(F.lit("A1 选x课 通"))) == ["a1", "x", "选", "课", "通", "选课", "课通"]
    assert one(tokens.gap_closed_bigrams(F.lit("选x课选课"))) == ["选课", "课选"]
    assert one(tokens.run_bigrams(F.lit("选x课选课"))) == ["课选", "选课"]


def test_chunk_id_reacts_to_every_field(spark):
    rows = [("d", 0, "t", "a"), ("d", 0, "t", "b"), ("d", 1, "t", "a"), ("e", 0, "t", "a"), ("d", 0, "u", "a"), ("d", 0, "t", None), ("d", 0, "t", "a")]
    df = spark.createDataFrame(rows, "doc string, i int, t string, category string")
    ids = [r[0] for r in df.select(chunk_id(F.col("doc"), F.col("i"), F.col("t"), ["category"])).collect()]
    assert len(set(ids)) == 6 and ids[0] == ids[-1]


def test_numbering_over_slices(spark):
    pages = [("d", p, [{"text": f"{p}-{i}", "start": i} for i in range(p % 4)]) for p in range(1, 30)]
    df = spark.createDataFrame(pages, "document_id string, page int, chunks array<struct<text:string,start:int>>")
    rows = C.number_chunks(df, slice_pages=3).orderBy("chunk_index").collect()
    expected = [c["text"] for _, _, cs in pages for c in cs]
    assert [r.content for r in rows] == expected and [r.chunk_index for r in rows] == list(range(len(expected)))


def test_hash_embedding_takes_the_tokens_of_hash_tokens(spark):
    """Texts are cut in Python for it; the vectors are those of the column function's tokens."""
    import hashlib

    texts = [None, "", " . ", "A1 选x课 通", "\u212aELVIN \u0130STANBUL ß ﬁ É\x00b1", "㐀鿿\U00020000䷀", "转专业 " * 40, *(f"w{i} the THE {i % 7}" for i in range(300))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        tokens.hash_tokens(F.col("t")).alias("tokens"), hash_embedding(4096)(F.col("t")).alias("v"), "t").collect()
    for row in rows:
        vector = np.zeros(4096)
        for token in row.tokens or []:
            number = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
            vector[number % 4096] += 1.0 if number % 2 else -1.0
        norm = np.sqrt((vector * vector).sum())
        assert row.v == (vector / norm if norm else vector).astype(np.float32).tolist()
        assert tokens.hash_tokens_of(row.t or "") == (row.tokens or [])
