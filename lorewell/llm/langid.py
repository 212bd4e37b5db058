"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters is a blank, and runs of one to three characters are hashed to
``BUCKETS`` features. Document frequencies are counted over all documents to learn from; the regression itself is trained
on a bounded sample per language with follow-the-regularised-leader updates under an elastic-net penalty, and a
temperature fitted on rows put aside makes its scores probabilities. Scoring is one gather per n-gram, with no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.llm import batches as B
from lorewell.scale import top_per_key

BUCKETS = 1 << 16
ORDERS = 3
SAMPLE_PER_LANGUAGE = 600
UNKNOWN = "und"
_BLOCK = 1 << 18
_SCALE = 50.0


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, first, has_letter): hashed n-grams of all texts; those of text i start at ``first[i]``.

    A text has one n-gram of each order per character, the blank before it included; n-grams run into blanks behind.
    """
    padded = [f" {(t or '').lower()}  " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32)
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in padded])))
    letter = _letters()[codes]
    some = np.add.reduceat(letter, offsets[:-1], dtype=np.int64) > 0 if len(texts) else np.zeros(0, bool)
    codes = np.where(letter, codes, np.uint32(32))
    count = len(codes)
    out = np.empty((count, ORDERS), np.uint16)
    state = np.zeros(count, np.uint32)
    for order in range(ORDERS):
        state[:count - order] = state[:count - order] * np.uint32(0x01000193) + codes[order:]
        mixed = (state + np.uint32(order)) * np.uint32(0x9E3779B1)
        out[:, order] = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(16)
    own = np.ones(count, bool)  # n-grams that start in the blanks behind a text are none of its own
    own[offsets[1:] - 1] = own[offsets[1:] - 2] = False
    kept = np.cumsum(own)
    first = np.concatenate(([0], kept[offsets[1:] - 1])) if len(texts) else np.zeros(1, np.int64)
    return out[own].ravel(), first * ORDERS, some


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray = field(repr=False)  # BUCKETS x languages, document rarity included
    bias: np.ndarray = field(repr=False)
    temperature: float = 1.0

    def logits(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        sums = np.add.reduceat(self.weights[features], first[:-1], axis=0)
        return sums * (_SCALE / np.diff(first))[:, None] + self.bias


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def rarity(docs: DataFrame, text: str) -> np.ndarray:
    """Smoothed inverse document frequency of every feature, over all given documents."""

    def run(rows):
        total, seen, docs_seen = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), 0
        for batch in rows:
            for block in B.blocks(batch, text, _BLOCK):
                features, first, _ = grams(block.column(text).to_pylist())
                docs_seen += block.num_rows
                for a, b in zip(first[:-1], first[1:], strict=True):
                    mine = features[a:b]
                    seen[mine] = 1
                    total += seen
                    seen[mine] = 0
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used], pa.int64()), pa.array([docs_seen, *total[used]], pa.int64())], ["feature", "docs"])

    found = docs.select(text).mapInArrow(run, "feature long, docs long").groupBy("feature").agg(F.sum("docs").alias("docs"))
    count, out = 0, np.zeros(BUCKETS)
    for feature, n in found.collect():
        if feature < 0:
            count = n
        else:
            out[feature] = n
    return np.log((1 + count) / (1 + out)) + 1


def _examples(docs: DataFrame, text: str) -> pa.Table:
    """(lang, rank, features, frequencies) of each row of a bounded sample, in the order of lang and rank."""
    schema = "lang string, rank int, features array<int>, frequencies array<float>"

    def run(rows):
        for batch in rows:
            for block in B.blocks(batch, text, _BLOCK):
                features, first, some = grams(block.column(text).to_pylist())
                ids, values = [], []
                for a, b in zip(first[:-1], first[1:], strict=True):
                    mine, often = np.unique(features[a:b], return_counts=True)
                    ids.append(mine.astype(np.int32))
                    values.append((often / (b - a)).astype(np.float32))
                out = pa.RecordBatch.from_arrays(
                    [block.column("lang"), block.column("rank"), pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
                    ["lang", "rank", "features", "frequencies"])
                yield out.filter(pa.array(some))

    return docs.select("lang", "rank", text).mapInArrow(run, schema).orderBy("lang", "rank").toArrow()


def follow_the_leader(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int, alpha: float,
                      beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal multinomial logistic regression; ``l1`` keeps weights at zero, ``l2`` keeps them small."""
    size = BUCKETS + 1  # the last feature is the bias
    z, n, w = (np.zeros((size, classes)) for _ in range(3))
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            ids, values, label = examples[k]
            p = softmax(values @ w[ids])
            p[label] -= 1
            gradient = values[:, None] * p
            before = n[ids]
            after = before + gradient ** 2
            zi = z[ids] + gradient - (np.sqrt(after) - np.sqrt(before)) / alpha * w[ids]
            z[ids], n[ids] = zi, after
            shrunk = np.sign(zi) * np.maximum(np.abs(zi) - l1, 0)
            w[ids] = -shrunk / ((beta + np.sqrt(after)) / alpha + l2)
    return w[:-1], w[-1]


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the smallest loss on rows put aside."""
    if not len(labels):
        return 1.0
    choices = np.geomspace(0.1, 10, 81)
    losses = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in choices]
    return float(choices[int(np.argmin(losses))])


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE,
          epochs: int = 5, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> LanguageModel:
    """Learn from all given rows whose language is not null.

    Document frequencies cover all of them; the weights come from at most ``per_language`` rows of each
    language, chosen by a hash of the id, a fifth of which set the temperature. Without any labelled text the
    model knows no language.
    """
    B.prepare(docs.sparkSession)
    known = docs.where(F.col(lang).isNotNull()).select(
        F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    idf = rarity(known, "text")
    order = [F.xxhash64("id"), F.xxhash64("text")]
    few = B.hash_sample(known, ["id", "text"], per_language, "lang")
    rows = _examples(top_per_key(few, ["lang"], order, per_language), "text")
    labels = rows.column("lang").to_pylist()
    languages = sorted(set(labels))
    number = {name: i for i, name in enumerate(languages)}
    fitted, aside = [], []
    bias = np.array([BUCKETS], np.int32)
    # views into the few large arrays that came back; lists of numbers would take many times their room
    features, frequencies = (rows.column(c).combine_chunks() for c in ("features", "frequencies"))
    ends = np.cumsum(features.value_lengths().to_numpy()) if len(labels) else []
    features, frequencies = features.flatten().to_numpy(), frequencies.flatten().to_numpy()
    for k, (name, rank, end) in enumerate(zip(labels, rows.column("rank").to_pylist(), ends, strict=True)):
        start = ends[k - 1] if k else 0
        ids, often = features[start:end], frequencies[start:end]
        row = (np.concatenate((ids, bias)), np.concatenate((often * idf[ids] * _SCALE, [1.0])).astype(np.float32), number[name])
        (fitted if rank % 5 else aside).append(row)
    del rows, features, frequencies
    if not fitted:
        return LanguageModel([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1))
    w, b = follow_the_leader(fitted, len(languages), epochs, alpha, beta, l1, l2)
    full = np.vstack((w, b))
    logits = np.array([v @ full[i] for i, v, _ in aside]).reshape(-1, len(languages))
    temperature = _temperature(logits, np.array([k for _, _, k in aside], np.int64))
    del fitted, aside
    pa.default_memory_pool().release_unused()
    return LanguageModel(languages, (w * idf[:, None]).astype(np.float32), b, temperature)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred (a learned language) and score (its calibrated probability).

    Null texts, texts without a letter, and all texts under a model that knows no language are ``und`` with
    score 0. Only the text is looked at; repeated rows are judged alike; equal scores go to the first language by name.
    Columns lang_pred and score of the input are replaced.
    """
    B.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(block):
        model = shared.value
        features, first, some = grams(block.column(text).to_pylist())
        if not model.languages:
            return [[UNKNOWN] * block.num_rows, [0.0] * block.num_rows]
        p = softmax(model.logits(features, first) / model.temperature)
        best = p.argmax(axis=1)
        names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, some, strict=True)]
        return [names, np.where(some, p[np.arange(len(best)), best], 0.0)]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return B.annotate(docs, text, docs.columns, fields, compute, limit=_BLOCK)


def accepted(minimum: float = 0.3) -> Column:
    """Rows whose language was recognised with at least this probability."""
    return (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= minimum)
