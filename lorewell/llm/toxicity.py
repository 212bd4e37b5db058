"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

A sentence is as toxic as its worst word window, and a text as its worst sentence. Windows are compared through the
gap-weighted subsequence kernel: two strings are alike if they share ordered letter triples, discounted by the
gaps inside them, so a letter put into an insult or characters strewn over it cost a little and no more. Training finds
the windows that mark the labelled sentences (multiple-instance learning), takes landmarks among them and among
harmless words, and fits a support vector machine in the space that the landmarks span. Because the kernel
has explicit features, the trained machine folds into one weight per letter triple, and scoring a window never touches
a landmark again.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.llm import batches as B
from lorewell.scale import cut_lineage

DECAY = 0.7
LONGEST = 24
SAMPLE_ROWS = 6000
POSITIVES = 400
NEGATIVES = 10_000
ROUNDS = 3
HARD = 4000
LANDMARKS = 240
CACHE_WORDS = 400_000

_LETTERS = 64
_SENTENCE = re.compile(r"[.!?\n]+")
_SPACED = re.compile(r"(?<!\S)\w(?:[ \t]\w){2,}(?!\S)")
_NOISE = re.compile(r"[\W_]+")


def windows(word: str) -> list[str]:
    """A token without its non-letters, cut into overlapping stretches if it is long."""
    bare = _NOISE.sub("", word)
    if len(bare) <= LONGEST:
        return [bare] if len(bare) >= 3 else []
    step = LONGEST // 2
    return [bare[i:i + LONGEST] for i in range(0, len(bare) - step, step)]


def tokens(text: str) -> set[str]:
    """Distinct tokens of a lower-cased text; letters written one by one count as one token, too."""
    found = set(text.split())
    if " " in text:
        found.update(m.group() for m in _SPACED.finditer(text))
    return found


def codes(words: list[str]) -> np.ndarray:
    """Equally long words as numbers between two end marks: a-z, 0-9, other letters folded behind them."""
    table = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.int64)
    out = 36 + table % (_LETTERS - 38)
    out = np.where((table >= 97) & (table <= 122), table - 97, out)
    out = np.where((table >= 48) & (table <= 57), table - 22, out)
    return np.pad(out, ((0, 0), (1, 1)), constant_values=((0, 0), (_LETTERS - 1, _LETTERS - 2)))


@lru_cache(maxsize=None)
def _gaps(n: int) -> np.ndarray:
    """decay ** (letters passed over), strictly below the diagonal."""
    i = np.arange(n)
    distance = i[:, None] - i[None, :] - 1
    return np.where(distance >= 0, DECAY ** np.maximum(distance, 0), 0.0)


@lru_cache(maxsize=None)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    i, j, k = (np.array(x) for x in zip(*[(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n)], strict=True))
    return i, j, k, DECAY ** (k - i + 1.0)


def kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Subsequence kernel (triples) of paired rows of letters."""
    same = (left[:, :, None] == right[:, None, :]) * DECAY ** 2
    a, b = _gaps(left.shape[1]), _gaps(right.shape[1])
    state = same
    for _ in range(2):
        state = same * (a @ state @ b.T)
    return state.sum(axis=(1, 2))


def _by_length(words: list[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    return groups


def similarities(words: list[str], others: list[str]) -> np.ndarray:
    """Normalised kernel of every word with every other; both lists are bounded by the caller."""
    known = np.zeros(_LETTERS ** 3, np.int32)
    triples = [_triple_weights(w) for w in others]
    used = np.unique(np.concatenate([ids for ids, _ in triples]))
    known[used] = np.arange(1, len(used) + 1)
    table = np.zeros((len(used) + 1, len(others)), np.float32)
    for column, (ids, weights) in enumerate(triples):
        np.add.at(table[:, column], known[ids], weights)
    out = np.zeros((len(words), len(others)))
    for n, rows in _by_length(words).items():
        letters = codes([words[r] for r in rows])
        i, j, k, decay = _triples(n + 2)
        part = np.zeros((len(rows), len(others)), np.float32)
        for a, b, c, d in zip(i, j, k, decay, strict=True):
            part += table[known[(letters[:, a] * _LETTERS + letters[:, b]) * _LETTERS + letters[:, c]]] * np.float32(d)
        out[rows] = part / np.sqrt(kernel(letters, letters))[:, None]
    return out


def _triple_weights(word: str) -> tuple[np.ndarray, np.ndarray]:
    """The word's normalised explicit features: triple numbers (may repeat) and their weights."""
    letters = codes([word])
    i, j, k, decay = _triples(letters.shape[1])
    return ((letters[:, i] * _LETTERS + letters[:, j]) * _LETTERS + letters[:, k])[0], decay / math.sqrt(kernel(letters, letters)[0])


@dataclass
class ToxicityModel:
    weights: np.ndarray = field(repr=False)  # one per ordered letter triple
    bias: float = -1.0
    slope: float = 0.0
    shift: float = 0.0
    lowest: float = -2.0
    words: list[str] = field(default_factory=list)

    def margins(self, words: list[str]) -> np.ndarray:
        """Decision values of windows of at least three letters."""
        out = np.empty(len(words))
        for n, rows in _by_length(words).items():
            i, j, k, decay = _triples(n + 2)
            step = max(1, 400_000 // len(i))
            letters = codes([words[r] for r in rows])
            for at in range(0, len(rows), step):
                part = letters[at:at + step]
                value = self.weights[(part[:, i] * _LETTERS + part[:, j]) * _LETTERS + part[:, k]] @ decay
                out[rows[at:at + step]] = value / np.sqrt(kernel(part, part)) + self.bias
        return out

    def probability(self, margin):
        return 1 / (1 + np.exp(-(self.slope * np.asarray(margin) + self.shift)))


class Scorer:
    """Margins of texts, with the words already seen in this worker remembered up to a bound."""

    def __init__(self, model: ToxicityModel):
        self.model, self.seen = model, {}

    def margins(self, texts: list[str | None]) -> np.ndarray:
        wanted = [tokens((t or "").lower()) for t in texts]
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        new = [w for w in set().union(*wanted) if w not in self.seen]
        cut = [(w, piece) for w in new for piece in windows(w)]
        self.seen.update(dict.fromkeys(new, self.model.lowest))
        pieces = list(dict.fromkeys(p for _, p in cut))
        margin = dict(zip(pieces, self.model.margins(pieces).tolist(), strict=True))
        for w, piece in cut:
            self.seen[w] = max(self.seen[w], margin[piece])
        return np.array([max((self.seen[w] for w in ws), default=self.model.lowest) for ws in wanted])


def fit_machine(features: np.ndarray, labels: np.ndarray, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, both classes weighing the same."""
    x = np.hstack((features, np.ones((len(features), 1))))
    weight = np.where(labels > 0, 0.5 / max((labels > 0).sum(), 1), 0.5 / max((labels < 0).sum(), 1)) * cost * len(labels) / 10
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(50):
        active = labels * (x @ w) < 1
        part = x[active] * weight[active][:, None]
        new = np.linalg.solve(ridge + part.T @ x[active], part.T @ labels[active])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def _calibrate(margins: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic fit of the label on the margin, a little regularised."""
    x = np.stack((margins, np.ones(len(margins))), axis=1)
    theta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (toxic - p) - 1e-3 * theta)
        size = np.abs(step).max()
        theta += step / max(1.0, size / 2)
        if size < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def _window_counts(sample: DataFrame) -> DataFrame:
    """(word, toxic, clean): in how many distinct sentences each window stands; a sentence of any clean text is clean."""

    def run(rows):
        for batch in rows:
            for block in B.blocks(batch, "text"):
                out = {}
                for text, toxic in zip(block.column("text").to_pylist(), block.column("toxic").to_pylist(), strict=True):
                    for sentence in _SENTENCE.split((text or "").lower()):
                        for word in tokens(sentence):
                            for piece in windows(word):
                                out[piece, sentence] = min(toxic, out.get((piece, sentence), 1))
                words, sentences = zip(*out) if out else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words, pa.string()), pa.array(sentences, pa.string()), pa.array(out.values(), pa.int32())], ["word", "sentence", "toxic"])

    pairs = sample.select("text", "toxic").mapInArrow(run, "word string, sentence string, toxic int")
    once = pairs.groupBy("word", F.xxhash64("sentence").alias("sentence")).agg(F.min("toxic").alias("toxic"))
    return once.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))


def train(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
          rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn from at most ``rows`` labelled texts, chosen by a hash of the id; null labels and texts teach nothing.

    A window marks toxic sentences if chance would put it there less than once in a hundred vocabularies. Without
    such windows the model answers with the share of toxic texts, whatever the text.
    """
    spark = labelled.sparkSession
    B.prepare(spark)
    known = labelled.where(F.col(toxic).isNotNull() & F.col(text).isNotNull())
    known = known.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(toxic).cast("int").alias("toxic"))
    few = B.hash_sample(known, ["id", "text"], rows)
    sample = cut_lineage(few.orderBy(F.xxhash64("id"), F.xxhash64("text")).limit(rows).repartition(8))
    counts = _window_counts(sample).persist()
    total = counts.agg(F.count("*"), F.sum("toxic"), F.sum("clean")).first()
    vocabulary, in_toxic, in_clean = total[0], total[1] or 0, total[2] or 0
    base = np.clip(in_toxic / max(in_toxic + in_clean, 1), 1e-6, 1 - 1e-6)
    # log likelihood ratio of the window's share of toxic sentences against the share overall
    t, c = F.col("toxic"), F.col("clean")
    share = t / (t + c)
    surprise = t * F.log(share / F.lit(float(base))) + F.when(c > 0, c * F.log((1 - share) / F.lit(float(1 - base)))).otherwise(0.0)
    ranked = counts.where(t > 0).withColumn("surprise", surprise).where(
        (share > 0.5) & (F.col("surprise") > math.log(100 * max(vocabulary, 1))))
    positives = [r.word for r in ranked.orderBy(F.desc("surprise"), "word").limit(POSITIVES).collect()]
    harmless = counts.where((c > 0) & (share < 0.5)).orderBy(F.xxhash64("word")).limit(NEGATIVES)
    negatives = [r.word for r in harmless.select("word").collect()]
    blank = ToxicityModel(np.zeros(_LETTERS ** 3))
    share_of_texts = sample.agg(F.avg("toxic")).first()[0] or 0.0
    p = float(np.clip(share_of_texts, 1e-3, 0.49))
    blank.shift = math.log(p / (1 - p))
    if not positives or not negatives:
        return blank
    model = _machine(positives, negatives, [])
    for _ in range(ROUNDS):
        hard = _hardest(counts.where((c > 0) & (share < 0.5)), model)
        model = _machine(positives, negatives, hard)
    counts.unpersist()
    shared = spark.sparkContext.broadcast(model)

    def score(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for block in B.blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(scorer.margins(block.column("text").to_pylist())), block.column("toxic")], ["margin", "toxic"])

    fitted = sample.select("text", "toxic").mapInArrow(score, "margin double, toxic int").toArrow()
    order = np.lexsort((fitted.column("toxic").to_numpy(), fitted.column("margin").to_numpy()))
    model.slope, model.shift = _calibrate(fitted.column("margin").to_numpy()[order], fitted.column("toxic").to_numpy()[order])
    return model if model.slope > 0 else blank


def _hardest(words: DataFrame, model: ToxicityModel) -> list[str]:
    """The harmless windows that the model suspects most."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            names = batch.column("word").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(shared.value.margins(names))], ["word", "margin"])

    rows = words.select("word").mapInArrow(score, "word string, margin double")
    return [r.word for r in rows.orderBy(F.desc("margin"), "word").limit(HARD).collect()]


def _machine(positives: list[str], negatives: list[str], hard: list[str]) -> ToxicityModel:
    """Landmarks from all three lists, the projection that they span, and the machine in it, as letter triples."""
    part = LANDMARKS // 4
    negatives = list(dict.fromkeys([*hard, *negatives]))
    landmarks = list(dict.fromkeys([*positives[:part], *positives[part::max(1, len(positives) // part)], *negatives[:part], *negatives[-part:]]))
    values, vectors = np.linalg.eigh(similarities(landmarks, landmarks))
    good = values > 1e-6
    root = vectors[:, good] / np.sqrt(values[good])
    words = [*positives, *negatives]
    labels = np.array([1.0] * len(positives) + [-1.0] * len(negatives))
    w, bias = fit_machine(similarities(words, landmarks) @ root, labels)
    weights = np.zeros(_LETTERS ** 3)
    for word, alpha in zip(landmarks, root @ w, strict=True):
        ids, part = _triple_weights(word)
        np.add.at(weights, ids, alpha * part)
    return ToxicityModel(weights, bias, words=positives)


def toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with score (probability of label 1) and predicted (1 from 0.5 up).

    Whole texts are read, whatever their length; null, empty and wordless texts get the score of a text without any
    suspicious window. Repeated rows are judged alike. Columns score and predicted of the input are replaced.
    """
    B.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    def compute(block):
        if "scorer" not in state:
            state["scorer"] = Scorer(shared.value)
        p = model_probability(shared.value, state["scorer"], block.column(text).to_pylist())
        return [p, (p >= 0.5).astype(np.int32)]

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return B.annotate(docs, text, docs.columns, fields, compute)


def model_probability(model: ToxicityModel, scorer: Scorer, texts: list[str | None]) -> np.ndarray:
    return model.probability(scorer.margins(texts))
