"""Collocations against plain counting, with budgets so small that prefixes need all their words."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from lorewell.llm import phrases
from lorewell.llm.phrases import collocations

SCHEMA = "text string, lang string, rank string, phrase string"


def plain(rows, least=30, top=2000):
    counts, sizes = defaultdict(Counter), Counter()
    for text, lang, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang or "und"] += len(words)
            for n in range(1, 5):
                counts[lang or "und"].update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                if j - i < len(p) and 100 * a >= 80 * f[p[i:j]]}
        scored = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "é", "漢字", "a-b", "x1", "x2", "rare", "new", "york", "city", "ß\x01"]
    passage = "one two three four five six"
    rows = []
    for _ in range(300):
        words = [rng.choice(vocabulary[:rng.choice([3, 13])]) for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.4:
            words.insert(rng.randint(0, len(words)), passage)
        if rng.random() < 0.5:
            words.insert(rng.randint(0, len(words)), "new york\tcity")
        rows.append((rng.choice([" ", "  ", ". ", "\n"]).join(words), rng.choice(["en", "en", "en", "de", None, "und"]), "x", "y"))
    return rows + [(None, "en", "x", "y"), ("", None, "x", "y"), ("the " * 40_000, "fr", "x", "y")]


@pytest.mark.parametrize(("seed", "budget"), [(1, 1 << 20), (2, 200), (3, 20)])
def test_against_plain_counting(spark, seed, budget):
    rows = made(seed)
    got = collocations(spark.createDataFrame(rows, SCHEMA), budget=budget)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    equal = sorted(map(tuple, got.collect())) == plain(rows)
    assert equal


def test_report_length_and_least(spark):
    rows = made(4)
    got = collocations(spark.createDataFrame(rows, SCHEMA), least=5, top=7, budget=300)
    assert sorted(map(tuple, got.collect())) == plain(rows, 5, 7)


def test_codes_that_collide_are_made_anew(spark, monkeypatch):
    rows = made(5)
    seen = []

    def counting(docs, seed):
        found = original(docs, seed)
        if not seed:
            return found.withColumn("code", found["code"].bitwiseAND(7))
        seen.append(seed)
        return found

    original = phrases.count_words
    monkeypatch.setattr(phrases, "count_words", counting)
    got = collocations(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect())) == plain(rows)
    assert seen == [1]


def test_nothing_to_find(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations(spark.createDataFrame([(None, None, "", ""), (" \n.", "en", "", "")], SCHEMA)).collect() == []


def test_pieces_and_words():
    batch = pa.record_batch({"text": ["A b.c\td", None, "", "e", "f  g"], "lang": ["x", "x", "y", "y", "x"]})
    words = phrases.Words(batch, 0)
    assert [words.text(k) for k in range(len(words.starts))] == ["a", "b", "c", "d", "e", "f", "g"]
    assert words.goes_on.tolist() == [True, False, True, False, False, True, False]
    assert [words.names[k] for k in words.lang] == ["x", "x", "x", "x", "y", "x", "x"]
