"""SimHash groups against all pairs, and the rows that are easy to get wrong."""

import os
import random
import re

import numpy as np
import pytest
import xxhash

from lorewell.llm import simhash
from lorewell.llm.graph import components, meet

SF = os.environ.get("LOREWELL_TEST_SF", "/root/testdata/sf0.001")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=2):
    """Smallest id reachable, by comparing all pairs of different fingerprints."""
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for i in ids:
        parent[root(i)] = root(first.setdefault(prints[i], i))
    reps = np.array(list(first.values()))
    values = np.array(list(first), np.uint64)
    for n in range(len(values)):
        for m in np.flatnonzero(np.bitwise_count(values[n + 1:] ^ values[n]) <= radius) + n + 1:
            x, y = root(reps[n]), root(reps[m])
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_every_pair_within_the_radius_meets_in_a_table():
    for radius in (2, 4):
        tables = simhash.masks(radius)
        assert len(tables) == 2 ** (radius + 1) - 1
        assert {m.bit_count() for m in tables} <= set(range(30, 38))
        rng = random.Random(radius)
        for _ in range(3000):
            change = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
            assert any(change & m == 0 for m in tables)


@pytest.mark.parametrize("text", ["", "one", "One two", "a b c", "a b c a b c a b c", "É é x  y\tz\x0bw", "w " * 5000])
def test_fingerprint(text, monkeypatch):
    low = text.encode().translate(simhash.B.LOWER_TABLE)
    assert simhash.fingerprint(low) == plain_fingerprint(text)
    monkeypatch.setattr(simhash, "STRETCH", 7)
    assert simhash.fingerprint(low) == plain_fingerprint(text)


@pytest.mark.parametrize("bucket", [1, 4, 256])
def test_links_join_what_all_pairs_join(spark, bucket):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(400):  # chains and dense clouds around a few centres
        values.append(values[rng.randrange(len(values))] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    values += [values[0] ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]
    prints = {n: v for n, v in enumerate(dict.fromkeys(values))}
    rows = [(simhash._signed(v), n) for n, v in prints.items()]
    classes = spark.createDataFrame(rows, "fingerprint long, rep long")
    found = {r.id: r.component for r in components(simhash.links(classes, 2, bucket)).collect()}
    assert {n: found.get(n, n) for n in prints} == plain_components(prints)


def test_whole_table_against_all_pairs(spark):
    from lorewell.llm.queries import QUERIES

    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    want = {(i, f"{prints[i]:016x}", c) for i, c in plain_components(prints).items()}
    got = QUERIES["op12_simhash_near_dedup"](spark, SF)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert {tuple(r) for r in got.collect()} == want


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(9, None, "x"), (4, "", "x"), (7, "  \n ", "x"), (1, "alone", "x"), (2, long, "x"), (3, long, "x"), (3, "alone", "x"),
            (None, long, "x"), (3, long, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sorted(map(tuple, simhash.simhash_groups(docs, keep=["text"]).select("doc_id", "text", "component_id").collect()), key=str)
    want = sorted([(9, None, 4), (4, "", 4), (7, "  \n ", 4), (1, "alone", 1), (2, long, 1), (3, long, 1), (3, "alone", 1),
                   (None, long, None), (3, long, 1)], key=str)
    assert got == want
    assert simhash.simhash_groups(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        simhash.simhash_groups(docs, radius=3)


def test_meet_deals_a_hot_key_over_tasks(spark):
    rows = spark.range(20_000).selectExpr("if(id % 3 = 0, -1L, id) as k", "id as v")
    facts = rows.groupBy("k").count().selectExpr("k", "count as weight", "k * 2 as twice")
    joined = meet(rows, facts, ["k"], "weight", 20_000)
    assert joined.columns == ["k", "v", "twice"]
    assert joined.count() == 20_000 and joined.where("twice <> 2 * k").count() == 0
