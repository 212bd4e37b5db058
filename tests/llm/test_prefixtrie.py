"""The prefix trie against plain counting, in small segments and shards too."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lorewell.llm.prefixtrie import DoubleArray, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def plain(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv].append((turn is not None, turn or 0, mark, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        sequence = (*own.get(base, [])[:h], *own[c][h:])
        ends[sequence].append(c)
        for d in range(len(sequence) + 1):
            members[sequence[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1].encode()) if path else 0
    return sorted((min(convs), len(path), min(members[path[:-1]]) if path else -1, len(convs), kids[path], leaves[path], saved[path],
                   hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest()) for path, convs in members.items())


def rows_of(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def made(seed, convs=120):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 400), convs):
        if rng.random() < 0.3:  # one common conversation
            texts = ["hello", "é", "", "bye"]
        else:
            texts = [rng.choice(["hello", "what", "x" * 40, None, "é"]) for _ in range(rng.choice([1, 2, 5, 9, 14]))]
        for turn, text in enumerate(texts):
            rows.append((c, None if rng.random() < 0.1 else turn, rng.choice(["user", "user", None]), text, "other"))
    return rows


def test_double_array_finds_every_sequence_and_no_other():
    rng = random.Random(1)
    sequences = sorted({tuple(rng.randint(1, 30) for _ in range(rng.randint(0, 6))) for _ in range(400)})
    trie = DoubleArray([list(s) for s in sequences])
    paths = {s[:d] for s in sequences for d in range(1, len(s) + 1)}
    assert len(trie.states) == len(set(trie.states)) == len(paths)

    def walk(sequence):
        state = 1
        for symbol in sequence:
            state = trie.step(state, symbol)
            if not state:
                return False
        return True

    assert all(walk(p) for p in paths)
    for _ in range(2000):
        probe = tuple(rng.randint(1, 30) for _ in range(rng.randint(1, 4)))
        assert walk(probe) == (probe in paths)


@pytest.mark.parametrize(("seed", "segment", "budget"), [(1, 1 << 16, 200_000), (2, 3, 40), (3, 5, 5), (4, 1 << 16, 12)])
def test_against_plain_counting(spark, seed, segment, budget):
    rows = made(seed)
    got = prefix_trie(spark.createDataFrame(rows, SCHEMA), segment=segment, budget=budget)
    equal = rows_of(got) == plain(rows)  # not inside the assert: describing the difference of long lists takes minutes
    assert equal


def test_odd_rows(spark):
    rows = [(None, 0, "user", "nobody's", "x"), (5, None, None, None, "x"), (5, None, None, None, "x"), (6, 1, "user", "y" * 3_000_000, "x"),
            (7, 0, "a", "bc", "x"), (8, 0, "ab", "c", "x"), (10, 3, "user", "late", "x"), (10, 3, "user", "late", "x"), (10, -1, "user", "early", "x")]
    got = prefix_trie(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert rows_of(got) == plain(rows)
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
