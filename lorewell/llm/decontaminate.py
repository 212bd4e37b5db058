"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item is cut into windows of consecutive words and each window into word shingles. The shingles of
a window are put in order of rarity in the documents; for whole containment the rarest alone is a sufficient
prefix. Documents are joined with the windows on that prefix shingle only; the place of the shingle in the window
and the ends of the document bound the candidate (no window may start before or end behind the text), and the
words of each candidate are compared one by one. The benchmark is joined in blocks of bounded size, so it
may grow beyond what one broadcast can hold; documents are never shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.llm import batches as B

WINDOW = 13
SHINGLE = 5
BLOCK_WINDOWS = 50_000

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
           T.StructField("items", T.ArrayType(T.StringType()))]


def _hashes(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return B.span_hashes(data, ends - [len(w) for w in words], ends)


def benchmark_windows(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """(item, window): every distinct window of each item, its words joined by blanks. Items without words have none."""
    schema = "item string, window string"

    def run(rows):
        for batch in rows:
            items, windows = [], []
            for name, value in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = _WORD.findall((value or "").encode().translate(B.LOWER_TABLE))
                cut = {b" ".join(words[i:i + window]) for i in range(max(len(words) - window, 0) + 1)} if words else ()
                windows += [w.decode() for w in sorted(cut)]
                items += [name] * len(cut)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(windows, pa.string())], ["item", "window"])

    named = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return named.mapInArrow(run, schema).distinct()


class _Shingles:
    """Sorted shingle hashes by size, for a quick look-up of all shingles of a text."""

    def __init__(self, by_size: dict[int, np.ndarray]):
        self.sorted = {k: np.unique(v) for k, v in by_size.items()}
        self.base = {}
        total = 0
        for k, v in self.sorted.items():
            self.base[k] = total
            total += len(v)
        self.count = total
        self.seen = {}
        for k, v in self.sorted.items():
            self.seen[k] = np.zeros(1 << 20, bool)
            self.seen[k][v >> np.uint64(44)] = True

    def find(self, words: np.ndarray):
        """(size, places, numbers) of the known shingles among all runs of the words."""
        for k, known in self.sorted.items():
            hashes = B.window_hashes(words, k)
            places = np.flatnonzero(self.seen[k][hashes >> np.uint64(44)])
            if len(places):
                at = np.minimum(np.searchsorted(known, hashes[places]), len(known) - 1)
                same = known[at] == hashes[places]
                yield k, places[same], at[same] + self.base[k]


def _words_of(block: pa.RecordBatch, text: str):
    data, offsets = B.text_bytes(block.column(text))
    data = B.LOWER[data]
    starts, ends, first = B.word_spans(data, offsets, B.ALNUM)
    return data, starts, ends, first, B.span_hashes(data, starts, ends)


def _rarity(docs: DataFrame, text: str, shingles: _Shingles) -> np.ndarray:
    """In how many documents each known shingle is found, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(shingles)

    def count(rows):
        table = shared.value
        total = np.zeros(table.count, np.int64)
        for batch in rows:
            for block in B.blocks(batch, text):
                _, _, _, first, words = _words_of(block, text)
                for k, places, numbers in table.find(words):
                    owner = np.searchsorted(first, places, "right") - 1
                    inside = places + k <= first[owner + 1]
                    pairs = np.unique(owner[inside] * table.count + numbers[inside])
                    total += np.bincount(pairs % table.count, minlength=table.count)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["number", "docs"])

    rows = docs.select(text).mapInArrow(count, "number long, docs long").groupBy("number").agg(F.sum("docs").alias("docs"))
    out = np.zeros(shingles.count, np.int64)
    for number, found in rows.collect():
        out[number] = found
    return out


def _prefix_table(docs: DataFrame, text: str, windows: list, shingle: int):
    """(shingles, entries): for each prefix shingle's number the windows that it stands for; rarest shingle first.

    A window with a shingle that no document holds cannot occur and is left out.
    """
    cut, by_size = [], {}
    for item, window in windows:
        words = window.encode().split(b" ")
        size = min(shingle, len(words))
        hashes = _hashes(words)
        runs = B.window_hashes(hashes, size)
        cut.append((item, words, hashes, size, runs))
        by_size.setdefault(size, []).append(runs)
    shingles = _Shingles({k: np.concatenate(v) for k, v in by_size.items()})
    docs_with = _rarity(docs, text, shingles)
    entries: dict[int, list] = {}
    chosen: dict[int, list] = {}
    for item, words, hashes, size, runs in cut:
        numbers = np.searchsorted(shingles.sorted[size], runs) + shingles.base[size]
        order = np.lexsort((numbers, docs_with[numbers]))
        if docs_with[numbers[order[0]]]:
            best = int(order[0])
            chosen.setdefault(size, []).append(runs[best])
            entries.setdefault((size, int(runs[best])), []).append((best, hashes, b" ".join(words), item))
    prefix = _Shingles({k: np.array(v, np.uint64) for k, v in chosen.items()})
    table = {}
    for (size, value), found in entries.items():
        table[int(np.searchsorted(prefix.sorted[size], np.uint64(value))) + prefix.base[size]] = found
    return prefix, table


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE,
                  block_windows: int = BLOCK_WINDOWS, per: int = 20) -> DataFrame:
    """``docs`` with n_words, n_hit, items and contaminated.

    A window is ``window`` consecutive words of an item, or a shorter item as a whole. n_hit counts the document's
    words inside any occurrence of a window; items lists the ids (as strings, sorted) of items with an occurring
    window; contaminated is n_hit > 0 and one word in ``per`` hit at least.

    Null and empty texts have no words and are clean. A null item id counts as the id ''; rows of the benchmark with
    one id are one item; an empty benchmark marks nothing. Repeated documents are judged row by row. Input columns
    named like the results are replaced; all others pass through. ``block_windows`` bounds what is broadcast.
    """
    B.prepare(docs.sparkSession)
    windows = benchmark_windows(benchmark, item, item_text, window)
    keep = docs.columns
    result = docs
    carried: list[str] = []
    count = windows.count()
    parts = -(-count // block_windows)
    if parts > 1:
        windows = windows.withColumn("part", F.pmod(F.xxhash64("window"), F.lit(parts)))
    for part in range(max(parts, 1)):
        block = (windows.where(F.col("part") == part) if parts > 1 else windows).select("item", "window").collect()
        prefix, table = _prefix_table(docs, text, sorted(map(tuple, block)), shingle)
        shared = docs.sparkSession.sparkContext.broadcast((prefix, table))
        result = _mark(result, text, keep, carried, shared)
        carried = ["__hit", "items"]
    return result.drop("__hit").withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * per >= F.col("n_words")))


def _mark(docs: DataFrame, text: str, keep: list[str], earlier: list[str], shared) -> DataFrame:
    """The documents with the hits of one benchmark block, added to those of ``earlier`` blocks."""

    def compute(block):
        prefix, table = shared.value
        data, starts, ends, first, words = _words_of(block, text)
        hit = np.zeros(len(words), bool)
        items: list[set] = [set() for _ in range(block.num_rows)]
        if earlier:
            for i, (bits, old) in enumerate(zip(block.column("__hit").to_pylist(), block.column("items").to_pylist(), strict=True)):
                n = int(first[i + 1] - first[i])
                hit[first[i]:first[i + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
                items[i].update(old)
        for size, places, numbers in prefix.find(words):
            owner = np.searchsorted(first, places, "right") - 1
            for place, number, doc in zip(places.tolist(), numbers.tolist(), owner.tolist(), strict=True):
                low, high = int(first[doc]), int(first[doc + 1])
                for offset, hashes, joined, item in table[number]:
                    start = place - offset
                    end = start + len(hashes)
                    if start < low or end > high or not np.array_equal(words[start:end], hashes):
                        continue
                    if b" ".join(data[a:b].tobytes() for a, b in zip(starts[start:end], ends[start:end], strict=True)) == joined:
                        hit[start:end] = True
                        items[doc].add(item)
        total = np.concatenate(([0], np.cumsum(hit)))
        bits = [np.packbits(hit[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        return [np.diff(first), total[first[1:]] - total[first[:-1]], [sorted(x, key=str.encode) for x in items], bits]

    fields = [*_FIELDS, T.StructField("__hit", T.BinaryType())]
    return B.annotate(docs, text, keep, fields, compute, earlier)
