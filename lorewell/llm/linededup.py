"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches. A batch's line hashes are counted and anti-joined with the runs kept so far: lines never seen
before go, sorted, into a run of the batch's own, so every line stands in exactly one run; lines seen before go
into the updates, which only hold repeated lines. When a level holds ``fan_in`` runs they are compacted into one run of
the next level. At the end only the lines with updates, and those that one batch alone found often enough, can be
common. Runs and updates live in the cluster's checkpoint folder.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.llm import batches as B
from lorewell.scale import cut_lineage

BLANKS = b" \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3
#: Every table goes through this many batches, whatever its size.
BATCHES = 4
FAN_IN = 2


def _key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of the line's key (16 bytes), or nothing for a short key."""
    line = line.strip(BLANKS)
    if len(line) < min_chars:
        return None
    if len(line) < 4 * min_chars and not line.isascii() and sum((b & 0xC0) != 0x80 for b in line) < min_chars:
        return None
    return xxhash.xxh3_128_digest(line.translate(B.LOWER_TABLE))


def line_keys(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(doc_id, own, high, low): each document's distinct long lines as 128-bit hashes.

    ``own`` tells rows with a null id apart, by their text; it is 0 for all others.
    """
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(n, T.LongType()) for n in ("own", "high", "low")]])

    def run(rows):
        for batch in rows:
            for block in B.blocks(batch, text):
                owners, found = [], []
                for i, value in enumerate(block.column(text).to_pylist()):
                    keys = {k for line in (value or "").encode().split(b"\n") if (k := _key(line, min_chars))}
                    found += keys
                    owners += [i] * len(keys)
                halves = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
                ids, own = (block.column(c).take(pa.array(owners, pa.int64())) for c in (doc_id, "__own"))
                yield pa.RecordBatch.from_arrays(
                    [ids, own, pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], ["doc_id", "own", "high", "low"])

    return docs.select(doc_id, text, _own(doc_id, text).alias("__own")).mapInArrow(run, schema)


def _own(doc_id: str, text: str) -> Column:
    return F.when(F.col(doc_id).isNull(), F.xxhash64(F.coalesce(F.col(text), F.lit("")))).otherwise(F.lit(0).cast("long"))


class LineRuns:
    """Levels of runs, in which every line stands once with its count and largest id so far, and the updates of lines seen again."""

    def __init__(self, fan_in: int = FAN_IN):
        self.fan_in = fan_in
        self.levels: list[list[DataFrame]] = []
        self.updates: list[DataFrame] = []

    def add(self, keys: DataFrame) -> DataFrame:
        """Take in one batch of (doc_id, high, low); returns its run, the lines not seen before."""
        once = keys.groupBy("high", "low", "doc_id").agg(F.lit(1).alias("one"))
        mine = once.groupBy("high", "low").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper"))
        known = [run for level in self.levels for run in level]
        if known:
            mine = cut_lineage(mine)
            fresh = cut_lineage(mine.join(self._lines(known), ["high", "low"], "left_anti").sortWithinPartitions("high", "low"))
            self.updates.append(cut_lineage(mine.join(fresh.select("high", "low"), ["high", "low"], "left_anti")))
        else:
            fresh = cut_lineage(mine.sortWithinPartitions("high", "low"))
        self._put(0, fresh)
        return fresh

    @staticmethod
    def _lines(runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.union, [run.select("high", "low") for run in runs])

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_in:
            runs, self.levels[level] = self.levels[level], []
            tasks = sum(r.rdd.getNumPartitions() for r in runs)
            merged = reduce(DataFrame.union, runs).repartitionByRange(max(1, tasks // len(runs)), "high", "low")
            self._put(level + 1, cut_lineage(merged.sortWithinPartitions("high", "low")))

    def common(self, least: int) -> DataFrame:
        """(high, low, keeper) of the lines found in at least ``least`` documents of all batches."""
        runs = [run for level in self.levels for run in level]
        lines = reduce(DataFrame.union, [run.select("high", "low", "docs", "keeper") for run in runs])
        if not self.updates:
            return lines.where(F.col("docs") >= least).select("high", "low", "keeper")
        again = reduce(DataFrame.union, self.updates).groupBy("high", "low").agg(
            F.sum("docs").alias("more"), F.max("keeper").alias("later"))
        both = lines.join(again, ["high", "low"], "left").where(F.col("docs") + F.coalesce("more", F.lit(0)) >= least)
        return both.select("high", "low", F.greatest("keeper", "later").alias("keeper"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS, batches: int = BATCHES, fan_in: int = FAN_IN) -> DataFrame:
    """``docs`` with lines that repeat over documents taken out of the text, plus n_lines and n_dropped.

    Texts are split at newline; a null or empty text is one empty line. A line's key is the line without blanks
    at its ends and with A-Z lower-cased. Keys of at least ``min_chars`` code points that stand in at least
    ``min_docs`` documents lose all their lines except in the document with the largest id. If all lines go, the text
    is empty.

    Rows with one id are one document. Rows with a null id share the id null, which is smaller than any
    other. The kept lines are joined by newline, a null text becomes an empty one. Input columns n_lines and n_dropped are
    replaced; all others pass through. The documents go through the runs in ``batches``, told by a hash of the id (of the
    text where it is null); the batches' line hashes are written below the checkpoint folder, where they stay until the
    folder is emptied.
    """
    B.prepare(docs.sparkSession)
    keys = line_keys(docs, doc_id, text, min_chars)
    runs = LineRuns(fan_in)
    # one folder per batch, so that taking a batch reads that batch alone
    keys = B.stored_by(keys.withColumn("part", F.pmod(F.xxhash64("doc_id", "own"), F.lit(batches))), "part")
    for i in range(batches):
        runs.add(keys.where(F.col("part") == i).select("doc_id", "high", "low"))
    lost = (keys.select("doc_id", "own", "high", "low").join(runs.common(min_docs), ["high", "low"])
            .where(F.col("keeper").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("keeper"))))
    lost = lost.groupBy(F.col("doc_id").alias("__owner"), F.col("own").alias("__owned")).agg(
        F.collect_set(F.struct("high", "low")).alias("__lost"))
    own = docs.withColumn("__own", _own(doc_id, text))
    joined = own.join(lost.hint("shuffle_hash"), own[doc_id].eqNullSafe(F.col("__owner")) & (F.col("__own") == F.col("__owned")), "left")
    fields = [T.StructField(text, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    old = f"__{text}"
    joined = joined.withColumnRenamed(text, old)

    def compute(block):
        texts, lines, dropped = [], [], []
        gone = block.column("__lost").to_pylist()
        for value, keys_lost in zip(block.column(old).to_pylist(), gone, strict=True):
            value = value or ""
            parts = value.split("\n")
            kept = parts
            if keys_lost:
                drop = {np.array([k["high"], k["low"]], np.int64).tobytes() for k in keys_lost}
                kept = [p for p in parts if _key(p.encode(), min_chars) not in drop]
                value = "\n".join(kept)
            texts.append(value)
            lines.append(len(parts))
            dropped.append(len(parts) - len(kept))
        return [texts, lines, dropped]

    rest = [c for c in joined.columns if c not in (old, "__owner", "__owned", "__own", "__lost")]
    out = B.annotate(joined, old, rest, fields, compute, ["__lost"])
    order = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*[F.col(f"`{c}`") for c in order], "n_lines", "n_dropped")


def text_digest(column: str):
    """sha-256 of the text's UTF-8 bytes, lowercase hex."""
    return F.sha2(F.col(column).cast("binary"), 256)
