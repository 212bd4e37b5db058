"""SimHash near-duplicates by covering locality-sensitive hashing.

1. One pass turns each text into a 64-bit fingerprint of its word shingles. Equal fingerprints are one class,
   stood for by its smallest id.
2. Every bit is given one of the 2**(radius + 1) - 1 non-zero vectors of radius + 1 bits. A mask belongs to each such
   vector v and keeps the bits whose own vector has an odd product with v. The vectors of ``radius`` differing bits
   cannot span the whole space, so some v is orthogonal to all of them: its mask hides every difference, and the
   pair collides in that table. No pair within the radius is missed, whatever the data.
3. Colliding fingerprints are compared in full. In a bucket of up to ``bucket`` fingerprints that happens in one
   block, which gives back only links that join two components. Larger buckets turn each fingerprint into all
   that differ from it in up to radius / 2 of the bits the mask hides: two fingerprints are within the
   radius exactly if they have one of those in common, and all that have one in common are linked as a star.
   Such a star has at most as many members as there are hidden bits, so no bucket is ever compared as all its pairs.
4. Links are joined into components.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.llm import batches as B
from lorewell.llm.graph import components, few, forest, meet
from lorewell.scale import cut_lineage

SHINGLE = 3
SEED = 42
RADIUS = 2
BUCKET = 256
ROWS_A_TASK = 100_000
STRETCH = 1 << 20

_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def masks(radius: int) -> list[int]:
    """One mask of the 64 bits for each non-zero vector of radius + 1 bits."""
    vectors = 2 ** (radius + 1) - 1
    return [sum(1 << bit for bit in range(64) if ((1 + bit % vectors) & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def hidden(mask: int, radius: int) -> list[int]:
    """All changes of up to radius / 2 bits that the mask does not keep."""
    bits = [1 << bit for bit in range(64) if not mask >> bit & 1]
    return [sum(chosen) for n in range(radius // 2 + 1) for chosen in combinations(bits, n)]


def _stretches(data: bytes, size: int) -> Iterator[list[bytes]]:
    """The words in stretches that overlap by size - 1 words; a very long text is never split up at once."""
    carry, at = [], 0
    while at < len(data):
        end = _BLANK.search(data, at + STRETCH)
        end = end.start() if end else len(data)
        words = carry + data[at:end].split()
        yield words
        carry, at = words[-(size - 1):] if size > 1 else [], end


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """Bit k is set if more than half of the shingles' hashes have it; 0 without words."""
    ones, total, short = np.zeros(64, np.int64), 0, []
    for words in _stretches(text, size):
        if len(words) < size:
            short = words
            continue
        whole = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[:len(words) - size + 1]
        hash_of = xxhash.xxh64_intdigest
        spans = zip(starts.tolist(), ends[size - 1:].tolist(), strict=True)
        hashes = np.array([hash_of(whole[a:b], seed) for a, b in spans], "<u8")
        total += len(hashes)
        for low in range(0, len(hashes), 1 << 16):
            bits = np.unpackbits(hashes[low:low + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
    if not total and short:
        return xxhash.xxh64_intdigest(b" ".join(short), seed)
    return int(((2 * ones > total).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, text: str, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """The ``keep`` columns and the 64-bit ``fingerprint`` of every row; a narrow pass."""

    def compute(block: pa.RecordBatch) -> list:
        out = []
        for value in block.column(text):
            low = value.as_py().encode().translate(B.LOWER_TABLE) if value.is_valid else b""
            out.append(_signed(fingerprint(low, shingle)))
        return [out]

    return B.annotate(docs, text, keep, [T.StructField("fingerprint", T.LongType())], compute)


def _links_in_buckets(radius: int):
    """Links inside each row's list of fingerprints, enough of them to hold its components together."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for members in batch.column("members"):
                flat = members.values
                prints = flat.field("fingerprint").to_numpy().view(np.uint64)
                reps = flat.field("rep").to_numpy()
                i, j = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius, 1))
                chosen = forest(reps[i], reps[j])
                a.append(reps[i[chosen]])
                b.append(reps[j[chosen]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (a, b)], ["a", "b"])

    return run


def links(classes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, total: int | None = None) -> DataFrame:
    """Links (a, b) between the ``rep`` of distinct fingerprints (fingerprint, rep) that hold components together."""
    total = classes.count() if total is None else total
    tables = masks(radius)
    kept = F.array(*[F.struct(F.lit(n).alias("table"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("key"))
                     for n, m in enumerate(tables)])
    banded = classes.select("fingerprint", "rep", F.inline(kept))
    sizes = banded.groupBy("table", "key").agg(F.count("*").alias("size")).where("size > 1").withColumn("weight", F.col("size"))
    members = meet(banded, sizes, ["table", "key"], "weight", len(tables) * total)
    members = cut_lineage(few(members, len(tables) * total, ROWS_A_TASK))
    small = members.where(F.col("size") <= bucket).groupBy("table", "key").agg(
        F.collect_list(F.struct("fingerprint", "rep")).alias("members"))
    found = small.select("members").mapInArrow(_links_in_buckets(radius), "a long, b long")
    changes = F.array(*[F.array(*[F.lit(_signed(c)) for c in hidden(m, radius)]) for m in tables])
    near = members.where(F.col("size") > bucket).select(
        "rep", "table", F.explode(F.transform(changes[F.col("table")], lambda c: c.bitwiseXOR(F.col("fingerprint")))).alias("near"))
    stars = near.groupBy("table", "near").agg(F.min("rep").alias("a"), F.collect_list("rep").alias("reps"))
    stars = stars.select("a", F.explode("reps").alias("b")).where("a < b")
    return found.union(stars).distinct()


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS,
                   bucket: int = BUCKET, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, the ``keep`` columns, fingerprint as 16 hex digits, component_id) of every row.

    A-Z is lower-cased, words are split at blanks. Bit k of a fingerprint is set if it is set in more than half of
    the XXH64 hashes (seed 42) of all ``shingle``-word runs, repeats included; a text of fewer words is one run; null,
    empty and blank texts have the fingerprint 0 and are linked like any other. Fingerprints that differ in at most
    ``radius`` bits (an even number) are linked; component_id is the smallest doc_id reachable, itself included.

    Rows that repeat a doc_id keep one row each with their own fingerprint and are linked through the id. A null id
    takes part in nothing: its component is null. Columns of the input are only looked at if named in ``keep``, so
    clashing names do no harm. An empty table gives an empty result. ``bucket`` is where comparing all
    pairs of a bucket ends; the links are the same either way.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    B.prepare(docs.sparkSession)
    passed = {f"__keep{i}": c for i, c in enumerate(keep or [])}
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), *[F.col(f"`{c}`").alias(n) for n, c in passed.items()])
    known = cut_lineage(fingerprints(base, "text", ["id", *passed], shingle))
    named = known.where(F.col("id").isNotNull())
    classes = named.groupBy("fingerprint").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    total = named.count()
    classes = cut_lineage(few(classes, total, ROWS_A_TASK))
    found = links(classes.select("fingerprint", "rep"), radius, bucket, classes.count())
    repeated = named.groupBy("id").agg(F.countDistinct("fingerprint").alias("n")).where("n > 1").select("id")
    several = cut_lineage(named.join(repeated, "id", "left_semi").select("id", "fingerprint").join(
        classes.select("fingerprint", "rep"), "fingerprint").select("id", "rep").distinct())
    joined = several.join(several.groupBy("id").agg(F.min("rep").alias("a")), "id").select("a", F.col("rep").alias("b"))
    groups = components(found.union(joined))
    whole = classes.join(groups, classes["rep"] == groups["id"], "left").select(
        "fingerprint", "weight", F.coalesce("component", "rep").alias("component_id"))
    out = meet(named, cut_lineage(whole), ["fingerprint"], "weight", total)
    out = out.unionByName(known.where(F.col("id").isNull()).withColumn("component_id", F.col("id")))
    return out.select(F.col("id").alias(doc_id), *[F.col(n).alias(c) for n, c in passed.items()],
                      F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
