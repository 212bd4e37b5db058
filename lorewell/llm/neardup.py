"""Near-duplicate documents: banded MinHash, sequential Bayesian verification, exact sets.

1. One pass turns each text into its set of word shingles (64-bit hashes), a 128-bit fingerprint of the set and a
   MinHash signature. Documents with equal sets are one class, stood for by its smallest id.
2. Signatures are cut into bands; classes that share a band are candidates, first as a star around the bucket's
   smallest member. A pair is judged batch by batch of signature values: as soon as the posterior probability that
   its similarity reaches the threshold falls below ``miss`` it is dropped. Survivors form families.
3. Families are verified exactly on their full sets, block against block inside a task. A large family is first
   linked within blocks and with its first block; only members that this leaves outside its main component
   are then compared with all others. Members of one bucket that belong to different families are judged in
   the same way on their signatures, and the survivors on their sets. Only links that join components are
   written out, so a group of copies never turns into its pairs.
4. Links are joined into components by alternating star steps.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.llm import batches as B
from lorewell.scale import cut_lineage

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 32
ROWS = 4
BATCH = 32
MISS = 1e-9
CHUNK = 256
DENSE_CELLS = 1 << 23
DOCS_A_TASK = 8_000


def _coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    values = B.mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (values[:count] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (values[count:] >> np.uint64(32)).astype(np.uint32)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        values = a[:, None] * x[None, i:i + 512]
        values += b[:, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def shingle_sets(block: pa.RecordBatch, text: str, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; shorter texts are one shingle, texts without words none."""
    data, offsets = B.text_bytes(block.column(text))
    data = B.LOWER[data]
    starts, ends, first = B.word_spans(data, offsets, B.NOT_BLANK)
    words = B.span_hashes(data, starts, ends)
    out = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        mine = words[low:high]
        out.append(np.unique(B.window_hashes(mine, min(size, len(mine)))) if high > low else mine)
    return out


def features(docs: DataFrame, text: str, size: int, count: int) -> DataFrame:
    """``docs`` without the text, with n_shingles, fingerprint and signature (null for an empty set)."""
    a, b = _coefficients(count)
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("fingerprint", T.BinaryType()),
              T.StructField("signature", T.BinaryType())]

    def compute(block):
        sets = shingle_sets(block, text, size)
        prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        return [[len(s) for s in sets], prints, [signature(s, a, b).tobytes() if len(s) else None for s in sets]]

    return B.annotate(docs, text, [c for c in docs.columns if c != text], fields, compute)


def fewest_matches(seen: int, threshold: float, miss: float) -> int:
    """Least number of equal values among ``seen`` at which P(similarity >= threshold) reaches ``miss``.

    The posterior under a uniform prior is a Beta distribution; its upper tail is a binomial sum.
    """
    n, tail = seen + 1, 0.0
    for m in range(seen + 1):
        tail += math.comb(n, m) * threshold ** m * (1 - threshold) ** (n - m)
        if tail >= miss:
            return m
    return seen + 1


class Verifier:
    """Judges pairs of signature rows batch by batch."""

    def __init__(self, count: int, threshold: float, miss: float, batch: int = BATCH):
        stops = [*range(batch, count, batch), count]
        self.steps = [(i, j, fewest_matches(j, threshold, miss)) for i, j in zip([0, *stops], stops)]
        self.threshold = threshold

    def survive(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Numbers of the rows that no batch has ruled out."""
        alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
        for low, high, least in self.steps:
            matches = matches + (left[alive, low:high] == right[alive, low:high]).sum(axis=1)
            keep = matches >= least
            alive, matches = alive[keep], matches[keep]
        return alive

    def survive_all(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of left, rows of right) of all pairs that no batch has ruled out."""
        low, high, least = self.steps[0]
        one = np.zeros((len(left), len(right)), np.int16)
        for k in range(low, high):
            one += left[:, k][:, None] == right[:, k][None, :]
        i, j = np.nonzero(one >= least)
        alive = self.survive(left[i], right[j])
        return i[alive], j[alive]


def _matrix(column: pa.Array, count: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, count)


def _few(df: DataFrame, rows: int, per: int) -> DataFrame:
    """The rows in no more partitions than their number asks for, so that small tables don't make many small files."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per)))


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, component) of every linked id: the smallest id reachable. Alternates star steps until nothing moves."""
    links = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u > v").distinct()
    links = cut_lineage(links)
    state, count = None, links.count()
    while True:
        links = _few(links, count, 200_000)
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = _few(large, count, 200_000)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        small = _few(small.where("u > v").union(least.select("u", F.col("m").alias("v"))), count, 200_000)
        links = cut_lineage(_few(small.distinct(), count, 200_000))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            own = links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(own)
        state = now


def _links_within(left: list[np.ndarray], right: list[np.ndarray], near: tuple[np.ndarray, np.ndarray], whole: int) -> np.ndarray:
    """Which of the pairs ``near`` (rows of left, rows of right) have similar enough sets."""
    i, j = near
    if not len(i):
        return np.zeros(0, bool)
    rows, columns = np.unique(i), np.unique(j)
    sizes_left, sizes_right = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    values = np.unique(np.concatenate([*(left[r] for r in rows), *(right[c] for c in columns)]))
    if len(values) * (len(rows) + len(columns)) <= DENSE_CELLS and len(i) > 4:
        def dense(sets, chosen):
            out = np.zeros((len(chosen), len(values)), np.float32)
            for n, r in enumerate(chosen):
                out[n, np.searchsorted(values, sets[r])] = 1
            return out

        shared = (dense(left, rows) @ dense(right, columns).T)[np.searchsorted(rows, i), np.searchsorted(columns, j)].round().astype(np.int64)
    else:
        shared = np.array([len(left[p]) + len(right[q]) - len(np.union1d(left[p], right[q])) for p, q in zip(i, j, strict=True)], np.int64)
    return 100 * shared >= whole * (sizes_left[i] + sizes_right[j] - shared)


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the links that join two components, one after the other."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out = []
    for n, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append(n)
    return np.array(out, np.int64)


def _compare(verifier: Verifier, count: int, threshold: float):
    """Exact links between the two sides of a block; members of one component are taken as linked already."""
    whole = round(threshold * 100)

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        side = group.column("side").to_numpy()
        left, right = group.filter(pa.array(side == 0)), group.filter(pa.array(side == 1))
        alone = group.column("i")[0].as_py() == group.column("j")[0].as_py() and not right.num_rows  # a block with itself
        right = left if alone else right
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        x, y = left.column("id").to_numpy(), right.column("id").to_numpy()
        i, j = verifier.survive_all(_matrix(left.column("signature"), count), _matrix(right.column("signature"), count))
        p, q = left.column("n").to_numpy()[i], right.column("n").to_numpy()[j]
        keep = (left.column("component").to_numpy()[i] != right.column("component").to_numpy()[j]) & (
            100 * np.minimum(p, q) >= whole * np.maximum(p, q)) & (x[i] != y[j])
        if alone:
            keep &= i < j
        i, j = i[keep], j[keep]
        sets = [[np.frombuffer(s.as_buffer(), np.uint64) for s in t.column("shingles")] for t in (left, right)]
        linked = _links_within(*sets, (i, j), whole)
        a, b = np.minimum(x[i[linked]], y[j[linked]]), np.maximum(x[i[linked]], y[j[linked]])
        chosen = _forest(a, b)
        return pa.table({"a": pa.array(a[chosen], pa.int64()), "b": pa.array(b[chosen], pa.int64())})

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    whole = round(threshold * 100)
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))

    def run(rows):
        for batch in rows:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(100 * shared >= whole * (len(p) + len(q) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, miss: float = MISS,
                    chunk: int = CHUNK, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, the ``keep`` columns, n_shingles, component_id, kept) of every row.

    A document's set: distinct ``shingle``-word runs of the text with A-Z lower-cased and split at blanks; a text
    of fewer words is one shingle; null, empty and blank texts have the empty set and are linked with nothing.
    Documents whose sets have a Jaccard similarity of at least ``threshold`` are linked; component_id is the
    smallest doc_id reachable by links, kept marks the document with that id.

    Rows with one doc_id get one component each by their own text; if such rows differ they join through
    the id. A null id takes part in nothing: it is its own component (null) and kept. ``miss`` is the chance that
    the Bayesian test drops a true pair; ``bands`` times ``rows`` is the signature's length.
    """
    spark = docs.sparkSession
    B.prepare(spark)
    count = bands * rows
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    passed = [F.col(f"`{c}`").alias(f"__keep{i}") for i, c in enumerate(keep or [])]
    known = cut_lineage(features(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), *passed), "text", shingle, count))
    total = known.count()
    usable = known.where(F.col("id").isNotNull() & F.col("fingerprint").isNotNull())
    classes = usable.groupBy("fingerprint").agg(
        F.min("id").alias("rep"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n"))
    classes = cut_lineage(_few(classes, total, DOCS_A_TASK))

    band = F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")
    banded = classes.select("rep", "signature", band).select(
        "rep", F.xxhash64("band", F.expr(f"substring(signature, band * {4 * rows} + 1, {4 * rows})")).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size"), F.min("rep").alias("leader")).where("size > 1")
    members = cut_lineage(_few(banded.join(shared, "bucket"), total, DOCS_A_TASK))
    candidates = members.select(F.col("rep").alias("id")).distinct()
    signatures = classes.join(candidates, classes["rep"] == candidates["id"], "left_semi").select(F.col("rep").alias("id"), "signature", "n")
    signatures = cut_lineage(_few(signatures, total, DOCS_A_TASK))

    star = members.where("rep > leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    star = _few(star, total, DOCS_A_TASK)
    likely = _likely(star, signatures, count, threshold, miss)
    family = components(likely).withColumnRenamed("component", "family")
    strangers = _across(members, family, signatures, count, threshold, miss, chunk)
    strangers = cut_lineage(_few(strangers, total, DOCS_A_TASK))
    wanted = family.select("id").union(strangers.select("a")).union(strangers.select("b")).distinct()
    sets = cut_lineage(_few(_sets(base.join(wanted, "id", "left_semi"), shingle), total, DOCS_A_TASK))
    links = _within(family, signatures, sets, total, count, threshold, miss, chunk)
    links = links.union(cut_lineage(_few(_confirmed(strangers, sets, threshold), total, DOCS_A_TASK)))
    same_id = usable.join(classes.select("fingerprint", "rep"), "fingerprint").where("id > rep")
    same_id = same_id.select(F.col("rep").alias("a"), F.col("id").alias("b"))
    found = components(_few(links.union(cut_lineage(_few(same_id, total, DOCS_A_TASK))), total, DOCS_A_TASK))

    out = known.join(found, "id", "left").withColumn("component_id", F.coalesce("component", "id"))
    passed = [F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep or [])]
    return out.select(F.col("id").alias(doc_id), *passed, "n_shingles", "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    field = [T.StructField("shingles", T.BinaryType())]

    def compute(block):
        return [[s.tobytes() for s in shingle_sets(block, "text", shingle)]]

    return B.annotate(docs, "text", ["id"], field, compute)


def _likely(pairs: DataFrame, signatures: DataFrame, count: int, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) that the Bayesian test on the signatures lets through."""
    left = signatures.select(F.col("id").alias("a"), F.col("signature").alias("sa"), F.col("n").alias("na"))
    right = signatures.select(F.col("id").alias("b"), F.col("signature").alias("sb"), F.col("n").alias("nb"))
    near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * round(threshold * 100)
    verifier = Verifier(count, threshold, miss)

    def run(rows):
        for batch in rows:
            alive = verifier.survive(_matrix(batch.column("sa"), count), _matrix(batch.column("sb"), count))
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return pairs.join(left, "a").join(right, "b").where(near).select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _blocks(side_a: DataFrame, side_b: DataFrame | None, compare) -> DataFrame:
    """Links found by ``compare`` in each block (owner, i, j); the sides are told apart by ``side``."""
    rows = side_a.withColumn("side", F.lit(0))
    if side_b is not None:
        rows = rows.unionByName(side_b.withColumn("side", F.lit(1)))
    return rows.groupBy("owner", "i", "j").applyInArrow(compare, "a long, b long")


def _upto(count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), count - 1))


def _within(family: DataFrame, signatures: DataFrame, sets: DataFrame, total: int, count: int, threshold: float, miss: float,
            chunk: int) -> DataFrame:
    """Exact links between members of one family, enough of them to hold its components together."""
    compare = _compare(Verifier(count, threshold, miss), count, threshold)
    sizes = family.groupBy("family").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    members = family.join(sizes, "family").join(signatures, "id").join(sets, "id").select(
        F.col("family").alias("owner"), "id", "signature", "n", "shingles", "chunks",
        F.pmod(F.xxhash64("id"), "chunks").alias("chunk"))
    members = cut_lineage(_few(members, total, DOCS_A_TASK))
    alone = members.withColumn("component", F.col("id"))
    plain = ["owner", "id", "signature", "n", "shingles", "component", "i", "j"]
    zero = F.lit(0).cast("long")
    inner = _blocks(alone.withColumn("i", F.col("chunk")).withColumn("j", F.col("chunk")).select(plain), None, compare)
    large = alone.where("chunks > 1")
    hub = large.where("chunk = 0").withColumn("i", zero).withColumn("j", _upto(F.col("chunks"))).where("j > 0")
    rest = large.where("chunk > 0").withColumn("i", zero).withColumn("j", F.col("chunk"))
    first = cut_lineage(_few(inner.union(_blocks(hub.select(plain), rest.select(plain), compare)), total, DOCS_A_TASK))

    # a family of one block is done; in the others whoever is not in the main component meets all others
    found = components(first)
    placed = members.where("chunks > 1").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = placed.groupBy("owner", "component").agg(F.count("*").alias("part"))
    main = parts.groupBy("owner").agg(F.max(F.struct("part", "component")).alias("main"), F.sum("part").alias("size")).select(
        "owner", F.col("main.component").alias("main"), F.ceil((F.col("size") - F.col("main.part")) / chunk).alias("out_chunks"))
    placed = placed.join(main.where("out_chunks > 0"), "owner")
    outside = placed.where("component <> main").withColumn("i", F.pmod(F.xxhash64("id", F.lit(1)), "out_chunks")).withColumn(
        "j", _upto(F.col("chunks")))
    every = placed.withColumn("j", F.col("chunk")).withColumn("i", _upto(F.col("out_chunks")))
    second = _blocks(outside.select(plain), every.select(plain), compare)
    return first.union(cut_lineage(_few(second, total, DOCS_A_TASK)))


def _across(members: DataFrame, family: DataFrame, signatures: DataFrame, count: int, threshold: float,
            miss: float, chunk: int) -> DataFrame:
    """Likely pairs of different families that share a bucket; the stars are not tried again.

    Per bucket, members outside its main family stand against all members, in blocks of ``chunk`` by ``chunk``.
    """
    placed = members.join(family.withColumnRenamed("id", "rep"), "rep", "left")
    placed = placed.withColumn("component", F.coalesce("family", "rep"))
    parts = placed.where("size > 2").groupBy("bucket", "component").agg(F.count("*").alias("part"), F.first("size").alias("size"))
    main = parts.groupBy("bucket").agg(F.max(F.struct("part", "component")).alias("main"), F.first("size").alias("size"))
    mixed = main.where("main.part < size").select(
        "bucket", F.col("main.component").alias("main"), F.ceil(F.col("size") / chunk).alias("all_chunks"),
        F.ceil((F.col("size") - F.col("main.part")) / chunk).alias("out_chunks"))
    inside = placed.select("bucket", "rep", "component").join(mixed, "bucket")
    inside = inside.join(signatures.select(F.col("id").alias("rep"), "signature", "n"), "rep")
    inside = inside.withColumnRenamed("bucket", "owner").withColumnRenamed("rep", "id")
    plain = ["owner", "id", "signature", "n", "component", "i", "j"]
    number = F.xxhash64("id")
    every = inside.withColumn("j", F.pmod(number, "all_chunks")).withColumn("i", _upto(F.col("out_chunks")))
    outside = inside.where("component <> main").withColumn("i", F.pmod(number, "out_chunks")).withColumn("j", _upto(F.col("all_chunks")))
    verifier, whole = Verifier(count, threshold, miss), round(threshold * 100)

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        side = group.column("side").to_numpy()
        left, right = group.filter(pa.array(side == 0)), group.filter(pa.array(side == 1))
        x, y = left.column("id").to_numpy(), right.column("id").to_numpy()
        if not len(x) or not len(y):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        i, j = verifier.survive_all(_matrix(left.column("signature"), count), _matrix(right.column("signature"), count))
        p, q = left.column("n").to_numpy()[i], right.column("n").to_numpy()[j]
        apart = left.column("component").to_numpy()[i] != right.column("component").to_numpy()[j]
        keep = apart & (100 * np.minimum(p, q) >= whole * np.maximum(p, q))
        a, b = x[i[keep]], y[j[keep]]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return _blocks(outside.select(plain), every.select(plain), compare).distinct()
