"""Phrase collocations by vertical partitioning of a depth-truncated suffix tree of words.

1. One pass counts words per language. A word is told by a 64-bit code; should two words of the corpus share a
   code, the codes are made anew from another seed until none do.
2. Only words that are frequent enough can be part of a phrase. A Bloom filter of bounded size says which, with no miss;
   a suffix is cut where the piece ends, where a word is too rare, and after ``longest`` words.
3. Word prefixes of the suffixes are grouped by a memory budget: prefixes are hashed to slots, slots are counted, and
   neighbouring slots share a group as long as their suffixes fit. A slot beyond the budget is told apart by one
   word more, counted again and grouped again, up to whole suffixes.
4. Equal suffixes of a batch become one record with a count before they travel. Each group sorts its records into a
   depth-truncated suffix subtree on its own: leaf totals are the counts of whole suffixes, every other node is the
   sum of its leaves. Nodes above a group's prefix are added up over groups.
5. Nodes with enough occurrences are the candidates. Their parts are looked up among the nodes and words, the lowest cut
   is kept, candidates inside a longer one go, and each language is ranked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.llm import batches as B
from lorewell.llm.graph import meet
from lorewell.scale import cut_lineage

LEAST = 30
LONGEST = 4
INSIDE = 80
TOP = 2000
BUDGET = 1 << 20
FILTER_BITS = 27
STRETCH = 1 << 18
BLOCK_BYTES = 4 << 20

PIECE_END = np.zeros(256, bool)
PIECE_END[list(b".,;:!?\n\x0b\x0c\r")] = True

#: Bytes of words: everything but blanks, tabs and what ends a piece.
WORD = ~PIECE_END
WORD[[32, 9]] = False

CODES = [f"c{k}" for k in range(1, LONGEST + 1)]
U64 = np.uint64


class Words:
    """The words of a batch of texts: byte spans, codes, language numbers, and whether the next one goes on in the piece."""

    def __init__(self, batch: pa.RecordBatch, seed: int):
        data, offsets = B.text_bytes(batch.column("text"))
        data = B.LOWER[data]
        starts, ends, first = B.word_spans(data, offsets, WORD)
        self.data, self.starts, self.ends = data, starts, ends
        shuffled = np.random.default_rng(seed).permutation(256).astype(np.uint8) if seed else np.arange(256, dtype=np.uint8)
        self.codes = B.span_hashes(shuffled[data], starts, ends)
        self.codes[self.codes == 0] = U64(1)
        langs = batch.column("lang").dictionary_encode()
        self.names = langs.dictionary.to_pylist()
        self.seeds = np.array([xxhash.xxh64_intdigest(n.encode()) for n in self.names], U64)
        self.lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int32), np.diff(first))
        self.goes_on = np.zeros(len(starts), bool)
        if len(starts):
            before = np.concatenate(([0], np.cumsum(PIECE_END[data], dtype=np.int32)))
            self.goes_on[:-1] = before[starts[1:]] == before[ends[:-1]]
            last = first[1:][first[1:] > first[:-1]] - 1
            self.goes_on[last] = False

    def text(self, k: int) -> str:
        return self.data[self.starts[k]:self.ends[k]].tobytes().decode()


def _blocks(batches):
    """Batches of texts in blocks that bound what a task holds; no text is cut."""
    for batch in batches:
        yield from B.blocks(batch, "text", BLOCK_BYTES)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for column in columns:
            new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def count_words(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, code, n): occurrences of every word of every language."""

    def run(batches):
        for batch in _blocks(batches):
            words = Words(batch, seed)
            order = np.lexsort((words.codes, words.lang))
            at = _runs(words.lang[order], words.codes[order])
            some = order[at]
            yield pa.RecordBatch.from_arrays([
                pa.array([words.names[k] for k in words.lang[some]], pa.string()), pa.array([words.text(k) for k in some], pa.string()),
                pa.array(words.codes[some].view(np.int64)), pa.array(np.diff(np.append(at, len(order))), pa.int64())],
                ["lang", "word", "code", "n"])

    rows = docs.mapInArrow(run, "lang string, word string, code long, n long")
    return rows.groupBy("lang", "word", "code").agg(F.sum("n").alias("n"))


def _filter_of(frequent: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of the codes, two bits each, at most 2**27 bits: true where a bit is set."""
    bits = min(FILTER_BITS, max(15, int(16 * count).bit_length()))
    low = F.lit((1 << bits) - 1)
    places = F.array(F.col("code").bitwiseAND(low), F.shiftrightunsigned("code", 32).bitwiseAND(low))
    places = frequent.select(F.explode(places).alias("place")).withColumn("place", F.col("place") + 1)  # buckets count from 1
    parts = places.groupBy(F.bitmap_bucket_number("place").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for part, some in parts.collect():  # at most 4,096 rows of 4 KB
        low_byte = (part - 1) * 4096
        out[low_byte:low_byte + 4096] = np.frombuffer(some, np.uint8)[:len(out) - low_byte]
    return out


class Suffixes:
    """Depth-truncated suffixes of frequent words, and the group that each belongs to."""

    def __init__(self, seed: int, bloom: np.ndarray, slots: int):
        self.seed, self.bloom, self.slots = seed, bloom, slots
        self.groups: list[np.ndarray] = []  # per number of prefix words: group of each slot, -1 if it needs a word more

    def frequent(self, codes: np.ndarray) -> np.ndarray:
        last = U64(8 * len(self.bloom) - 1)
        out = np.ones(len(codes), bool)
        for place in (codes & last, (codes >> U64(32)) & last):
            out &= (self.bloom[place >> U64(3)] >> (place & U64(7)).astype(np.uint8)) & 1 == 1
        return out

    def of(self, batch: pa.RecordBatch):
        """(words, language numbers, codes by column) of the suffixes of at least two words, in stretches."""
        words = Words(batch, self.seed)
        good = self.frequent(words.codes)
        total = len(good)
        for low in range(0, total, STRETCH):
            high = min(low + STRETCH, total)
            columns, going = [words.codes[low:high]], good[low:high].copy()
            for k in range(1, LONGEST):
                column = np.zeros(high - low, U64)
                reach = max(min(high, total - k) - low, 0)
                going[reach:] = False
                going[:reach] &= words.goes_on[low + k - 1:low + k - 1 + reach] & good[low + k:low + k + reach]
                column[:reach] = np.where(going[:reach], words.codes[low + k:low + k + reach], U64(0))
                columns.append(column)
            keep = columns[1] != 0
            yield words, words.lang[low:high][keep], [c[keep] for c in columns]

    def slot(self, seeds: np.ndarray, columns: list[np.ndarray], size: int) -> np.ndarray:
        out = seeds
        for column in columns[:size]:
            out = B.mix(out + column)
        return (out & U64(self.slots - 1)).astype(np.int64)

    def open(self, seeds: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
        """Which suffixes have no group yet."""
        out = np.ones(len(seeds), bool)
        for size, table in enumerate(self.groups, 1):
            out[out] = table[self.slot(seeds[out], [c[out] for c in columns], size)] < 0
        return out

    def group(self, seeds: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(group, number of its prefix words) of every suffix."""
        group, prefix = np.full(len(seeds), -1, np.int64), np.zeros(len(seeds), np.int64)
        for size, table in enumerate(self.groups, 1):
            rest = group < 0
            found = table[self.slot(seeds[rest], [c[rest] for c in columns], size)]
            group[rest] = found
            prefix[rest] = size
        return group, prefix

    def count(self) -> int:
        """Number of groups."""
        return 1 + max((int(t.max()) for t in self.groups), default=0)

    def add(self, loads: np.ndarray, budget: int) -> bool:
        """Give groups to the slots of one prefix length by their loads; whether some need a word more."""
        first = 1 + max((int(t.max()) for t in self.groups), default=-1)
        last = len(self.groups) + 1 == LONGEST
        table, room, group = np.full(self.slots, -1, np.int32), 0, first - 1
        for slot in np.flatnonzero(loads):
            load = int(loads[slot])
            if load > budget and not last:
                continue
            if load > room:
                group, room = group + 1, budget
            table[slot], room = group, room - load
        # slots that no counted prefix has; a false hit of the filter may still lead there
        table[loads == 0] = max(first, group)
        self.groups.append(table)
        return bool((table < 0).any())


def _collected(rows: DataFrame, slots: int) -> np.ndarray:
    """Loads by slot: at most one row per slot comes to the driver."""
    out = np.zeros(slots, np.int64)
    found = rows.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


def _loads_of_words(frequent: DataFrame, suffixes: Suffixes) -> np.ndarray:
    def run(batches):
        for batch in batches:
            seeds = np.array([xxhash.xxh64_intdigest(x.encode()) for x in batch.column("lang").to_pylist()], U64)
            slot = suffixes.slot(seeds, [batch.column("code").to_numpy().view(U64)], 1)
            yield pa.RecordBatch.from_arrays([pa.array(slot), batch.column("n")], ["slot", "n"])

    return _collected(frequent.select("lang", "code", "n").mapInArrow(run, "slot long, n long"), suffixes.slots)


def _loads_of_prefixes(docs: DataFrame, suffixes: Suffixes, size: int) -> np.ndarray:
    """Loads of the prefixes of ``size`` words that have no group yet."""

    def run(batches):
        loads = np.zeros(suffixes.slots, np.int64)
        for batch in _blocks(batches):
            for words, lang, columns in suffixes.of(batch):
                seeds = words.seeds[lang]
                rest = suffixes.open(seeds, columns)
                slot = suffixes.slot(seeds[rest], [c[rest] for c in columns], size)
                loads += np.bincount(slot, minlength=suffixes.slots)
        some = np.flatnonzero(loads)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(loads[some])], ["slot", "n"])

    return _collected(docs.mapInArrow(run, "slot long, n long"), suffixes.slots)


def _pack(rows: np.ndarray, counts: np.ndarray) -> bytes:
    """Suffixes as places in the list of their different codes, which is far shorter than the codes over and over."""
    codes, places = np.unique(rows, return_inverse=True)
    kind = np.uint16 if len(codes) <= 1 << 16 else np.uint32
    sizes = np.array([len(codes), len(rows), np.dtype(kind).itemsize], np.int64)
    return sizes.tobytes() + codes.tobytes() + counts.astype(np.uint32).tobytes() + places.astype(kind).tobytes()


def _unpack(packed: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the suffixes by row, counts)."""
    count, rows, size = np.frombuffer(packed, np.int64, 3).tolist()
    codes = np.frombuffer(packed, U64, count, 24)
    counts = np.frombuffer(packed, np.uint32, rows, 24 + 8 * count).astype(np.int64)
    places = np.frombuffer(packed, np.uint16 if size == 2 else np.uint32, rows * LONGEST, 24 + 8 * count + 4 * rows)
    return codes[places].reshape(rows, LONGEST), counts


def _records(docs: DataFrame, suffixes: Suffixes) -> DataFrame:
    """(group, lang, prefix, records): different suffixes of a batch with their counts, packed."""

    def run(batches):
        for batch in _blocks(batches):
            for words, lang, columns in suffixes.of(batch):
                seeds = words.seeds[lang]
                key = suffixes_key(seeds, columns)
                order = np.argsort(key, kind="stable")
                columns, lang = [c[order] for c in columns], lang[order]
                at = _runs(key[order], lang, *columns)
                counts = np.diff(np.append(at, len(order)))
                columns, lang = [c[at] for c in columns], lang[at]
                group, prefix = suffixes.group(words.seeds[lang], columns)
                order = np.lexsort((lang, group))
                rows = np.stack(columns, axis=1)[order]
                group, prefix, lang, counts = group[order], prefix[order], lang[order], counts[order]
                at = _runs(group, lang)
                ends = np.append(at[1:], len(group)) if len(at) else at
                packed = [_pack(rows[a:b], counts[a:b]) for a, b in zip(at, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(group[at]), pa.array([words.names[k] for k in lang[at]], pa.string()), pa.array(prefix[at]),
                    pa.array(packed, pa.binary())], ["group", "lang", "prefix", "records"])

    return docs.mapInArrow(run, "group long, lang string, prefix long, records binary")


def suffixes_key(seeds: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    out = seeds
    for column in columns:
        out = B.mix(out + column)
    return out


def _subtree(least: int):
    """Nodes of the depth-truncated suffix subtree of one group and language."""

    def run(group: pa.Table) -> pa.Table:
        lang, prefix = group.column("lang")[0].as_py(), group.column("prefix")[0].as_py()
        parts = [_unpack(r.as_buffer()) for c in group.column("records").chunks for r in c]
        rows, counts = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.lexsort([rows[:, k] for k in range(LONGEST - 1, -1, -1)])
        rows = rows[order]
        leaves = _runs(*[rows[:, k] for k in range(LONGEST)])
        totals = np.add.reduceat(counts[order], leaves)
        rows = rows[leaves]
        out = []
        for depth in range(2, LONGEST + 1):
            at = _runs(*[rows[:, k] for k in range(depth)])
            n = np.add.reduceat(totals, at)
            keep = rows[at, depth - 1] != 0
            if depth >= prefix:
                keep &= n >= least
            nodes = rows[at[keep], :LONGEST].copy()
            nodes[:, depth:] = 0
            out.append((nodes, n[keep], np.full(keep.sum(), depth)))
        nodes, n, size = (np.concatenate([o[k] for o in out]) for k in range(3))
        return pa.table({
            "lang": pa.array([lang] * len(n), pa.string()), **{c: pa.array(np.ascontiguousarray(nodes[:, k]).view(np.int64)) for k, c in enumerate(CODES)},
            "size": pa.array(size, pa.int64()), "a": pa.array(n, pa.int64()), "whole": pa.array(size >= prefix)})

    return run


def frequent_nodes(docs: DataFrame, least: int, budget: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frequent words with codes, candidates, words per language) of ``docs`` (lang, text)."""
    seed = 0
    while True:
        words = cut_lineage(count_words(docs, seed))
        shared = words.groupBy("code").agg(F.min("word").alias("low"), F.max("word").alias("high")).where("low <> high")
        if shared.isEmpty():
            break
        seed += 1
    per_lang = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = cut_lineage(words.where(F.col("n") >= least).select("lang", "word", "code", "n"))
    count, total = frequent.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    slots = 1 << min(22, max(12, (4 * total // budget).bit_length()))
    suffixes = Suffixes(seed, _filter_of(frequent, count), slots)
    unfinished = suffixes.add(_loads_of_words(frequent, suffixes), budget)
    for size in range(2, LONGEST + 1):
        if unfinished:
            unfinished = suffixes.add(_loads_of_prefixes(docs, suffixes, size), budget)
    fields = [T.StructField("lang", T.StringType()), *[T.StructField(c, T.LongType()) for c in (*CODES, "size", "a")],
              T.StructField("whole", T.BooleanType())]
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), suffixes.count())
    records = _records(docs, suffixes).repartition(tasks, "group")  # a task has about one group, however many there are
    nodes = cut_lineage(records.groupBy("group", "lang").applyInArrow(_subtree(least), T.StructType(fields)))
    parts = nodes.where("not whole").groupBy("lang", *CODES, "size").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return frequent, cut_lineage(nodes.where("whole").drop("whole").unionByName(parts)), per_lang


def _reachable(scored: DataFrame, top: int) -> DataFrame:
    """Without the candidates that stand behind ``top`` better ones of their language by their step of 1,000 points.

    Steps are counted, at most 1,001 for each language, so no language has to be ranked as a whole.
    """
    step = F.floor(F.col("cut.score") / 1000)
    steps = scored.groupBy("lang", step.alias("step")).agg(F.count("*").alias("n"))
    better = Window.partitionBy("lang").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("ahead", F.coalesce(F.sum("n").over(better), F.lit(0)))
    lowest = steps.groupBy("lang").agg(F.min(F.when(F.col("ahead") < top, F.col("step"))).alias("lowest"), F.sum("n").alias("weight"))
    reached = meet(scored, lowest, ["lang"], "weight", scored.count())
    return reached.where(step >= F.col("lowest")).drop("lowest")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, inside: int = INSIDE, top: int = TOP,
                 budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    A-Z is lower-cased, texts are cut into pieces at ``.,;:!?`` and line ends and those into words at blanks and tabs.
    Phrases of 2 to 4 words that occur at least ``least`` times (a) are candidates. Cut after k words into parts with
    l and r occurrences they score floor(2,000,000 a / (l + r)); the lowest cut counts, of equal ones the first.
    A candidate within a longer one that has at least ``inside`` per cent of its occurrences goes. n: all words of
    the language. Order: score and a descending, then the phrase by its bytes.

    Null text is empty, null lang is ``und``. Repeated rows count each time. Empty tables and texts give no phrase. Long texts
    are read whole. Other columns are not looked at. ``budget`` bounds the suffix records of a group; it
    changes no result.
    """
    B.prepare(docs.sparkSession)
    docs = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    frequent, nodes, per_lang = frequent_nodes(docs, least, budget)
    key = ["lang", *CODES]

    def parts(rows, first, count):
        """Rows with the key of the ``count`` words from ``first`` on."""
        clear = F.least(first, F.lit(LONGEST - 1))
        inner = [F.when(F.lit(k) < count, F.get(F.array(*CODES), (clear + k).cast("int"))).otherwise(F.lit(0)).alias(f"s{k + 1}")
                 for k in range(LONGEST - 1)]
        return rows.select("*", *inner)

    sub = [f"s{k + 1}" for k in range(LONGEST - 1)]
    counts = frequent.select("lang", F.col("code").alias("s1"), *[F.lit(0).cast("long").alias(s) for s in sub[1:]], F.col("n").alias("f"))
    counts = counts.unionByName(nodes.where(F.col("size") < LONGEST).select(
        "lang", *[F.col(c).alias(s) for c, s in zip(CODES, sub, strict=False)], F.col("a").alias("f")))

    def looked_up(rows, name):
        wanted = rows.groupBy("lang", *sub).agg(F.count("*").alias("weight"))
        facts = counts.join(wanted, ["lang", *sub]).withColumnRenamed("f", name)
        return meet(rows, facts, ["lang", *sub], "weight", rows.count()).drop(*sub)

    cuts = nodes.withColumn("k", F.explode(F.sequence(F.lit(1), (F.col("size") - 1).cast("int"))))
    cuts = looked_up(cut_lineage(parts(cuts, F.lit(0), F.col("k"))), "l")
    cuts = looked_up(cut_lineage(parts(cuts, F.col("k"), F.col("size") - F.col("k"))), "r")
    exact = F.expr("cast((cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as bigint)")
    scored = cuts.withColumn("score", exact).groupBy(*key, "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    longer = nodes.where("size > 2").withColumn("from", F.explode(F.sequence(F.lit(0), (F.col("size") - 2).cast("int"))))
    longer = longer.withColumn("count", F.explode(F.expr("sequence(2, least(size - 1, size - from))")))
    longer = parts(longer, F.col("from"), F.col("count")).groupBy("lang", *sub).agg(F.max("a").alias("within"))
    longer = longer.select("lang", *[F.col(s).alias(c) for s, c in zip(sub, CODES, strict=False)], F.lit(0).cast("long").alias(CODES[-1]), "within")
    kept = scored.join(longer, key, "left").where(
        f"within is null or cast(within as decimal(19,0)) * 100 < cast(a as decimal(19,0)) * {inside}")

    kept = _reachable(cut_lineage(kept.drop("within")), top)
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"))
    kept = cut_lineage(kept.withColumn("place", F.rank().over(best)).where(F.col("place") <= top).drop("place"))
    named = kept.select(*key, "size", F.posexplode(F.slice(F.array(*CODES), 1, F.col("size").cast("int"))).alias("pos", "code"))
    named = named.join(frequent.select("lang", "code", "word"), ["lang", "code"]).groupBy(*key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = kept.join(named, key).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return out.join(per_lang, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
