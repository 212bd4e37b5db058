"""Prefix trie of conversations, built as double arrays per prefix shard.

1. Turns become 16-byte marks and a size. Positions are counted in slices of a conversation, so none has to meet
   in one task. A conversation that was resumed from another takes over that one's first turns.
2. Conversations are cut into segments of ``segment`` turns. Equal segments after equal beginnings are one entry with
   a count. Layers of segments are worked off from the deepest up, each handing the totals of its
   subtrees to the one above; usual conversations have one segment.
3. A shard holds all entries that share their first turns. Where one turn begins more than ``budget`` turns, the
   shared beginning is doubled until every shard fits. Each bucket of shards becomes one trie: dense turn ids, BASE
   and CHECK packed by first fit, entries walked through the arrays, subtree totals handed from child to parent by
   CHECK. All that lies below a shard's beginning is final there.
4. The nodes above, which several shards share, are merged globally by a key of their path, and what they
   themselves add is handed to their ancestors.
5. Ids of the conversations that end at a node are joined in short slices side by side; a SHA-256 can only be fed in
   order, so the slices of a node pass one after the other through one task that holds nothing but the hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm import batches as B
from lorewell.llm.graph import meet
from lorewell.scale import cut_lineage, running_total

FOLDS = 9
FAMILY = 5
SEGMENT = 1 << 16
BUDGET = 200_000
#: A shard has at most this part of all turns too, so that no task stands out; fewer than LEAST_BUDGET are always left together.
BALANCE = 256
LEAST_BUDGET = 256
SLICE = 1024
TRIES = 64

NODE = ("key string, parent_key string, ancestors array<string>, conv_id long, parent_conv_id long, depth long, n_convs long, "
        "size long, kids long, n_leaves long, saved_tokens long, end string")


class DoubleArray:
    """A trie in two arrays: the child of state s by symbol c is BASE[s] + c where CHECK says s.

    Built from sorted different sequences of symbols from 1 up. State 1 is the top, ``states`` has all others,
    parents before children, with their depths.
    """

    def __init__(self, sequences: list[list[int]]):
        self.base, self.check, self._free = [0, 0], [0, 1], [2, 2]
        self.states: list[int] = []
        self.depths: list[int] = []
        self.children: dict[int, int] = {}
        self._build(sequences)

    def step(self, state: int, symbol: int) -> int:
        """The child, or 0."""
        at = self.base[state] + symbol
        return at if self.base[state] and at < len(self.check) and self.check[at] == state else 0

    def _grow(self, size: int) -> None:
        have = len(self.check)
        if size > have:
            self.base.extend([0] * (size - have))
            self.check.extend([0] * (size - have))
            self._free.extend(range(have, size))

    def _next_free(self, at: int) -> int:
        self._grow(at + 1)
        free, first = self._free, at
        while at < len(free) and free[at] != at:
            at = free[at]
        while first < len(free) and free[first] != at and first < at:
            free[first], first = at, free[first]
        self._grow(at + 1)
        return at

    def _place(self, symbols: list[int]) -> int:
        low, high, check = symbols[0], symbols[-1], self.check
        at = self._next_free(low + 1)
        for _ in range(TRIES):
            base = at - low
            self._grow(base + high + 1)
            if not any(check[base + c] for c in symbols):
                return base
            at = self._next_free(at + 1)
        base = len(check)
        self._grow(base + high + 1)
        return base

    def _build(self, sequences: list[list[int]]) -> None:
        todo = [(1, 0, len(sequences), 0)]
        for state, low, high, depth in todo:
            while low < high and len(sequences[low]) == depth:
                low += 1
            symbols, runs = [], []
            while low < high:
                symbol, first = sequences[low][depth], low
                while low < high and sequences[low][depth] == symbol:
                    low += 1
                symbols.append(symbol)
                runs.append((first, low))
            self.children[state] = len(symbols)
            if not symbols:
                continue
            base = self.base[state] = self._place(symbols)
            for symbol, (first, last) in zip(symbols, runs, strict=True):
                child = base + symbol
                self.check[child], self._free[child] = state, child + 1
                self.states.append(child)
                self.depths.append(depth + 1)
                todo.append((child, first, last, depth + 1))


def _mark_hash(path: str, mark: bytes) -> str:
    return hashlib.sha256(path.encode() + mark).hexdigest()


def _shard_nodes(offset: int):
    """All nodes of a bucket of shards; those above a shard's beginning carry what this bucket knows of them."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        turns = group.column("turns").chunk(0)
        marks = turns.flatten().field("mark").dictionary_encode()
        sizes, of_turn = [0] * len(marks.dictionary), marks.indices.to_pylist()
        for code, size in zip(of_turn, turns.flatten().field("size").to_pylist(), strict=True):
            sizes[code] = size
        names = marks.dictionary.to_pylist()
        starts = group.column("start").chunk(0).dictionary_encode()
        owners = dict(zip(group.column("start").to_pylist(), group.column("start_conv").to_pylist(), strict=True))
        first_start = len(names) + 1
        at = [0]
        for length in turns.value_lengths().to_pylist():
            at.append(at[-1] + length)
        sequences = [[first_start + s, *[c + 1 for c in of_turn[a:b]]]
                     for s, a, b in zip(starts.indices.to_pylist(), at, at[1:], strict=False)]
        entries = [group.column(c).to_pylist() for c in ("n", "conv_id", "prefix", "end", "below_kids", "below_leaves", "below_saved")]
        trie = DoubleArray(sorted(sequences))

        count = len(trie.check)
        members, smallest, prefix, end = [0] * count, [None] * count, [0] * count, [None] * count
        kids, leaves, saved = [0] * count, [0] * count, [0] * count
        symbol_of = [0] * count
        for sequence, n, conv, shared, key, more, below_leaves, below_saved in zip(sequences, *entries, strict=True):
            state = 1
            for symbol in sequence:
                state = trie.step(state, symbol)
                members[state] += n
                if smallest[state] is None or conv < smallest[state]:
                    smallest[state] = conv
                prefix[state], symbol_of[state] = shared, symbol
            end[state] = key
            kids[state] += more
            leaves[state] += below_leaves
            saved[state] += below_saved

        depth_of = dict(zip(trie.states, trie.depths, strict=True))
        upper = {s: depth_of[s] - 1 < prefix[s] for s in trie.states}
        for state in reversed(trie.states):
            parent = trie.check[state]
            if not upper[state]:
                kids[state] += trie.children[state]
                leaves[state] += kids[state] == 0
                saved[state] += (members[state] - 1) * sizes[symbol_of[state] - 1]
                kids[parent] += upper.get(parent, False)  # upper children are counted when they are merged
            if parent != 1:
                leaves[parent] += leaves[state]
                saved[parent] += saved[state]

        path, above, out = {}, {}, []
        for state in trie.states:
            parent = trie.check[state]
            if parent == 1:
                path[state], above[state] = starts.dictionary[symbol_of[state] - first_start].as_py(), []
                if owners[path[state]] is not None:  # conversations that end there count too
                    smallest[state] = owners[path[state]]
            elif upper[state]:
                path[state] = _mark_hash(path[parent], names[symbol_of[state] - 1])
                above[state] = [*above[parent], path[parent]]
            out.append((
                path.get(state), path.get(parent), above.get(state), smallest[state],
                None if parent == 1 or upper[parent] else smallest[parent], offset + depth_of[state] - 1, members[state],
                0 if parent == 1 else sizes[symbol_of[state] - 1], kids[state], leaves[state], saved[state], end[state]))
        columns = zip(*out, strict=True) if out else [[]] * 12
        types = [pa.string(), pa.string(), pa.list_(pa.string()), *[pa.int64()] * 8, pa.string()]
        names = [field.split()[0] for field in NODE.split(", ")]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})

    return run


def _sharded(entries: DataFrame, budget: int) -> DataFrame:
    """Entries with the length of their shard's beginning (``prefix``) and their ``bucket``.

    Beginnings with more than ``budget`` turns after them, or more than one turn in ``BALANCE``, are doubled in length; there
    are at most all turns / budget and ``BALANCE`` of those, which are broadcast.
    """
    session = entries.sparkSession
    weight = F.size("turns") + F.lit(1)
    total = entries.agg(F.sum(weight)).first()[0] or 0
    budget = min(budget, max(LEAST_BUDGET, total // BALANCE))
    buckets = max(-(-4 * total // budget), int(session.conf.get("spark.sql.shuffle.partitions")))
    done, rest, prefix = None, entries, 1
    while True:
        beginning = F.transform(F.slice("turns", 1, prefix), lambda x: x["mark"])
        rest = rest.withColumn("prefix", F.lit(prefix).cast("long")).withColumn("shard", F.xxhash64("start", "prefix", beginning))
        loads = rest.groupBy("shard").agg(F.sum(weight).alias("load"), F.count("*").alias("n"), F.max(F.size("turns")).alias("longest"))
        full = cut_lineage(loads.where((F.col("load") > budget) & (F.col("n") > 1) & (F.col("longest") > prefix)).select("shard"))
        ready = rest.join(F.broadcast(full), "shard", "left_anti")
        done = ready if done is None else done.unionByName(ready)
        if full.isEmpty():
            return done.withColumn("bucket", F.pmod("shard", F.lit(buckets))).drop("shard")
        rest, prefix = cut_lineage(rest.join(F.broadcast(full), "shard", "left_semi")), 2 * prefix


def _layer(entries: DataFrame, offset: int, budget: int) -> DataFrame:
    """The nodes of one layer of segments: the columns of the result, ``key`` (of shared nodes) and ``end``."""
    columns = ["start", "start_conv", "turns", "n", "conv_id", "prefix", "end", "below_kids", "below_leaves", "below_saved"]
    grouped = _sharded(entries, budget).select("bucket", *columns).groupBy("bucket")
    nodes = cut_lineage(grouped.applyInArrow(_shard_nodes(offset), NODE))
    final, shared = nodes.where("key is null"), nodes.where("key is not null")
    merged = shared.groupBy("key").agg(
        *[F.first(c).alias(c) for c in ("parent_key", "ancestors", "depth", "size")], F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "kids", "n_leaves", "saved_tokens")], F.max("end").alias("end"))
    merged = cut_lineage(merged)
    shared_kids = merged.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("shared_kids"))
    merged = merged.join(shared_kids, "key", "left").withColumn("shared_kids", F.coalesce("shared_kids", F.lit(0)))
    merged = cut_lineage(merged.withColumn("n_children", F.col("kids") + F.col("shared_kids")))
    own = merged.select(
        F.explode(F.array_append("ancestors", F.col("key"))).alias("key"), (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("spared")).groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("spared").alias("spared"))
    merged = merged.join(own, "key").withColumn("n_leaves", F.col("n_leaves") + F.col("leaf")).withColumn(
        "saved_tokens", F.col("saved_tokens") + F.col("spared"))
    merged = cut_lineage(merged.drop("leaf", "spared", "ancestors", "size"))

    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end", "key"]
    final = final.withColumnRenamed("kids", "n_children")
    total = nodes.count()
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"), "kids", "shared_kids")
    below = meet(final.where("parent_key is not null").drop("parent_conv_id"), parents.drop("shared_kids"), ["parent_key"], "kids", total)
    upper = meet(merged.where("parent_key is not null"), parents.drop("kids").withColumnRenamed("shared_kids", "weight"),
                 ["parent_key"], "weight", total)
    tops = merged.where("parent_key is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    parts = [final.where("parent_key is null"), below, upper, tops]
    out = parts[0].select(result)
    for part in parts[1:]:
        out = out.union(part.select(result))
    return out


def _ends(ends: DataFrame) -> DataFrame:
    """(end, ends_sha256): hash of the ascending, comma-joined ids of the conversations that end at each node."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    slices = ends.groupBy("end", F.floor(F.col("conv_id") / 4096).alias("slice")).agg(text.alias("ids"))
    ordered = slices.repartition("end").sortWithinPartitions("end", "slice")

    def run(batches: Iterable[pa.RecordBatch]):
        key, running = None, None
        for batch in batches:
            out = []
            for end, ids in zip(batch.column("end").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if end == key:
                    running.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((key, running.hexdigest()))
                key, running = end, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in (0, 1)], ["end", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([running.hexdigest()])], ["end", "ends_sha256"])

    return ordered.select("end", "ids").mapInArrow(run, "end string, ends_sha256 string")


def rebuilt_turns(conversations: DataFrame, folds: int = FOLDS, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, mark, size) of every rebuilt turn, pos from 0, and the conv_id of conversations left without any.

    Conversation c begins with the first h turns of conversation c - c % family, h = crc32(c as text) % folds, and
    goes on with its own turns after its first h.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.substring(mark, 1, 32)).alias("mark"), F.octet_length(text).cast("long").alias("size"))
    slice_of = F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(-(1 << 62)))
    numbered = running_total(cut_lineage(turns), ["conv_id"], [F.asc_nulls_first("turn"), F.col("mark")], slice_of, F.lit(1), "pos")
    numbered = cut_lineage(numbered.drop("turn"))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % folds
    sizes = numbered.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    sizes = sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(base, "base", "left")
    sizes = cut_lineage(sizes.withColumn("taken", taken).withColumn(
        "got", F.least("taken", F.coalesce("base_n", F.lit(0)))))
    heads = numbered.where((F.col("conv_id") % family == 0) & (F.col("pos") < folds - 1)).withColumnRenamed("conv_id", "base")
    inherited = sizes.select("conv_id", "base", "taken").join(heads, "base").where("pos < taken").select("conv_id", "pos", "mark", "size")
    own = meet(numbered.where(F.col("pos") >= taken), sizes.select("conv_id", "n", "taken", "got"), ["conv_id"], "n", numbered.count())
    own = own.select("conv_id", (F.col("pos") - F.col("taken") + F.col("got")).alias("pos"), "mark", "size")
    return inherited.unionByName(own), sizes.where("got = 0 and n <= taken").select("conv_id")


def prefix_trie(conversations: DataFrame, folds: int = FOLDS, family: int = FAMILY, segment: int = SEGMENT,
                budget: int = BUDGET) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (columns ``conv_id, turn, role, text``).

    A node is a different sequence of first turns, told by role and text; the root has depth 0. conv_id: smallest
    member; depth; parent_conv_id: that of the parent (null for the root); n_convs: members; n_children; n_leaves:
    childless nodes in the subtree, itself included; saved_tokens: over the subtree, (n_convs - 1) times the UTF-8 bytes
    of each node's last text; ends_sha256: SHA-256 of the ids of the members that end there, ascending, comma-joined.

    Turns go by turn, null first; equal turn numbers by the hash of role and text, repeated rows are repeated turns. Null
    role or text counts as empty. Rows without a conv_id belong to no conversation and are left out. An empty
    table has no node. Extra columns are not looked at. Any length of text costs 24 bytes; ``segment`` turns of
    one conversation at most meet in one row, ``budget`` turns or one segment in one trie.
    """
    B.prepare(conversations.sparkSession)
    turns, empty = rebuilt_turns(conversations, folds, family)
    turns = turns.withColumn("segment", F.floor(F.col("pos") / segment)).groupBy("conv_id", "segment").agg(
        F.sort_array(F.collect_list(F.struct("pos", "mark", "size"))).alias("turns"))
    turns = turns.withColumn("turns", F.transform("turns", lambda t: F.struct(t["mark"].alias("mark"), t["size"].alias("size"))))
    nothing = F.array().cast("array<struct<mark:binary,size:bigint>>")
    turns = turns.unionByName(empty.select("conv_id", F.lit(0).cast("long").alias("segment"), nothing.alias("turns")))
    content = F.sha2(F.array_join(F.transform("turns", lambda t: F.hex(t["mark"])), "").cast("binary"), 256)
    turns = cut_lineage(turns.withColumn("content", content))
    root = hashlib.sha256(b"").hexdigest()
    deepest = turns.agg(F.max("segment")).first()[0]
    if not deepest:  # one segment each: its content is the whole path
        turns = turns.withColumn("start", F.lit(root)).withColumn("end", F.col("content")).withColumn("last", F.lit(True))
    else:
        order = Window.partitionBy("conv_id").orderBy("segment")
        path = lambda last: F.sha2(F.array_join(F.collect_list("content").over(
            order.rowsBetween(Window.unboundedPreceding, last)), "").cast("binary"), 256)
        paths = turns.select("conv_id", "segment", path(-1).alias("start"), path(0).alias("end"),
                             F.lead("segment").over(order).isNull().alias("last"))
        first = F.col("segment") == 0
        paths = paths.withColumn("start", F.when(first, F.lit(root)).otherwise(F.col("start")))
        turns = turns.join(paths, ["conv_id", "segment"])
        turns = turns.withColumn("end", F.when(first & (F.size("turns") == 0), F.lit(root)).otherwise(F.col("end")))
        turns = cut_lineage(turns)
    entries = turns.groupBy("segment", "start", "end").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns"))
    entries = cut_lineage(entries)

    owners = entries.select((F.col("segment") + 1).alias("segment"), F.col("end").alias("start"), F.col("conv_id").alias("start_conv"))
    below, out = None, None
    for layer in range(deepest or 0, -1, -1):
        mine = entries.where(F.col("segment") == layer)
        if layer:
            mine = mine.join(owners, ["segment", "start"])
        else:
            mine = mine.withColumn("start_conv", F.lit(None).cast("long"))
        if below is not None:
            mine = mine.join(below, "end", "left")
        for c in ("below_kids", "below_leaves", "below_saved"):
            mine = mine.withColumn(c, F.coalesce(c, F.lit(0)) if below is not None else F.lit(0).cast("long"))
        nodes = cut_lineage(_layer(mine, layer * segment, budget))
        if layer:
            start = (F.col("depth") == layer * segment)
            below = nodes.where(start).select(F.col("key").alias("end"), F.col("n_children").alias("below_kids"),
                                              F.col("n_leaves").alias("below_leaves"), F.col("saved_tokens").alias("below_saved"))
            nodes = nodes.where(~start)
        out = nodes if out is None else out.unionByName(nodes)
    hashes = _ends(turns.where("last").select("end", "conv_id"))
    ended = out.where("end is not null").join(hashes, "end", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(root)))
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return ended.select(result).unionByName(out.where("end is null").withColumn("ends_sha256", F.lit(root)).select(result))
