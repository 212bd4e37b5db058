"""Exact vector top-k, hybrid re-ranking, citations and confidence for batches of questions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.functions.text import none_if_blank, strip
from lorewell.functions.tokens import HAN, HAN_COMMON, gap_closed_bigrams, run_bigrams
from lorewell.functions.numbers import half_up
from lorewell.scale import cut_lineage, let, rows_of_keys, top_per_key

# Weights, caps and limits of the ranking, and the texts it looks for.
CURATED_BONUS, CATEGORY_BONUS = 0.15, 0.03
FILENAME_STEP, FILENAME_CAP = 0.02, 0.10
LEXICAL_STEP, LEXICAL_CAP, MARKER_BONUS, LEXICAL_TOTAL = 0.025, 0.12, 0.10, 0.20
STOP_BIGRAMS = ("哪些", "什么", "怎么", "如何", "一下", "请问", "是否")
MARKER = r"(?<![a-z0-9])([a-z][a-z0-9-]{0,5}\s*类)"
TARGET = r"转专业目标[：:]\s*([^\n；;]+)"
TARGET_MOST = 0.35
TARGET_TOPIC = "转专业"
TARGET_GENERAL = ("管理办法", "工作安排", "转专业安排")
TOP_K, CANDIDATE_K, MIN_SCORE = 5, 20, 0.35
NO_FILENAME, NO_SOURCE, OFFICIAL = "未知文件", "未知来源", "official"
FALLBACK = "知识库中暂无相关信息，请咨询相关部门。"

QUERY_BYTES = 64 * 1024 * 1024
INDEX_BYTES = 2 * QUERY_BYTES
SLAB_BYTES = 16 * 1024 * 1024
QUERIES_AT_ONCE, ROWS_AT_ONCE, PAIRS_AT_ONCE, ROWS_OUT = 512, 4096, 4096, 65_536
MERGE_GROUPS, PACKED_ROWS = 4, 2048
DIGITS = 6
STEPS, KEY_BITS = 10.0 ** DIGITS, 63


def candidate_count(top_k: int) -> int:
    return max(100, 5 * top_k)


# --- vector search ---------------------------------------------------------------------------

def unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def vector_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(column):
        return flat.reshape(0, 0)
    sizes = pc.unique(pc.list_value_length(column))
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(sizes.to_pylist(), key=str)}")
    return flat.reshape(len(column), -1)


class _Best:
    """The k nearest rows seen so far for every query of a block, ties by the place of the row.

    A row found is one number: its query, its distance in steps of the last digit and its place, from the highest bits down. Sorting
    those numbers sorts by query, distance and place.
    """

    def __init__(self, queries: int, k: int):
        self.k, self.worst = k, np.full(queries, np.inf)
        self.query, self.place, self.step = (np.empty(0, np.int64) for _ in range(3))
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.count = 0

    def offer(self, queries: np.ndarray, asked: tuple[np.ndarray, np.ndarray], rows: Rows, low: int, high: int, room: _Room) -> None:
        """``asked``: unit vectors of ``queries`` in double and single precision."""
        score, near = room.of(len(queries), high - low)
        np.matmul(asked[1], rows.single[low:high].T, out=score)
        limit = self.worst[queries]
        if score.shape[1] > self.k and np.isinf(limit).any():
            # Nothing behind the k-th of this batch can be among the k best; ties stay in.
            held = np.where(np.isnan(score), -np.inf, score) if np.isnan(score).any() else score
            last = np.partition(held, held.shape[1] - self.k, axis=1)[:, held.shape[1] - self.k].astype(np.float64)
            limit = np.fmin(limit, np.where(np.isfinite(last), _steps(last - rows.off) + 1, np.inf))
        # Single precision only tells which rows may be near enough; the slack is wider than what it and rounding move.
        least = np.where(np.isinf(limit), -np.inf, 1.0 - (limit + 1) / STEPS - rows.off).astype(np.float32)
        np.greater_equal(score, least[:, None], out=near)
        query, row = np.divmod(_true_places(near), score.shape[1])
        row += low
        step = np.empty(len(query))
        for at in range(0, len(query), PAIRS_AT_ONCE):
            some = slice(at, at + PAIRS_AT_ONCE)
            step[some] = _steps(np.einsum("ij,ij->i", asked[0].take(query[some], axis=0), rows.vectors.take(row[some], axis=0)))
        near = step <= limit[query]
        self.waiting.append((queries[query[near]], rows.places[row[near]], step[near].astype(np.int64)))
        self.count += len(self.waiting[-1][0])
        if self.count > len(self.worst) * self.k:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        query, place, step = (np.concatenate(parts) for parts in zip((self.query, self.place, self.step), *self.waiting))
        self.waiting, self.count, self.query, self.place, self.step = [], 0, None, None, None
        low, middle = int(place.max(initial=0)).bit_length(), int(step.max(initial=0)).bit_length()
        packed = low + middle + len(self.worst).bit_length() <= KEY_BITS
        if packed:
            # One array in the end, worked on where it is: a task has many such rows.
            query <<= low + middle
            step <<= low
            query |= step
            query |= place
            del place, step
            query.sort()
            first = np.searchsorted(query, np.arange(len(self.worst) + 1) << (low + middle))
        else:
            order = np.lexsort((place, step, query))
            query, place, step = query[order], place[order], step[order]
            first = np.searchsorted(query, np.arange(len(self.worst) + 1))
        keep = np.arange(len(query))
        keep -= np.repeat(first[:-1], np.diff(first))
        keep = keep < self.k
        if packed:
            key = query[keep]
            query, step, place = key >> (low + middle), key >> low & ((1 << middle) - 1), key & ((1 << low) - 1)
        else:
            query, place, step = query[keep], place[keep], step[keep]
        last = np.cumsum(np.minimum(np.diff(first), self.k)) - 1
        full = np.diff(first) >= self.k
        self.worst[full] = np.minimum(self.worst[full], step[last[full]])
        self.query, self.place, self.step = query, place, step


class _Room:
    """Memory for the scores of a batch and for which of them are near, used again for every batch."""

    def __init__(self):
        self.score, self.near = np.empty(QUERIES_AT_ONCE * ROWS_AT_ONCE, np.float32), np.empty(QUERIES_AT_ONCE * ROWS_AT_ONCE, bool)

    def of(self, queries: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
        return self.score[:queries * rows].reshape(queries, rows), self.near[:queries * rows].reshape(queries, rows)


def _true_places(mask: np.ndarray) -> np.ndarray:
    """``flatnonzero`` of a mask that is nearly everywhere false: eight places are looked at together."""
    if mask.size % 8:
        return np.flatnonzero(mask)
    some = np.flatnonzero(mask.reshape(-1).view(np.uint64))
    word, place = np.nonzero(mask.reshape(-1, 8)[some])
    return some[word] * 8 + place


def _steps(score: np.ndarray) -> np.ndarray:
    """Distances as whole numbers of the last digit that is kept; not a number stays so."""
    return np.rint((1.0 - score) * STEPS)


class Rows:
    """Index rows ready to be searched: unit vectors in the order of their groups, and every row's place by id."""

    def __init__(self, vectors: np.ndarray, groups: np.ndarray | None, places: np.ndarray):
        vectors = unit(vectors)
        if groups is not None:
            order = np.argsort(groups, kind="stable")
            vectors, groups, places = vectors[order], groups[order], places[order]
        self.vectors, self.groups, self.places = vectors, groups, places
        self.single = vectors.astype(np.float32)
        # Twice what a product of unit vectors of this length can be off in single precision.
        self.off = (vectors.shape[1] + 4) * 2.0 ** -23


class Block:
    """A block of queries that reads index rows and remembers the best overall and per group.

    ``groups``: for every query the group it searches, or a row of them, each at most once; below zero for none.
    """

    def __init__(self, vectors: np.ndarray, groups: np.ndarray | None, k: int, modes: tuple[bool, ...]):
        self.vectors, self.modes = unit(vectors), modes
        self.single = self.vectors.astype(np.float32)
        self.best, self.room = [_Best(len(vectors), k) for _ in modes], _Room()
        if True in modes:
            groups = groups.reshape(len(vectors), -1)
            asked, wanted = np.repeat(np.arange(len(vectors)), groups.shape[1]), groups.ravel()
            order = np.argsort(wanted, kind="stable")
            self.asked, wanted = asked[order], wanted[order]
            self.wanted, first = np.unique(wanted, return_index=True)
            self.bounds = np.append(first, len(wanted))

    def read(self, rows: Rows) -> None:
        for grouped, best in sorted(zip(self.modes, self.best), key=lambda mode: not mode[0]):
            if not grouped:
                if True in self.modes:
                    # The k-th inside its group bounds what a query needs of all rows.
                    best.worst = np.minimum(best.worst, self.best[self.modes.index(True)].worst)
                self._read(best, np.arange(len(self.vectors)), rows, 0, len(rows.places))
                continue
            low, high = np.searchsorted(rows.groups, self.wanted), np.searchsorted(rows.groups, self.wanted, side="right")
            for n in np.flatnonzero((self.wanted >= 0) & (low < high)):
                self._read(best, self.asked[self.bounds[n]:self.bounds[n + 1]], rows, low[n], high[n])
            best.settle()

    def _read(self, best: _Best, queries: np.ndarray, rows: Rows, begin: int, end: int) -> None:
        # As long as little is known of what is near, twice as many rows at a time: each part bounds the next.
        low, part = begin, ROWS_AT_ONCE if np.isinf(best.worst[queries]).any() else end - begin
        while low < end:
            high = min(end, low + part)
            for first in range(0, len(queries), QUERIES_AT_ONCE):
                some = queries[first:first + QUERIES_AT_ONCE]
                asked = self.vectors[some], self.single[some]
                for at in range(low, high, ROWS_AT_ONCE):
                    best.offer(some, asked, rows, at, min(high, at + ROWS_AT_ONCE), self.room)
            if high < end:
                best.settle()
            low, part = high, 2 * part

    def emit(self, query_ids: pa.Array, ids: pa.Array, names: list[str]) -> Iterator[pa.RecordBatch]:
        """``ids``: those of the rows by place."""
        for grouped, best in zip(self.modes, self.best):
            best.settle()
            yield from _batches(best.query, best.place, best.step, np.full(len(best.query), grouped), query_ids, ids, names)

    def emit_merged(self, query_ids: pa.Array, ids: pa.Array, names: list[str]) -> Iterator[pa.RecordBatch]:
        """One row for a row found in both modes; ``modes`` are (False, True), and no id stands twice in ``ids``."""
        general, grouped = self.best
        general.settle()
        grouped.settle()
        pairs = [best.query * len(ids) + best.place for best in self.best]
        only = ~np.isin(pairs[0], pairs[1])
        for best, keep, preferred in ((grouped, slice(None), True), (general, only, False)):
            query = best.query[keep]
            yield from _batches(query, best.place[keep], best.step[keep], np.full(len(query), preferred), query_ids, ids, names)


def _batches(query: np.ndarray, place: np.ndarray, step: np.ndarray, flag: np.ndarray, query_ids: pa.Array, ids: pa.Array,
             names: list[str]) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(query), ROWS_OUT):
        part = slice(low, low + ROWS_OUT)
        yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(query[part])), ids.take(pa.array(place[part])),
                                          pa.array(step[part] / STEPS), pa.array(flag[part])], names=names)


def by_id(ids: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The ids in order, and the place of every row in it."""
    order = pc.array_sort_indices(ids)
    places = np.empty(len(ids), np.int64)
    places[order.to_numpy()] = np.arange(len(ids))
    return ids.take(order), places


class _Known:
    """Ids behind the places that a block holds, while more and more rows are read."""

    def __init__(self, block: Block):
        self.block, self.ids = block, None

    def read(self, ids: pa.Array, vectors: np.ndarray, groups: np.ndarray | None) -> None:
        old = 0 if self.ids is None else len(self.ids)
        self.ids, places = by_id(ids if self.ids is None else pa.concat_arrays([self.ids, ids]))
        for best in self.block.best:
            best.place = places[best.place]
        self.block.read(Rows(vectors, groups, places[old:]))
        for best in self.block.best:
            best.settle()
        held = np.unique(np.concatenate([best.place for best in self.block.best]))
        self.ids = self.ids.take(pa.array(held))
        for best in self.block.best:
            best.place = np.searchsorted(held, best.place)


def _codes(column: pa.Array, known: pa.Array, missing: int) -> np.ndarray:
    """Places of the values among ``known``; ``missing`` for nulls and other values."""
    return np.array(pc.fill_null(pc.index_in(column, value_set=known, skip_nulls=True), missing))


def vector_candidates(queries: DataFrame, index: DataFrame, k: int, modes: tuple[bool, ...], query_id: str = "query_id",
                      query_vector: str = "query_vector", index_id: str = "chunk_key", vector: str = "vector",
                      same: str | None = "category", max_query_bytes: int = QUERY_BYTES, merge_groups: int | None = None,
                      merged: bool = False, along: Sequence[str] = ()) -> DataFrame:
    """(query_id, index_id, distance, grouped): the ``k`` nearest rows by cosine, for every mode.

    Mode ``False`` searches all rows, mode ``True`` only rows that share the query's value in
    ``same``. Exact; both modes share one reading of the index. Only ids, vectors and ``same`` take part.

    Few questions, and all that weigh less than the index with their candidates, travel to the index. Each task multiplies its
    rows with a broadcast block of queries and emits only its own top k, then a limited rank merges them. A task reads many files, ``merge_groups`` tasks in all (by default four for every
    core): so the rows to merge grow with the cluster and not with the files of the index. Queries travel in blocks of about
    ``max_query_bytes`` with what a task remembers for them.

    For many questions an index of up to ``INDEX_BYTES`` travels as one block; each task answers its own questions, at most
    ``max_query_bytes`` of them at once, so it leaves k rows a question however many tasks there are. A larger index is packed and
    stored in the order of its ids, and every task reads all of it for its own questions (``_index_in_order``).

    Of several blocks of questions each is answered and stored before the next one is sent out.

    ``merged``: rows may come as (query_id, index_id, distance, preferred) already, see ``merged_candidates``. They may then
    carry the index columns ``along`` too.
    """
    same = same if True in modes else None
    queries = queries.select(query_id, query_vector, *([same] if same else [])).where(F.size(query_vector) > 0)
    queries = cut_lineage(queries)  # counted and shipped; their vectors may come from a model
    index = index.select(index_id, vector, *([same] if same else []), *along).where(F.size(vector) > 0)
    count, size = queries.agg(F.count("*"), F.max(F.size(query_vector))).first()
    merged = merged and queries.select(query_id).distinct().count() == count
    rows = index.count()
    merge_groups = merge_groups or MERGE_GROUPS * queries.sparkSession.sparkContext.defaultParallelism
    vector_bytes, held = (size or 1) * 8, k * len(modes) * 16
    columns = (query_id, query_vector, index_id, vector, same)
    if count * (vector_bytes + held * merge_groups) > max(max_query_bytes, rows * vector_bytes):
        return index_to_queries(queries, index, k, modes, *columns, max_query_bytes=max_query_bytes, tasks=merge_groups, merged=merged, along=along)
    index = index.drop(*along).coalesce(merge_groups)
    blocks = max(1, math.ceil(count * (vector_bytes + held) / max_query_bytes))
    part = F.pmod(F.xxhash64(query_id), F.lit(blocks))

    def answered(block: int) -> DataFrame:
        local, shipped = _scan(queries.where(part == block), index, k, modes, *columns)
        best = _nearest(local, k, query_id, index_id)
        if blocks > 1:
            best = cut_lineage(best)
            shipped.destroy()
        return best

    return reduce(DataFrame.union, [answered(block) for block in range(blocks)])


def merged_candidates(queries: DataFrame, index: DataFrame, k: int, query_id: str = "query_id", query_vector: str = "query_vector",
                      index_id: str = "chunk_key", vector: str = "vector", same: str = "category", **limits) -> DataFrame:
    """(query_id, index_id, distance, preferred): ``vector_candidates`` of both modes with one row per query and id.

    ``preferred``: found inside the query's own ``same``. Where the index travels to many questions, their tasks merge the
    modes themselves. Columns named in ``along`` come with the rows only where a large index was stored for the search and no id
    in it is null or stands twice.
    """
    found = vector_candidates(queries, index, k, (False, True), query_id, query_vector, index_id, vector, same, merged=True, **limits)
    if "preferred" in found.columns:
        return found
    return collapse_candidates(found.withColumnRenamed("grouped", "preferred"), query_id, index_id)


def index_to_queries(queries: DataFrame, index: DataFrame, k: int, modes: tuple[bool, ...], query_id: str, query_vector: str, index_id: str,
                     vector: str, same: str | None, visits: Callable[[np.ndarray], np.ndarray] | None = None,
                     max_query_bytes: int = QUERY_BYTES, tasks: int | None = None, merged: bool = False,
                     along: Sequence[str] = ()) -> DataFrame:
    """``vector_candidates`` of many queries: the index comes to the queries, as one block or row by row from where it is stored.

    ``visits`` gives the groups that queries search from their unit vectors, instead of one group in ``same``; ``same`` is then a
    number and never null.
    """
    rows, size = index.agg(F.count("*"), F.max(F.size(vector))).first()
    vector_bytes = (size or 1) * 8
    if rows * vector_bytes > INDEX_BYTES:
        return _index_in_order(queries, index, rows, size, k, modes, query_id, query_vector, index_id, vector, same, visits, merged, along)
    queries = queries.repartition(tasks or MERGE_GROUPS * queries.sparkSession.sparkContext.defaultParallelism, query_id)
    return _scan_queries(queries, index.drop(*along), k, modes, query_id, query_vector, index_id, vector, same, visits,
                         max(1, max_query_bytes // vector_bytes), merged)


def _index_in_order(queries: DataFrame, index: DataFrame, rows: int, size: int, k: int, modes: tuple[bool, ...], query_id: str,
                    query_vector: str, index_id: str, vector: str, same: str | None, visits: Callable[[np.ndarray], np.ndarray] | None,
                    merged: bool, along: Sequence[str]) -> DataFrame:
    """``vector_candidates`` of many queries over an index of any size: ``rows`` vectors of ``size`` numbers.

    The index is shuffled once, into the order of its ids, and stored in packed rows. Queries are sent out in blocks of about
    ``INDEX_BYTES``; a task takes its share of a block and reads the whole stored index as a stream, so it holds its queries with their
    k nearest and nothing else, and no candidates of several tasks are merged. What is found is a row's number in that order, which
    settles ties as the id does; only the rows that are left at the end meet their ids.
    """
    cores = queries.sparkSession.sparkContext.defaultParallelism
    packed = cut_lineage(_packed(index.select(vector, *([same] if same else []), index_id, *along), index_id, vector,
                                 max(cores, math.ceil(rows * size * 8 / INDEX_BYTES))))
    parts = packed.groupBy("part").agg(F.max(F.col("first") + F.col("count")).alias("count"), F.bool_or("again").alias("again")).collect()
    starts, total = {}, 0
    for part in sorted(parts, key=lambda p: p["part"]):
        starts[part["part"]], total = total, total + part["count"]
    count = queries.count()
    merged = merged and not any(part["again"] for part in parts)
    narrow = queries.schema[query_vector].dataType.elementType.simpleString() == "float"
    blocks = max(1, math.ceil(count * size * (4 if narrow else 8) / INDEX_BYTES))
    block_of = F.pmod(F.xxhash64(query_id), F.lit(blocks))

    def answered(block: int) -> DataFrame:
        asked = queries.where(block_of == block) if blocks > 1 else queries
        # As few tasks as the cores and what a task may hold allow: each of them reads the index.
        held = count / blocks * (size * 8 + k * len(modes) * 16) / INDEX_BYTES
        tasks = cores * max(1, math.ceil(held / cores)) if count / blocks > cores * QUERIES_AT_ONCE else math.ceil(count / blocks / QUERIES_AT_ONCE)
        best, shipped = _scan_in_order(asked, packed, starts, total, k, modes, query_id, query_vector, vector, same, visits, max(1, tasks), merged)
        if blocks > 1:
            best = cut_lineage(best)
            shipped.destroy()
        return best

    found = reduce(DataFrame.union, [answered(block) for block in range(blocks)])
    carried = [index_id, *(along if merged else ())]
    named = _unpacked(packed, starts, index.select(*carried).schema, 2 if same else 1)
    return found.join(named.hint("shuffle_hash"), "__row").select(
        query_id, index_id, "distance", *(c for c in found.columns if c not in (query_id, "__row", "distance")), *carried[1:])


def _packed(index: DataFrame, index_id: str, vector: str, parts: int) -> DataFrame:
    """(part, first, count, again, rows): the index in the order of ``index_id``, up to ``PACKED_ROWS`` of its rows in one.

    ``again``: an id among them is null or also stands before.
    """
    order = F.col(index_id).asc_nulls_last()
    ordered = index.repartitionByRange(parts, order).sortWithinPartitions(order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last = TaskContext.get().partitionId(), 0, pa.scalar(None)
        for batch in batches:
            for low in range(0, batch.num_rows, PACKED_ROWS):
                rows = batch.slice(low, PACKED_ROWS)
                vector_matrix(rows.column(vector))  # all of one length
                ids = rows.column(index_id)
                again = ids.null_count > 0 or ids[0] == last or len(pc.unique(ids)) < len(ids)
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_batch(rows)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part], pa.int32()), "first": pa.array([first], pa.int64()), "count": pa.array([len(ids)], pa.int64()),
                    "again": [again], "rows": pa.array([out.getvalue().to_pybytes()], pa.binary())})
                first, last = first + len(ids), ids[-1]

    return ordered.mapInArrow(pack, "part int, first long, count long, again boolean, rows binary")


def _columns_of(rows: pa.BinaryScalar, places: list[int]) -> pa.RecordBatch:
    """Columns of a packed row; the others are not unpacked."""
    return pa.ipc.open_stream(rows.as_buffer(), options=pa.ipc.IpcReadOptions(included_fields=places, use_threads=False)).read_next_batch()


def _unpacked(packed: DataFrame, starts: dict[int, int], schema: T.StructType, first_column: int) -> DataFrame:
    """(__row, ...): the columns of ``schema``, which stand behind ``first_column`` others, with the number of every row."""
    places = list(range(first_column, first_column + len(schema)))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, rows in zip(*(batch.column(c) for c in ("part", "first", "rows"))):
                held, start = _columns_of(rows, places), starts[part.as_py()] + first.as_py()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + held.num_rows)), *held.columns], ["__row", *held.schema.names])

    return packed.select("part", "first", "rows").mapInArrow(unpack, T.StructType([T.StructField("__row", T.LongType()), *schema]))


class _Numbers:
    """Stands for the ids of rows that are known by their place only."""

    def __init__(self, count: int):
        self.count = count

    def __len__(self) -> int:
        return self.count

    def take(self, places: pa.Array) -> pa.Array:
        return places


def _scan_in_order(queries: DataFrame, packed: DataFrame, starts: dict[int, int], total: int, k: int, modes: tuple[bool, ...], query_id: str,
                   query_vector: str, vector: str, same: str | None, visits: Callable[[np.ndarray], np.ndarray] | None, tasks: int,
                   merged: bool) -> tuple[DataFrame, Broadcast]:
    """The nearest rows of the packed index for one block of queries, and the block as it was sent out."""
    flag = "preferred" if merged else "grouped"
    names = [query_id, "__row", "distance", flag]
    block = queries.toArrow()
    vectors = vector_matrix(block.column(query_vector))
    if pa.types.is_float32(block.schema.field(query_vector).type.value_type):
        vectors = vectors.astype(np.float32)
    groups = known = None
    if same and not visits:
        known = pc.drop_null(pc.unique(block.column(same).combine_chunks()))
        groups = _codes(block.column(same).combine_chunks(), known, -2)
    shipped = queries.sparkSession.sparkContext.broadcast((block.column(query_id).combine_chunks(), vectors, groups, known))
    # One partition against one for every task: each of them reads the stored rows as a stream.
    turns = queries.sparkSession.range(0, tasks, 1, tasks).withColumnRenamed("id", "__turn")
    streamed = packed.select("part", "first", "rows").coalesce(1).crossJoin(turns.hint("shuffle_replicate_nl"))

    def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        """(turn, rows and their numbers) in batches of about half of ``SLAB_BYTES``, as the questions take room too."""
        waiting, turn, size = [], 0, 0
        for batch in batches:
            for part, first, rows, turn in zip(*(batch.column(c) for c in ("part", "first", "rows", "__turn"))):
                held, start = _columns_of(rows, [0, 1] if same else [0]), starts[part.as_py()] + first.as_py()
                waiting.append(held.append_column("__row", pa.array(np.arange(start, start + held.num_rows))))
                size += held.nbytes
                if size >= SLAB_BYTES // 2:
                    yield turn.as_py(), pa.concat_batches(waiting)
                    waiting, size = [], 0
        if waiting:
            yield turn.as_py(), pa.concat_batches(waiting)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for turn, slab in slabs(batches):
            if found is None:
                query_ids, vectors, groups, known = shipped.value
                mine = slice(len(query_ids) * turn // tasks, len(query_ids) * (turn + 1) // tasks)
                query_ids, vectors = query_ids[mine], vectors[mine].astype(np.float64)
                found = Block(vectors, visits(unit(vectors)) if visits else None if groups is None else groups[mine], k, modes)
            codes = None if not same else slab.column(same).to_numpy() if visits else _codes(slab.column(same), known, -1)
            found.read(Rows(vector_matrix(slab.column(vector)), codes, slab.column("__row").to_numpy()))
        if found is not None:
            yield from (found.emit_merged if merged else found.emit)(query_ids, _Numbers(total), names)

    kind = queries.schema[query_id].dataType.simpleString()
    return streamed.mapInArrow(scan, f"{query_id} {kind}, __row long, distance double, {flag} boolean"), shipped


def _nearest(found: DataFrame, k: int, query_id: str, index_id: str) -> DataFrame:
    return top_per_key(found, [query_id, "grouped"], [F.col("distance"), F.col(index_id)], k).drop("rank")


def _names(queries: DataFrame, index: DataFrame, query_id: str, index_id: str, flag: str = "grouped") -> tuple[list[str], str]:
    names = [query_id, index_id, "distance", flag]
    types = [queries.schema[query_id].dataType.simpleString(), index.schema[index_id].dataType.simpleString(), "double", "boolean"]
    return names, ", ".join(f"{n} {t}" for n, t in zip(names, types))


def _scan(queries: DataFrame, index: DataFrame, k: int, modes: tuple[bool, ...], query_id: str, query_vector: str, index_id: str,
          vector: str, same: str | None) -> tuple[DataFrame, Broadcast]:
    """Candidates of one block of queries from every partition of the index, and the block as it was sent out."""
    names, schema = _names(queries, index, query_id, index_id)
    block = queries.toArrow()
    groups = known = None
    if same:
        known = pc.drop_null(pc.unique(block.column(same).combine_chunks()))
        groups = _codes(block.column(same).combine_chunks(), known, -2)
    shipped = index.sparkSession.sparkContext.broadcast((
        block.column(query_id).combine_chunks(), vector_matrix(block.column(query_vector)), groups, known))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors, groups, known = shipped.value
        found = _Known(Block(vectors, groups, k, modes))
        for slab in _slabs(batches):
            if len(vectors):
                # A row in no query's group, or in none at all, matches no query.
                codes = None if known is None else _codes(slab.column(same), known, -1)
                found.read(slab.column(index_id), vector_matrix(slab.column(vector)), codes)
        if found.ids is not None:
            yield from found.block.emit(query_ids, found.ids, names)

    return index.mapInArrow(scan, schema), shipped


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``SLAB_BYTES``."""
    waiting, size = [], 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            size += batch.nbytes
        if size >= SLAB_BYTES:
            yield pa.concat_batches(waiting)
            waiting, size = [], 0
    if waiting:
        yield pa.concat_batches(waiting)


def _scan_queries(queries: DataFrame, index: DataFrame, k: int, modes: tuple[bool, ...], query_id: str, query_vector: str, index_id: str,
                  vector: str, same: str | None, visits: Callable[[np.ndarray], np.ndarray] | None,
                  at_once: int, merged: bool = False) -> DataFrame:
    """The nearest rows of an index of one block for all queries where they are."""
    block = index.toArrow()
    ids, places = by_id(block.column(index_id).combine_chunks())
    merged = merged and ids.null_count == 0 and len(pc.unique(ids)) == len(ids)  # an id that stands twice is merged behind the search
    names, schema = _names(queries, index, query_id, index_id, "preferred" if merged else "grouped")
    groups = known = None
    if same:
        column = block.column(same).combine_chunks()
        known = pc.drop_null(pc.unique(column))
        groups = column.to_numpy() if visits else _codes(column, known, -1)
    shipped = index.sparkSession.sparkContext.broadcast((ids, Rows(vector_matrix(block.column(vector)), groups, places), known))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, known = shipped.value
        for batch in batches:
            for low in range(0, batch.num_rows if len(ids) else 0, min(at_once, QUERIES_AT_ONCE)):
                part = batch.slice(low, min(at_once, QUERIES_AT_ONCE))
                vectors, asked = vector_matrix(part.column(query_vector)), None
                if visits:
                    asked = visits(unit(vectors))
                elif same:
                    asked = _codes(part.column(same), known, -2)
                found = Block(vectors, asked, k, modes)
                found.read(rows)
                yield from (found.emit_merged if merged else found.emit)(part.column(query_id), ids, names)

    return queries.mapInArrow(scan, schema)


def vector_topk(queries: DataFrame, index: DataFrame, k: int, **names) -> DataFrame:
    """Nearest ``k`` index rows of every query."""
    return vector_candidates(queries, index, k, (False,), **names).drop("grouped")


def vector_topk_filtered(queries: DataFrame, index: DataFrame, k: int, same: str = "category", **names) -> DataFrame:
    """Nearest ``k`` rows inside the query's category; queries without one find nothing.

    Only rows of categories that are asked for are read: of an index stored by category, only their folders.
    """
    asked = queries.where(F.size(names.get("query_vector", "query_vector")) > 0)
    return vector_candidates(queries, rows_of_keys(index, asked, same), k, (True,), same=same, **names).drop("grouped")


# --- candidates ------------------------------------------------------------------------------

def chunk_identity(document_id: Column, chunk_index: Column, content: Column) -> Column:
    identity = F.concat(F.coalesce(document_id.cast("string"), F.lit("")), F.lit(":"),
                        F.coalesce(chunk_index.cast("string"), F.lit("")))
    return F.when(identity == ":", F.sha2(content, 256)).otherwise(identity)


def merge_candidates(preferred: DataFrame, general: DataFrame, query_id: str = "query_id",
                     identity: str = "identity") -> DataFrame:
    """One row per query and chunk with its smallest distance; ``preferred`` when in that set."""
    both = preferred.withColumn("preferred", F.lit(True)).unionByName(general.withColumn("preferred", F.lit(False)))
    return collapse_candidates(both, query_id, identity)


def collapse_candidates(both: DataFrame, query_id: str = "query_id", identity: str = "identity") -> DataFrame:
    """``merge_candidates`` for rows that already carry the ``preferred`` flag."""
    rest = [c for c in both.columns if c not in (query_id, identity, "preferred")]
    if rest == ["distance"]:  # a plain minimum, which needs no sort
        return both.groupBy(query_id, identity).agg(F.min("distance").alias("distance"), F.bool_or("preferred").alias("preferred"))
    return (
        both.groupBy(query_id, identity)
        .agg(F.min_by(F.struct(*rest), F.col("distance")).alias("__row"), F.bool_or("preferred").alias("preferred"))
        .select(query_id, identity, "__row.*", "preferred"))


# --- scores ----------------------------------------------------------------------------------

def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - distance))


def _found(bigrams: Column, text: Column) -> Column:
    return F.size(F.filter(bigrams, lambda b: F.contains(text, b)))


def filename_bonus(question: Column, filename: Column, symbol: str = HAN_COMMON) -> Column:
    return filename_bonus_of(gap_closed_bigrams(question, symbol), filename)


def filename_bonus_of(bigrams: Column, filename: Column) -> Column:
    found = _found(bigrams, F.coalesce(filename, F.lit("")))
    return F.least(F.lit(FILENAME_CAP), found * F.lit(FILENAME_STEP))


def filename_pairs(filename: Column, symbol: str = HAN_COMMON) -> Column:
    """All that ``filename_bonus_of_pairs`` reads of a file name; found once for each name, however many questions meet it."""
    name = F.coalesce(filename, F.lit(""))
    # Looking whether there is a pair costs far less than listing pairs from every place of a long name.
    return F.when(name.rlike(f"{symbol}{{2}}"), run_bigrams(name, symbol)).otherwise(F.array().cast("array<string>"))


def filename_bonus_of_pairs(bigrams: Column, pairs: Column) -> Column:
    """``filename_bonus_of``, where question bigrams and ``filename_pairs`` are of the same symbols."""
    none = (F.size(pairs) == 0) & bigrams.isNotNull()
    found = F.when(none, F.lit(0)).otherwise(F.size(F.array_intersect(bigrams, pairs)))
    return F.least(F.lit(FILENAME_CAP), found * F.lit(FILENAME_STEP))


def search_text(filename: Column, content: Column, chars: int | None = None) -> Column:
    """What the lexical bonus reads, before ``nfkc_lower``; store it once with the index."""
    body = content if chars is None else F.substring(content, 1, chars)
    return F.concat(F.coalesce(filename, F.lit("")), F.lit("\n"), body)


def lexical_bonus(question: Column, searchable: Column, symbol: str = HAN, marker: str = MARKER) -> Column:
    """Exact words shared by question and chunk; both sides already ``nfkc_lower``."""
    return lexical_bonus_of(lexical_words(question, symbol), class_markers(question, marker), searchable)


def lexical_words(question: Column, symbol: str = HAN) -> Column:
    return F.array_except(run_bigrams(question, symbol), F.array(*[F.lit(w) for w in STOP_BIGRAMS]))


def class_markers(question: Column, marker: str = MARKER) -> Column:
    return F.array_distinct(F.transform(
        F.regexp_extract_all(question, F.lit(marker), F.lit(1)), lambda m: F.regexp_replace(m, r"\s+", "")))


def lexical_bonus_of(words: Column, markers: Column, searchable: Column) -> Column:
    shared = F.least(F.lit(LEXICAL_CAP), _found(words, searchable) * F.lit(LEXICAL_STEP))
    compact = F.regexp_replace(searchable, r"\s+", "")
    marked = F.when(F.size(markers) == 0, F.lit(0.0)).when(
        F.exists(markers, lambda m: F.contains(compact, m)), F.lit(MARKER_BONUS)).otherwise(F.lit(0.0))
    return F.least(F.lit(LEXICAL_TOTAL), shared + marked)


def curated_bonus(source_type: Column) -> Column:
    return F.when(source_type == "CURATED_OFFICIAL", F.lit(CURATED_BONUS)).otherwise(F.lit(0.0))


def category_bonus(preferred: Column) -> Column:
    return F.when(preferred, F.lit(CATEGORY_BONUS)).otherwise(F.lit(0.0))


def target_bonus(question: Column, filename: Column, content: Column, chars: int | None = None) -> Column:
    """Lift files about the target of a transfer question above general rules; ``chars`` may limit the content."""
    return let(target_of(question), lambda goal: target_bonus_of(goal, filename, content, chars))


def target_of(question: Column) -> Column:
    """The target that a transfer question names; empty for others."""
    return F.coalesce(F.regexp_replace(strip(F.regexp_extract(question, TARGET, 1)), r"(?:专业|学院)$", ""), F.lit(""))


def may_have_target(goal: Column, filename: Column) -> Column:
    """Whether ``target_bonus_of`` can be above zero, whatever the content is."""
    return (goal != "") & is_topic(filename)


def is_topic(filename: Column) -> Column:
    return F.contains(F.coalesce(filename, F.lit("")), F.lit(TARGET_TOPIC))


def target_bonus_of(goal: Column, filename: Column, content: Column, chars: int | None = None) -> Column:
    name = F.coalesce(filename, F.lit(""))
    text = F.concat(name, F.lit("\n"), content if chars is None else F.substring(content, 1, chars))
    general = F.lit(False)
    for words in TARGET_GENERAL:
        general = general | F.contains(name, F.lit(words))
    bigrams = F.regexp_extract_all(goal, F.lit("(?s)(?=(..))"), F.lit(1))
    return (
        F.when(~may_have_target(goal, filename), F.lit(0.0))
        .when(F.contains(text, goal), F.lit(TARGET_MOST))
        .when(F.exists(bigrams, lambda b: F.contains(name, b)), F.lit(0.30))
        .when(general, F.lit(0.08)).otherwise(F.lit(0.02)))


def result_score(raw: Column, *bonuses: Column) -> Column:
    total = raw
    for bonus in bonuses:
        total = total + bonus
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def drop_hopeless(candidates: DataFrame, top_k: int, query_id: str = "query_id") -> DataFrame:
    """Candidates that can still reach the first ``top_k``, whatever their text adds.

    ``candidates`` carries ``floor`` (what is known of its ranking value) and ``ceiling`` (floor plus the
    most its text can add). A row whose ceiling is below the k-th best floor cannot be ranked, so
    dropping it changes nothing; far fewer texts have to be fetched.
    """
    ordered = Window.partitionBy(query_id).orderBy(F.desc("floor"))
    sofar = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        candidates.withColumns({"__place": F.row_number().over(ordered), "__bar": F.nth_value("floor", top_k).over(sofar)})
        .where((F.col("__place") <= top_k) | (F.col("ceiling") >= F.col("__bar") - 1e-9)).drop("__place", "__bar", "floor", "ceiling"))


def hybrid_rerank(candidates: DataFrame, top_k: int, query_id: str = "query_id",
                  identity: str = "identity") -> DataFrame:
    """Best ``top_k`` candidates of each query as ``rank`` 1.. with the exposed ``score``.

    ``candidates`` carries distance, preferred and the bonus columns filename_bonus,
    lexical_bonus, curated_bonus, target_bonus. Being in the preferred category moves a row up but
    does not show in its score, so scores need not fall with the rank.
    """
    raw = similarity(F.col("distance"))
    # The order of the additions is part of the result: scores are compared as doubles.
    exposed = result_score(raw, F.col("filename_bonus"), F.col("curated_bonus"), F.col("target_bonus"), F.col("lexical_bonus"))
    ranking = F.round(
        raw + category_bonus(F.col("preferred")) + F.col("filename_bonus") + F.col("curated_bonus")
        + F.col("target_bonus") + F.col("lexical_bonus"), 9)
    scored = candidates.withColumns({"__ranking": ranking, "__raw": raw, "score": F.round(exposed, 9)})
    order = [F.desc("__ranking"), F.desc("__raw"), F.desc("preferred"), F.col("distance"), F.col(identity)]
    return top_per_key(scored, [query_id], order, top_k).drop("__ranking", "__raw")


def project_results(results: DataFrame) -> DataFrame:
    """Fill display defaults: names, page from 1, blanks as null."""
    return results.withColumns({
        "filename": F.coalesce("filename", F.lit(NO_FILENAME)),
        "page": F.greatest(F.lit(1), F.coalesce(F.col("page").cast("int"), F.lit(1))),
        "source": F.coalesce("source", F.lit(NO_SOURCE)),
        "source_url": F.when(F.col("source_url") != "", F.col("source_url")),
        "source_type": F.when(F.col("source_type") != "", F.col("source_type")),
        "category": F.when(F.col("category") != "", F.col("category")),
    })


# --- answers ---------------------------------------------------------------------------------

def relevance_cut(results: DataFrame, minimum: float = MIN_SCORE, k: int = TOP_K,
                  query_id: str = "query_id") -> DataFrame:
    """Rows with enough score, first ``k`` of each query in the order they came."""
    kept = results.where(F.col("score") >= minimum).withColumnRenamed("rank", "__rank")
    return top_per_key(kept, [query_id], [F.col("__rank")], k).drop("__rank")


def confidence(score: Column) -> Column:
    return (
        F.when(score >= 0.85, F.lit(95)).when(score >= 0.70, F.lit(85))
        .when(score.isNotNull(), F.least(F.lit(59), F.greatest(F.lit(0), half_up(score * 100).cast("int"))))
        .otherwise(F.lit(0)))


def answer_confidence(queries: DataFrame, results: DataFrame, query_id: str = "query_id") -> DataFrame:
    best = results.groupBy(query_id).agg(F.max("score").alias("__best"))
    return (
        queries.join(best, query_id, "left")
        .withColumn("confidence", confidence(F.col("__best"))).drop("__best"))


def citations(results: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Sources per query, each file page once, in rank order. ``results`` is already cut to top k."""
    source = F.struct(
        F.col("rank"), F.col("filename").alias("title"),
        F.coalesce(none_if_blank(F.col("source_type")), F.lit(OFFICIAL)).alias("type"),
        "page", "score", "source", F.col("source_url").alias("url"), "category")
    firsts = results.groupBy(query_id, "filename", "page").agg(F.min_by(source, F.col("rank")).alias("cited"))
    ordered = firsts.groupBy(query_id).agg(F.sort_array(F.collect_list("cited")).alias("sources"))
    return ordered.withColumn("sources", F.transform("sources", lambda s: s.dropFields("rank")))


def prompt_rows(questions: DataFrame, results: DataFrame, history: DataFrame | None = None,
                query_id: str = "query_id") -> DataFrame:
    """The user message of each question: numbered context, dialogue, question.

    ``results`` (at most top-k rows a query) has rank, filename, page, source, content;
    ``history`` (bounded) has the query id, ord, role, content.
    """
    block = F.concat(
        F.lit("[片段 "), F.col("rank").cast("string"), F.lit("]\n文件："), F.col("filename"), F.lit("\n页码："),
        F.col("page").cast("string"), F.lit("\n来源部门："), F.col("source"), F.lit("\n内容："),
        strip(F.col("content")), F.lit("\n\n"))
    context = results.groupBy(query_id).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", block.alias("text")))), lambda b: b["text"]), "").alias("__context"))
    joined = questions.join(context, query_id, "left")
    dialogue = F.lit("")
    if history is not None:
        line = F.concat("role", F.lit("："), strip(F.col("content")), F.lit("\n"))
        turns = history.groupBy(query_id).agg(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("ord", line.alias("text")))), lambda b: b["text"]), "").alias("__turns"))
        joined = joined.join(turns, query_id, "left")
        dialogue = F.coalesce("__turns", F.lit(""))
    prompt = F.concat(
        F.lit("<knowledge_context>\n"), F.coalesce("__context", F.lit("")), F.lit("</knowledge_context>\n\n"),
        F.lit("<conversation_history>\n"), dialogue, F.lit("</conversation_history>\n\n当前问题：\n"), F.col("question"))
    return joined.withColumn("prompt", prompt).drop("__context", "__turns")


def answerability(queries: DataFrame, cited: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Queries with their sources; those without get the fallback text and an empty list."""
    joined = queries.join(cited.select(query_id, "sources"), query_id, "left")
    empty = F.array().cast(cited.schema["sources"].dataType)
    return joined.withColumns({
        "answerable": F.col("sources").isNotNull(),
        "fallback": F.when(F.col("sources").isNull(), F.lit(FALLBACK)),
        "sources": F.coalesce("sources", empty),
    })
