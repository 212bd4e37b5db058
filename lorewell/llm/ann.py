"""Approximate nearest neighbours by inner product: stable projections, kd-trees, and a chi-square stopping test.

Inner product search becomes nearest-neighbour search by one more coordinate that fills every vector up to the largest
norm. A few Gaussian (2-stable) projections keep distances in distribution: the squared projected distance over the
squared true distance follows a chi-square law. Each block of vectors is indexed by a kd-tree over its
projections; a query verifies leaves in the order of their projected distance, against the true inner product, and
stops once the chance that an unseen vector still belongs among its nearest is small. Queries travel to the
vectors in blocks of bounded size; of each block of vectors only the nearest of each query travel back.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.llm import batches as B
from lorewell.scale import cut_lineage, top_per_key

PROJECTIONS = 8
NEIGHBOURS = 20
CONFIDENCE = 0.98
QUERY_ROWS = 16_384
BLOCK_ROWS = 16_384
LEAF = 64
_CHUNK = 256


def chi_square_quantile(degrees: int, p: float) -> float:
    """Where the chi-square distribution with an even number of degrees reaches ``p``."""

    def below(x):
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))

    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


class KdTree:
    """Rows in leaf order with the bounding box of every leaf; each split halves the widest side."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order, self.bounds = np.arange(len(points)), []
        todo = [(0, len(points))]
        while todo:
            low, high = todo.pop()
            rows = self.order[low:high]
            part = points[rows]
            if high - low <= leaf:
                self.bounds.append((low, high, part.min(axis=0), part.max(axis=0)))
                continue
            side = int(np.argmax(np.ptp(part, axis=0)))
            middle = (high - low) // 2
            self.order[low:high] = rows[np.argpartition(part[:, side], middle)]
            todo += [(low, low + middle), (low + middle, high)]
        self.low = np.array([b[2] for b in self.bounds])
        self.high = np.array([b[3] for b in self.bounds])

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Least projected distance of every point to every leaf."""
        gap = np.maximum(self.low[None] - points[:, None], points[:, None] - self.high[None])
        return np.sqrt((np.maximum(gap, 0) ** 2).sum(axis=2))


def search_block(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, norm: float,
                 directions: np.ndarray, quantile: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, ids, scores): the block's nearest to every query, ties to the smaller id, the query's own id left out."""
    lift = np.sqrt(np.maximum(norm ** 2 - (vectors ** 2).sum(axis=1), 0))
    tree = KdTree(np.hstack((vectors, lift[:, None])) @ directions)
    vectors, ids = vectors[tree.order], ids[tree.order]
    small = vectors.astype(np.float32)
    slack = 1e-5 * norm
    out = []
    for at in range(0, len(queries), _CHUNK):
        part, part_ids = queries[at:at + _CHUNK], query_ids[at:at + _CHUNK]
        length = (part ** 2).sum(axis=1)
        away = tree.distances(part @ directions[:-1])
        rank = np.argsort(np.argsort(away, axis=1), axis=1)
        scores = np.full((len(part), len(ids)), -np.inf, np.float32)
        active = np.arange(len(part))
        done, step = 0, max(2, 4 * k // LEAF)
        while len(active) and done < len(tree.bounds):
            reach = min(done + step, len(tree.bounds))
            for leaf, (low, high, _, _) in enumerate(tree.bounds):
                rows = active[(rank[active, leaf] >= done) & (rank[active, leaf] < reach)]
                if len(rows):
                    scores[rows, low:high] = part[rows].astype(np.float32) @ small[low:high].T
            done, step = reach, step * 2
            if len(ids) <= k + 1 or done >= len(tree.bounds):
                continue
            kth = np.partition(scores[active], -k - 1, axis=1)[:, -k - 1]  # one more: the query itself may be among them
            distance = np.sqrt(np.maximum(length[active] + norm ** 2 - 2 * kth, 0) * quantile)
            ahead = np.where(rank[active] >= done, away[active], np.inf).min(axis=1)
            active = active[~(ahead >= distance)]
        for row in range(len(part)):
            mine = scores[row]
            mine[ids == part_ids[row]] = -np.inf
            seen = np.flatnonzero(mine > -np.inf)
            if len(seen) > k:
                least = np.partition(mine[seen], -k)[-k]
                seen = seen[mine[seen] >= least - slack * max(1.0, math.sqrt(length[row]))]
            exact = np.einsum("ij,j->i", vectors[seen], part[row])
            best = np.lexsort((ids[seen], -exact))[:k]
            out.append((np.full(len(best), at + row), ids[seen][best], exact[best]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def usable(vector: str) -> Column:
    """Vectors without nulls, infinities and NaNs, and not all zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _by_length(rows) -> list[tuple[int, pa.RecordBatch | pa.Table]]:
    """The rows (id, v) of a batch or table by the length of v."""
    if not rows.num_rows:
        return []
    if isinstance(rows, pa.Table):
        rows = rows.combine_chunks().to_batches()[0]
    sizes = rows.column("v").value_lengths().to_numpy()
    if sizes.min() == sizes.max():
        return [(int(sizes[0]), rows)]
    return [(int(n), rows.filter(pa.array(sizes == n))) for n in np.unique(sizes)]


def nearest(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS,
            projections: int = PROJECTIONS, confidence: float = CONFIDENCE, query_rows: int = QUERY_ROWS,
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of every row that fulfils ``queries``, nearest first.

    The score is the inner product of the original vectors in double precision; ties go to the smaller id. Candidates
    are all rows but those with the query's own id. Vectors that are null, zero, hold null or non-finite
    components take no part, and neither do rows without an id. A query is compared with the vectors of its own length,
    whatever other lengths there are. Rows that repeat an id are candidates of their own but one query, the smallest of
    the id's longest vectors. Fewer than k candidates are all returned.
    ``projections`` is even; ``confidence`` is the chance with which each true neighbour is found. Of several query blocks
    each is answered and written to the checkpoint folder before the next one is sent out.
    """
    spark = vectors.sparkSession
    B.prepare(spark)
    base = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), queries.alias("asks")).where(
        F.col("id").isNotNull() & usable("v"))
    base = base.withColumn("v", F.col("v").cast("array<double>"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    norms = {n: math.sqrt(most) for n, most in base.groupBy(F.size("v")).agg(F.max(square)).collect()}
    schema = "query_id long, id long, score double"
    if not norms:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    quantile = chi_square_quantile(projections, confidence)
    asked = base.where("asks").groupBy("id").agg(F.min(F.struct((-F.size("v")).alias("n"), "v")).alias("first")).select("id", "first.v")
    count = asked.count()
    parts = max(1, -(-count // query_rows))

    def one(part: int) -> DataFrame:
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).toArrow().sort_by("id")
        asked_for = {n: (rows.column("id").to_numpy(), _matrix(rows.column("v"), n)) for n, rows in _by_length(block)}
        shared = spark.sparkContext.broadcast({n: (*rows, norms[n]) for n, rows in asked_for.items()})

        def run(rows):
            held: dict[int, list] = {}
            room: dict[int, int] = {}

            def found(size):
                query_ids, queries, norm = shared.value[size]
                table = pa.Table.from_batches(held.pop(size)).combine_chunks()
                del room[size]
                directions = np.random.default_rng(7).standard_normal((size + 1, projections))
                data = _matrix(table.column("v").combine_chunks(), size)
                own, ids, scores = search_block(data, table.column("id").to_numpy(), queries, query_ids, k, norm, directions, quantile)
                return pa.RecordBatch.from_arrays([pa.array(query_ids[own]), pa.array(ids), pa.array(scores)], ["query_id", "id", "score"])

            for batch in rows:
                for size, mine in _by_length(batch):
                    if size not in shared.value:  # nobody asks for vectors of this length
                        continue
                    for low in range(0, mine.num_rows, block_rows):
                        piece = mine.slice(low, block_rows)
                        while room and sum(room.values()) + piece.num_rows > block_rows:
                            yield found(max(room, key=room.get))
                        held.setdefault(size, []).append(piece)
                        room[size] = room.get(size, 0) + piece.num_rows
            for size in list(held):
                yield found(size)

        best = top_per_key(base.select("id", "v").mapInArrow(run, schema), ["query_id"], [F.desc("score"), F.asc("id")], k)
        if parts > 1:
            best = cut_lineage(best)
            shared.destroy()
        return best

    best = reduce(DataFrame.union, [one(part) for part in range(parts)])
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
