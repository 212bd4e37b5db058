"""Approximate vector top-k: rows kept by the signs of random projections, queries sent to several buckets each.

Every row lies in one bucket, the bits that say on which side of each random plane its vector is. A query visits
buckets in the order of the least angle it would have to turn through to get there, its own bucket first. Queries and rows
meet by (bucket, slice); a large bucket is cut into slices and many queries of a bucket into blocks, so that no task
reads more than one slice against one block, and only the nearest of each query leave it. Where the visits would weigh more than
the rows, no query is copied for them: the rows travel in blocks, and each task looks into the buckets that its queries visit.
Distances of found rows are exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.operators.retrieve import Block, Rows, by_id, index_to_queries, unit, vector_matrix
from lorewell.scale import cut_lineage, rows_of_keys, top_per_key

BITS_RANGE = (2, 16)
ROWS_A_BUCKET = 4096
SLICE_ROWS = 8192
VISIT_BYTES = 64 * 1024 * 1024
BLOCK_QUERIES = 4096
SEED = 17
SAMPLE = 20_000


def lsh_bits(rows: int, rows_a_bucket: int = ROWS_A_BUCKET) -> int:
    """Number of planes that leaves about ``rows_a_bucket`` rows in a bucket; from 2 to 16."""
    return min(BITS_RANGE[1], max(BITS_RANGE[0], math.ceil(math.log2(max(rows, 1) / rows_a_bucket))))


def planes(length: int, bits: int, seed: int = SEED) -> np.ndarray:
    """Normals of the planes, one column each, at right angles to each other where the length allows it."""
    normals = np.random.default_rng(seed).standard_normal((length, bits))
    return np.linalg.qr(normals)[0] if bits <= length else normals


def _sides(vectors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, signed distances to the planes) of unit vectors."""
    away = vectors @ planes(vectors.shape[1], bits)
    return (away > 0) @ (1 << np.arange(bits)), away


def probe_order(vectors: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """The ``probes`` nearest buckets of every unit vector, nearest first, its own bucket in front."""
    own, away = _sides(vectors, bits)
    crossing = np.arange(1 << bits)[None, :] ^ own[:, None]
    cost = np.zeros(crossing.shape)
    for bit in range(bits):
        cost += (crossing >> bit & 1) * (away[:, bit] ** 2)[:, None]
    probes = min(probes, 1 << bits)
    first = np.argpartition(cost, probes - 1, axis=1)[:, :probes]
    order = np.argsort(np.take_along_axis(cost, first, axis=1), axis=1, kind="stable")
    return np.take_along_axis(first, order, axis=1)


def bucketed_schema(schema: T.StructType) -> T.StructType:
    """The columns of an index and ``bucket``."""
    return T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])


def with_bucket(index: DataFrame, bits: int, vector: str = "vector") -> DataFrame:
    """The index with the ``bucket`` of every row; rows without a vector, or with an empty one, have none. Narrow."""
    schema = bucketed_schema(index.schema)

    def run(batches):
        for batch in batches:
            sizes = batch.column(vector).value_lengths().fill_null(0).to_numpy()
            bucket = np.full(batch.num_rows, -1)
            rows = np.flatnonzero(sizes)
            if len(rows):
                bucket[rows] = _sides(unit(vector_matrix(batch.column(vector).take(pa.array(rows)))), bits)[0]
            new = pa.array(bucket.astype(np.int32), mask=bucket < 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, new], [*batch.schema.names, "bucket"])

    return index.mapInArrow(run, schema)


def store_lsh_index(index: DataFrame, folder: str, bits: int, vector: str = "vector") -> None:
    """Write the index with one folder per bucket; a search then only opens the buckets it visits."""
    (with_bucket(index.where(F.size(vector) > 0), bits, vector).hint("rebalance", "bucket")
     .write.mode("overwrite").partitionBy("bucket").parquet(folder))


def _probes(queries: DataFrame, query_id: str, query_vector: str, bits: int, probes: int) -> DataFrame:
    """(query_id, query_vector, bucket): a row for every bucket that a query visits."""
    schema = f"{query_id} {queries.schema[query_id].dataType.simpleString()}, {query_vector} array<double>, bucket int"

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                order = probe_order(unit(vector_matrix(part.column(query_vector))), bits, probes)
                rows = pa.array(np.repeat(np.arange(part.num_rows), order.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(query_id).take(rows), part.column(query_vector).take(rows), pa.array(order.ravel().astype(np.int32))],
                    [query_id, query_vector, "bucket"])

    asked = queries.select(query_id, F.col(query_vector).cast("array<double>").alias(query_vector)).where(F.size(query_vector) > 0)
    return asked.mapInArrow(run, schema)


def _visited(queries: DataFrame, query_vector: str, bits: int, probes: int) -> DataFrame:
    """The buckets that any query visits."""
    def run(batches):
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                seen[probe_order(unit(vector_matrix(batch.column(query_vector).slice(low, 256))), bits, probes)] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen).astype(np.int32))], ["bucket"])

    return queries.select(query_vector).mapInArrow(run, "bucket int").distinct()


def vector_topk_lsh(queries: DataFrame, index: DataFrame, k: int, bits: int, probes: int, query_id: str = "query_id",
                    query_vector: str = "query_vector", index_id: str = "chunk_key", vector: str = "vector",
                    slice_rows: int = SLICE_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, index_id, distance, rank): nearest ``k`` rows among the buckets that each query visits.

    ``index`` carries ``bucket`` (``with_bucket`` or a folder of ``store_lsh_index``, both with the same ``bits``).
    Distances and ties are those of ``vector_topk``; with ``probes`` = 2 ** bits the result is the same.
    """
    asked = queries.select(query_id, query_vector).where(F.size(query_vector) > 0)
    asking, size = asked.agg(F.count("*"), F.max(F.size(query_vector))).first()
    if asking * min(probes, 1 << bits) * (size or 0) * 8 > max(VISIT_BYTES, index.where(F.size(vector) > 0).count() * (size or 0) * 8):
        visited = rows_of_keys(index.where(F.size(vector) > 0), _visited(asked, query_vector, bits, probes), "bucket")
        found = index_to_queries(cut_lineage(asked), visited, k, (True,), query_id, query_vector, index_id, vector, "bucket",
                                visits=lambda vectors: probe_order(vectors, bits, probes))
        return top_per_key(found.drop("grouped"), [query_id], [F.col("distance"), F.col(index_id)], k)
    visits = cut_lineage(_probes(queries, query_id, query_vector, bits, probes))
    # At most 2 ** 16 rows each: how many slices and blocks a bucket has.
    blocks = visits.groupBy("bucket").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("blocks"))
    rows = index.select(index_id, vector, "bucket").join(F.broadcast(blocks), "bucket")
    slices = rows.groupBy("bucket").agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("slices"))
    number = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    rows = rows.join(F.broadcast(slices), "bucket").withColumn("slice", F.pmod(F.xxhash64(index_id), "slices").cast("int"))
    rows = rows.withColumn("block", number(F.col("blocks"))).select("bucket", "slice", "block", index_id, vector)
    asked = visits.join(F.broadcast(blocks), "bucket").join(F.broadcast(slices), "bucket")
    asked = asked.withColumn("block", F.pmod(F.xxhash64(query_id), "blocks").cast("int")).withColumn("slice", number(F.col("slices")))
    asked = asked.select("bucket", "slice", "block", query_id, query_vector)
    key = ["bucket", "slice", "block"]
    types = [queries.schema[query_id].dataType.simpleString(), index.schema[index_id].dataType.simpleString(), "double"]
    names = [query_id, index_id, "distance"]

    def meet(asking: pa.Table, found: pa.Table) -> pa.Table:
        asking, found = asking.combine_chunks(), found.combine_chunks()
        out = []
        if asking.num_rows and found.num_rows:
            block = Block(vector_matrix(asking.column(query_vector)), None, k, (False,))
            ids, places = by_id(found.column(index_id).combine_chunks())
            block.read(Rows(vector_matrix(found.column(vector)), None, places))
            out = [b.select(names) for b in block.emit(asking.column(query_id).combine_chunks(), ids, [*names, "grouped"])]
        return pa.Table.from_batches(out) if out else pa.table(
            {query_id: asking.column(query_id).slice(0, 0), index_id: found.column(index_id).slice(0, 0), "distance": pa.array([], pa.float64())})

    local = asked.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(meet, ", ".join(f"{n} {t}" for n, t in zip(names, types)))
    return top_per_key(local, [query_id], [F.col("distance"), F.col(index_id)], k)


def lsh_probes(index: DataFrame, k: int, bits: int, recall: float = 0.95, vector: str = "vector", sample: int = SAMPLE,
               queries: int = 256) -> int:
    """Number of buckets to visit so that about ``recall`` of the nearest ``k`` are found.

    Measured on at most ``sample`` rows of the index (the parameter bounds what is learned from, not what is searched):
    ``queries`` of them are asked against the sample, with k cut down to the sample's share of the index.
    """
    index = index.where(F.size(vector) > 0).select(vector)
    total = index.count()
    if not total:
        return 1
    share = min(1.0, sample / total)
    held = index.where(F.rand(SEED) < share).limit(sample).toArrow().column(vector)
    vectors = unit(vector_matrix(held))
    if not len(vectors):
        return 1 << bits
    near = max(1, min(len(vectors) - 1, round(k * len(vectors) / total)))
    asked = vectors[:queries]
    bucket = _sides(vectors, bits)[0]
    order = probe_order(asked, bits, 1 << bits)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(order), axis=0), axis=1)
    score = asked @ vectors.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    nearest = np.argpartition(-score, near - 1, axis=1)[:, :near]
    needed = np.take_along_axis(place, bucket[nearest], axis=1).ravel() + 1
    return int(np.quantile(needed, recall, method="higher"))
