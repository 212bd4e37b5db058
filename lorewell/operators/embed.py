"""Embeddings: a deterministic hashing embedder and a plug point for others."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.functions.tokens import hash_tokens, hash_tokens_of
from lorewell.scale import in_pieces, let

VECTOR = T.ArrayType(T.FloatType())
DEFAULT_DIMENSIONS = 384
DIMENSION_RANGE = (64, 4096)
PIECE_NUMBERS, TOKENS_KEPT = 1 << 18, 200_000


class _Places(dict):
    """The place of every token: its component, and ``dimensions`` behind that where it counts down."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions

    def __missing__(self, token: str) -> int:
        number = int.from_bytes(hashlib.blake2b(token.encode("utf-8"), digest_size=8).digest(), "big")
        self[token] = place = number % self.dimensions + (0 if number % 2 else self.dimensions)
        return place


def _hashed(texts: list[str | None], places: _Places) -> np.ndarray:
    """Unit vectors of the texts; no tokens give zeros."""
    place_of = places.__getitem__
    found = [list(map(place_of, hash_tokens_of(text))) if text else [] for text in texts]
    flat = np.fromiter(chain.from_iterable(found), np.int64)
    row = np.repeat(np.arange(len(texts)) * (2 * places.dimensions), [len(f) for f in found])
    up, down = np.bincount(flat + row, minlength=len(texts) * 2 * places.dimensions).reshape(len(texts), 2, -1).transpose(1, 0, 2)
    vectors = (up - down).astype(np.float64)
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, norms, out=vectors, where=norms > 0).astype(np.float32)


def hash_embedding(dimensions: int = DEFAULT_DIMENSIONS) -> Callable[[Column], Column]:
    """Column function text -> unit vector by signed feature hashing; no tokens give zeros.

    The tokens are those of ``hash_tokens``. A text reaches Python whole and leaves it as its vector, both in Arrow batches.
    """
    if not DIMENSION_RANGE[0] <= dimensions <= DIMENSION_RANGE[1]:
        raise ValueError(f"dimensions must be in {DIMENSION_RANGE}")
    piece = max(1, PIECE_NUMBERS // (2 * dimensions))

    @F.arrow_udf(VECTOR)
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places = _Places(dimensions)
        for batch in batches:
            # A piece at a time: the vectors of a batch may be far larger than what was read.
            for low in range(0, max(1, len(batch)), piece):
                texts = batch.slice(low, piece).to_pylist()
                vectors = _hashed(texts, places)
                yield pa.ListArray.from_arrays(
                    pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dimensions), pa.array(vectors.ravel()))
                if len(places) > TOKENS_KEPT:
                    places.clear()

    return embed


def native_hash_embedding(dimensions: int = DEFAULT_DIMENSIONS) -> Callable[[Column], Column]:
    """As ``hash_embedding`` without Python: signed feature hashing by XXH64 in column expressions.

    Token t counts for component xxhash64(t) mod ``dimensions``, up if the hash is odd and down if it is even. The vectors
    differ from those of ``hash_embedding``, so an index and its questions need the same one. Equal hashes are first
    summed up in sorted order; a component then looks only at the hashes of its own place.
    """
    if not DIMENSION_RANGE[0] <= dimensions <= DIMENSION_RANGE[1]:
        raise ValueError(f"dimensions must be in {DIMENSION_RANGE}")

    def embed(text: Column) -> Column:
        marks = F.transform(F.coalesce(hash_tokens(text), F.array().cast("array<string>")), lambda t: let(F.xxhash64(t), lambda h: F.struct(
            F.pmod(h, F.lit(dimensions)).cast("int").alias("place"), F.when(h % 2 == 0, -1.0).otherwise(1.0).alias("sign"))))

        def vector(found: Column) -> Column:
            places = F.transform(found, lambda m: m["place"])
            sums = F.transform(F.array_sort(F.array_distinct(places)), lambda p: F.struct(p.alias("place"), F.aggregate(
                found, F.lit(0.0), lambda total, m: total + F.when(m["place"] == p, m["sign"]).otherwise(0.0)).alias("sum")))
            return let(sums, lambda held: let(
                F.sqrt(F.aggregate(held, F.lit(0.0), lambda total, s: total + s["sum"] * s["sum"])),
                lambda norm: let(F.map_from_entries(held), lambda by_place: F.transform(
                    F.sequence(F.lit(0), F.lit(dimensions - 1)),
                    lambda i: F.coalesce(F.try_element_at(by_place, i) / F.nullif(norm, F.lit(0.0)), F.lit(0.0)).cast("float")))))

        return let(marks, vector)

    return embed


def external_embedding(model: Callable[[list[str]], list[list[float]]]) -> Callable[[Column], Column]:
    """Wrap any batch model; it is created and called inside the tasks."""
    @F.pandas_udf(VECTOR)
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in in_pieces(batches):
            yield pd.Series(list(model(batch.tolist())))

    return embed
