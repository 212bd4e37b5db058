"""Arrow batches of texts: bounded blocks, word spans and word hashes as whole-array work.

Texts are looked at as the UTF-8 bytes that Arrow already holds. A word is a maximal run of word bytes inside
one text; both word alphabets used here keep all bytes from 0x80 up together, so no character is ever split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lorewell.session import ship_package

BLOCK_BYTES = 1 << 20
BATCH_BYTES = 16 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_TABLE = LOWER.tobytes()

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Lower-cased bytes of words made of digits, letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: Bytes of words that are split at blanks only.
NOT_BLANK = ~SPACE

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers and keep Arrow batches of long texts small."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "67108864b", str(64 << 20)):
        spark.conf.set(key, str(BATCH_BYTES))


def powers(count: int, base: int = _BASE) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null as empty; ``offsets`` start at 0."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    buffers = column.buffers()
    if n == 0 or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int32, n + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes of text each, one text at least; none is cut."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows, start + 4096)
        yield batch.slice(start, end - start)
        start = end


def word_spans(data: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words; words of text i are ``first[i]:first[i + 1]``."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = alphabet[data]
    opened = inside.copy()
    opened[1:] &= ~inside[:-1]
    borders = offsets[1:-1]
    borders = borders[borders < len(data)]
    opened[borders] = inside[borders]
    closed = inside.copy()
    closed[:-1] &= ~inside[1:]
    before = borders[borders > 0] - 1
    closed[before] = inside[before]
    starts, ends = np.flatnonzero(opened), np.flatnonzero(closed) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_TABLES: list[np.ndarray] = []


def _position_powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base by byte position, and their inverses."""
    if not _TABLES or len(_TABLES[0]) < count:
        _TABLES[:] = [powers(max(count, BLOCK_BYTES + 4096), base) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _TABLES[0], _TABLES[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of each byte span. Long data is worked off in stretches of about one block."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + BLOCK_BYTES, "right")))
        high = int(ends[to - 1])
        up, down = _position_powers(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[:high - low], out=total[1:])
        first, last = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)
        at = to
    return mix(out)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n].copy()
    for k, power in enumerate(powers(size, 0xD6E8FEB86659FD93)[1:], 1):
        total += words[k:k + n] * power
    return mix(total + np.uint64(size))


def annotate(df: DataFrame, text: str, keep: list[str], fields: list[T.StructField],
             compute: Callable[[pa.RecordBatch], list], inputs: list[str] | None = None,
             limit: int = BLOCK_BYTES) -> DataFrame:
    """The ``keep`` columns with new ones from ``compute``, which gets blocks of rows and returns one list per field.

    ``compute`` also sees the ``inputs`` columns. New columns replace columns of the same name. No shuffle; blocks
    bound the memory of a task.
    """
    names = {f.name for f in fields}
    kept = [c for c in keep if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    arrow = to_arrow_schema(schema)
    types = [arrow.field(f.name).type for f in fields]

    def run(batches):
        for batch in batches:
            for block in blocks(batch, text, limit):
                new = [pa.array(v, t) for v, t in zip(compute(block), types, strict=True)]
                old = [block.column(c) for c in kept]
                old = [c.cast(arrow.field(n).type) for c, n in zip(old, kept, strict=True)]
                yield pa.RecordBatch.from_arrays(old + new, schema=arrow)

    columns = list(dict.fromkeys([*kept, text, *(inputs or [])]))
    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


def fold(key: str, parts: int):
    """crc32 of the id's text, modulo ``parts``; null where the id is null."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def hash_sample(rows: DataFrame, keys: list, n: int, by: str | None = None) -> DataFrame:
    """About ``4 * n`` rows (of each value of ``by`` but null) with the smallest hashes of ``keys``; all rows where there are fewer.

    A share is set from the counts first, so that no task ever gathers more than the sample of a value. The counts, one
    row per value of ``by``, are broadcast.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << 20))
    if by is None:
        return rows.where(place <= min(1.0, 4 * n / max(rows.count(), 1)) * (1 << 20))
    shares = rows.groupBy(F.col(by).alias("__by")).agg((F.least(F.lit(1.0), 4 * n / F.count("*")) * (1 << 20)).alias("__share"))
    shared = rows.join(F.broadcast(shares), F.col(by) == F.col("__by")).where(place <= F.col("__share"))
    return shared.select(*[F.col(f"`{c}`") for c in rows.columns])


def stored_by(df: DataFrame, column: str) -> DataFrame:
    """The rows as a table in the shared checkpoint folder, in one folder per value of ``column``."""
    context = df.sparkSession.sparkContext
    base = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir") or (
        df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    folder = f"{base.rstrip('/')}/tables-{uuid4()}"
    df.write.partitionBy(column).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
