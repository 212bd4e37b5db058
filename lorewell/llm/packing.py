"""Best-fit packing by a configuration linear program over the length histogram.

Texts become token ids in one pass; what is packed is only the histogram of piece lengths, which has at most
``capacity`` entries whatever the corpus holds. The program "cover every length's count with as few sequences as possible"
is solved by multiplicative weights: lengths covered ahead of schedule lose weight, and a knapsack dynamic program
prices the best filling of each length's sequence under the present weights. The fractional solution is rounded
down, what remains is solved again, and the last leftovers go to the sequence they fit best. Pieces take their places
by their rank among the pieces of equal length, counted in slices so that no length has to meet in one task.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from lorewell.llm import batches as B
from lorewell.scale import cut_lineage

CAPACITY = 2048
END = 0
ROUNDS = 8
#: How much more a character of a long piece is worth than one of a short piece when the program starts; the best is kept.
LEANINGS = (1.0, 0.1, 0.0)

#: Fixed value: how byte-level vocabularies of this family split a text into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Runs of blanks from here on need more stack than the faster library has.
LONG_BLANK = re.compile(r"\s{20000}")


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of texts, exactly those of the vocabulary file's own library.

    A byte-level vocabulary whose ids follow its merges is run by the faster of the installed libraries; any other
    file, and any text that holds one of the file's added tokens or a very long run of blanks, goes through the file's own.
    """

    def __init__(self, path: str):
        self.own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._fast(spec)

    def _fast(self, spec: dict):
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (model.get("type") == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space")
                 and split.get("use_regex", True) and not spec.get("normalizer") and not model.get("dropout")
                 and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
                 and not model.get("end_of_word_suffix"))
        if not plain:
            return None
        vocabulary = {k: v for k, v in model["vocab"].items() if k not in self.added}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        places = [vocabulary[m] for m in merged]
        if places != sorted(places) or len(merged) + 256 != len(vocabulary):
            return None
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in k): v for k, v in vocabulary.items()}
        return tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and not any(a in text for a in self.added) and not LONG_BLANK.search(text):
            try:
                return self.fast.encode_ordinary(text)
            except (KeyboardInterrupt, SystemExit, GeneratorExit):
                raise
            except BaseException:  # its failures are no Exceptions; the file's own library has no such limits
                pass
        return self.own.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, doc_id: str, text: str, capacity: int, end: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part): each document's ids with ``end`` behind, cut to the capacity."""
    numbers = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()),
                           *[T.StructField(n, T.LongType()) for n, _ in numbers[1:]]])

    def run(rows):
        for batch in rows:
            for block in B.blocks(batch, text):
                owners, values = [], []
                for i, value in enumerate(block.column(text).to_pylist()):
                    ids = np.array([*encoder(tokenizer).ids(value or ""), end], "<u4")
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        owners.append(i)
                        values.append((piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*values), numbers, strict=True)]
                ids = block.column(doc_id).take(pa.array(owners, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *[n for n, _ in numbers]])

    rows = docs.select(doc_id, text).mapInArrow(run, schema)
    return cut_lineage(rows.withColumn("part", F.spark_partition_id()))


def _fillings(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack: the most that lengths can be worth in each space, and the length to take first (0: leave it empty)."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    back = np.zeros(capacity + 1)  # best in reverse, so that each step is one addition of slices
    for space in range(1, capacity + 1):
        value = price[1:space + 1] + back[capacity - space + 1:capacity + 1]
        k = int(np.argmax(value))
        if value[k] > best[space - 1]:
            best[space], take[space] = value[k], k + 1
        else:
            best[space], take[space] = best[space - 1], -1
        back[capacity - space] = best[space]
    return best, take


def configurations(counts: np.ndarray, rounds: int, leaning: float, rate: float = 4.0) -> dict[tuple[int, ...], float]:
    """A fractional cover of the histogram: how often to use each configuration (lengths, longest first)."""
    capacity = len(counts) - 1
    sizes = np.flatnonzero(counts)
    covered, used = np.zeros(capacity + 1), {}
    for step in range(1, rounds + 1):
        ahead = covered[sizes] / counts[sizes] - (step - 1) / rounds
        price = np.full(capacity + 1, -np.inf)
        price[sizes] = sizes / capacity * (1 + leaning * sizes / capacity) * np.exp(-rate * np.clip(ahead, -2, 8))
        _, take = _fillings(price, capacity)
        for size in sizes[::-1].tolist():
            lack = counts[size] * step / rounds - covered[size]
            if lack <= 0:
                continue
            chosen, space = [size], capacity - size
            while space > 0 and take[space]:
                if take[space] < 0:
                    space -= 1
                else:
                    chosen.append(int(take[space]))
                    space -= int(take[space])
            often = Counter(chosen)
            amount = lack / often[size]
            for length, n in often.items():
                covered[length] += amount * n
            key = tuple(sorted(chosen, reverse=True))
            used[key] = used.get(key, 0.0) + amount
    return used


def pack_lengths(counts: np.ndarray, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, how many such sequences)] that place every piece of the histogram exactly once."""
    capacity = len(counts) - 1
    bound = -(-int((np.asarray(counts) * np.arange(capacity + 1)).sum()) // capacity)
    best, fewest = [], None
    for leaning in LEANINGS:
        packed = _solve(counts, rounds, leaning)
        used = sum(times for _, times in packed)
        if fewest is None or used < fewest:
            best, fewest = packed, used
        if fewest == bound:
            break
    return best


def _solve(counts: np.ndarray, rounds: int, leaning: float) -> list[tuple[tuple[int, ...], int]]:
    """One solution: solve, round down, solve the rest again, and place the last leftovers where they fit best."""
    left = np.array(counts, np.int64)
    capacity = len(left) - 1
    packed: dict[tuple[int, ...], int] = {}

    def use(key, times):
        packed[key] = packed.get(key, 0) + times

    if left[capacity]:
        use((capacity,), int(left[capacity]))
        left[capacity] = 0
    while left.any():
        before = int(left.sum())
        for key, amount in sorted(configurations(left, rounds, leaning).items(), key=lambda kv: (-sum(kv[0]), -kv[1], kv[0])):
            times = min([int(amount + 1e-9), *(int(left[s]) // n for s, n in Counter(key).items())])
            if times > 0:
                use(key, times)
                for s, n in Counter(key).items():
                    left[s] -= n * times
        if before - left.sum() < 0.1 * before:
            break
    # leftovers: longest first, each to the open sequence that it fills best
    spare: list[list] = [[] for _ in range(capacity + 1)]
    filled = np.zeros(capacity + 1, bool)
    for size in np.flatnonzero(left)[::-1].tolist():
        n = int(left[size])
        while n:
            fits = np.flatnonzero(filled[size:])
            if len(fits):
                space = size + int(fits[0])
                key, times = spare[space].pop()
                filled[space] = bool(spare[space])
                now = min(n, times)
                if times > now:
                    spare[space].append((key, times - now))
                    filled[space] = True
            else:
                space, key, now = capacity, (), -(-n // (capacity // size))
                now = min(n, now)
            spare[space - size].append(((*key, size), now))
            filled[space - size] = True
            n -= now
    for group in spare:
        for key, times in group:
            use(key, times)
    return sorted(packed.items())


def _slots(packed: list) -> tuple[np.ndarray, np.ndarray]:
    """Places by length: (sorted keys length * 2**42 + first rank, rows of (first rank, repeats, first sequence, offset))."""
    rows, ranks, sequence = [], Counter(), 0
    for key, times in packed:
        offset = 0
        for size, n in sorted(Counter(key).items(), reverse=True):
            rows.append((size << 42 | ranks[size], ranks[size], n, sequence, offset))
            ranks[size] += n * times
            offset += size * n
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return table[:, 0], table[:, 1:]


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         end: int = END, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece and its place.

    A document is the ids of its whole text and then ``end``; null and empty texts are that one id. Only documents
    of more than ``capacity`` ids are cut, into pieces of that length; the first piece may be shorter. Repeated rows and
    null ids are documents of their own. Pieces of a sequence follow each other without gaps from offset 0. An
    empty table gives no rows; other columns take no part.
    """
    spark = docs.sparkSession
    B.prepare(spark)
    pieces = token_pieces(docs, tokenizer, doc_id, text, capacity, end)
    by_slice = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_slice.groupBy("length").agg(F.sum("n")).collect():
        counts[length] = n
    shared = spark.sparkContext.broadcast(_slots(pack_lengths(counts, rounds)))

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_slice.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(inside)).join(before, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank") - 1).alias("rank"))
    schema = T.StructType([*ranked.drop("rank").schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(rows):
        keys, places = shared.value
        for batch in rows:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = places[np.searchsorted(keys, length << 42 | rank, "right") - 1]
            nth = rank - at[:, 0]
            columns = batch.columns[:5] + [pa.array(at[:, 2] + nth // at[:, 1]), pa.array(at[:, 3] + nth % at[:, 1] * length)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return ranked.mapInArrow(place, schema)
