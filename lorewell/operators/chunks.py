"""Cutting documents into overlapping chunks."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.functions.text import clean_document_text, strip
from lorewell.scale import cut_lineage, in_pieces, running_total

# Separators from coarse to fine, size limits, header lines of a chunked page.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", "，", ".", "!", "?", ";", ",", " ", "")
CHUNK_SIZE, CHUNK_OVERLAP = 800, 100
SIZE_RANGE, OVERLAP_RANGE = (500, 1000), (0, 250)
HEADER = ("文件名：%s\n来源：%s\n分类：%s\n页码：%d\n正文：\n%s", "未分类")

CHUNKS = T.ArrayType(T.StructType().add("text", "string").add("start", "integer"))
TOKEN_CHUNKS = T.ArrayType(
    T.StructType().add("text", "string").add("start", "integer").add("tokens", "integer").add("shared", "integer"))


def enrich_text(filename: Column, source: Column, category: Column, page: Column, text: Column) -> Column:
    """The page text under a header that names its file, source, category and page."""
    template, no_category = HEADER
    return F.format_string(template, filename, source, F.coalesce(category, F.lit(no_category)), page.cast("int"), text)


#: Weight of the span from one code-point offset to another.
Weigh = Callable[[int, int], int]


def _atoms(text: str, begin: int, end: int, limit: int, weigh: Weigh, level: int = 0) -> Iterator[tuple[int, int]]:
    """Spans of at most ``limit``, cut at the coarsest separator that is fine enough."""
    if weigh(begin, end) <= limit or end - begin == 1:
        yield begin, end
        return
    while SEPARATORS[level] and text.find(SEPARATORS[level], begin, end) < 0:
        level += 1
    mark = SEPARATORS[level]
    if not mark:
        # Down to characters: only pieces that small can make the overlap.
        yield from ((i, i + 1) for i in range(begin, end))
        return
    finer = min(level + 1, len(SEPARATORS) - 1)
    while begin < end:
        # A separator opens the piece that follows it.
        cut = text.find(mark, begin + (len(mark) if text.startswith(mark, begin, end) else 0), end)
        cut = end if cut < 0 else cut
        yield from _atoms(text, begin, cut, limit, weigh, finer)
        begin = cut


def split_spans(text: str, size: int, overlap: int, weigh: Weigh) -> list[dict]:
    """Greedy packing of the atoms; a chunk starts with up to ``overlap`` of the one before."""
    chunks, spans, used = [], deque(), 0

    def close() -> None:
        raw = text[spans[0][0]:spans[-1][1]]
        body = raw.strip()
        if body:
            chunks.append({"text": body, "start": spans[0][0] + raw.index(body)})

    for start, end, weight in ((a, b, weigh(a, b)) for a, b in (_atoms(text, 0, len(text), size, weigh) if text else ())):
        if spans and used + weight > size:
            close()
            while spans and (used > overlap or used + weight > size):
                used -= spans.popleft()[2]
        spans.append((start, end, weight))
        used += weight
    if spans:
        close()
    return chunks


def split_text(text: str, size: int, overlap: int, size_of: Callable[[str], int]) -> list[dict]:
    """``split_spans`` by the size of texts, such as ``len``."""
    if size_of is len:
        return split_spans(text, size, overlap, lambda a, b: b - a)
    return split_spans(text, size, overlap, lambda a, b: size_of(text[a:b]))


def _limits(size: int, overlap: int) -> None:
    if not SIZE_RANGE[0] <= size <= SIZE_RANGE[1] or not OVERLAP_RANGE[0] <= overlap <= OVERLAP_RANGE[1]:
        raise ValueError(f"size must be in {SIZE_RANGE}, overlap in {OVERLAP_RANGE}")


def chunk_text(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
               size_of: Callable[[str], int] = len) -> Callable[[Column], Column]:
    """Column function text -> chunks. ``size_of`` measures text, code points by default."""
    _limits(size, overlap)

    @F.pandas_udf(CHUNKS)
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in in_pieces(batches):
            yield batch.map(lambda t: [] if t is None else split_text(t, size, overlap, size_of))

    return split


@lru_cache(maxsize=4)
def token_ends_of(tokenizer: str) -> Callable[[str], np.ndarray]:
    """A function from a text to the code-point offset behind each of its tokens, in order.

    ``tokenizer``: path of a vocabulary file that the ``tokenizers`` library reads.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer)

    def ends(text: str) -> np.ndarray:
        offsets = own.encode(text, add_special_tokens=False).offsets
        return np.maximum.accumulate(np.fromiter((b for _, b in offsets), np.int64, len(offsets)))

    return ends


def split_tokens(text: str, size: int, overlap: int, ends: np.ndarray) -> list[dict]:
    """``split_spans`` in tokens: a span weighs the tokens that end inside it.

    The text is tokenized once. A letter of several tokens weighs all of them, a letter within a token none, so the
    weights of neighbouring spans add up to that of both together.
    """
    before = np.zeros(len(text) + 1, np.int64)
    np.add.at(before, ends, 1)
    before = before.cumsum()
    chunks = split_spans(text, size, overlap, lambda a, b: int(before[b] - before[a]))
    last = 0
    for chunk in chunks:
        start, end = chunk["start"], chunk["start"] + len(chunk["text"])
        chunk["tokens"] = int(before[end] - before[start])
        chunk["shared"] = int(max(0, before[last] - before[start]))
        last = end
    return chunks


def chunk_tokens(tokenizer: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Callable[[Column], Column]:
    """Column function text -> chunks of at most ``size`` tokens, with their number of tokens.

    ``shared`` is how many of them the chunk before has too, at most ``overlap``. ``tokenizer`` is a path that all
    machines can read. Null and empty texts have no chunk; texts of any length are split whole.
    """
    _limits(size, overlap)

    @F.pandas_udf(TOKEN_CHUNKS)
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ends = token_ends_of(tokenizer)
        for batch in in_pieces(batches):
            yield batch.map(lambda t: split_tokens(t, size, overlap, ends(t)) if t else [])

    return split


def number_chunks(pages: DataFrame, slice_pages: int = 4096) -> DataFrame:
    """One row per chunk of ``pages`` (document_id, page, chunks, ...) with its index in the document.

    Pages are numbered by a running total of chunk counts, taken in slices of pages, so one
    very long document is still spread over many tasks. Chunking is paid once: the pages are
    checkpointed before the totals read them again.
    """
    offset = running_total(
        cut_lineage(pages), ["document_id"], [F.col("page")], F.floor(F.col("page") / slice_pages),
        F.size("chunks"), "__offset")
    return _unfold(offset).drop("__offset")


def number_single_pages(pages: DataFrame) -> DataFrame:
    """As ``number_chunks`` for documents of exactly one page: the position is the index, no shuffle."""
    return _unfold(pages.withColumn("__offset", F.lit(0))).drop("__offset")


def _unfold(pages: DataFrame) -> DataFrame:
    rest = [c for c in pages.columns if c != "chunks"]
    return (
        # The outer explode keeps Spark from testing the array, and so cutting the text, a second time.
        pages.select(*rest, F.posexplode_outer("chunks").alias("pos", "chunk")).where(F.col("chunk").isNotNull())
        .withColumn("chunk_index", (F.col("__offset") + F.col("pos")).cast("int"))
        .select(*rest, "chunk_index", F.col("chunk")["text"].alias("content"), F.col("chunk")["start"].alias("start")))


def clean_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """Cleaned page texts; pages without text disappear."""
    return pages.withColumn(text, clean_document_text(F.col(text))).where(strip(F.col(text)) != "")
