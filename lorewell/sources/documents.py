"""Text of uploaded files, one row per page."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.functions.text import clean_document_text
from lorewell.scale import cut_lineage, first_per_key, in_pieces

WORDS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_W = f"{{{WORDS}}}"
CELL_JOIN = " | "
PAGES = T.StructType().add(
    "pages", T.ArrayType(T.StructType().add("page", "integer").add("text", "string"))).add("error", "string")
Extractor = Callable[[bytes], list[tuple[int, str]]]


def _paragraph(node) -> str:
    marks = {f"{_W}t": lambda n: n.text or "", f"{_W}tab": lambda n: "\t", f"{_W}br": lambda n: "\n"}
    return "".join(marks[n.tag](n) for n in node.iter() if n.tag in marks)


def docx_pages(content: bytes) -> list[tuple[int, str]]:
    """Paragraphs, then table rows; the format has no page borders, so all of it is page 1."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    blocks = [_paragraph(p) for p in body.findall(f"{_W}p")]
    for row in (r for t in body.findall(f"{_W}tbl") for r in t.findall(f"{_W}tr")):
        blocks.append(CELL_JOIN.join(
            "\n".join(_paragraph(p) for p in cell.findall(f"{_W}p")) for cell in row.findall(f"{_W}tc")))
    return [(1, "\n".join(blocks))]


def pdf_pages(content: bytes) -> list[tuple[int, str]]:
    from pypdf import PdfReader  # optional; pass another extractor where it is missing

    return [(n, page.extract_text() or "") for n, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1)]


def read_documents(uploads: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """Usable uploads (path, filename, extension, content) without their content, with ``pages`` and ``error``.

    ``pages`` holds (page, text) of the pages with any text. Every file is read once: the result is stored.
    """
    readers = {"docx": docx_pages, "pdf": pdf_pages, **(extractors or {})}

    @F.pandas_udf(PAGES)
    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in in_pieces(batch["content"].set_axis(batch["extension"]) for batch in batches):
            rows = []
            for extension, content in files.items():
                try:
                    pages = readers[extension](content)
                    rows.append(([{"page": n, "text": t} for n, t in pages], None))
                except Exception as problem:  # a broken file must not end the job
                    rows.append(([], f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(rows, columns=["pages", "error"])

    read = uploads.withColumn("__read", extract(F.struct("extension", "content"))).withColumn("__pages", F.filter(
        F.transform("__read.pages", lambda p: F.struct(p["page"].alias("page"), clean_document_text(p["text"]).alias("text"))),
        lambda p: p["text"] != ""))
    rest = [c for c in uploads.columns if c != "content"]
    return cut_lineage(read.select(*rest, F.col("__pages").alias("pages"), F.col("__read.error").alias("error")))


def unreadable(read: DataFrame) -> DataFrame:
    """(path, error) of files that gave no text."""
    return read.where(F.size("pages") == 0).select("path", F.coalesce("error", F.lit("no_text")).alias("error"))


def unfold_pages(read: DataFrame) -> DataFrame:
    """One row per page."""
    rest = [c for c in read.columns if c not in ("pages", "error")]
    return read.select(*rest, F.explode_outer("pages").alias("__page")).where(F.col("__page").isNotNull()).select(
        *rest, "__page.page", "__page.text")


def parse_documents(uploads: DataFrame, extractors: dict[str, Extractor] | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, errors) of usable uploads (path, filename, extension, content).

    Empty pages are dropped; a file without any text is an error row.
    """
    read = read_documents(uploads, extractors)
    return unfold_pages(read), unreadable(read)
