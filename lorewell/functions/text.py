"""String cleaning on Catalyst expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.scale import let

# What counts as a blank, as a line end, and the menu words dropped from pages.
BLANKS = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BLANK_CHARS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000)))
CONTROL_CHARS = "".join(map(chr, range(0x21)))
IN_LINE_BLANKS = r" \t\x{1f}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
LINE_ENDS = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
MENU_WORDS = ("首页", "更多", "返回", "关闭")
CONVERSION_SUFFIX = (
    r"(?i)\s*(?:的副本\s*)?(?:\(\s*)?(?:原\s*)?"
    r"(?:docx?|xlsx?|xls|pdf)\s*(?:文件)?\s*(?:转换|转化)(?:\s*\))?\s*\z"
)


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(BLANK_CHARS))


def trim_controls(value: Column) -> Column:
    """Drop blanks and control characters up to U+0020 at both ends."""
    return F.btrim(value, F.lit(CONTROL_CHARS))


def is_blank(value: Column) -> Column:
    return value.isNull() | ~value.rlike(rf"[^{BLANKS}]")


def none_if_blank(value: Column) -> Column:
    return F.when(~is_blank(value), value)


def fold_blanks(value: Column) -> Column:
    return strip(F.regexp_replace(value, rf"[{BLANKS}]+", " "))


def clean_lines(value: Column, menu_words: tuple[str, ...] = MENU_WORDS) -> Column:
    """Fold blanks per line, drop empty and menu lines, then repeats of the line kept before."""
    folded = F.regexp_replace(value, rf"[{IN_LINE_BLANKS}]+", " ")
    lines = F.filter(
        F.transform(F.split(folded, LINE_ENDS), strip),
        lambda line: (line != "") & ~line.isin(*menu_words),
    )
    kept = let(lines, lambda kept: F.filter(
        kept, lambda line, i: (i == 0) | (line != F.get(kept, i - 1))))
    return F.array_join(kept, "\n")


def clean_document_text(value: Column) -> Column:
    steps = (("\x00", " "), ("\r\n", "\n"), (r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"))
    for pattern, replacement in steps:
        value = F.regexp_replace(value, pattern, replacement)
    return strip(value)


def first_lines(value: Column, lines: int = 6, chars: int = 480) -> Column:
    """The heading of a first page: its first non-blank lines, joined and cut."""
    kept = F.filter(F.transform(F.split(value, LINE_ENDS), strip), lambda line: line != "")
    return F.substring(F.array_join(F.slice(kept, 1, lines), "\n"), 1, chars)


def drop_extension(filename: Column) -> Column:
    """Cut at the last dot unless that dot is the first character."""
    return F.regexp_replace(filename, r"(?s)(?<=.)\.[^.]*\z", "")


def display_title(title: Column, filename: Column) -> Column:
    return F.coalesce(trim_controls(none_if_blank(title)), drop_extension(filename))


def source_or_default(source: Column, default: str = "未知来源") -> Column:
    return F.coalesce(trim_controls(none_if_blank(source)), F.lit(default))


@F.pandas_udf(T.StringType())
def nfkc_lower(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility-normalized lower case; Spark has no built-in for it."""
    for batch in batches:
        yield batch.map(lambda text: None if text is None else unicodedata.normalize("NFKC", text).lower())


def filename_stem(filename: Column) -> Column:
    """Normalized file name without extension and without file-conversion noise."""
    base = F.regexp_extract(filename, r"(?s)([^/]*)/*\z", 1)
    # A trailing dot or a leading one does not start an extension.
    stem = F.regexp_replace(base, r"(?s)(?<=[^.])\.[^.]+\z", "")
    return strip(F.regexp_replace(nfkc_lower(stem), CONVERSION_SUFFIX, ""))
