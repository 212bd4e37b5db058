"""Token and bigram lists."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Han ranges used for indexing and for file-name matching.
HAN = r"[\x{3400}-\x{9fff}]"
HAN_COMMON = r"[\x{4e00}-\x{9fff}]"
_LATIN_WORD, _HAN_SIGN = re.compile("[a-z0-9]+"), re.compile("[\u3400-\u9fff]")


def _every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _pairs(text: Column, symbol: str) -> Column:
    """Overlapping pairs of neighbouring symbols; the lookahead finds them in one pass."""
    return _every(text, f"(?=({symbol}{{2}}))", 1)


def _only(text: Column, symbol: str) -> Column:
    return F.regexp_replace(text, symbol.replace("[", "[^", 1) + "+", "")


def hash_tokens(text: Column) -> Column:
    """Latin words, Han characters, then Han bigrams that run across gaps."""
    lower = F.lower(text)
    return F.concat(_every(lower, "[a-z0-9]+"), _every(lower, HAN), _pairs(_only(lower, HAN), HAN))


def hash_tokens_of(text: str) -> list[str]:
    """``hash_tokens`` of one text, for Python stages."""
    lower = text.lower()
    words = _LATIN_WORD.findall(lower)
    if lower.isascii():
        return words
    signs = _HAN_SIGN.findall(lower)
    return words + signs + [a + b for a, b in zip(signs, signs[1:])]


def gap_closed_bigrams(text: Column, symbol: str = HAN_COMMON) -> Column:
    """Distinct bigrams of the matching characters with everything between them removed."""
    return F.array_distinct(_pairs(_only(text, symbol), symbol))


def run_bigrams(text: Column, symbol: str = HAN) -> Column:
    """Distinct bigrams inside each unbroken run of matching characters."""
    return F.array_distinct(_pairs(text, symbol))
