"""Dates found in pages, headers and addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date shapes in text and in page addresses.
TEXT_DATE = r"(20\d{2})[-./年](\d{1,2})[-./月](\d{1,2})"
URL_DATE = r"/(20\d{2})/(\d{2})(\d{2})/"


def _first_date(value: Column, pattern: str) -> Column:
    year, month, day = (F.regexp_extract(value, pattern, group).try_cast("int") for group in (1, 2, 3))
    return F.try_make_timestamp_ntz(year, month, day, F.lit(0), F.lit(0), F.lit(0))


def published_time(metas: Sequence[Column], content: Column, url: Column,
                   content_chars: int | None = None) -> Column:
    """Publication time from meta tags, else the text, else the address.

    The whole text is looked at unless ``content_chars`` limits it to its head.
    """
    head = content if content_chars is None else F.substring(content, 1, content_chars)
    from_url = F.when(url.rlike(URL_DATE), _first_date(url, URL_DATE)).otherwise(_first_date(url, TEXT_DATE))
    return F.coalesce(*[_first_date(meta, TEXT_DATE) for meta in metas], _first_date(head, TEXT_DATE), from_url)


def http_date(value: Column) -> Column:
    """An HTTP header date as UTC timestamp without zone; null when malformed."""
    text = F.regexp_replace(F.substring_index(value, ", ", -1), r" GMT\z", "")
    return F.try_to_timestamp(text, F.lit("dd MMM yyyy HH:mm:ss")).cast("timestamp_ntz")


def last_updated(published: Column, last_modified: Column, now: Column) -> Column:
    return F.coalesce(published, http_date(last_modified), now)


def years_before(now: Column, years: int) -> Column:
    """Same clock time ``years`` earlier; 29 February becomes the 28th."""
    return now - F.make_ym_interval(F.lit(years), F.lit(0))


def local_time(moment: Column, zone: str = "Asia/Shanghai") -> Column:
    """Wall-clock time in ``zone`` of a UTC timestamp without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), moment)
