"""Rounding as the reports define it: half up, towards positive infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int = 0) -> Column:
    scale = float(10**digits)
    return F.floor(value.cast("double") * scale + F.lit(0.5)).cast("double") / F.lit(scale)


def percentage(part: Column, whole: Column, digits: int = 1) -> Column:
    """``part`` of ``whole`` in percent, 0 when there is nothing to divide by."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(half_up(part * F.lit(100.0) / whole, digits))


def file_size_label(size: Column) -> Column:
    """KB (at least 0.1) below one MiB, MB from there on; one decimal."""
    def one_decimal(value: Column) -> Column:
        return F.format_string("%.1f", value)

    kib = F.greatest(size / F.lit(1024.0), F.lit(0.1))
    mib = size / F.lit(1048576.0)
    return F.when(size < 1048576, F.concat(one_decimal(kib), F.lit(" KB"))).otherwise(
        F.concat(one_decimal(mib), F.lit(" MB")))
