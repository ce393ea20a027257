"""Rounding, megabytes and percentages that agree with other engines to the last digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MB = 1024.0 * 1024.0


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero on the scaled double, so decimal half-way values round like the double they are."""
    return F.round(x.cast("double") * F.lit(10.0**digits)) / F.lit(10.0**digits)


def mb(size: Column, digits: int = 2) -> Column:
    return rounded(size / F.lit(MB), digits)


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """Null where the whole is 0 or null."""
    return rounded(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), digits)


def named(c: str, default: str) -> Column:
    return F.coalesce(F.col(c), F.lit(default))


def human(size: Column) -> Column:
    """Bytes as text in the largest unit of 1024 that they fill."""
    out = F.concat(F.format_number(size, 0), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(F.abs(size) >= 1024**k, F.concat(F.format_number(size / float(1024**k), 2), F.lit(f" {unit}"))).otherwise(out)
    return out
