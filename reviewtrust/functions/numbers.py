"""Rounding and number text. Ties go to the even digit, as the published numbers do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: float, high: float) -> Column:
    """Bound a value, keeping null as null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def whole(value: Column) -> Column:
    return half_even(value).cast("bigint")


def fixed(value: Column, digits: int, signed: bool = False) -> Column:
    """Text with a fixed number of decimals."""
    return F.format_string(f"%{'+' if signed else ''}.{digits}f", half_even(value, digits))


def percent(share: Column) -> Column:
    return F.concat(whole(share * 100).cast("string"), F.lit("%"))


def text(value: Column) -> Column:
    return value.cast("string")


def join_text(*parts) -> Column:
    """Concatenate literals and columns into one sentence."""
    return F.concat(
        *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    )
