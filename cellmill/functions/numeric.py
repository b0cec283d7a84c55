"""Numeric and array expressions.  Column to Column."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, the default where that isn't a number (MTH2, MTH4, STA26)."""
    return finite(F.try_divide(a.cast("double"), b.cast("double")), default)


def finite(c: Column, default: float = 0.0) -> Column:
    """The default for null, NaN and the infinities (MTH4)."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(default)).otherwise(c)


def clipped(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """(MTH3)"""
    if low is not None:
        c = F.greatest(c, F.lit(low))
    return c if high is None else F.least(c, F.lit(high))


def like_integer(c: Column) -> Column:
    """Whether a value is close to a whole number, as isclose has it (MTH5)."""
    return F.abs(c - F.rint(c)) <= 1e-8 + 1e-5 * F.abs(F.rint(c))


def number(c: Column) -> Column:
    """Text to double, null where it isn't one."""
    return c.try_cast("double")


def union_of(a: Column, b: Column) -> Column:
    """Distinct members of two lists in order of first sight (ARR1)."""
    return F.array_distinct(F.concat(a, b))


def best_two(scores: list[tuple[str, Column]]) -> tuple[Column, Column, Column]:
    """(label, score, margin to the next) of the highest of several columns;
    of equal ones the first (ARR2, ARR3).  Nulls are lowest."""
    low = F.lit(float("-inf"))
    rows = F.array(*(F.struct(F.coalesce(c.cast("double"), low).alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("label")) for i, (name, c) in enumerate(scores)))
    ranked = F.sort_array(rows, asc=False)
    return ranked[0]["label"], ranked[0]["score"], ranked[0]["score"] - ranked[1]["score"] if len(scores) > 1 else ranked[0]["score"]


def zero_one(c: Column, w: Window, flat: Column | None = None) -> Column:
    """Scaled to the group's range; where the range is 0, ``flat`` or 0 (WIN1)."""
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high > low, (c - low) / (high - low)).otherwise(F.lit(0.0) if flat is None else flat)


def share_of(c: Column, w: Window) -> Column:
    """The share of the group's total; equal shares where that is 0 (WIN2)."""
    total = F.sum(c).over(w)
    return F.when(total != 0, c / total).otherwise(1.0 / F.count(F.lit(1)).over(w))


def average_rank(order: Window, ties: Window) -> Column:
    """Ranks from 1, ties sharing the mean of theirs (WIN6)."""
    return F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0
