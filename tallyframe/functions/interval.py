"""Interval arithmetic as Column functions; an interval is ``struct<lo double, hi double>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def interval(lo: Column, hi: Column) -> Column:
    """[lo, hi], ends swapped if they are the wrong way round; null if either is."""
    return F.when(lo.isNotNull() & hi.isNotNull(), F.struct(F.least(lo, hi).alias("lo"), F.greatest(lo, hi).alias("hi")))


def exact(value: Column) -> Column:
    """[value, value]."""
    return interval(value, value)


def widen(x: Column, by: Column) -> Column:
    """Both ends moved out."""
    return interval(x["lo"] - by, x["hi"] + by)


def midpoint(x: Column) -> Column:
    """Middle of the interval."""
    return (x["lo"] + x["hi"]) / 2


def width(x: Column) -> Column:
    """Length of the interval."""
    return x["hi"] - x["lo"]


def add(x: Column, y: Column) -> Column:
    """Sum of intervals."""
    return interval(x["lo"] + y["lo"], x["hi"] + y["hi"])


def sub(x: Column, y: Column) -> Column:
    """Difference of intervals."""
    return interval(x["lo"] - y["hi"], x["hi"] - y["lo"])


def scale(x: Column, k: Column) -> Column:
    """The interval times a number."""
    return interval(x["lo"] * k, x["hi"] * k)


def _corners(values: list[Column]) -> Column:
    return interval(F.array_min(F.array(*values)), F.array_max(F.array(*values)))


def mul(x: Column, y: Column) -> Column:
    """Product: the extremes of the four corner products."""
    return F.when(x.isNotNull() & y.isNotNull(), _corners([x[a] * y[b] for a in ("lo", "hi") for b in ("lo", "hi")]))


def div(x: Column, y: Column) -> Column:
    """Quotient; null where the denominator spans zero."""
    safe = ~((y["lo"] <= 0) & (y["hi"] >= 0))
    return F.when(x.isNotNull() & safe, _corners([F.try_divide(x[a], y[b]) for a in ("lo", "hi") for b in ("lo", "hi")]))


def contains(x: Column, value: Column) -> Column:
    """Closed containment."""
    return (x["lo"] <= value) & (value <= x["hi"])


def overlaps(x: Column, y: Column) -> Column:
    """Closed overlap."""
    return (x["lo"] <= y["hi"]) & (y["lo"] <= x["hi"])
