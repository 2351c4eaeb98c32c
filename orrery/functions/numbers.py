"""Numeric expressions with the null and rounding rules of the panels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero; a negative divisor divides."""
    return a / F.nullif(b, F.lit(0))


def clipped(v: Column, low: Column, high: Column) -> Column:
    """v within bounds; null stays null."""
    return F.when(v.isNotNull(), F.greatest(low, F.least(high, v)))


def even_round(v: Column, digits: int) -> Column:
    """Round half to even."""
    return F.bround(v, digits)


def on_grid(v: Column, steps: int = 10, tolerance: float = 1e-6) -> Column:
    """Whether v is a multiple of 1 / steps."""
    return F.abs(v * steps - F.bround(v * steps, 0)) <= tolerance


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """a divided by its length; a zero vector stays."""
    n = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("")


def spearman_brown(r: Column, k: int) -> Column:
    """Reliability of the mean of k raters."""
    return k * r / (1 + (k - 1) * r)
