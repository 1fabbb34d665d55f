"""Column expressions with one policy for undefined results: NULL, never NaN and never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(value: Column, fill: float | None = None) -> Column:
    """NULL for NaN, infinite and fill values."""
    value = value.cast("double")
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    if fill is not None:
        bad = bad | (value == F.lit(float(fill)))
    return F.when(~bad, value)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def pearson(x: Column, y: Column) -> Column:
    """Correlation of rows where both are present; NULL where a side does not vary.

    Built from covar_pop and stddev_pop, because corr raises on a constant side in ANSI mode.
    """
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def lat_weight(lat: Column, root: bool = True) -> Column:
    w = F.abs(F.cos(F.radians(lat)))
    return F.sqrt(w) if root else w


def draw(seed: int, *parts: Column) -> Column:
    """A counter-based random integer in 0 .. 2^32 - 1: the same in every plan and on every engine with md5."""
    key = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def uniform(seed: int, *parts: Column) -> Column:
    return draw(seed, *parts) / F.lit(4294967296.0)
