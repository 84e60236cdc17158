"""Arithmetic with defined results at the edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def r6(x: Column) -> Column:
    return F.round(x, 6)


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r, 0 where it is undefined."""
    return F.coalesce(F.nanvl(F.corr(x, y), F.lit(0.0)), F.lit(0.0))


def percent_change(old: Column, new: Column, lower_is_better: bool = False) -> Column:
    change = F.when(old != 0, (new - old) / old * 100).otherwise(F.lit(0.0))
    return -change if lower_is_better else change


def upper_median(x: Column) -> Column:
    """The value at index n // 2 of the sorted values, as an aggregate."""
    s = F.sort_array(F.collect_list(x))
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def wald_interval(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Percent bounds of a share, clamped to [0, 100]."""
    p = ratio(successes, n)
    half = z * F.sqrt(ratio(p * (1 - p), n))
    return clamp(p - half) * 100, clamp(p + half) * 100
