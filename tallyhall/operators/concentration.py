"""Concentration of an additive measure over actors.

Every function takes counts that are already aggregated per actor. Ranks come
from a count of counts, not from one global sort of all actors: actors that
share a value are interchangeable, and a run of ``m`` equal values at ranks
``i+1 .. i+m`` contributes ``x * (m * i + m * (m + 1) / 2)`` to the rank-weighted
sum. The table of distinct values is far smaller than the table of actors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOPS = (5, 10, 20)


def level(gini: Column, hhi: Column, top5: Column) -> Column:
    def any_over(g: float, h: float, t: float) -> Column:
        return (gini >= g) | (hhi >= h) | (top5 >= t)

    # Thresholds of the levels.
    return (
        F.when(any_over(0.8, 0.25, 0.7), "very_high")
        .when(any_over(0.6, 0.15, 0.5), "high")
        .when(any_over(0.4, 0.10, 0.35), "moderate")
        .otherwise("low")
    )


def rank_sums(counts: DataFrame, by: list[str], value: str = "x") -> DataFrame:
    """Per group: contributors, total, rank-weighted sum, squares and top-N sums of positive values."""
    x = F.col(value)
    runs = counts.filter(x > 0).groupBy(*by, x.alias("_x")).agg(F.count("*").alias("_m"))
    up = Window.partitionBy(*by).orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*by).orderBy(F.desc("_x")).rowsBetween(Window.unboundedPreceding, -1)
    v, m = F.col("_x"), F.col("_m")
    below, above = F.coalesce(F.sum("_m").over(up), F.lit(0)), F.coalesce(F.sum("_m").over(down), F.lit(0))
    ranked = runs.withColumns({"_below": below, "_above": above})
    top = [F.sum(v * F.least(m, F.greatest(F.lit(0), F.lit(n) - F.col("_above")))).alias(f"_top{n}") for n in TOPS]
    return ranked.groupBy(*by).agg(
        F.sum("_m").alias("contributors"),
        F.sum(v * m).cast("double").alias("total"),
        F.sum(v.cast("double") * (m * F.col("_below") + m * (m + 1) / 2)).alias("_weighted"),
        F.sum(v.cast("double") * v * m).alias("_squares"),
        *top,
    )


def concentration(counts: DataFrame, by: list[str] | None = None, value: str = "x", digits: int = 6) -> DataFrame:
    """Gini, HHI, top-5/10/20 shares and level, overall or per group of ``by``."""
    by = by or []
    n, s = F.coalesce("contributors", F.lit(0)), F.coalesce("total", F.lit(0.0))
    some = s > 0  # no positive value: every measure is 0
    gini = F.when(some, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (2 * F.col("_weighted") - (n + 1) * s) / (n * s)))).otherwise(0.0)
    hhi = F.when(some, F.col("_squares") / (s * s)).otherwise(0.0)
    shares = {t: F.when(some, F.col(f"_top{t}") / s).otherwise(0.0) for t in TOPS}
    return rank_sums(counts, by, value).select(
        *by,
        n.cast("long").alias("contributors"),
        s.alias("total"),
        F.round(gini, digits).alias("gini"),
        F.round(hhi, digits).alias("hhi"),
        *[F.round(c, digits).alias(f"top{t}_share") for t, c in shares.items()],
        level(gini, hhi, shares[5]).alias("level"),
    )


def gini_forms(counts: DataFrame, by: list[str] | None = None, value: str = "x") -> DataFrame:
    """Other published forms of the coefficient, none of them clamped, and top-1/3/5/10 shares.

    ``gini_zeros`` keeps actors without any share, ``gini_positive`` drops them;
    ``gini_descending`` weights the largest first (1 - 2 * sum(i * x) / (n * S));
    ``gini_flipped`` feeds descending values to the ascending formula.
    """
    by = by or []
    runs = counts.groupBy(*by, F.col(value).alias("_x")).agg(F.count("*").alias("_m"))
    up = Window.partitionBy(*by).orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*by).orderBy(F.desc("_x")).rowsBetween(Window.unboundedPreceding, -1)
    r = runs.withColumns({"_b": F.coalesce(F.sum("_m").over(up), F.lit(0)), "_a": F.coalesce(F.sum("_m").over(down), F.lit(0)), "_z": F.col("_x") <= 0})
    v, m = F.col("_x").cast("double"), F.col("_m")
    tops = [F.sum(v * F.least(m, F.greatest(F.lit(0), F.lit(k) - F.col("_a")))).alias(f"_t{k}") for k in (1, 3, 5, 10)]
    s = r.groupBy(*by).agg(F.sum("_m").alias("n"), F.sum(F.when(F.col("_z"), m).otherwise(0)).alias("_none"), F.sum(v * m).alias("s"), F.sum(v * (m * F.col("_b") + m * (m + 1) / 2)).alias("_up"), F.sum(v * (m * F.col("_a") + m * (m + 1) / 2)).alias("_down"), *tops)
    n, total = F.col("n"), F.col("s")
    kept = n - F.col("_none")
    # Without the zeros every rank is less by their number.
    positive = (2 * (F.col("_up") - F.col("_none") * total) - (kept + 1) * total) / (kept * total)
    return s.select(
        *by, n.alias("actors"), F.round((2 * F.col("_up")) / (n * total) - (n + 1) / n, 6).alias("gini_zeros"), F.round(positive, 6).alias("gini_positive"),
        F.round(1 - 2 * F.col("_down") / (n * total), 6).alias("gini_descending"), F.round((2 * F.col("_down")) / (n * total) - (n + 1) / n, 6).alias("gini_flipped"),
        *[F.round(F.col(f"_t{k}") / total, 6).alias(f"top{k}_share") for k in (1, 3, 5, 10)],
    )
