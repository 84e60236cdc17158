"""Tests and intervals: sums run in Spark, distributions are closed forms on a few numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhall.functions.numbers import ratio


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def chi_square(cells: DataFrame, yates: bool = True) -> DataFrame:
    """chi2, dof, n and Cramer's V of a table of cells (a, b, n); absent cells count as 0.

    chi2 = N * (sum of n^2 / (row * column) - 1) needs no absent cell. In a 2 x 2
    table all four deviations are equal, so one cell gives the correction.
    """
    a, b = cells.groupBy("a").agg(F.sum("n").alias("ra")), cells.groupBy("b").agg(F.sum("n").alias("rb"))
    t = cells.join(a, "a").join(b, "b")
    names = ("s", "n", "one", "rows", "ia", "cols", "ib")
    kinds = {"s": "double", "n": "long", "one": "struct<n:bigint,ra:bigint,rb:bigint>", "rows": "long", "ia": "double", "cols": "long", "ib": "double"}

    def part(df: DataFrame, **found: Column) -> DataFrame:
        return df.agg(*[found.get(c, F.max(F.lit(None))).cast(kinds[c]).alias(c) for c in names])

    n = F.col("n").cast("double")
    every = part(t, s=F.sum(n * n / (F.col("ra") * F.col("rb"))), n=F.sum("n"), one=F.min(F.struct("n", "ra", "rb"))).unionByName(part(a, rows=F.count("*"), ia=F.sum(1 / F.col("ra")))).unionByName(part(b, cols=F.count("*"), ib=F.sum(1 / F.col("rb"))))
    m = every.agg(*[F.max(c).alias(c) for c in names])  # three rows into one
    off = F.abs(F.col("one.n") - F.col("one.ra") * F.col("one.rb") / F.col("n"))
    corrected = F.pow(F.greatest(off - 0.5, F.lit(0.0)), 2) * F.col("n") * F.col("ia") * F.col("ib")
    plain = F.greatest(F.col("n") * (F.col("s") - 1), F.lit(0.0))
    two = (F.col("rows") == 2) & (F.col("cols") == 2) & F.lit(yates)
    least = F.least("rows", "cols")
    out = m.select(F.when(two, corrected).otherwise(plain).alias("chi2"), ((F.col("rows") - 1) * (F.col("cols") - 1)).alias("dof"), "n", least.alias("_m"))
    return out.withColumn("cramers_v", F.when(F.col("_m") > 1, F.sqrt(F.col("chi2") / (F.col("n") * (F.col("_m") - 1)))).otherwise(F.lit(0.0))).drop("_m")


def chi_square_p(chi2: float, dof: int) -> float:
    """Upper tail: the regularised incomplete gamma function by series or continued fraction."""
    a, x = dof / 2, chi2 / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


def t_test(df: DataFrame, group: Column, value: str, equal_var: bool = False) -> DataFrame:
    """t, dof, means, Cohen's d and the difference of two groups (flag true: group 1)."""
    v = F.col(value).cast("double")
    one, two = F.when(group, v), F.when(~group, v)
    s = df.agg(*[f(c).alias(f"{n}{k}") for k, c in ((1, one), (2, two)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    n1, n2, v1, v2 = (F.col(x) for x in ("n1", "n2", "v1", "v2"))
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    if equal_var:
        se, dof = F.sqrt(pooled * (1 / n1 + 1 / n2)), (n1 + n2 - 2).cast("double")
    else:
        a, b = v1 / n1, v2 / n2
        se, dof = F.sqrt(a + b), (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1))
    diff = F.col("m1") - F.col("m2")
    return s.select("n1", "n2", F.col("m1").alias("mean1"), F.col("m2").alias("mean2"), (diff / se).alias("t"), dof.alias("dof"), (diff / F.sqrt(pooled)).alias("cohens_d"), diff.alias("difference"))


def t_p(t: float, dof: float) -> float:
    """Two-sided p of Student's t by the incomplete beta function."""
    x, a, b = dof / (dof + t * t), dof / 2, 0.5
    if x >= 1:
        return 1.0

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
        h = d
        for m in range(1, 300):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + k * d) or 1e-300)
                c = (1 + k / c) or 1e-300
                h *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def accumulated(df: DataFrame, key: str, value: str, how=F.sum, descending: bool = False, inclusive: bool = True, buckets: int = 64) -> DataFrame:
    """Adds ``_run``: ``how`` (sum, min, max) of ``value`` over all rows up to this one's key.

    Rows are dealt into buckets by quantiles of the key, so no task orders all
    of them: a bucket is accumulated by itself and takes on what the buckets
    before it make, one row for each. ``key`` must be unique and numeric.
    """
    cuts = df.agg(F.percentile_approx(key, [k / buckets for k in range(1, buckets)], 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(float(x)) for x in sorted(set(cuts))]).cast("array<double>")
    marked = df.withColumn("_bucket", F.size(F.filter(bounds, lambda x: x < F.col(key))))
    per = marked.groupBy("_bucket").agg(how(value).alias("_v"))
    side = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    before = how("_v").over(Window.orderBy(side("_bucket")).rowsBetween(Window.unboundedPreceding, -1))
    earlier = per.select("_bucket", before.alias("_earlier"))  # at most as many rows as buckets
    own = how(value).over(Window.partitionBy("_bucket").orderBy(side(key)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    out = marked.join(F.broadcast(earlier), "_bucket").withColumn("_own", own)
    both = F.when(F.col("_own").isNull(), F.col("_earlier")).when(F.col("_earlier").isNull(), F.col("_own"))
    joined = {F.sum: F.col("_own") + F.col("_earlier"), F.min: F.least("_own", "_earlier"), F.max: F.greatest("_own", "_earlier")}[how]
    return out.withColumn("_run", both.otherwise(joined)).drop("_bucket", "_earlier", "_own")


def mann_whitney(df: DataFrame, group: Column, value: str) -> DataFrame:
    """U of group 1, z and rank-biserial correlation, ties at their mean rank.

    Ranks come from counts per distinct value, not from a sort of all rows.
    """
    per = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.count_if(group).cast("double").alias("a"), F.count("*").cast("double").alias("t"))
    ranked = accumulated(per, "x", "t", inclusive=False)
    rank = F.coalesce("_run", F.lit(0.0)) + (F.col("t") + 1) / 2
    s = ranked.withColumn("rank", rank).agg(F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum("a").alias("n1"), F.sum(F.col("t") - F.col("a")).alias("n2"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    n, u = n1 + n2, F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    return s.select(n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), u.alias("u"), ((u - n1 * n2 / 2) / sd).alias("z"), (2 * u / (n1 * n2) - 1).alias("rank_biserial"))


def adjust(df: DataFrame, p: str, method: str = "fdr_bh") -> DataFrame:
    """Adjusted p-values of a family of tests: fdr_bh, bonferroni or holm.

    Ranks come from counts per distinct value, not from a sort of all rows;
    tests of one p-value share the adjusted one. Null p-values aren't counted.
    """
    tests = df.filter(F.col(p).isNotNull())
    m = tests.count()
    per = tests.groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_t"))
    r = accumulated(per, "_p", "_t").withColumnRenamed("_run", "_r")
    v = F.col("_p")
    if method == "bonferroni":
        r = r.withColumn("_run", v * m)
    elif method == "holm":
        r = accumulated(r.withColumn("_v", v * (m - F.col("_r") + F.col("_t"))), "_p", "_v", F.max)
    else:
        r = accumulated(r.withColumn("_v", v * m / F.col("_r")), "_p", "_v", F.min, descending=True)
    r = r.select("_p", F.least(F.lit(1.0), F.col("_run")).alias("p_adjusted"))
    return df.join(r, F.col(p) == F.col("_p"), "left").drop("_p")


def effect_words(x: Column, steps: tuple[float, float, float] = (0.2, 0.5, 0.8)) -> Column:
    a = F.abs(x)
    return F.when(a < steps[0], "negligible").when(a < steps[1], "small").when(a < steps[2], "medium").otherwise("large")


def slope(series: DataFrame, x: Column, y: Column) -> DataFrame:
    """Least-squares line through a series and its correlation."""
    return series.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"))


def sweep(df: DataFrame, params: DataFrame, by: list[str], hit: Column) -> DataFrame:
    """One pass over the rows for every parameter row; the parameters are a few constants."""
    return df.crossJoin(F.broadcast(params)).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits")).withColumn("rate", ratio(F.col("hits"), F.col("n")))


def logistic_regression(df: DataFrame, features: list[str], label: str, c: float = 1.0, iterations: int = 100) -> DataFrame:
    """``feature, coefficient, z, p_value, odds_ratio, intercept`` with an L2 penalty, trained by Spark ML.

    Rows with a null are left out. As in common use of this test, standard
    errors come from the inverse of X'X, which one aggregation makes: its size
    is that of the features squared.
    """
    import numpy as np
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("_y")).dropna()
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    got = rows.agg(F.count("*").alias("n"), *[F.sum(F.col(features[i]) * F.col(features[j])).alias(f"_{i}_{j}") for i, j in pairs]).first()
    assembled = VectorAssembler(inputCols=features, outputCol="_x").transform(rows)
    m = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1.0 / (c * max(1, got.n)), maxIter=iterations, standardization=False).fit(assembled)
    xx = np.zeros((len(features), len(features)))
    for i, j in pairs:
        xx[i, j] = xx[j, i] = got[f"_{i}_{j}"] or 0.0
    error = np.sqrt(np.clip(np.diag(np.linalg.pinv(xx)), 1e-300, None))
    out = []
    for f, b, e in zip(features, m.coefficients, error, strict=True):
        z = float(b) / float(e)
        out.append((f, float(b), z, math.erfc(abs(z) / math.sqrt(2)), math.exp(float(b)), float(m.intercept)))
    return df.sparkSession.createDataFrame(out, "feature string, coefficient double, z double, p_value double, odds_ratio double, intercept double")
