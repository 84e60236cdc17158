"""Data quality: required fields, order of times, duplicates, completeness, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhall.functions.numbers import ratio


def missing_fields(df: DataFrame, required: list[str]) -> DataFrame:
    """``field, missing, total``; blank text counts as missing. One pass for all fields."""
    counts = [F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(c) for c in required]
    one = df.agg(F.count("*").alias("_n"), *counts)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("missing"), F.col("_n").alias("total")) for c in required])).alias("r")).select("r.*")


def errors(checks: dict[str, Column]) -> Column:
    """Names of the checks a row fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def out_of_order(df: DataFrame, earlier: str, later: str) -> DataFrame:
    return df.filter(F.col(later) < F.col(earlier))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def completeness(collected: Column, expected: Column) -> Column:
    return F.struct(F.round(ratio(collected, expected) * 100, 2).alias("percentage"), (collected >= expected).alias("complete"))


def status(issues: Column) -> Column:
    return F.when(issues == 0, "excellent").when(issues <= 2, "good").when(issues <= 4, "fair").otherwise("poor")


def dangling(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference has no parent."""
    return child.join(parent.select(F.col(parent_key).alias("_p")).distinct(), child[key] == F.col("_p"), "left_anti")


def within(value: Column, low: float, high: float) -> Column:
    return value.between(low, high)
