"""Cleaning of records: rows without their keys go, texts and times take one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhall.functions import dates as D
from tallyhall.functions import text as T


def present(df: DataFrame, column: str) -> Column:
    """Whether a key is there: not null, not 0, not blank text."""
    kind = dict(df.dtypes)[column]
    return F.coalesce(F.col(column) != "" if kind == "string" else F.col(column) != 0, F.lit(False))


def iso(c: Column) -> Column:
    """A time as ISO text to the second, null if it can't be read."""
    return F.date_format(D.parse(c), "yyyy-MM-dd'T'HH:mm:ss")


def clean_records(df: DataFrame, required: list[str], texts: list[str] = (), times: list[str] = (), lowered: list[str] = ()) -> DataFrame:
    """Records that have every required field, after cleaning (FIL1-FIL6).

    Times become ISO text (unreadable: null, so a required time drops the
    row), texts lose runs of white space and control characters, addresses in
    ``lowered`` are trimmed and lower-cased.
    """
    out = df.withColumns({**{c: F.when(F.col(c) != "", iso(F.col(c))) for c in times}, **{c: F.when(F.col(c).isNotNull(), T.clean(F.col(c))) for c in texts}, **{c: F.lower(F.trim(c)) for c in lowered}})
    keep = F.lit(True)
    for c in required:
        keep = keep & present(out, c)
    return out.filter(keep)


def cleaning_report(kept: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``source, processed, errors, rate``: of (before, after) of each source (DQ17)."""
    out = None
    for name, (before, after) in kept.items():
        both = before.select(F.lit(1).alias("n"), F.lit(0).alias("k")).unionByName(after.select(F.lit(0).alias("n"), F.lit(1).alias("k")))
        one = both.agg(F.sum("k").alias("processed"), (F.sum("n") - F.sum("k")).alias("errors")).select(F.lit(name).alias("source"), "processed", "errors")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("rate", F.round(F.try_divide("processed", F.col("processed") + F.col("errors")) * 100, 2))
