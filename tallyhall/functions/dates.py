"""Time functions as Column expressions; sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhall.functions.keywords import EPOCHS, ERAS


def parse(c: Column) -> Column:
    """ISO-8601 text, else a few common forms, else null; no zone means UTC."""
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "EEE, d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss Z"]
    return F.coalesce(F.try_to_timestamp(c), *[F.try_to_timestamp(c, F.lit(f)) for f in forms[:2]])


def quarter_label(c: Column) -> Column:
    return F.concat(F.year(c), F.lit("-Q"), F.quarter(c))


def month_label(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def era(c: Column) -> Column:
    """Name of the era; the last day of an era counts up to its midnight."""
    out = None
    for name, lo, hi in ERAS:
        inside = c.between(F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz"))
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise("unknown")


def epoch(year: Column) -> Column:
    out = None
    for name, lo, hi in EPOCHS:
        out = F.when(year.between(lo, hi), name) if out is None else out.when(year.between(lo, hi), name)
    return out


def period(year: Column) -> Column:
    return F.when(year.between(2012, 2020), "historical").when(year.between(2021, 2025), "recent").otherwise("other")


PERIODS = {"year": lambda c: F.year(c).cast("string"), "quarter": quarter_label, "month": month_label, "era": era}


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def days_between(a: Column, b: Column) -> Column:
    """Days from a to b, with fractions."""
    return (micros(b) - micros(a)) / 86_400_000_000.0


def hours_between(a: Column, b: Column) -> Column:
    return (micros(b) - micros(a)) / 3_600_000_000.0


def whole_days(a: Column, b: Column) -> Column:
    return F.floor(days_between(a, b))


def year_of_prefix(c: Column) -> Column:
    return F.substring(c, 1, 4).try_cast("int")
