"""Ordered-row operators: look-backs, sessions, trends, ranks and cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallyhall.functions.dates import whole_days


def completion_signal(events: DataFrame, entity: str, author: str, order: list, is_review: Column, is_ack: Column, score: Column, done: float = 0.7, reducer: str = "max") -> DataFrame:
    """Score per entity: an acknowledgement doesn't count after a substantial review by its author.

    Each author contributes the best (``max``) or the sum of their scores.
    """
    before = Window.partitionBy(entity, author).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    finished = F.coalesce(F.max(F.when(is_review & (score >= done), 1)).over(before), F.lit(0))
    left = events.withColumns({"_done": finished, "_s": score}).filter(~(is_ack & (F.col("_done") == 1)))
    best = F.max("_s") if reducer == "max" else F.sum("_s")
    return left.groupBy(entity, author).agg(best.alias("_b")).groupBy(entity).agg(F.sum("_b").alias("score"))


def timeline(actor: str, ts: str) -> WindowSpec:
    """Each actor's events in order of time, those without one last, as in the SQL."""
    return Window.partitionBy(actor).orderBy(F.col(ts).asc_nulls_last())


def gap_sessions(events: DataFrame, actor: str, ts: str, gap: Column | None = None, days: int = 180) -> DataFrame:
    """Activity periods of each actor; a new one starts after a gap.

    By default a gap is more than ``days`` whole days; a caller's ``gap`` looks
    back over ``timeline``. One sort per actor; the periods are then ordinary
    aggregates. Events at one time share a period, whichever of them comes first.
    """
    order = timeline(actor, ts)
    last = F.lag(ts).over(order)
    new = (whole_days(last, F.col(ts)) > days) if gap is None else gap
    marked = events.withColumn("_last", last).withColumn("_new", F.coalesce(new.cast("int"), F.lit(0)))
    return (
        marked.withColumn("session", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy(actor, "session")
        .agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))
    )


def tenure(events: DataFrame, actor: str, ts: str, as_of: Column, open_days: int = 90) -> DataFrame:
    """Periods of activity; the last one is open if it ended recently."""
    periods = gap_sessions(events, actor, ts)
    return periods.withColumn("end", F.when(whole_days(F.col("end"), as_of) < open_days, None).otherwise(F.col("end")))


def moving_average(series: DataFrame, order: str, value: str, window: int = 3, by: list[str] | None = None) -> DataFrame:
    """Trailing mean; a series shorter than the window is returned as it is."""
    w = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(-(window - 1), 0)
    n = F.count("*").over(Window.partitionBy(*(by or [])))
    return series.withColumn("moving_average", F.when(n < window, F.col(value).cast("double")).otherwise(F.avg(value).over(w)))


def trend(series: DataFrame, order: str, value: str, window: int = 3, by: list[str] | None = None) -> DataFrame:
    """First and last value, mean of the first and last ``window``, direction at 10 per cent."""
    by = by or []
    up = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    down = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    v = F.col(value).cast("double")
    out = series.withColumns({"_up": up, "_down": down}).groupBy(*by).agg(
        F.min_by(v, order).alias("first"), F.max_by(v, order).alias("last"),
        F.avg(F.when(F.col("_up") <= window, v)).alias("early"), F.avg(F.when(F.col("_down") <= window, v)).alias("recent"),
    )
    change = F.when(F.col("early") != 0, (F.col("recent") - F.col("early")) / F.col("early") * 100).otherwise(F.lit(0.0))
    return out.withColumn("change_pct", change).withColumn("direction", F.when(change > 10, "increasing").when(change < -10, "decreasing").otherwise("stable"))


def top_per_group(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def share(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    return df.withColumn("share", F.col(value) / F.sum(value).over(Window.partitionBy(*(by or []))))


def first_event(events: DataFrame, actor: str, ts: str, *keep: str) -> DataFrame:
    """Each actor's first event, by an aggregate rather than a sort."""
    first = F.min(F.struct(ts, *keep)).alias("_f")
    return events.groupBy(actor).agg(first).select(actor, "_f.*")


def retention(events: DataFrame, actor: str, ts: str, as_of: Column, days: int = 365) -> DataFrame:
    """Per year of joining: actors, how many were active in the last ``days`` days, and their share."""
    span = events.groupBy(actor).agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    active = F.count_if(whole_days(F.col("last"), as_of) < days)
    return span.groupBy(F.year("first").alias("cohort")).agg(F.count("*").alias("joined"), active.alias("active")).withColumn("retention", F.col("active") / F.col("joined"))


def snapshot_diff(snapshots: DataFrame, order: str, names: str) -> DataFrame:
    """Names that each snapshot adds to and takes from the one before."""
    before = F.coalesce(F.lag(names).over(Window.orderBy(order)), F.array().cast("array<string>"))
    return snapshots.withColumn("_b", before).select(order, F.array_sort(F.array_except(names, "_b")).alias("added"), F.array_sort(F.array_except("_b", names)).alias("removed"))


def carry_forward(df: DataFrame, order: str, value: str, by: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))
