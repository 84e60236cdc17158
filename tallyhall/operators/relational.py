"""Joins, rates, cross-tabulations and set overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhall.functions.numbers import ratio


def overlay(facts: DataFrame, mapping: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left lookup whose columns replace the facts' own, even by null, where the key is found."""
    m = mapping.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_m_{c}") for c in columns])
    out = facts.join(m, facts[key] == m["_k"], "left")
    return out.withColumns({c: F.when(F.col("_k").isNotNull(), F.col(f"_m_{c}")).otherwise(facts[c]) for c in columns}).drop("_k", *[f"_m_{c}" for c in columns])


def resolve(facts: DataFrame, mapping: DataFrame, column: str, source: str, target: str) -> DataFrame:
    """Replace identities by their unified ones; unknown identities stay."""
    m = mapping.select(F.col(source).alias("_s"), F.col(target).alias("_t"))
    return facts.join(m, facts[column] == m["_s"], "left").withColumn(column, F.coalesce("_t", column)).drop("_s", "_t")


def during(events: DataFrame, periods: DataFrame, actor: str, ts: str, as_of: Column) -> DataFrame:
    """Events that fall in a validity period of their actor (ends open up to ``as_of``)."""
    p = periods.select(F.col(actor).alias("_a"), F.col("start").alias("_s"), F.coalesce("end", as_of).alias("_e"))
    return events.join(p, (events[actor] == p["_a"]) & events[ts].between(p["_s"], p["_e"]), "left_semi")


def best_before(scores: DataFrame, entities: DataFrame, key: str, ts: str, limit: str, author: str, score: str) -> DataFrame:
    """Best score per entity and author among rows dated before the entity's limit."""
    e = entities.select(F.col(key).alias("_k"), F.col(limit).alias("_l"))
    return scores.join(e, (scores[key] == e["_k"]) & (scores[ts] < e["_l"])).groupBy(key, author).agg(F.max(score).alias("score"))


def explode_mentions(messages: DataFrame, numbers: Column, name: str = "number") -> DataFrame:
    return messages.withColumn(name, F.explode(F.array_distinct(numbers)))


def reciprocity(edges: DataFrame, src: str, dst: str, weight: str) -> DataFrame:
    """Unordered pairs with their weights both ways, by one aggregation instead of a self join."""
    a, b = F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")
    w = F.col(weight)
    out = edges.filter(F.col(src) != F.col(dst)).groupBy(a, b).agg(
        F.sum(F.when(F.col(src) == F.least(src, dst), w).otherwise(0)).alias("a_to_b"),
        F.sum(F.when(F.col(src) == F.greatest(src, dst), w).otherwise(0)).alias("b_to_a"),
    )
    return out.withColumn("reciprocity", ratio(F.least("a_to_b", "b_to_a"), F.greatest("a_to_b", "b_to_a")))


def rate_by(df: DataFrame, by: list, flag: Column, least: int = 1) -> DataFrame:
    """Count, hits and rate per group; groups under ``least`` rows go."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(flag).alias("hits")).filter(F.col("n") >= least)
    return out.withColumn("rate", F.col("hits") / F.col("n"))


def rate_of_two(numerator: DataFrame, denominator: DataFrame, by: str) -> DataFrame:
    """Rate per period of either table; 0 where the denominator has none.

    The two are tagged and counted together: one shuffle, no outer join.
    """
    both = numerator.select(by, F.lit(1).alias("_n"), F.lit(0).alias("_d")).unionByName(denominator.select(by, F.lit(0).alias("_n"), F.lit(1).alias("_d")))
    return both.groupBy(by).agg(F.sum("_n").alias("numerator"), F.sum("_d").alias("denominator")).withColumn("rate", ratio(F.col("numerator"), F.col("denominator")))


def uniformity(df: DataFrame, by: list, outcome: str, least: int = 2) -> DataFrame:
    """Groups of at least ``least`` rows and whether they have one outcome."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.min(outcome).alias("_lo"), F.max(outcome).alias("_hi")).filter(F.col("n") >= least)
    return g.withColumn("consistent", F.col("_lo") == F.col("_hi")).drop("_lo", "_hi")


def overlap(sources: dict[str, DataFrame], actor: str) -> DataFrame:
    """Actors by the exact set of sources they appear in."""
    names = sorted(sources)
    every = None
    for n in names:
        one = sources[n].select(F.col(actor).alias("actor"), F.lit(n).alias("source"))
        every = one if every is None else every.unionByName(one)
    seen = every.groupBy("actor").agg(F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))
    return seen.groupBy("sources").agg(F.count("*").alias("actors"))


def keep_first(df: DataFrame, key: str, order: list) -> DataFrame:
    """First row of every key; rows whose key is blank are all kept."""
    blank = F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == ""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    first = df.filter(~blank).withColumn("_r", rank).filter("_r = 1").drop("_r")
    return first.unionByName(df.filter(blank))


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")


def new_rows(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return incoming.join(stored.select(key).distinct(), key, "left_anti")


def transitions(before: DataFrame, after: DataFrame, key: str, state: str) -> DataFrame:
    """Counts of (from, to) for keys in both tables."""
    b = after.select(key, F.col(state).alias("to"))
    return before.select(key, F.col(state).alias("from")).join(b, key).groupBy("from", "to").agg(F.count("*").alias("n"))
