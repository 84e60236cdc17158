"""Linking a person's names across platforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def flatten_mapping(df: DataFrame, mapping: str) -> DataFrame:
    """map<unified, map<platform, array<id>>> as ``id, unified, platform``; of repeated ids the last by name wins."""
    flat = df.select(F.explode(mapping).alias("unified", "platforms")).select("unified", F.explode("platforms").alias("platform", "ids")).select("unified", "platform", F.explode("ids").alias("id")).withColumn("id", F.lower("id"))
    return flat.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("unified"), F.desc("platform")))).filter("_r = 1").drop("_r")


def unify(users: DataFrame, precedence: list[str]) -> DataFrame:
    """Users (platform, id, email) that share an id or address become one person.

    The person's name is the id on the platform that comes first in precedence.
    """
    order = F.array_position(F.array(*[F.lit(p) for p in precedence]), F.col("platform"))
    key = F.coalesce(F.nullif(F.lower("email"), F.lit("")), F.lower("id"))
    u = users.withColumns({"_key": key, "_o": order})
    main = u.groupBy("_key").agg(F.min(F.struct("_o", F.lower("id").alias("name")))["name"].alias("person"), F.sort_array(F.collect_set("platform")).alias("platforms"), F.count("*").alias("names"))
    return main.select("person", "platforms", "names")


def infer_maintainers(merges: DataFrame, actor: str, ts: str) -> DataFrame:
    """Actors whose merges make them maintainers, with how sure that is."""
    g = merges.groupBy(F.lower(actor).alias("actor")).agg(F.count("*").alias("merges"), F.min(ts).alias("start"), F.max(ts).alias("end"))
    days = F.floor((F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 86_400_000_000)
    per_day = F.col("merges") / F.greatest(days, F.lit(1))
    sure = F.when(F.col("merges") >= 10, "high").when((F.col("merges") >= 5) & (per_day > 0.1), "medium").when((F.col("merges") >= 3) & (days > 90), "low")
    return g.withColumn("confidence", sure).filter(F.col("confidence").isNotNull())


def co_mentions(messages: DataFrame, nick: str, number: str, changes: DataFrame, key: str, author: str, least: int = 3) -> DataFrame:
    """Nicks and the authors of changes they mention at least ``least`` times."""
    c = changes.select(F.col(key).alias("_k"), F.lower(author).alias("author"))
    return messages.join(c, messages[number] == c["_k"]).groupBy(F.lower(nick).alias("nick"), "author").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
