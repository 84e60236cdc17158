"""Connected components of an edge table, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhall.llm.common import discard, stash


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` (the least node reachable) of every node with an edge.

    Alternates large-star and small-star steps; each halves the depth of what
    is left, so rounds grow with the logarithm of a component's size. Every
    step is a minimum per node, combined before the shuffle, and an equi join,
    so a star with very many leaves is never gathered in one task. Each round
    is written to the shared folder; the driver only sees two counts.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u <> v").distinct()
    now = stash(e, "edges")
    state = None
    while True:
        # Large star: every larger neighbour of a node links to the node's least neighbour.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        mid = stash(large, "edges")
        # Small star: a node and its smaller neighbours link to the least of them.
        least = mid.groupBy("u").agg(F.min("v").alias("m"))
        linked = mid.join(least, "u")
        small = linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        nxt = stash(small, "edges")
        discard(now)
        discard(mid)
        now = nxt
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            break
        state = tuple(found)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
