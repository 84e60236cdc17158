"""Collaboration graphs as edge tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhall.checkpoints import cut_lineage
from tallyhall.functions.numbers import ratio


def edges(df: DataFrame, src: Column, dst: Column, loops: bool = False) -> DataFrame:
    """Weighted directed edges; case-folded ends, null ends dropped."""
    e = df.select(src.alias("src"), dst.alias("dst")).dropna()
    if not loops:
        e = e.filter("src <> dst")
    return e.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def degrees(e: DataFrame) -> DataFrame:
    """Weighted and plain in-, out- and total degree of every node."""
    both = e.select(F.col("src").alias("node"), F.col("weight").alias("out"), F.lit(0).alias("in")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("out"), F.col("weight").alias("in")))
    return both.groupBy("node").agg(
        F.sum("out").alias("out_degree"), F.sum("in").alias("in_degree"), F.sum(F.col("out") + F.col("in")).alias("degree"),
        F.count_if(F.col("out") > 0).alias("targets"), F.count_if(F.col("in") > 0).alias("sources"),
    )


def pagerank(e: DataFrame, iterations: int = 20, damping: float = 0.85, weighted: bool = True) -> DataFrame:
    """``node, rank``; weight that dead ends hold is spread over all nodes.

    Every iteration is one equi join and one sum per node, pre-aggregated; its
    result is written to the shared folder, so lineage stays short.
    """
    w = F.col("weight") if weighted else F.lit(1)
    links = e.select("src", "dst", w.cast("double").alias("w"))
    out = links.groupBy("src").agg(F.sum("w").alias("total"))
    links = cut_lineage(links.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")))
    nodes = cut_lineage(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().join(out.select(F.col("src").alias("node"), F.lit(True).alias("leads")), "node", "left").select("node", F.coalesce("leads", F.lit(False)).alias("leads")))
    n = nodes.count()
    ranks = nodes.select("node", "leads", F.lit(1.0 / max(n, 1)).alias("rank"))
    for _ in range(iterations):
        held = ranks.agg(F.coalesce(F.sum(F.when(~F.col("leads"), F.col("rank"))), F.lit(0.0))).first()[0]
        given = links.join(ranks, links["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        base = (1 - damping) / n + damping * held / n
        ranks = cut_lineage(nodes.join(given, nodes["node"] == given["dst"], "left").select("node", "leads", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")))
    return ranks.select("node", "rank")


def eigenvector(e: DataFrame, iterations: int = 50) -> DataFrame:
    """Power iteration on incoming edges, of unit length."""
    e = cut_lineage(e)
    nodes = cut_lineage(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    x = nodes.withColumn("value", F.lit(1.0))
    for _ in range(iterations):
        got = e.join(x, e["src"] == x["node"]).groupBy("dst").agg(F.sum(F.col("value") * F.col("weight")).alias("got"))
        y = cut_lineage(x.join(got, x["node"] == got["dst"], "left").select("node", (F.col("value") + F.coalesce("got", F.lit(0.0))).alias("value")))
        norm = y.agg(F.sqrt(F.sum(F.col("value") * F.col("value")))).first()[0] or 1.0
        x = y.select("node", (F.col("value") / norm).alias("value"))
    return x


def path_centralities(e: DataFrame, sources: DataFrame | None = None, edge_limit: int = 200_000, weighted: bool = True) -> DataFrame:
    """``node, betweenness, closeness`` by one shortest-path tree per source (Brandes).

    An edge is as long as its weight, which must be positive, or 1 if not ``weighted``.
    The graph must have at most ``edge_limit`` edges: its size is checked before
    it is broadcast, and a larger one is refused, since exact path counts need
    the whole graph. Sources are spread over the tasks.
    """
    e = cut_lineage(e)
    w = F.col("weight") if weighted else F.lit(1)
    rows = e.select("src", "dst", w.alias("w")).limit(edge_limit + 1).collect()
    if len(rows) > edge_limit:
        raise ValueError(f"path centralities are exact up to {edge_limit} edges")
    spark = e.sparkSession
    shared = spark.sparkContext.broadcast([(r[0], r[1], r[2]) for r in rows])
    kind = e.schema["src"].dataType.simpleString()
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    starts = nodes if sources is None else sources

    def run(batches: Iterator) -> Iterator:
        from heapq import heappop, heappush

        import pandas as pd

        to, back, names = {}, {}, {}
        for a, b, w in shared.value:
            to.setdefault(a, []).append((b, w))
            back.setdefault(b, []).append((a, w))
            names[a] = names[b] = None
        n = len(names)

        def tree(s, links: dict) -> tuple[dict, dict, dict]:
            """Distances in order of length, numbers of shortest paths, nodes before each node."""
            done, seen, paths, before, heap, k = {}, {s: 0}, {s: 1.0}, {}, [(0, 0, s)], 0
            while heap:
                at, _, v = heappop(heap)
                if v in done:
                    continue
                done[v] = at
                for u, w in links.get(v, ()):
                    if u in done:
                        continue
                    if u not in seen or at + w < seen[u]:
                        seen[u], paths[u], before[u] = at + w, paths[v], [v]
                        k += 1
                        heappush(heap, (at + w, k, u))
                    elif at + w == seen[u]:
                        paths[u] += paths[v]
                        before[u].append(v)
            return done, paths, before

        for frame in batches:
            part: dict = {}
            close = []
            for s in frame["node"]:
                order, paths, before = tree(s, to)
                gain = dict.fromkeys(order, 0.0)
                for v in reversed(order):
                    for u in before.get(v, ()):
                        gain[u] += paths[u] / paths[v] * (1 + gain[v])
                    if v != s:
                        part[v] = part.get(v, 0.0) + gain[v]
                d = tree(s, back)[0]  # closeness looks at paths that end here
                total = sum(d.values())
                close.append((s, 0.0, (len(d) - 1) / total * (len(d) - 1) / (n - 1) if total and n > 1 else 0.0))
            scale = (n - 1) * (n - 2) or 1
            out = close + [(v, g / scale, 0.0) for v, g in part.items()]
            yield pd.DataFrame(out, columns=["node", "betweenness", "closeness"])

    return starts.select("node").mapInPandas(run, f"node {kind}, betweenness double, closeness double").groupBy("node").agg(F.sum("betweenness").alias("betweenness"), F.sum("closeness").alias("closeness"))


def with_status(e: DataFrame, status: DataFrame, node: str, flag: str) -> DataFrame:
    a = status.select(F.col(node).alias("src"), F.col(flag).alias("src_status"))
    b = status.select(F.col(node).alias("dst"), F.col(flag).alias("dst_status"))
    return e.join(a, "src").join(b, "dst")


def homophily(e: DataFrame, status: DataFrame, node: str, flag: str, weighted: bool = False) -> DataFrame:
    """Share of edges whose ends have the same status; edges count once, or by weight."""
    w = F.col("weight") if weighted else F.lit(1)
    s = with_status(e, status, node, flag)
    same = F.sum(F.when(F.col("src_status") == F.col("dst_status"), w).otherwise(0))
    return s.agg(F.sum(w).alias("edges"), same.alias("same")).withColumn("homophily", ratio(F.col("same"), F.col("edges")))


def status_matrix(e: DataFrame, status: DataFrame, node: str, flag: str) -> DataFrame:
    return with_status(e, status, node, flag).groupBy("src_status", "dst_status").agg(F.sum("weight").alias("n"))


def clustering(e: DataFrame) -> DataFrame:
    """Local clustering coefficient of every node of the undirected graph.

    Each edge is directed from the end of lower degree to that of higher, so
    two-paths are only opened from the low-degree end and a hub opens few.
    """
    u = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()
    deg = u.select(F.col("a").alias("node")).union(u.select("b")).groupBy("node").agg(F.count("*").alias("d"))
    da, db = deg.select(F.col("node").alias("a"), F.col("d").alias("da")), deg.select(F.col("node").alias("b"), F.col("d").alias("db"))
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    lo, hi = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))
    by = u.join(da, "a").join(db, "b").select(lo.alias("x"), hi.alias("y"))
    paths = by.join(by.select("x", F.col("y").alias("z")), "x").filter("y < z")
    closed = paths.join(u, (paths["y"] == u["a"]) & (paths["z"] == u["b"])).select("x", "y", "z")
    t = closed.select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    d = F.col("d")
    return deg.join(t, "node", "left").select("node", d.alias("degree"), F.coalesce("triangles", F.lit(0)).alias("triangles"), F.when(d > 1, 2 * F.coalesce("triangles", F.lit(0)) / (d * (d - 1))).otherwise(F.lit(0.0)).alias("clustering"))
