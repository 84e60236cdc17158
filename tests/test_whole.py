"""Queries that must read all rows, against DuckDB and plain Python."""

from __future__ import annotations

import itertools
import math

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tallyhall.operators import graph as G

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "nation customer supplier part orders lineitem events documents conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def review_edges(con):
    return con.sql("SELECT s_nationkey, c_nationkey, count(*) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2").fetchall()


def test_paths_are_weighted(spark):
    e = spark.createDataFrame([("a", "b", 5), ("a", "c", 1), ("c", "b", 1)], "src string, dst string, weight int")
    got = {r.node: r for r in G.path_centralities(e).collect()}
    assert (got["c"].betweenness, got["b"].closeness) == (0.5, 2 / 3)
    assert {r.node: r.betweenness for r in G.path_centralities(e, weighted=False).collect()}["c"] == 0.0


def test_path_centralities_reads_all_reviews(spark, review_edges):
    nodes = sorted({x for e in review_edges for x in e[:2]})
    d = {(a, b): 0 if a == b else math.inf for a in nodes for b in nodes} | {(a, b): w for a, b, w in review_edges}
    for k, a, b in itertools.product(nodes, nodes, nodes):
        d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    paths = {(a, a): 1 for a in nodes}
    for s in nodes:  # numbers of shortest paths, nearest ends first
        for v in sorted((v for v in nodes if v != s and d[s, v] < math.inf), key=lambda v: d[s, v]):
            paths[s, v] = sum(paths.get((s, u), 0) for u, x, w in review_edges if x == v and d[s, u] + w == d[s, v])
    n, got = len(nodes), {r.node: r for r in QUERIES["path_centralities"](spark, SF).collect()}
    assert sorted(got) == nodes
    for v in nodes:
        between = sum(paths[s, v] * paths[v, t] / paths[s, t] for s in nodes for t in nodes if len({s, v, t}) == 3 and d[s, v] + d[v, t] == d[s, t] < math.inf)
        to = [d[u, v] for u in nodes if u != v and d[u, v] < math.inf]
        assert math.isclose(got[v].betweenness, between / ((n - 1) * (n - 2)), abs_tol=2e-6)
        assert math.isclose(got[v].closeness, len(to) / sum(to) * len(to) / (n - 1) if to else 0, abs_tol=2e-6)


def test_eigenvector_reads_all_reviews(spark, review_edges):
    nodes = sorted({x for e in review_edges for x in e[:2]})
    m, x = np.eye(len(nodes)), np.ones(len(nodes))
    for a, b, w in review_edges:
        m[nodes.index(b), nodes.index(a)] += w
    for _ in range(15):
        x = m @ x / np.linalg.norm(m @ x)
    got = {r.node: r.value for r in QUERIES["eigenvector"](spark, SF).collect()}
    assert np.allclose([got[v] for v in nodes], x, atol=2e-6)


@pytest.mark.parametrize("name", ["pagerank", "clustering"])
def test_whole_graph_is_read(spark, review_edges, name):
    assert {r.node for r in QUERIES[name](spark, SF).collect()} == {x for e in review_edges for x in e[:2]}


def test_whole_texts_are_read(spark, tmp_path):
    long = "neutral words that go on and on and on for a while "
    rows = [(1, long + "consensus vulnerability", 400), (2, long + "nothing", 400)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.importance: r.n for r in QUERIES["text_importance"](spark, str(tmp_path)).collect()}
    assert got == {"critical": 1, "low": 1}
    turns = [("user", "I went back over it. " + long), ("user", "a few words, and then at the end: lgtm"), ("user", "ok")]
    spark.createDataFrame(turns, "role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["rubber_stamps"](spark, str(tmp_path)).first().stamps == 2


def test_all_tests_are_adjusted(spark):
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    assert n > 50 and QUERIES["bh_adjust"](spark, SF).count() == n


def test_keys_cover_the_dimension(spark, tmp_path):
    spark.range(4000).selectExpr("id AS c_custkey", "CAST(id >= 1500 AS INT) AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(4000).selectExpr("id AS event_id", "7 AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    assert {(r.nick, r.author, r.n) for r in QUERIES["co_mentions"](spark, str(tmp_path)).collect()} == {("7", "0", 1500), ("7", "1", 2500)}
    spark.range(2000).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(20000).selectExpr("id AS o_orderkey", "IF(id BETWEEN 1000 AND 1999, 'F', 'O') AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    assert {r.o_orderstatus: r.coverage for r in QUERIES["attribution_coverage"](spark, str(tmp_path)).collect()} == {"F": 1.0, "O": round(1000 / 19000, 6)}
