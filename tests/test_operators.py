"""Operators on small fixtures, edge rows included."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tallyhall.functions import dates as D
from tallyhall.functions import text as T
from tallyhall.operators import classify as C
from tallyhall.operators import graph as G
from tallyhall.operators import identity as I
from tallyhall.operators import quality as Q
from tallyhall.operators import relational as R
from tallyhall.operators import stats as S
from tallyhall.operators import windows as W
from tallyhall.operators.concentration import concentration


def one(spark, expr, **values):
    cols = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], cols).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("values,gini", [([], 0.0), ([0, 0], 0.0), ([5], 0.0), ([2, 2, 2], 0.0), ([1, 0, 3], 0.25), ([1, 2, 3, 4], 0.25)])
def test_gini(spark, values, gini):
    df = spark.createDataFrame([(v,) for v in values], "x long")
    assert concentration(df).first()["gini"] == gini


def test_concentration_by_group(spark):
    df = spark.createDataFrame([("a", 9), ("a", 1), ("b", 1), ("b", 1)], "g string, x long")
    got = {r.g: r for r in concentration(df, ["g"]).collect()}
    assert (got["a"].gini, got["a"].level, got["b"].gini) == (0.4, "very_high", 0.0)


@pytest.mark.parametrize("n,score", [(0, 0.5), (1, 0.7), (10, 0.7), (11, 0.8), (50, 0.8), (51, 1.0)])
def test_formal_score(spark, n, score):
    assert one(spark, C.formal_score(F.col("s"), F.col("b")), s=("string", "APPROVED"), b=("string", "x" * n)) == score


@pytest.mark.parametrize("body,score", [("ACK", 0.2), ("z" * 21, 0.4), ("z" * 101, 0.5), ("ACK deadbeef1", 0.3), (None, 0.2)])
def test_ack_score(spark, body, score):
    assert one(spark, C.ack_score(F.col("b")), b=("string", body)) == score


@pytest.mark.parametrize("body,hit", [("ACK", True), ("utACK", False), ("NACK", False), ("back", False), ("ack, nice", True), ("first\nACK deadbeef1", True)])
def test_ack_detector(spark, body, hit):
    assert one(spark, C.is_ack(F.col("b")), b=("string", body)) is hit


@pytest.mark.parametrize("changes,title,names,want", [(5, "fix typo", ["a.md"], "trivial"), (30, "fix typo", ["a.md"], "low"), (5, "consensus", [], "critical"), (1001, "zzz", [], "critical"), (60, "zzz", ["src/x.cpp"], "normal"), (250, "zzz", ["src/x.cpp"], "high")])
def test_importance(spark, changes, title, names, want):
    e = C.importance(F.col("t"), F.lit(""), F.array().cast("array<string>"), F.col("n"), F.col("f"))
    assert one(spark, e, t=("string", title), n=("int", changes), f=("array<string>", names)) == want


def test_review_class(spark):
    r = one(spark, C.review_class(F.col("s"), F.col("b")), s=("string", "APPROVED"), b=("string", "NACK, a serious problem"))
    assert (r.review_type, r.sentiment, r.strength, r.is_nack) == ("approval", "positive", "strong", True)


def test_change_type(spark):
    r = one(spark, C.change_type(F.col("t"), F.lit(None).cast("string"), F.array(F.lit("Bug"))), t=("string", "Optimize speed"))
    assert (r.primary_type, r.subtypes, r.confidence) == ("bugfix", ["bugfix", "performance"], "high")


@pytest.mark.parametrize("days,periods", [(180, 1), (180.99, 1), (181, 2)])
def test_gap_of_whole_days(spark, days, periods):
    t = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([("a", t), ("a", t + dt.timedelta(days=days))], "actor string, ts timestamp")
    assert W.gap_sessions(df, "actor", "ts").count() == periods


def test_completion_signal(spark):
    t = dt.datetime(2020, 1, 1)
    rows = [(1, "a", t, 0, "review", 1.0), (1, "a", t, 1, "ack", 0.2), (1, "b", t, 0, "ack", 0.4), (2, "a", t, 0, "ack", 0.2), (2, "a", t, 1, "review", 0.5)]
    df = spark.createDataFrame(rows, "pr int, who string, ts timestamp, seq int, kind string, s double")
    got = W.completion_signal(df, "pr", "who", ["ts", "seq"], F.col("kind") == "review", F.col("kind") == "ack", F.col("s"))
    assert {r.pr: round(r.score, 6) for r in got.collect()} == {1: 1.4, 2: 0.5}


def test_short_series_is_not_averaged(spark):
    df = spark.createDataFrame([("a", 1), ("b", 5)], "p string, n int")
    assert [r.moving_average for r in W.moving_average(df, "p", "n").orderBy("p").collect()] == [1.0, 5.0]


@pytest.mark.parametrize("day,era", [("2011-04-23 00:00:00", "founding"), ("2011-04-23 12:00:00", "unknown"), ("2011-04-24 00:00:00", "early")])
def test_era_boundary(spark, day, era):
    assert one(spark, D.era(F.col("t").cast("timestamp_ntz")), t=("string", day)) == era


def test_text_functions(spark):
    assert one(spark, T.clean(F.col("t")), t=("string", " a \tb\x07 ")) == "a b"
    assert one(spark, T.issue_links(F.col("t")), t=("string", "fixes #12, #3 and #12")) == [3, 12]
    assert one(spark, T.mentions(F.col("t")), t=("string", "hi @Ann and @b.c")) == ["ann", "b.c"]
    assert one(spark, T.email_author(F.col("t")), t=("string", '"Ann B" <ann.b@x.org>')) == "ann.b"
    assert one(spark, T.author_list(F.col("t")), t=("string", "Ann <a@x>, Bob")) == ["ann", "bob"]
    assert one(spark, T.unquoted(F.col("t")), t=("string", "> old\nnew")) == "new"


def test_overlay_replaces_even_by_null(spark):
    f = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    m = spark.createDataFrame([(1, None)], "k int, v string")
    assert {r.k: r.v for r in R.overlay(f, m, "k", ["v"]).collect()} == {1: None, 2: "y"}


def test_blank_keys_are_kept(spark):
    df = spark.createDataFrame([("", 1), ("", 2), ("a", 3), ("a", 4), (None, 5)], "k string, n int")
    assert sorted(r.n for r in R.keep_first(df, "k", ["n"]).collect()) == [1, 2, 3, 5]


def test_validity_periods(spark):
    e = spark.createDataFrame([("a", 5), ("a", 50), ("b", 5)], "actor string, ts int")
    p = spark.createDataFrame([("a", 1, 10), ("b", 6, None)], "actor string, start int, end int")
    assert [(r.actor, r.ts) for r in R.during(e, p, "actor", "ts", F.lit(99)).collect()] == [("a", 5)]


def test_clustering_and_paths(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("c", "d", 1)], "src string, dst string, weight int")
    got = {r.node: r for r in G.clustering(e).collect()}
    assert (got["a"].clustering, got["d"].clustering, got["c"].triangles) == (1.0, 0.0, 1)
    assert math.isclose({r.node: r.betweenness for r in G.path_centralities(e).collect()}["c"], 3 / 6)
    assert math.isclose(sum(r["rank"] for r in G.pagerank(e, 30).collect()), 1.0, abs_tol=1e-9)


def test_published_chi_square(spark):
    cells = spark.createDataFrame([("h", 0, 2885), ("h", 1, 6656), ("r", 0, 204), ("r", 1, 5805)], "a string, b int, n long")
    r = S.chi_square(cells, yates=False).first()
    assert round(r.chi2, 3) == 1668.853 and r.dof == 1 and round(r.cramers_v, 4) == 0.3276


def test_distributions():
    assert math.isclose(S.chi_square_p(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(S.t_p(2.2281388519649385, 10), 0.05, rel_tol=1e-9)


@pytest.mark.parametrize("method,want", [("fdr_bh", [0.03, 0.03, 0.03]), ("bonferroni", [0.03, 0.06, 0.09]), ("holm", [0.03, 0.04, 0.04])])
def test_adjust(spark, method, want):
    df = spark.createDataFrame([(0.01,), (0.02,), (0.03,)], "p double")
    assert [round(r.p_adjusted, 9) for r in S.adjust(df, "p", method).orderBy("p").collect()] == want


def test_quality(spark):
    df = spark.createDataFrame([("a", None), (" ", 1)], "s string, n int")
    assert {r.field: r.missing for r in Q.missing_fields(df, ["s", "n"]).collect()} == {"s": 1, "n": 1}
    assert one(spark, Q.status(F.col("n")), n=("int", 3)) == "fair"


def test_identity_mapping(spark):
    df = spark.createDataFrame([({"u1": {"hub": ["Ann"], "chat": ["ann_"]}, "u2": {"hub": ["ann"]}},)], "m map<string,map<string,array<string>>>")
    assert {r.id: r.unified for r in I.flatten_mapping(df, "m").collect()} == {"ann": "u2", "ann_": "u1"}


def test_chi_square_equals_the_full_table(spark):
    for rows, yates in (([("a", "x", 10), ("a", "y", 20), ("b", "x", 30)], True), ([("a", "x", 3), ("b", "y", 4)], True), ([("a", "x", 5), ("a", "y", 9), ("b", "z", 7), ("c", "x", 2)], True), ([("a", "x", 10), ("a", "y", 20), ("b", "x", 30), ("b", "y", 5)], False)):
        from tallyhall.operators import stats

        got = stats.chi_square(spark.createDataFrame(rows, "a string, b string, n long"), yates).first()
        ka, kb = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
        n = {(x, y): sum(r[2] for r in rows if r[:2] == (x, y)) for x in ka for y in kb}
        total, chi = sum(n.values()), 0.0
        for x in ka:
            for y in kb:
                e = sum(n[x, z] for z in kb) * sum(n[z, y] for z in ka) / total
                off = abs(n[x, y] - e)
                chi += (max(off - 0.5, 0) if yates and len(ka) == len(kb) == 2 else off) ** 2 / e
        assert abs(got.chi2 - chi) < 1e-9 and got.dof == (len(ka) - 1) * (len(kb) - 1) and got.n == total


def test_ranks_do_not_need_one_task(spark):
    import random

    from tallyhall.operators import stats

    r = random.Random(8)
    rows = [(r.randint(0, 500) / 7, r.random() < 0.4) for _ in range(3000)]
    got = stats.mann_whitney(spark.createDataFrame(rows, "x double, g boolean"), __import__("pyspark.sql.functions", fromlist=["col"]).col("g"), "x").first()
    a, b = [x for x, g in rows if g], [x for x, g in rows if not g]
    assert got.u == sum((x > y) + 0.5 * (x == y) for x in a for y in b) and (got.n1, got.n2) == (len(a), len(b))
    ps = [(k, round(r.random(), 2)) for k in range(400)] + [(999, None)]
    df = spark.createDataFrame(ps, "k int, p double")
    known = sorted((p, k) for k, p in ps if p is not None)
    m = len(known)
    bh, best = {}, 1.0
    for i in range(m, 0, -1):
        best = min(best, known[i - 1][0] * m / i)
        bh[known[i - 1][1]] = best
    low = {}
    for p, k in known:  # tests of one p-value share the least of theirs
        low[p] = min(low.get(p, 2.0), bh[k])
    out = {x.k: x.p_adjusted for x in stats.adjust(df, "p").collect()}
    assert out[999] is None and all(abs(out[k] - low[p]) < 1e-12 for p, k in known)
    holm, most = {}, 0.0
    for i, (p, k) in enumerate(known):
        most = max(most, p * (m - i))
        holm[k] = min(1.0, most)
    high = {}
    for p, k in known:
        high[p] = max(high.get(p, 0.0), holm[k])
    out = {x.k: x.p_adjusted for x in stats.adjust(df, "p", "holm").collect()}
    assert all(abs(out[k] - high[p]) < 1e-12 for p, k in known)


def test_logistic_regression_gives_wald_tests(spark):
    import random

    from tallyhall.operators import stats

    r = random.Random(3)
    rows = []
    for _ in range(1500):
        x, z = r.gauss(0, 1), r.gauss(0, 1)
        rows.append((x, z, int(r.random() < 1 / (1 + 2.718281828 ** (-1.5 * x)))))
    out = {x.feature: x for x in stats.logistic_regression(spark.createDataFrame([*rows, (None, 1.0, 1)], "x double, z double, y int"), ["x", "z"], "y").collect()}
    assert 1.2 < out["x"].coefficient < 1.8 and out["x"].p_value < 1e-6 and abs(out["z"].coefficient) < 0.25
    assert abs(out["x"].odds_ratio - 2.718281828 ** out["x"].coefficient) < 1e-6
