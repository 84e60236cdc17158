"""Graphs, overlaps, identity and tests.

The review graph links a reviewer's nation to the author's nation, so that both
ends are of one kind; a nation's status is its region.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhall.functions.numbers import correlation, r6
from tallyhall.operators import graph as G
from tallyhall.operators import identity as I
from tallyhall.operators import quality as Q
from tallyhall.operators import relational as R
from tallyhall.operators import stats as S
from tallyhall.operators import windows as W
from tallyhall.operators.concentration import concentration
from tallyhall.plans.concentration_queries import _CONCENTRATION_SQL
from tallyhall.plans.registry import query, table


def _nation_edges(spark, d, loops=False):
    """Suppliers' to customers' nations, summed per pair of actors' nations before the last join."""
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "dst")
    j = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return G.edges(j, F.col("src"), F.col("dst"), loops)


_EDGES = """e AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS weight FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2)"""
_BOTH = "b AS (SELECT src AS node, weight AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, weight FROM e)"


@query("weighted_degree", f"WITH {_EDGES}, {_BOTH} SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o + i) AS BIGINT) AS degree, count(*) FILTER (WHERE o > 0) AS targets, count(*) FILTER (WHERE i > 0) AS sources FROM b GROUP BY 1")
def weighted_degree(spark, d):
    """Degrees of the review graph (GRA1, GRA4, GRA7)."""
    return G.degrees(_nation_edges(spark, d))


@query("review_edges", f"WITH {_EDGES} SELECT src, dst, weight FROM e")
def review_edges(spark, d):
    """The review graph without loops (GRA1, GRA2, GRA12)."""
    return _nation_edges(spark, d)


@query("degree_concentration", _CONCENTRATION_SQL.format(counts=f"SELECT * FROM (WITH {_EDGES}, {_BOTH} SELECT node AS actor, CAST(sum(o + i) AS BIGINT) AS x FROM b GROUP BY 1)"))
def degree_concentration(spark, d):
    """Concentration of degree (GRA5, CON12 in its canonical form)."""
    return concentration(G.degrees(_nation_edges(spark, d)).select(F.col("node").alias("actor"), F.col("degree").alias("x")))


@query("homophily", f"""WITH {_EDGES} SELECT count(*) AS edges, count(*) FILTER (WHERE a.n_regionkey = b.n_regionkey) AS same, round(count(*) FILTER (WHERE a.n_regionkey = b.n_regionkey) / CAST(count(*) AS DOUBLE), 6) AS homophily
FROM e JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey""")
def homophily(spark, d):
    """Share of edges inside a region (GRA8, GRA11)."""
    return G.homophily(_nation_edges(spark, d), table(spark, d, "nation"), "n_nationkey", "n_regionkey").withColumn("homophily", r6(F.col("homophily")))


@query("status_matrix", f"WITH {_EDGES} SELECT a.n_regionkey AS src_status, b.n_regionkey AS dst_status, CAST(sum(weight) AS BIGINT) AS n FROM e JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey GROUP BY 1, 2")
def status_matrix(spark, d):
    """Reviews between regions (GRA9)."""
    return G.status_matrix(_nation_edges(spark, d), table(spark, d, "nation"), "n_nationkey", "n_regionkey")


_CLUSTERING = """u AS (SELECT DISTINCT least(src, dst) a, greatest(src, dst) b FROM e), v AS (SELECT a, b FROM u UNION ALL SELECT b, a FROM u), d AS (SELECT a AS node, count(*) AS degree FROM v GROUP BY 1),
t AS (SELECT x.a AS node, count(*) AS n FROM v x JOIN v y ON x.a = y.a AND x.b < y.b JOIN u ON u.a = x.b AND u.b = y.b GROUP BY 1)
SELECT node, degree, CAST(coalesce(n, 0) AS BIGINT) AS triangles, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(n, 0) / (degree * (degree - 1)) ELSE 0 END, 6) AS clustering FROM d LEFT JOIN t USING (node)"""


@query("clustering", f"WITH {_EDGES}, {_CLUSTERING}")
def clustering(spark, d):
    """Local clustering coefficients of the whole review graph (GRA10)."""
    return G.clustering(_nation_edges(spark, d)).withColumn("clustering", r6(F.col("clustering")))


_RANK_STEPS = 10


def _pagerank_sql(edges: str) -> str:
    parts = [f"WITH {edges}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), c AS (SELECT count(*) AS n FROM n), o AS (SELECT src, sum(weight) AS t FROM e GROUP BY 1), r0 AS MATERIALIZED (SELECT node, 1.0 / n AS rank FROM n, c)"]
    for k in range(1, _RANK_STEPS + 1):
        parts.append(f"r{k} AS MATERIALIZED (SELECT n.node, 0.15 / c.n + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE node NOT IN (SELECT src FROM o)) / c.n + 0.85 * coalesce((SELECT sum(r.rank * CAST(e.weight AS DOUBLE) / o.t) FROM e JOIN r{k - 1} r ON r.node = e.src JOIN o ON o.src = e.src WHERE e.dst = n.node), 0) AS rank FROM n, c)")
    return ", ".join(parts) + f" SELECT node, round(CAST(rank AS DOUBLE), 6) AS rank FROM r{_RANK_STEPS}"


@query("pagerank", _pagerank_sql(_EDGES))
def pagerank(spark, d):
    """Weighted PageRank of the whole review graph, ten steps (GRA4, GRA6)."""
    return G.pagerank(_nation_edges(spark, d), _RANK_STEPS).withColumn("rank", r6(F.col("rank")))


_HOPS = 24  # at most 25 nodes


def _paths_sql() -> str:
    """Distances by squaring, numbers of shortest paths by their edges, then both centralities."""
    parts = [f"WITH {_EDGES}, n AS MATERIALIZED (SELECT src AS v FROM e UNION SELECT dst FROM e), d0 AS MATERIALIZED (SELECT src AS s, dst AS t, weight AS d FROM e UNION ALL SELECT v, v, 0 FROM n)"]
    for k in range(1, 6):
        parts.append(f"d{k} AS MATERIALIZED (SELECT a.s, b.t, min(a.d + b.d) AS d FROM d{k - 1} a JOIN d{k - 1} b ON a.t = b.s GROUP BY 1, 2)")
    parts.append("p AS MATERIALIZED (SELECT a.s, e.src AS u, e.dst AS t FROM d5 a JOIN e ON e.src = a.t JOIN d5 b ON b.s = a.s AND b.t = e.dst WHERE a.d + e.weight = b.d AND a.s <> e.dst)")
    parts.append("c1 AS MATERIALIZED (SELECT s, t, CAST(1 AS DOUBLE) AS c FROM p WHERE u = s)")
    parts += [f"c{k} AS MATERIALIZED (SELECT p.s, p.t, sum(c) AS c FROM c{k - 1} x JOIN p ON p.s = x.s AND p.u = x.t GROUP BY 1, 2)" for k in range(2, _HOPS + 1)]
    parts.append("g AS MATERIALIZED (SELECT s, t, sum(c) AS c FROM (" + " UNION ALL ".join(f"SELECT * FROM c{k}" for k in range(1, _HOPS + 1)) + ") GROUP BY 1, 2)")
    parts.append("b AS (SELECT x.t AS v, sum(x.c * y.c / g.c) AS b FROM g x JOIN g y ON x.t = y.s JOIN g ON g.s = x.s AND g.t = y.t JOIN d5 dx ON dx.s = x.s AND dx.t = x.t JOIN d5 dy ON dy.s = y.s AND dy.t = y.t JOIN d5 dg ON dg.s = x.s AND dg.t = y.t WHERE dx.d + dy.d = dg.d AND x.s <> y.t GROUP BY 1)")
    parts.append("f AS (SELECT t AS v, count(*) - 1 AS k, sum(d) AS total FROM d5 GROUP BY 1), m AS (SELECT count(*) AS n FROM n)")
    return ", ".join(parts) + " SELECT n.v AS node, round(coalesce(b, 0) / greatest((n - 1) * (n - 2), 1), 6) AS betweenness, round(CASE WHEN total > 0 AND n > 1 THEN CAST(k AS DOUBLE) / total * k / (n - 1) ELSE 0 END, 6) AS closeness FROM m, n LEFT JOIN b USING (v) LEFT JOIN f USING (v)"


_EIGEN_STEPS = 15


def _eigen_sql(rounds: int = _EIGEN_STEPS) -> str:
    parts = [f"WITH {_EDGES}, x0 AS MATERIALIZED (SELECT v AS node, CAST(1 AS DOUBLE) AS value FROM (SELECT src AS v FROM e UNION SELECT dst FROM e))"]
    for k in range(1, rounds + 1):
        parts.append(f"g{k} AS MATERIALIZED (SELECT dst AS node, sum(value * weight) AS got FROM e JOIN x{k - 1} ON src = node GROUP BY 1), y{k} AS MATERIALIZED (SELECT node, value + coalesce(got, 0) AS value FROM x{k - 1} LEFT JOIN g{k} USING (node)), x{k} AS MATERIALIZED (SELECT node, value / (SELECT sqrt(sum(value * value)) FROM y{k}) AS value FROM y{k})")
    return ", ".join(parts) + f" SELECT node, round(value, 6) AS value FROM x{rounds}"


@query("path_centralities", _paths_sql())
def path_centralities(spark, d):
    """Betweenness and closeness of the review graph over weighted paths (GRA4)."""
    return G.path_centralities(_nation_edges(spark, d)).withColumns({c: r6(F.col(c)) for c in ("betweenness", "closeness")})


@query("eigenvector", _eigen_sql())
def eigenvector(spark, d):
    """Eigenvector centrality of the review graph (GRA4)."""
    return G.eigenvector(_nation_edges(spark, d), _EIGEN_STEPS).withColumn("value", r6(F.col("value")))


@query("thread_reply_graph", """WITH t AS (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) SELECT role AS src, prev AS dst, count(*) AS weight FROM t WHERE prev IS NOT NULL GROUP BY 1, 2""")
def thread_reply_graph(spark, d):
    """Who answers whom in threads (GRA3, GRA14)."""
    from pyspark.sql import Window

    prev = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    t = table(spark, d, "conversations").select("conv_id", "role", prev.alias("prev"))
    return G.edges(t, F.col("role"), F.col("prev"), loops=True)


@query("reciprocal_pairs", f"""WITH {_EDGES}, p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(CASE WHEN src < dst THEN weight ELSE 0 END) AS x, sum(CASE WHEN src > dst THEN weight ELSE 0 END) AS y FROM e GROUP BY 1, 2)
SELECT a, b, CAST(x AS BIGINT) AS a_to_b, CAST(y AS BIGINT) AS b_to_a, round(CASE WHEN greatest(x, y) = 0 THEN 0 ELSE least(x, y) / CAST(greatest(x, y) AS DOUBLE) END, 6) AS reciprocity FROM p""")
def reciprocal_pairs(spark, d):
    """Reviews both ways between nations (JOIN9-JOIN11)."""
    return R.reciprocity(_nation_edges(spark, d), "src", "dst", "weight").withColumn("reciprocity", r6(F.col("reciprocity")))


@query("platform_overlap", """WITH a AS (SELECT DISTINCT user_id AS actor, event_type AS source FROM events WHERE event_type IN ('purchase', 'error', 'signup')), s AS (SELECT actor, string_agg(source, '+' ORDER BY source) AS sources FROM a GROUP BY 1) SELECT sources, count(*) AS actors FROM s GROUP BY 1""")
def platform_overlap(spark, d):
    """Users by the set of event types they appear in (SET1-SET3)."""
    e = table(spark, d, "events")
    return R.overlap({t: e.filter(F.col("event_type") == t) for t in ("purchase", "error", "signup")}, "user_id")


@query("only_sets", "SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier")
def only_sets(spark, d):
    """Nations with authors but no reviewers (SET3)."""
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).distinct().join(table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")), "nation", "left_anti")


@query("author_overlap", "WITH a AS (SELECT DISTINCT c_nationkey k FROM customer), b AS (SELECT DISTINCT s_nationkey k FROM supplier) SELECT (SELECT count(*) FROM a) AS first_only_or_both, (SELECT count(*) FROM b) AS second_only_or_both, (SELECT count(*) FROM a JOIN b USING (k)) AS both_sides")
def author_overlap(spark, d):
    """Sizes of two actor sets and of their intersection in one aggregate (SET4, SET7)."""
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    u = a.unionByName(b).groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return u.agg(F.sum("a").alias("first_only_or_both"), F.sum("b").alias("second_only_or_both"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both_sides"))


@query("top10_overlap", """WITH a AS (SELECT o_custkey k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10), b AS (SELECT o_custkey k FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) SELECT count(*) AS shared, count(*) / 10.0 AS share FROM a JOIN b USING (k)""".replace("count(*) / 10.0", "CAST(count(*) AS DOUBLE) / 10"))
def top10_overlap(spark, d):
    """Whether the same authors lead two rankings (SET5)."""
    o = table(spark, d, "orders")

    def top(s):
        return o.filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(10).select("k")

    return top("F").join(top("O"), "k").agg(F.count("*").alias("shared"), (F.count("*").cast("double") / 10).alias("share"))


@query("state_transitions", """WITH a AS (SELECT o_custkey k, max(o_orderpriority) s FROM orders WHERE year(o_orderdate) < 1998 GROUP BY 1), b AS (SELECT o_custkey k, max(o_orderpriority) s FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY 1) SELECT a.s AS "from", b.s AS "to", count(*) AS n FROM a JOIN b USING (k) GROUP BY 1, 2""")
def state_transitions(spark, d):
    """Shifts of authors between periods (JOIN12)."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"), "o_orderpriority")
    a, b = (o.filter(c).groupBy("k").agg(F.max("o_orderpriority").alias("s")) for c in ("y < 1998", "y >= 1998"))
    return R.transitions(a, b, "k", "s")


@query("crosstab_chi2", """WITH t AS (SELECT quality AS a, toxic AS b, CAST(count(*) AS DOUBLE) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2), ra AS (SELECT a, sum(n) r FROM t GROUP BY 1), rb AS (SELECT b, sum(n) c FROM t GROUP BY 1), s AS (SELECT sum(n) s FROM t),
e AS (SELECT coalesce(t.n, 0) AS n, r * c / s AS e, s FROM ra CROSS JOIN rb CROSS JOIN s LEFT JOIN t USING (a, b)), x AS (SELECT sum(power(abs(n - e) - least(0.5, abs(n - e)), 2) / e) AS x, max(s) AS s FROM e)
SELECT round(x, 6) AS chi2, CAST(1 AS BIGINT) AS dof, CAST(s AS BIGINT) AS n, round(sqrt(x / s), 6) AS cramers_v FROM x""")
def crosstab_chi2(spark, d):
    """Chi-square with Yates' correction and Cramer's V (STA1, STA15, AGG14)."""
    out = S.chi_square(S.crosstab(table(spark, d, "labels"), "quality", "toxic"))
    return out.select(r6(F.col("chi2")).alias("chi2"), F.col("dof").cast("long").alias("dof"), F.col("n").cast("long").alias("n"), r6(F.col("cramers_v")).alias("cramers_v"))


@query("cramers_v_priority", """WITH t AS (SELECT o_orderpriority AS a, o_orderstatus AS b, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2), ra AS (SELECT a, sum(n) r FROM t GROUP BY 1), rb AS (SELECT b, sum(n) c FROM t GROUP BY 1), s AS (SELECT sum(n) s FROM t),
x AS (SELECT sum(power(coalesce(t.n, 0) - r * c / s, 2) / (r * c / s)) AS x, max(s) AS s, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb FROM ra CROSS JOIN rb CROSS JOIN s LEFT JOIN t USING (a, b))
SELECT round(x, 6) AS chi2, CAST((ka - 1) * (kb - 1) AS BIGINT) AS dof, CAST(s AS BIGINT) AS n, round(sqrt(x / (s * (least(ka, kb) - 1))), 6) AS cramers_v FROM x""")
def cramers_v_priority(spark, d):
    """A larger table, without correction (STA8)."""
    out = S.chi_square(S.crosstab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus"))
    return out.select(r6(F.col("chi2")).alias("chi2"), F.col("dof").cast("long").alias("dof"), F.col("n").cast("long").alias("n"), r6(F.col("cramers_v")).alias("cramers_v"))


@query("t_stat", """WITH s AS (SELECT count(l_quantity) FILTER (WHERE l_returnflag = 'R') n1, count(l_quantity) FILTER (WHERE l_returnflag <> 'R') n2, avg(l_quantity) FILTER (WHERE l_returnflag = 'R') m1, avg(l_quantity) FILTER (WHERE l_returnflag <> 'R') m2, var_samp(l_quantity) FILTER (WHERE l_returnflag = 'R') v1, var_samp(l_quantity) FILTER (WHERE l_returnflag <> 'R') v2 FROM lineitem)
SELECT n1, n2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round(power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)), 3) AS dof, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS cohens_d FROM s""")
def t_stat(spark, d):
    """Welch's t and Cohen's d (STA2)."""
    t = S.t_test(table(spark, d, "lineitem"), F.col("l_returnflag") == "R", "l_quantity")
    return t.select("n1", "n2", r6(F.col("t")).alias("t"), F.round("dof", 3).alias("dof"), r6(F.col("cohens_d")).alias("cohens_d"))


@query("mann_whitney_u", """WITH r AS (SELECT l_returnflag = 'R' AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rk FROM lineitem), s AS (SELECT sum(rk) FILTER (WHERE g) r1, CAST(count(*) FILTER (WHERE g) AS DOUBLE) n1, CAST(count(*) FILTER (WHERE NOT g) AS DOUBLE) n2 FROM r)
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, r1 - n1 * (n1 + 1) / 2 AS u, round(2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n2) - 1, 6) AS rank_biserial FROM s""")
def mann_whitney_u(spark, d):
    """Mann-Whitney U with mid-ranks (STA3)."""
    return S.mann_whitney(table(spark, d, "lineitem"), F.col("l_returnflag") == "R", "l_quantity").select("n1", "n2", "u", r6(F.col("rank_biserial")).alias("rank_biserial"))


@query("pearson", "SELECT l_returnflag, round(coalesce(corr(l_quantity, l_extendedprice), 0), 6) AS r FROM lineitem GROUP BY 1")
def pearson(spark, d):
    """Correlation of size and price (MTH3)."""
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r6(correlation(F.col("l_quantity"), F.col("l_extendedprice"))).alias("r"))




@query("bh_adjust", "WITH r AS (SELECT *, row_number() OVER (ORDER BY p, test) r, count(*) OVER () m FROM (SELECT p_partkey AS test, CAST(p_size AS DOUBLE) / 60 AS p FROM part)) SELECT test, round(p, 6) AS p, round(least(1.0, min(p * m / r) OVER (ORDER BY r DESC)), 6) AS p_adjusted FROM r")
def bh_adjust(spark, d):
    """Benjamini-Hochberg over all parts (STA5)."""
    t = table(spark, d, "part").select(F.col("p_partkey").alias("test"), (F.col("p_size").cast("double") / 60).alias("p"))
    return S.adjust(t, "p").withColumns({"p": r6(F.col("p")), "p_adjusted": r6(F.col("p_adjusted"))})


@query("trend_regression", "WITH s AS (SELECT CAST(year(o_orderdate) AS DOUBLE) x, CAST(count(*) AS DOUBLE) y FROM orders GROUP BY 1) SELECT round(regr_slope(y, x), 6) AS slope, round(corr(x, y), 6) AS r FROM s")
def trend_regression(spark, d):
    """Line through yearly counts (WIN15)."""
    s = table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("double").alias("x")).agg(F.count("*").cast("double").alias("y"))
    return S.slope(s, F.col("x"), F.col("y")).select(r6(F.col("slope")).alias("slope"), r6(F.col("r")).alias("r"))


@query("dup_keys", "SELECT text, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_keys(spark, d):
    """Texts seen more than once (IDR9)."""
    return Q.duplicates(table(spark, d, "documents"), "text")


@query("dedup_keep_first", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) i FROM events) SELECT event_id, user_id, event_type FROM r WHERE i = 1")
def dedup_keep_first(spark, d):
    """First event of every user and type (IDR1)."""
    e = table(spark, d, "events").withColumn("key", F.concat_ws(":", "user_id", "event_type"))
    return R.keep_first(e, "key", ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("anti_join_new", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join_new(spark, d):
    """Changes without a stored review (JOIN18, DQ8)."""
    return R.new_rows(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("ts_order_check", "SELECT count(*) AS out_of_order FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
def ts_order_check(spark, d):
    """Reviews dated before their change (DQ6)."""
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return Q.out_of_order(j, "o_orderdate", "l_shipdate").agg(F.count("*").alias("out_of_order"))


@query("required_fields", "SELECT f AS field, CAST(CASE f WHEN 'text' THEN (SELECT count(*) FROM documents WHERE text IS NULL OR trim(text) = '') WHEN 'lang' THEN (SELECT count(*) FROM documents WHERE lang IS NULL OR trim(lang) = '') ELSE (SELECT count(*) FROM documents WHERE source IS NULL OR trim(source) = '') END AS BIGINT) AS missing, (SELECT count(*) FROM documents) AS total FROM (VALUES ('text'), ('lang'), ('source')) v(f)")
def required_fields(spark, d):
    """Missing values of required columns (DQ1, DQ10)."""
    return Q.missing_fields(table(spark, d, "documents"), ["text", "lang", "source"])


@query("completeness", "SELECT count(*) AS collected, round(100.0 * count(*) / 2000, 2) AS percentage, count(*) >= 2000 AS complete FROM documents".replace("100.0 * count(*) / 2000", "CAST(count(*) AS DOUBLE) / 2000 * 100"))
def completeness(spark, d):
    """Collected against expected (DQ7, DQ19)."""
    return table(spark, d, "documents").agg(F.count("*").alias("collected")).withColumn("c", Q.completeness(F.col("collected"), F.lit(2000))).select("collected", "c.percentage", "c.complete")


@query("record_errors", "SELECT e AS error, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN o_totalprice <= 1000 THEN 'price' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'state' END], lambda x: x IS NOT NULL)) AS e FROM orders) GROUP BY 1")
def record_errors(spark, d):
    """Failed checks of records (DQ2-DQ5)."""
    e = Q.errors({"price": F.col("o_totalprice") > 1000, "state": F.col("o_orderstatus").isin("F", "O")})
    return table(spark, d, "orders").select(F.explode(e).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


@query("maintainer_inference", """WITH g AS (SELECT CAST(l_suppkey AS VARCHAR) AS actor, count(*) AS merges, date_diff('day', min(l_shipdate), max(l_shipdate)) AS d FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), c AS (SELECT *, CASE WHEN merges >= 10 THEN 'high' WHEN merges >= 5 AND merges / CAST(greatest(d, 1) AS DOUBLE) > 0.1 THEN 'medium' WHEN merges >= 3 AND d > 90 THEN 'low' END AS confidence FROM g)
SELECT actor, merges, confidence FROM c WHERE confidence IS NOT NULL""")
def maintainer_inference(spark, d):
    """Who acts like a maintainer (IDR8)."""
    m = table(spark, d, "lineitem").filter("l_returnflag = 'R'").withColumn("actor", F.col("l_suppkey").cast("string"))
    return I.infer_maintainers(m, "actor", "l_shipdate").select("actor", "merges", "confidence")


@query("identity_union", """WITH u AS (SELECT c_nationkey AS k, 'customer' AS p, lower(c_name) AS id, 1 AS o FROM customer UNION ALL SELECT s_nationkey, 'supplier', lower(s_name), 2 FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o, id) i FROM u)
SELECT max(id) FILTER (WHERE i = 1) AS person, string_agg(DISTINCT p, '+' ORDER BY p) AS platforms, count(*) AS names FROM r GROUP BY k""")
def identity_union(spark, d):
    """Names that share an address become one person (IDR2, IDR3)."""
    c = table(spark, d, "customer").select(F.lit("customer").alias("platform"), F.col("c_name").alias("id"), F.col("c_nationkey").cast("string").alias("email"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("platform"), F.col("s_name").alias("id"), F.col("s_nationkey").cast("string").alias("email"))
    return I.unify(c.unionByName(s), ["customer", "supplier"]).withColumn("platforms", F.array_join("platforms", "+"))


@query("overlay_lookup", "SELECT o_orderkey, CASE WHEN s_suppkey IS NOT NULL THEN s_name ELSE o_orderpriority END AS label FROM orders LEFT JOIN supplier ON o_orderkey = s_suppkey")
def overlay_lookup(spark, d):
    """Left lookup that replaces a column (SRC2, JOIN1, SRC33)."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label"))
    m = table(spark, d, "supplier").select(F.col("s_suppkey").alias("o_orderkey"), F.col("s_name").alias("label"))
    return R.overlay(o, m, "o_orderkey", ["label"])


@query("resolve_identity", "SELECT coalesce(n_name, 'nation ' || CAST(c_nationkey + 100 AS VARCHAR)) AS nation, count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3 GROUP BY 1".replace("'nation ' || CAST(c_nationkey + 100 AS VARCHAR)", "CAST(c_nationkey AS VARCHAR)"))
def resolve_identity(spark, d):
    """Unknown identities stay as they are (JOIN2)."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("nation"))
    m = table(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").cast("string").alias("s"), F.col("n_name").alias("t"))
    return R.resolve(c, m, "nation", "s", "t").groupBy("nation").agg(F.count("*").alias("n"))


@query("snapshot_diff", """WITH s AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, list_sort(list(DISTINCT o_orderpriority) FILTER (WHERE o_totalprice > 499500)) AS n FROM orders GROUP BY 1), l AS (SELECT y, coalesce(n, []) AS n, coalesce(lag(n) OVER (ORDER BY y), []) AS b FROM s)
SELECT y, array_to_string(list_sort(list_filter(n, lambda x: NOT list_contains(b, x))), ',') AS added, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(n, x))), ',') AS removed FROM l""")
def snapshot_diff(spark, d):
    """What each year's set adds and drops (WIN18)."""
    s = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.sort_array(F.collect_set(F.when(F.col("o_totalprice") > 499500, F.col("o_orderpriority")))).alias("n"))
    out = W.snapshot_diff(s, "y", "n")
    return out.select("y", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))
