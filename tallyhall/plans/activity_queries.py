"""Rates, trends, sessions, cohorts and look-backs over changes, reviews and events.

Roles: orders are changes (author o_custkey; status F merged, P open, O closed),
lineitem holds their reviews (reviewer l_suppkey, state l_returnflag), events is
an activity stream.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyhall.functions.dates import days_between, hours_between, month_label, quarter_label, whole_days
from tallyhall.functions.numbers import r6, ratio, upper_median, wald_interval
from tallyhall.operators import relational as R
from tallyhall.operators import windows as W
from tallyhall.operators.classify import importance_by_size
from tallyhall.operators.concentration import concentration
from tallyhall.plans.concentration_queries import _CONCENTRATION_SQL
from tallyhall.plans.registry import query, table

def merged():
    return F.col("o_orderstatus") == "F"


def _orders(spark, d):
    return table(spark, d, "orders")


def _line(spark, d):
    return table(spark, d, "lineitem")


def _events(spark, d):
    return table(spark, d, "events")


@query("status_rate_by_year", """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS hits,
round(count(*) FILTER (WHERE o_orderstatus = 'F') / CAST(count(*) AS DOUBLE), 6) AS rate FROM orders GROUP BY 1 HAVING count(*) >= 10""")
def status_rate_by_year(spark, d):
    """Share of changes merged per year, years of at least ten (AGG6, FIL18, QRY11)."""
    return R.rate_by(_orders(spark, d), [F.year("o_orderdate").alias("year")], merged(), 10).withColumn("rate", r6(F.col("rate")))


@query("quarterly_trends", """SELECT CAST(year(o_orderdate) AS VARCHAR) || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS hits,
round(count(*) FILTER (WHERE o_orderstatus = 'F') / CAST(count(*) AS DOUBLE), 6) AS rate FROM orders GROUP BY 1 HAVING count(*) >= 5""")
def quarterly_trends(spark, d):
    """The same per quarter, of at least five (DAT4, QRY12)."""
    return R.rate_by(_orders(spark, d), [quarter_label(F.col("o_orderdate")).alias("quarter")], merged(), 5).withColumn("rate", r6(F.col("rate")))


@query("count_by_period", "SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n FROM orders GROUP BY 1")
def count_by_period(spark, d):
    """Changes per month (AGG2, DAT5)."""
    return _orders(spark, d).groupBy(month_label(F.col("o_orderdate")).alias("period")).agg(F.count("*").alias("n"))


@query("count_by_actor_by_period", "SELECT CAST(year(o_orderdate) AS INTEGER) AS period, o_custkey AS actor, count(*) AS n FROM orders GROUP BY 1, 2")
def count_by_actor_by_period(spark, d):
    """Changes per author and year (AGG4)."""
    return _orders(spark, d).groupBy(F.year("o_orderdate").alias("period"), F.col("o_custkey").alias("actor")).agg(F.count("*").alias("n"))


@query("rate_by_period_full_outer", """SELECT coalesce(a.p, b.p) AS period, CAST(coalesce(a.n, 0) AS BIGINT) AS numerator, CAST(coalesce(b.n, 0) AS BIGINT) AS denominator,
round(CASE WHEN coalesce(b.n, 0) = 0 THEN 0.0 ELSE coalesce(a.n, 0) / CAST(b.n AS DOUBLE) END, 6) AS rate
FROM (SELECT strftime(l_shipdate, '%Y-%m') p, count(*) n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a
FULL JOIN (SELECT strftime(o_orderdate, '%Y-%m') p, count(*) n FROM orders GROUP BY 1) b ON a.p = b.p""")
def rate_by_period_full_outer(spark, d):
    """Rejecting reviews per change, by month of either (AGG5)."""
    num = _line(spark, d).filter("l_returnflag = 'R'").select(month_label(F.col("l_shipdate")).alias("period"))
    den = _orders(spark, d).select(month_label(F.col("o_orderdate")).alias("period"))
    return R.rate_of_two(num, den, "period").withColumn("rate", r6(F.col("rate")))


_MONTHLY = "SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n FROM orders GROUP BY 1"


def _monthly(spark, d):
    return _orders(spark, d).groupBy(month_label(F.col("o_orderdate")).alias("period")).agg(F.count("*").alias("n"))


@query("moving_average_monthly", f"SELECT period, n, round(CASE WHEN count(*) OVER () < 3 THEN n ELSE avg(n) OVER (ORDER BY period ROWS 2 PRECEDING) END, 6) AS moving_average FROM ({_MONTHLY})")
def moving_average_monthly(spark, d):
    """Trailing three-month mean (WIN5)."""
    return W.moving_average(_monthly(spark, d), "period", "n").withColumn("moving_average", r6(F.col("moving_average")))


@query("trend_monthly", f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY period) u, row_number() OVER (ORDER BY period DESC) v FROM ({_MONTHLY})),
a AS (SELECT CAST(min_by(n, period) AS DOUBLE) AS first, CAST(max_by(n, period) AS DOUBLE) AS last, avg(n) FILTER (WHERE u <= 3) AS early, avg(n) FILTER (WHERE v <= 3) AS recent FROM s),
c AS (SELECT *, (recent - early) / early * 100 AS ch FROM a)
SELECT first, last, round(early, 6) AS early, round(recent, 6) AS recent, round(ch, 6) AS change_pct, CASE WHEN ch > 10 THEN 'increasing' WHEN ch < -10 THEN 'decreasing' ELSE 'stable' END AS direction FROM c""")
def trend_monthly(spark, d):
    """First against last quarter of the series (WIN6)."""
    t = W.trend(_monthly(spark, d), "period", "n")
    return t.withColumns({c: r6(F.col(c)) for c in ("early", "recent", "change_pct")})


@query("activity_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) / 3600000000.0 > 6 THEN 1 ELSE 0 END AS g FROM events),
s AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, CAST(session AS BIGINT) AS session, CAST(min(ts) AS VARCHAR) AS start_ts, CAST(max(ts) AS VARCHAR) AS end_ts, count(*) AS n FROM s GROUP BY 1, 2""")
def activity_sessions(spark, d):
    """Periods of activity split by gaps of over six hours (WIN2)."""
    e = _events(spark, d)
    order = W.timeline("user_id", "ts")
    gap = hours_between(F.lag("ts").over(order), F.col("ts")) > 6
    s = W.gap_sessions(e, "user_id", "ts", gap)
    return s.select("user_id", "session", F.col("start").cast("string").alias("start_ts"), F.col("end").cast("string").alias("end_ts"), "n")


@query("inferred_tenure", """WITH e AS (SELECT o_custkey AS actor, o_orderdate AS ts, CASE WHEN date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), o_orderdate) > 180 THEN 1 ELSE 0 END AS g FROM orders),
s AS (SELECT *, sum(g) OVER (PARTITION BY actor ORDER BY ts ROWS UNBOUNDED PRECEDING) AS p FROM e), q AS (SELECT actor, p, min(ts) a, max(ts) b, count(*) n FROM s GROUP BY 1, 2)
SELECT actor, CAST(p AS BIGINT) AS session, CAST(CAST(a AS DATE) AS VARCHAR) AS start_day, CASE WHEN date_diff('day', b, TIMESTAMP '2001-08-02') < 90 THEN NULL ELSE CAST(CAST(b AS DATE) AS VARCHAR) END AS end_day, n FROM q""")
def inferred_tenure(spark, d):
    """Tenure periods by calendar days: gaps of over 180 days split, recent ends stay open (WIN4)."""
    o = _orders(spark, d).select(F.col("o_custkey").alias("actor"), F.col("o_orderdate").cast("date").alias("ts"))
    t = W.tenure(o, "actor", "ts", F.lit("2001-08-02").cast("timestamp_ntz"))
    return t.select("actor", "session", F.col("start").cast("date").cast("string").alias("start_day"), F.col("end").cast("date").cast("string").alias("end_day"), "n")


_SCORED = """SELECT user_id, event_id, CAST(ts AS DATE) AS day, ts, event_type,
CASE WHEN event_type = 'purchase' THEN CASE WHEN value > 50 THEN 1.0 WHEN value > 10 THEN 0.8 ELSE 0.5 END ELSE 0.2 END AS s FROM events WHERE event_type IN ('purchase', 'view')"""


@query("completion_signal_score", f"""WITH e AS ({_SCORED}),
w AS (SELECT *, coalesce(max(CASE WHEN event_type = 'purchase' AND s >= 0.7 THEN 1 END) OVER (PARTITION BY day, user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM e),
b AS (SELECT day, user_id, max(s) AS b FROM w WHERE NOT (event_type = 'view' AND done = 1) GROUP BY 1, 2)
SELECT CAST(day AS VARCHAR) AS day, round(CAST(sum(b) AS DOUBLE), 6) AS score FROM b GROUP BY 1""")
def completion_signal_score(spark, d):
    """Best score per user and day; a view after a substantial purchase doesn't count (WIN1)."""
    e = _events(spark, d).filter(F.col("event_type").isin("purchase", "view")).withColumn("day", F.to_date("ts"))
    score = F.when(F.col("event_type") == "purchase", F.when(F.col("value") > 50, 1.0).when(F.col("value") > 10, 0.8).otherwise(0.5)).otherwise(0.2)
    out = W.completion_signal(e, "day", "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_type") == "view", score)
    return out.select(F.col("day").cast("string").alias("day"), r6(F.col("score")).alias("score"))


@query("first_response_hours", """WITH f AS (SELECT o_orderkey, o_orderpriority, min(date_diff('microsecond', o_orderdate, l_shipdate) / 3600000000.0) FILTER (WHERE l_shipdate > o_orderdate) AS h FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT o_orderpriority, count(h) AS responded, round(avg(h), 6) AS mean_hours, round(quantile_cont(h, 0.5), 6) AS median_hours FROM f GROUP BY 1""")
def first_response_hours(spark, d):
    """Hours to the first review after creation (WIN12, WIN13, DAT8)."""
    lines = _line(spark, d).groupBy("l_orderkey", "l_shipdate").count().select("l_orderkey", "l_shipdate")
    j = _orders(spark, d).select("o_orderkey", "o_orderdate", "o_orderpriority").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    first = j.groupBy("o_orderkey", "o_orderpriority").agg(F.min(F.when(F.col("l_shipdate") > F.col("o_orderdate"), hours_between(F.col("o_orderdate"), F.col("l_shipdate")))).alias("h"))
    return first.groupBy("o_orderpriority").agg(F.count("h").alias("responded"), r6(F.avg("h")).alias("mean_hours"), r6(F.percentile("h", F.lit(0.5))).alias("median_hours"))


@query("cohort_retention", """WITH s AS (SELECT o_custkey, min(o_orderdate) a, max(o_orderdate) b FROM orders GROUP BY 1)
SELECT CAST(year(a) AS INTEGER) AS cohort, count(*) AS joined, count(*) FILTER (WHERE date_diff('day', b, TIMESTAMP '2001-08-02') < 365) AS active,
round(count(*) FILTER (WHERE date_diff('day', b, TIMESTAMP '2001-08-02') < 365) / CAST(count(*) AS DOUBLE), 6) AS retention FROM s GROUP BY 1""")
def cohort_retention(spark, d):
    """Retention by year of the first change (AGG17)."""
    out = W.retention(_orders(spark, d), "o_custkey", "o_orderdate", F.lit("2001-08-02").cast("timestamp_ntz"))
    return out.withColumn("retention", r6(F.col("retention")))


@query("first_event_cohorts", """WITH f AS (SELECT o_custkey, min((o_orderdate, o_orderkey)) AS f FROM orders GROUP BY 1), c AS (SELECT o_custkey, CAST(year(f[1]) AS INTEGER) AS cohort FROM f)
SELECT cohort, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS merged, round(avg(o_totalprice), 4) AS mean_size FROM orders JOIN c USING (o_custkey) GROUP BY 1""".replace("min((o_orderdate, o_orderkey)) AS f", "[min(o_orderdate)] AS f"))
def first_event_cohorts(spark, d):
    """Outcome of changes by the year their author started (WIN7-WIN9)."""
    o = _orders(spark, d)
    first = W.first_event(o, "o_custkey", "o_orderdate").select("o_custkey", F.year("o_orderdate").alias("cohort"))
    return o.join(first, "o_custkey").groupBy("cohort").agg(F.count("*").alias("n"), F.count_if(merged()).alias("merged"), F.round(F.avg("o_totalprice"), 4).alias("mean_size"))


@query("validity_interval_join", """WITH e AS (SELECT user_id, event_id, ts, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) / 3600000000.0 > 12 THEN 1 ELSE 0 END AS g FROM events WHERE event_type = 'purchase'),
s AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS p FROM e), q AS (SELECT user_id, p, min(ts) a, max(ts) b FROM s GROUP BY 1, 2)
SELECT event_type, count(*) AS n FROM events e WHERE EXISTS (SELECT 1 FROM q WHERE q.user_id = e.user_id AND e.ts BETWEEN q.a AND q.b) GROUP BY 1""")
def validity_interval_join(spark, d):
    """Events inside a purchase period of their user (JOIN5)."""
    e = _events(spark, d)
    order = W.timeline("user_id", "ts")
    p = W.gap_sessions(e.filter("event_type = 'purchase'"), "user_id", "ts", hours_between(F.lag("ts").over(order), F.col("ts")) > 12)
    return R.during(e, p, "user_id", "ts", F.lit("2024-12-31").cast("timestamp_ntz")).groupBy("event_type").agg(F.count("*").alias("n"))


_PHASES = [("growth", "1995-01-01", "1997-06-30"), ("middle", "1997-07-01", "1999-12-31"), ("late", "2000-01-01", "2001-12-31")]
_PHASE_SQL = "CASE " + " ".join(f"WHEN o_orderdate BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}' THEN '{n}'" for n, a, b in _PHASES) + " END"


def _phase():
    out = None
    for n, a, b in _PHASES:
        c = F.col("o_orderdate").between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz"))
        out = F.when(c, n) if out is None else out.when(c, n)
    return out


@query("phase_metrics", f"""WITH o AS (SELECT *, {_PHASE_SQL} AS ph FROM orders)
SELECT coalesce(ph, 'all') AS phase, count(*) AS n, count(DISTINCT o_custkey) AS authors, round(count(*) FILTER (WHERE o_orderstatus = 'F') / CAST(count(*) AS DOUBLE), 6) AS merge_rate
FROM o WHERE ph IS NOT NULL GROUP BY GROUPING SETS ((ph), ())""")
def phase_metrics(spark, d):
    """Metrics per phase and over all phases (AGG16, QRY46)."""
    o = _orders(spark, d).withColumn("ph", _phase()).filter("ph IS NOT NULL")
    g = o.rollup("ph").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("authors"), r6(F.count_if(merged()) / F.count("*")).alias("merge_rate"))
    return g.select(F.coalesce("ph", F.lit("all")).alias("phase"), "n", "authors", "merge_rate")


@query("before_merge_join", """SELECT l_suppkey AS reviewer, count(*) AS changes, CAST(sum(m) AS DOUBLE) AS score FROM (SELECT l_orderkey, l_suppkey, max(l_quantity) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_shipdate < o_orderdate + INTERVAL 30 DAY GROUP BY 1, 2) GROUP BY 1""")
def before_merge_join(spark, d):
    """Best review per change and reviewer within thirty days (JOIN6)."""
    e = _orders(spark, d).select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("limit"))
    best = R.best_before(_line(spark, d), e, "l_orderkey", "l_shipdate", "limit", "l_suppkey", "l_quantity")
    return best.groupBy(F.col("l_suppkey").alias("reviewer")).agg(F.count("*").alias("changes"), F.sum("score").cast("double").alias("score"))


@query("friend_pairs", """WITH p AS (SELECT l_suppkey AS merger, o_custkey AS author, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), s AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY author) AS DOUBLE) AS share FROM p)
SELECT merger, author, n, round(share, 6) AS share FROM s WHERE share >= 0.05 ORDER BY s.share DESC, n DESC, author, merger LIMIT 50""")
def friend_pairs(spark, d):
    """Pairs where one reviewer handles a large share of an author's work: top 50 (TOP4, AGG20)."""
    p = _line(spark, d).select("l_orderkey", F.col("l_suppkey").alias("merger")).join(_orders(spark, d).select("o_orderkey", F.col("o_custkey").alias("author")), F.col("l_orderkey") == F.col("o_orderkey"))
    s = W.share(p.groupBy("merger", "author").agg(F.count("*").alias("n")), "n", ["author"]).filter("share >= 0.05")
    return s.orderBy(F.desc("share"), F.desc("n"), "author", "merger").limit(50).withColumn("share", r6(F.col("share")))


@query("janitors", """SELECT l_suppkey AS merger, count(DISTINCT o_custkey) AS authors, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(DISTINCT o_custkey) >= 10""")
def janitors(spark, d):
    """Reviewers of at least ten authors (TOP4, AGG7)."""
    p = _line(spark, d).join(_orders(spark, d), F.col("l_orderkey") == F.col("o_orderkey"))
    return p.groupBy(F.col("l_suppkey").alias("merger")).agg(F.countDistinct("o_custkey").alias("authors"), F.count("*").alias("n")).filter("authors >= 10")


@query("power_hierarchy", """WITH p AS (SELECT l_suppkey AS merger, o_custkey AS author, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY merger ORDER BY n DESC, author) AS rank FROM p) SELECT merger, author, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def power_hierarchy(spark, d):
    """Five most frequent authors of every reviewer (WIN11)."""
    p = _line(spark, d).join(_orders(spark, d), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_suppkey").alias("merger"), F.col("o_custkey").alias("author")).agg(F.count("*").alias("n"))
    return W.top_per_group(p, ["merger"], [F.desc("n"), "author"], 5)


@query("yearly_concentration", """WITH c AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey AS actor, count(*) AS x FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY x, actor) i FROM c)
SELECT year, count(*) AS contributors, round((2.0 * sum(i * x) - (count(*) + 1) * sum(x)) / (count(*) * CAST(sum(x) AS DOUBLE)), 6) AS gini, round(sum(x * x) / (CAST(sum(x) AS DOUBLE) * sum(x)), 6) AS hhi FROM r GROUP BY 1""")
def yearly_concentration(spark, d):
    """Gini and HHI per year (CON6, QRY9)."""
    c = _orders(spark, d).groupBy(F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("actor")).agg(F.count("*").alias("x"))
    return concentration(c, ["year"]).select("year", "contributors", "gini", "hhi")


@query("compare_concentration", """WITH c AS (SELECT CASE WHEN year(o_orderdate) < 1998 THEN 'early' ELSE 'late' END AS period, o_custkey AS actor, count(*) AS x FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY x, actor) i FROM c),
g AS (SELECT period, (2.0 * sum(i * x) - (count(*) + 1) * sum(x)) / (count(*) * CAST(sum(x) AS DOUBLE)) AS g FROM r GROUP BY 1), a AS (SELECT round(max(g) FILTER (WHERE period = 'early'), 6) AS early, round(max(g) FILTER (WHERE period = 'late'), 6) AS late FROM g)
SELECT early, late, round(late - early, 6) AS change, CASE WHEN late - early > 0.05 THEN 'more_concentrated' WHEN late - early < -0.05 THEN 'less_concentrated' ELSE 'stable' END AS direction FROM a""")
def compare_concentration(spark, d):
    """Two periods against each other (CON8)."""
    period = F.when(F.year("o_orderdate") < 1998, "early").otherwise("late").alias("period")
    c = _orders(spark, d).groupBy(period, F.col("o_custkey").alias("actor")).agg(F.count("*").alias("x"))
    g = concentration(c, ["period"]).agg(F.max(F.when(F.col("period") == "early", F.col("gini"))).alias("early"), F.max(F.when(F.col("period") == "late", F.col("gini"))).alias("late"))
    diff = F.col("late") - F.col("early")
    return g.select("early", "late", r6(diff).alias("change"), F.when(diff > 0.05, "more_concentrated").when(diff < -0.05, "less_concentrated").otherwise("stable").alias("direction"))


@query("contributor_concentration", _CONCENTRATION_SQL.format(counts="SELECT user_id AS actor, count(*) AS x FROM events GROUP BY 1"))
def contributor_concentration(spark, d):
    """Concentration of activity over users (QRY8)."""
    return concentration(_events(spark, d).groupBy(F.col("user_id").alias("actor")).agg(F.count("*").alias("x")))


@query("release_concentration", _CONCENTRATION_SQL.format(counts="SELECT s_nationkey AS actor, count(*) AS x FROM supplier GROUP BY 1"))
def release_concentration(spark, d):
    """Concentration of signers over organisations (QRY7, CON19)."""
    return concentration(table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("actor")).agg(F.count("*").alias("x")))


@query("entropy_by_actor", """WITH c AS (SELECT l_suppkey, count(*) AS x FROM lineitem GROUP BY 1), p AS (SELECT x / CAST(sum(x) OVER () AS DOUBLE) AS p FROM c)
SELECT round(-sum(p * log2(p)), 6) AS entropy, round(-sum(p * log2(p)) / log2(count(*)), 6) AS normalised, count(*) AS actors FROM p""")
def entropy_by_actor(spark, d):
    """Shannon entropy of reviews over reviewers (CON16).

    H = log2(S) - sum(x log2 x) / S: one aggregate, no window over all actors.
    """
    c = _line(spark, d).groupBy("l_suppkey").agg(F.count("*").cast("double").alias("x"))
    h = F.log2(F.sum("x")) - F.sum(F.col("x") * F.log2("x")) / F.sum("x")
    return c.agg(r6(h).alias("entropy"), r6(h / F.log2(F.count("*"))).alias("normalised"), F.count("*").alias("actors"))


@query("pareto_ratio", """WITH c AS (SELECT l_suppkey, count(*) AS x FROM lineitem GROUP BY 1), r AS (SELECT x, row_number() OVER (ORDER BY x DESC, l_suppkey) AS i, count(*) OVER () AS n, sum(x) OVER () AS s FROM c)
SELECT round(sum(x) FILTER (WHERE i <= floor(0.2 * n)) / CAST(max(s) AS DOUBLE), 6) AS top_share, sum(x) FILTER (WHERE i <= floor(0.2 * n)) / CAST(max(s) AS DOUBLE) >= 0.8 AS is_pareto FROM r""")
def pareto_ratio(spark, d):
    """Share of the top fifth of reviewers (CON15), ranked by a count of counts."""
    c = _line(spark, d).groupBy("l_suppkey").agg(F.count("*").alias("x"))
    runs = c.groupBy("x").agg(F.count("*").alias("m"))
    above = F.coalesce(F.sum("m").over(Window.orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = runs.withColumns({"above": above, "n": F.sum("m").over(Window.partitionBy(F.lit(1)))})
    taken = F.least(F.col("m"), F.greatest(F.lit(0), F.floor(0.2 * F.col("n")) - F.col("above")))
    share = F.sum(F.col("x") * taken) / F.sum(F.col("x") * F.col("m"))
    return t.agg(r6(share).alias("top_share"), (share >= 0.8).alias("is_pareto"))


@query("combined_power", """WITH a AS (SELECT o_custkey k, count(*) x FROM orders GROUP BY 1), ra AS (SELECT x, row_number() OVER (ORDER BY x, k) i FROM a), b AS (SELECT l_suppkey k, count(*) x FROM lineitem GROUP BY 1), rb AS (SELECT x, row_number() OVER (ORDER BY x, k) i FROM b),
g AS (SELECT (2.0 * sum(i * x) - (count(*) + 1) * sum(x)) / (count(*) * CAST(sum(x) AS DOUBLE)) AS g FROM ra UNION ALL SELECT (2.0 * sum(i * x) - (count(*) + 1) * sum(x)) / (count(*) * CAST(sum(x) AS DOUBLE)) FROM rb)
SELECT round(avg(g), 5) AS combined FROM g""")
def combined_power(spark, d):
    """Mean Gini of two roles (CON18)."""
    a = concentration(_orders(spark, d).groupBy("o_custkey").agg(F.count("*").alias("x")), digits=12).select("gini")
    b = concentration(_line(spark, d).groupBy("l_suppkey").agg(F.count("*").alias("x")), digits=12).select("gini")
    return a.unionByName(b).agg(F.round(F.avg("gini"), 5).alias("combined"))


@query("outcome_uniformity", """SELECT l_returnflag, CAST(floor(l_quantity / 10) AS BIGINT) AS size, count(*) AS n, min(l_linestatus) = max(l_linestatus) AS consistent FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2""")
def outcome_uniformity(spark, d):
    """Whether like reviews have like outcomes (AGG13)."""
    return R.uniformity(_line(spark, d), ["l_returnflag", F.floor(F.col("l_quantity") / 10).alias("size")], "l_linestatus")


_SIZE = "CASE WHEN o_totalprice < 50000 THEN 'trivial' WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 200000 THEN 'normal' WHEN o_totalprice < 300000 THEN 'high' ELSE 'critical' END"


def _size():
    p = F.col("o_totalprice")
    return F.when(p < 50000, "trivial").when(p < 100000, "low").when(p < 200000, "normal").when(p < 300000, "high").otherwise("critical")


@query("importance_matrix", f"""SELECT {_SIZE} AS importance, count(*) FILTER (WHERE o_orderstatus = 'F') AS merged, count(*) FILTER (WHERE o_orderstatus = 'P') AS open, count(*) FILTER (WHERE o_orderstatus = 'O') AS closed FROM orders GROUP BY 1""")
def importance_matrix(spark, d):
    """Importance against outcome (AGG15, QRY3)."""
    p = _orders(spark, d).groupBy(_size().alias("importance")).pivot("o_orderstatus", ["F", "P", "O"]).count().na.fill(0)
    return p.select("importance", F.col("F").alias("merged"), F.col("P").alias("open"), F.col("O").alias("closed"))


@query("size_buckets", """SELECT CASE WHEN l_quantity < 10 THEN 'trivial' WHEN l_quantity < 50 THEN 'low' ELSE 'normal' END AS size, count(*) AS n, round(avg(l_extendedprice), 4) AS mean_price FROM lineitem GROUP BY 1""")
def size_buckets(spark, d):
    """Reviews by size class (CLS3, QRY70)."""
    return _line(spark, d).groupBy(importance_by_size(F.col("l_quantity")).alias("size")).agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"))


@query("speed_factors", """WITH f AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, date_diff('day', o_orderdate, max(l_shipdate)) AS days FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderstatus, o_orderdate)
SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(days), 6) AS mean_days FROM f GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus))""")
def speed_factors(spark, d):
    """Days to the last review by priority and by outcome, in one pass (QRY64, QRY13)."""
    last = _line(spark, d).groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    f = _orders(spark, d).join(last, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("days", F.datediff("last", "o_orderdate"))
    sets = [[F.col("o_orderpriority")], [F.col("o_orderstatus")]]
    return f.groupingSets(sets, "o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), r6(F.avg("days")).alias("mean_days"))


@query("survivorship", """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS merged, count(*) FILTER (WHERE o_orderstatus = 'O') AS rejected, count(*) FILTER (WHERE o_orderstatus = 'P') AS open, round(count(*) FILTER (WHERE o_orderstatus = 'F') / CAST(count(*) AS DOUBLE), 6) AS survival FROM orders GROUP BY 1""")
def survivorship(spark, d):
    """Who gets through, by priority (QRY22)."""
    s = F.col("o_orderstatus")
    return _orders(spark, d).groupBy("o_orderpriority").agg(F.count_if(s == "F").alias("merged"), F.count_if(s == "O").alias("rejected"), F.count_if(s == "P").alias("open"), r6(F.count_if(s == "F") / F.count("*")).alias("survival"))


@query("trajectories", """WITH a AS (SELECT o_custkey, count(*) n, max(year(o_orderdate)) y FROM orders GROUP BY 1) SELECT CASE WHEN n = 1 THEN 'one_time' WHEN y < 2000 THEN 'exited' ELSE 'persistent' END AS trajectory, count(*) AS actors, CAST(sum(n) AS BIGINT) AS changes FROM a GROUP BY 1""")
def trajectories(spark, d):
    """One-time, exited and persistent authors (QRY23)."""
    a = _orders(spark, d).groupBy("o_custkey").agg(F.count("*").alias("n"), F.max(F.year("o_orderdate")).alias("y"))
    return a.groupBy(F.when(F.col("n") == 1, "one_time").when(F.col("y") < 2000, "exited").otherwise("persistent").alias("trajectory")).agg(F.count("*").alias("actors"), F.sum("n").alias("changes"))


@query("abandonment", """SELECT count(*) AS closed, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS abandoned FROM orders WHERE o_orderstatus = 'O'""")
def abandonment(spark, d):
    """Closed changes without any review (QRY24)."""
    closed = _orders(spark, d).filter("o_orderstatus = 'O'")
    some = _line(spark, d).select("l_orderkey").distinct()
    j = closed.join(some, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.agg(F.count("*").alias("closed"), F.count_if(F.col("l_orderkey").isNull()).alias("abandoned"))


@query("quality_retention", """WITH a AS (SELECT o_custkey, avg(o_totalprice) / 1000 AS q, count(*) n FROM orders GROUP BY 1) SELECT q > 150 AS high_quality, count(*) AS actors, round(avg(CASE WHEN n > 5 THEN 1.0 ELSE 0.0 END), 6) AS retained FROM a GROUP BY 1""")
def quality_retention(spark, d):
    """Whether authors of larger changes stay (QRY25)."""
    a = _orders(spark, d).groupBy("o_custkey").agg((F.avg("o_totalprice") / 1000).alias("q"), F.count("*").alias("n"))
    return a.groupBy((F.col("q") > 150).alias("high_quality")).agg(F.count("*").alias("actors"), r6(F.avg(F.when(F.col("n") > 5, 1.0).otherwise(0.0))).alias("retained"))


@query("tournament_tiers", """WITH a AS (SELECT o_custkey, count(*) n FROM orders GROUP BY 1), t AS (SELECT CASE WHEN n >= 20 THEN 'top' WHEN n >= 15 THEN 'upper' WHEN n >= 10 THEN 'middle' ELSE 'base' END AS tier, n FROM a) SELECT tier, count(*) AS actors, CAST(sum(n) AS BIGINT) AS changes, round(avg(n), 6) AS mean FROM t GROUP BY 1""")
def tournament_tiers(spark, d):
    """Tiers of authors by output (QRY26)."""
    a, n = _orders(spark, d).groupBy("o_custkey").agg(F.count("*").alias("n")), F.col("n")
    return a.groupBy(F.when(n >= 20, "top").when(n >= 15, "upper").when(n >= 10, "middle").otherwise("base").alias("tier")).agg(F.count("*").alias("actors"), F.sum("n").alias("changes"), r6(F.avg("n")).alias("mean"))


@query("threshold_sweep", "SELECT t AS threshold, l_linestatus AS period, count(*) AS n, count(*) FILTER (WHERE l_quantity < t) AS hits, round(count(*) FILTER (WHERE l_quantity < t) / CAST(count(*) AS DOUBLE), 6) AS rate FROM lineitem CROSS JOIN (VALUES (5), (10), (15), (20), (25), (30), (35)) v(t) GROUP BY 1, 2")
def threshold_sweep(spark, d):
    """A rate under seven thresholds, in one pass (STA12-STA14).

    The thresholds are columns of one aggregate, so no row is repeated.
    """
    steps = (5, 10, 15, 20, 25, 30, 35)
    one = _line(spark, d).groupBy(F.col("l_linestatus").alias("period")).agg(F.count("*").alias("n"), *[F.count_if(F.col("l_quantity") < t).alias(f"t{t}") for t in steps])
    rows = one.select("period", "n", F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("hits")) for t in steps])).alias("r"))
    return rows.select("r.threshold", "period", "n", "r.hits", r6(F.col("r.hits") / F.col("n")).alias("rate"))


@query("wald_ci", """WITH a AS (SELECT o_orderpriority, count(*) n, count(*) FILTER (WHERE o_orderstatus = 'F') k FROM orders GROUP BY 1), p AS (SELECT *, k / CAST(n AS DOUBLE) AS p FROM a)
SELECT o_orderpriority, n, k AS hits, round(greatest(0.0, p - 1.96 * sqrt(p * (1 - p) / n)) * 100, 6) AS low, round(least(1.0, p + 1.96 * sqrt(p * (1 - p) / n)) * 100, 6) AS high FROM p""")
def wald_ci(spark, d):
    """Wald interval of the merge rate (STA7, STA9)."""
    a = _orders(spark, d).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(merged()).alias("hits"))
    lo, hi = wald_interval(F.col("hits"), F.col("n"))
    return a.withColumns({"low": r6(lo), "high": r6(hi)})


@query("upper_median_price", "SELECT o_orderstatus, list_sort(list(o_totalprice))[len(list(o_totalprice)) // 2 + 1] AS median FROM orders GROUP BY 1")
def upper_median_price(spark, d):
    """Median by index (AGG9)."""
    return _orders(spark, d).groupBy("o_orderstatus").agg(upper_median(F.col("o_totalprice")).alias("median"))


@query("coefficient_of_variation", "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sd, round(stddev_pop(l_quantity) / avg(l_quantity), 6) AS cv FROM lineitem GROUP BY 1")
def coefficient_of_variation(spark, d):
    """Population deviation and CV (AGG11)."""
    q = F.col("l_quantity")
    return _line(spark, d).groupBy("l_returnflag").agg(r6(F.stddev_pop(q)).alias("sd"), r6(F.stddev_pop(q) / F.avg(q)).alias("cv"))


@query("two_level_rates", "WITH a AS (SELECT l_suppkey, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS r FROM lineitem GROUP BY 1) SELECT round(avg(r), 6) AS mean_rate, count(*) AS actors FROM a")
def two_level_rates(spark, d):
    """Unweighted mean of per-reviewer rates (AGG12)."""
    a = _line(spark, d).groupBy("l_suppkey").agg(F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("r"))
    return a.agg(r6(F.avg("r")).alias("mean_rate"), F.count("*").alias("actors"))


@query("behaviour_over_time", """WITH a AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) n, count(*) FILTER (WHERE o_orderstatus = 'F') k FROM orders GROUP BY 1, 2 HAVING count(*) >= 2), b AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) c FROM a)
SELECT o_custkey, year, n, round(k / CAST(n AS DOUBLE), 6) AS rate FROM b WHERE c >= 2""")
def behaviour_over_time(spark, d):
    """Authors active in at least two years (AGG19)."""
    a = R.rate_by(_orders(spark, d), ["o_custkey", F.year("o_orderdate").alias("year")], merged(), 2)
    return a.withColumn("c", F.count("*").over(Window.partitionBy("o_custkey"))).filter("c >= 2").select("o_custkey", "year", "n", r6(F.col("rate")).alias("rate"))


@query("modal_value", """WITH c AS (SELECT user_id, event_type, count(*) n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) i FROM c) SELECT user_id, event_type, n FROM r WHERE i = 1""")
def modal_value(spark, d):
    """Most common event type of every user (AGG22)."""
    c = _events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "event_type", "n")).alias("b")
    return c.groupBy("user_id").agg(best).select("user_id", "b.event_type", "b.n")


@query("actor_dates", "SELECT o_custkey AS actor, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_day, CAST(date_diff('day', min(o_orderdate), max(o_orderdate)) AS BIGINT) AS tenure_days, count(*) = 1 AS one_time FROM orders GROUP BY 1")
def actor_dates(spark, d):
    """First and last activity, tenure (AGG10, CTB1, DAT9)."""
    a = _orders(spark, d).groupBy(F.col("o_custkey").alias("actor")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"), F.count("*").alias("n"))
    return a.select("actor", F.col("a").cast("date").cast("string").alias("first_day"), F.col("b").cast("date").cast("string").alias("last_day"), whole_days(F.col("a"), F.col("b")).alias("tenure_days"), (F.col("n") == 1).alias("one_time"))


@query("time_to_merge", "SELECT o_orderpriority, round(avg(d) FILTER (WHERE d >= 0), 6) AS mean_days, count(*) FILTER (WHERE d < 0) AS negative FROM (SELECT o_orderpriority, date_diff('microsecond', o_orderdate, l_shipdate) / 86400000000.0 AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1) GROUP BY 1")
def time_to_merge(spark, d):
    """Mean of non-negative days, and how many are negative (DAT14, AGG25, DQ23)."""
    j = _orders(spark, d).join(_line(spark, d).filter("l_linenumber = 1"), F.col("o_orderkey") == F.col("l_orderkey")).withColumn("d", days_between(F.col("o_orderdate"), F.col("l_shipdate")))
    return j.groupBy("o_orderpriority").agg(r6(F.avg(F.when(F.col("d") >= 0, F.col("d")))).alias("mean_days"), F.count_if(F.col("d") < 0).alias("negative"))


@query("two_period_summary", """WITH o AS (SELECT *, CASE WHEN year(o_orderdate) < 1998 THEN 'historical' ELSE 'recent' END AS period FROM orders), l AS (SELECT l_orderkey, count(*) r FROM lineitem GROUP BY 1)
SELECT period, count(*) AS n, round(count(*) FILTER (WHERE o_orderstatus = 'F') / CAST(count(*) AS DOUBLE), 6) AS merge_rate, count(DISTINCT o_custkey) AS authors, round(avg(coalesce(r, 0)), 6) AS mean_reviews, round(count(*) FILTER (WHERE r IS NULL) / CAST(count(*) AS DOUBLE), 6) AS zero_review_rate
FROM o LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1""")
def two_period_summary(spark, d):
    """Headline metrics of two periods (QRY1, QRY2): reviews are counted per change before the join."""
    per = _line(spark, d).groupBy("l_orderkey").agg(F.count("*").alias("r"))
    o = _orders(spark, d).withColumn("period", F.when(F.year("o_orderdate") < 1998, "historical").otherwise("recent")).join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.groupBy("period").agg(F.count("*").alias("n"), r6(F.count_if(merged()) / F.count("*")).alias("merge_rate"), F.countDistinct("o_custkey").alias("authors"), r6(F.avg(F.coalesce("r", F.lit(0)))).alias("mean_reviews"), r6(F.count_if(F.col("r").isNull()) / F.count("*")).alias("zero_review_rate"))


@query("self_review_breakdown", """WITH n AS (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1) SELECT o_custkey % 10 = o_orderkey % 10 AS own, CASE WHEN coalesce(k, 0) = 0 THEN '0' WHEN k = 1 THEN '1' ELSE '2+' END AS reviews, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM orders LEFT JOIN n ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def self_review_breakdown(spark, d):
    """Own against other merges by number of reviews (AGG6, QRY17)."""
    per = _line(spark, d).groupBy("l_orderkey").agg(F.count("*").alias("k"))
    o = _orders(spark, d).join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.coalesce("k", F.lit(0))
    g = o.groupBy((F.col("o_custkey") % 10 == F.col("o_orderkey") % 10).alias("own"), F.when(k == 0, "0").when(k == 1, "1").otherwise("2+").alias("reviews")).agg(F.count("*").alias("n"))
    return W.share(g, "n").withColumn("share", r6(F.col("share")))


@query("safe_ratio_by_type", "SELECT event_type, round(CASE WHEN count(*) FILTER (WHERE value < 0) = 0 THEN 0.0 ELSE count(*) / CAST(count(*) FILTER (WHERE value < 0) AS DOUBLE) END, 6) AS ratio FROM events GROUP BY 1")
def safe_ratio_by_type(spark, d):
    """Division that gives 0 by 0 (MTH1)."""
    return _events(spark, d).groupBy("event_type").agg(r6(ratio(F.count("*"), F.count_if(F.col("value") < 0))).alias("ratio"))
