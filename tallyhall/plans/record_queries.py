"""Composite analyses over nested change records.

``changes`` gives each order as one record with its reviews as an array of
struct, which is the shape collected records have. A review's state is APPROVED
(l_returnflag A), CHANGES_REQUESTED (R) or COMMENTED (N).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhall.functions.dates import era, period
from tallyhall.functions.numbers import r6, ratio
from tallyhall.operators import classify as C
from tallyhall.operators import quality as Q
from tallyhall.operators import relational as R
from tallyhall.operators import windows as W
from tallyhall.operators.concentration import concentration
from tallyhall.plans.registry import query, table


def changes(spark, d) -> DataFrame:
    """One row per change: number, author, state, created, size, priority, reviews."""
    state = F.when(F.col("l_returnflag") == "A", "APPROVED").when(F.col("l_returnflag") == "R", "CHANGES_REQUESTED").otherwise("COMMENTED")
    review = F.struct(state.alias("state"), F.col("l_suppkey").cast("string").alias("author"), F.when(F.col("l_returnflag") == "R", "nack").otherwise("").alias("body"), F.col("l_shipdate").alias("submitted_at"), F.col("l_quantity").alias("lines"))
    reviews = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(review)).alias("reviews"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("number"), F.col("o_custkey").alias("author"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("created"), F.col("o_totalprice").alias("size"), F.col("o_orderpriority").alias("priority"))
    return o.join(reviews, o["number"] == reviews["l_orderkey"], "left").drop("l_orderkey").withColumn("reviews", F.coalesce("reviews", F.array().cast(reviews.schema["reviews"].dataType)))


#: The same per change, flat.
_PER = """p AS (SELECT o_orderkey AS number, any_value(o_custkey) AS author, any_value(o_orderstatus) AS state, any_value(o_orderdate) AS created, any_value(o_totalprice) AS size, any_value(o_orderpriority) AS priority,
count(l_orderkey) AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE l_returnflag = 'N') AS c, count(DISTINCT l_suppkey) AS u, min(l_shipdate) AS first FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"""


def _counted(spark, d):
    m = changes(spark, d).withColumn("m", C.review_metrics(F.col("reviews")))
    return m.select("number", "author", "state", "created", "size", "priority", F.col("m.total_reviews").alias("n"), F.col("m.approvals").alias("a"), F.col("m.rejections").alias("r"), F.col("m.comments_only").alias("c"), F.col("m.unique_reviewers").alias("u"), F.array_min(F.transform("reviews", lambda x: x["submitted_at"])).alias("first"))


@query("review_metrics", f"WITH {_PER} SELECT number, CAST(n AS INTEGER) AS total_reviews, CAST(a AS INTEGER) AS approvals, CAST(r AS INTEGER) AS rejections, CAST(c AS INTEGER) AS comments_only, CAST(u AS INTEGER) AS unique_reviewers FROM p")
def review_metrics(spark, d):
    """Counts over each record's reviews (ARR1-ARR3, FIL20)."""
    return _counted(spark, d).select("number", F.col("n").alias("total_reviews"), F.col("a").alias("approvals"), F.col("r").alias("rejections"), F.col("c").alias("comments_only"), F.col("u").alias("unique_reviewers"))


@query("disputes", f"WITH {_PER} SELECT state, count(*) AS n, count(*) FILTER (WHERE a > 0 AND r > 0) AS disputes FROM p GROUP BY 1")
def disputes(spark, d):
    """Changes with both an approval and a change request (FIL16, QRY96)."""
    both = F.exists("reviews", lambda x: x["state"] == "APPROVED") & F.exists("reviews", lambda x: x["state"] == "CHANGES_REQUESTED")
    return changes(spark, d).groupBy("state").agg(F.count("*").alias("n"), F.count_if(both).alias("disputes"))


@query("stated_gaps", f"""WITH {_PER}, m AS (SELECT * FROM p WHERE state = 'F'), g AS (SELECT count(*) AS n, 1 - count(*) FILTER (WHERE n > 0) / CAST(count(*) AS DOUBLE) AS review_gap, 1 - count(*) FILTER (WHERE a > 0) / CAST(count(*) AS DOUBLE) AS approval_gap, count(*) FILTER (WHERE author % 10 = number % 10) / CAST(count(*) AS DOUBLE) AS self_gap, count(*) FILTER (WHERE r > 0) / CAST(count(*) AS DOUBLE) AS nack_gap FROM m)
SELECT n, round(review_gap, 6) AS review_gap, round(approval_gap, 6) AS approval_gap, round(self_gap, 6) AS self_gap, round(nack_gap, 6) AS nack_gap, round((review_gap + approval_gap + self_gap + nack_gap) / 4, 6) AS score FROM g""")
def stated_gaps(spark, d):
    """How far practice is from stated rules (QRY34, QRY35)."""
    n = F.count("*")
    m = _counted(spark, d).filter("state = 'F'").agg(n.alias("n"), (1 - F.count_if(F.col("n") > 0) / n).alias("review_gap"), (1 - F.count_if(F.col("a") > 0) / n).alias("approval_gap"), (F.count_if(F.col("author") % 10 == F.col("number") % 10) / n).alias("self_gap"), (F.count_if(F.col("r") > 0) / n).alias("nack_gap"))
    gaps = [F.col(c) for c in ("review_gap", "approval_gap", "self_gap", "nack_gap")]
    return m.withColumn("score", r6(C.gap_score(*gaps))).withColumns({c: r6(F.col(c)) for c in ("review_gap", "approval_gap", "self_gap", "nack_gap")})


_BUCKET = "CASE WHEN n = 0 THEN '0' WHEN n <= 2 THEN '1-2' WHEN n <= 5 THEN '3-5' ELSE '6+' END"


def _bucket(n):
    return F.when(n == 0, "0").when(n <= 2, "1-2").when(n <= 5, "3-5").otherwise("6+")


@query("opacity_buckets", f"WITH {_PER} SELECT {_BUCKET} AS reviews, count(*) AS n, round(count(*) FILTER (WHERE state = 'F') / CAST(count(*) AS DOUBLE), 6) AS merge_rate, round(avg(u), 6) AS reviewers FROM p GROUP BY 1")
def opacity_buckets(spark, d):
    """Outcome by number of reviews (QRY37, QRY38)."""
    return _counted(spark, d).groupBy(_bucket(F.col("n")).alias("reviews")).agg(F.count("*").alias("n"), r6(F.count_if(F.col("state") == "F") / F.count("*")).alias("merge_rate"), r6(F.avg("u")).alias("reviewers"))


@query("opacity_by_year", f"WITH {_PER}, y AS (SELECT CAST(year(created) AS INTEGER) AS year, count(*) AS n, count(*) FILTER (WHERE n <= 2) / CAST(count(*) AS DOUBLE) AS opacity FROM p GROUP BY 1 HAVING count(*) >= 10) SELECT year, n, round(opacity, 6) AS opacity, CASE WHEN opacity > 0.7 THEN 'very_high' WHEN opacity > 0.5 THEN 'high' WHEN opacity > 0.3 THEN 'moderate' ELSE 'low' END AS level FROM y")
def opacity_by_year(spark, d):
    """Share of barely reviewed changes per year, with its level (QRY39, CLS43)."""
    y = R.rate_by(_counted(spark, d), [F.year("created").alias("year")], F.col("n") <= 2, 10)
    return y.select("year", "n", r6(F.col("rate")).alias("opacity"), C.opacity_level(F.col("rate")).alias("level"))


_NACKS = "x AS (SELECT l_suppkey AS who, l_orderkey AS number, l_shipdate AS seen FROM lineitem WHERE l_returnflag = 'R')"


@query("nack_effectiveness", f"WITH {_NACKS} SELECT who AS reviewer, count(*) AS nacks, count(DISTINCT number) AS changes, round(count(*) FILTER (WHERE o_orderstatus = 'O') / CAST(count(DISTINCT number) AS DOUBLE), 6) AS kill_rate FROM x JOIN orders ON number = o_orderkey GROUP BY 1 ORDER BY count(*) FILTER (WHERE o_orderstatus = 'O') / CAST(count(DISTINCT number) AS DOUBLE) DESC, nacks DESC, who LIMIT 20")
def nack_effectiveness(spark, d):
    """Objections and what became of the changes: top 20 reviewers (CLS34, JOIN3, TOP2, QRY42)."""
    x = changes(spark, d).select("number", "state", F.explode("reviews").alias("r")).filter(F.lower("r.body").contains("nack"))
    rate = F.count_if(F.col("state") == "O") / F.countDistinct("number")
    g = x.groupBy(F.col("r.author").cast("long").alias("reviewer")).agg(F.count("*").alias("nacks"), F.countDistinct("number").alias("changes"), rate.alias("kill_rate"))
    return g.orderBy(F.desc("kill_rate"), F.desc("nacks"), "reviewer").limit(20).withColumn("kill_rate", r6(F.col("kill_rate")))


@query("nack_timing", f"WITH {_NACKS} SELECT CASE WHEN date_diff('microsecond', o_orderdate, seen) / 86400000000.0 < 30 THEN 'early' ELSE 'late' END AS timing, count(*) AS n FROM x JOIN orders ON number = o_orderkey GROUP BY 1")
def nack_timing(spark, d):
    """Early and late objections (CLS35)."""
    from tallyhall.functions.dates import days_between

    x = changes(spark, d).select("created", F.explode("reviews").alias("r")).filter("r.state = 'CHANGES_REQUESTED'")
    return x.groupBy(F.when(days_between(F.col("created"), F.col("r.submitted_at")) < 30, "early").otherwise("late").alias("timing")).agg(F.count("*").alias("n"))


@query("consensus_cases", f"WITH {_PER} SELECT number, CAST(a AS INTEGER) AS approvals FROM p WHERE a >= 2 AND r <= 1 ORDER BY number LIMIT 50")
def consensus_cases(spark, d):
    """First fifty changes that most reviewers approve (TOP7)."""
    return _counted(spark, d).filter("a >= 2 AND r <= 1").orderBy("number").limit(50).select("number", F.col("a").alias("approvals"))


@query("influence_flow", "WITH a AS (SELECT user_id k, min(ts) t FROM events GROUP BY 1), b AS (SELECT o_custkey k, min(o_orderdate) t FROM orders GROUP BY 1) SELECT count(*) AS both_sides, count(*) FILTER (WHERE a.t < b.t) AS informal_first FROM a JOIN b USING (k)")
def influence_flow(spark, d):
    """Whether talk comes before changes (JOIN13)."""
    a = table(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.min("ts").alias("a"))
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderdate").alias("b"))
    return a.join(b, "k").agg(F.count("*").alias("both_sides"), F.count_if(F.col("a") < F.col("b")).alias("informal_first"))


@query("benchmark_ratios", """WITH c AS (SELECT o_custkey, count(*) AS x FROM orders GROUP BY 1), r AS (SELECT x, row_number() OVER (ORDER BY x, o_custkey) i, row_number() OVER (ORDER BY x DESC, o_custkey) e FROM c), m AS (SELECT (2.0 * sum(i * x) - (count(*) + 1) * sum(x)) / (count(*) * CAST(sum(x) AS DOUBLE)) AS g, sum(x) FILTER (WHERE e <= 5) / CAST(sum(x) AS DOUBLE) AS t5, sum(x) FILTER (WHERE e <= 10) / CAST(sum(x) AS DOUBLE) AS t10 FROM r)
SELECT round(g / 0.6, 5) AS gini_ratio, round(t5 / 0.25, 5) AS top5_ratio, round(t10 / 0.4, 5) AS top10_ratio, g / 0.6 > 1.5 AS outlier FROM m""")
def benchmark_ratios(spark, d):
    """Against typical open projects (QRY41)."""
    m = concentration(table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("x")), digits=12)
    return m.select(F.round(F.col("gini") / 0.6, 5).alias("gini_ratio"), F.round(F.col("top5_share") / 0.25, 5).alias("top5_ratio"), F.round(F.col("top10_share") / 0.4, 5).alias("top10_ratio"), (F.col("gini") / 0.6 > 1.5).alias("outlier"))


@query("leader_boards", "WITH a AS (SELECT o_custkey, count(*) n, sum(o_totalprice) s FROM orders GROUP BY 1), x AS (SELECT 'count' AS board, o_custkey AS actor, row_number() OVER (ORDER BY n DESC, o_custkey) AS rank FROM a UNION ALL SELECT 'size', o_custkey, row_number() OVER (ORDER BY s DESC, o_custkey) FROM a) SELECT board, actor, CAST(rank AS INTEGER) AS rank FROM x WHERE rank <= 10")
def leader_boards(spark, d):
    """Ten leaders by two measures (TOP1, TOP5, TOP6): each is a top-k, ranked after the limit."""
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("actor")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))

    def board(name, by):
        top = a.orderBy(F.desc(by), "actor").limit(10)
        return top.select(F.lit(name).alias("board"), "actor", F.row_number().over(Window.orderBy(F.desc(by), "actor")).alias("rank"))

    return board("count", "n").unionByName(board("size", "s"))


@query("chronology", "WITH t AS (SELECT 'change' AS kind, o_orderdate AS seen FROM orders UNION ALL SELECT 'review', l_shipdate FROM lineitem UNION ALL SELECT 'event', ts FROM events) SELECT kind, count(*) AS n, CAST(CAST(min(seen) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(seen) AS DATE) AS VARCHAR) AS last_day FROM t GROUP BY 1")
def chronology(spark, d):
    """Events of three sources in one table (SET6, TOP8, QRY83)."""
    t = table(spark, d, "orders").select(F.lit("change").alias("kind"), F.col("o_orderdate").alias("at")).unionByName(table(spark, d, "lineitem").select(F.lit("review").alias("kind"), F.col("l_shipdate").alias("at"))).unionByName(table(spark, d, "events").select(F.lit("event").alias("kind"), F.col("ts").alias("at")))
    return t.groupBy("kind").agg(F.count("*").alias("n"), F.min("at").cast("date").cast("string").alias("first_day"), F.max("at").cast("date").cast("string").alias("last_day"))


@query("previous_change", "SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous, CAST(date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) AS INTEGER) AS days FROM orders")
def previous_change(spark, d):
    """Each change and the one before it (QRY84)."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("previous"), F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).alias("days"))


@query("premium_metrics", f"WITH {_PER}, q AS (SELECT author % 10 = 0 AS insider, state, date_diff('microsecond', created, first) / 86400000000.0 AS days FROM p) SELECT insider, count(*) AS n, round(count(*) FILTER (WHERE state = 'F') / CAST(count(*) AS DOUBLE), 6) AS merge_rate, round(quantile_cont(days, 0.5), 6) AS median_days FROM q GROUP BY 1")
def premium_metrics(spark, d):
    """Merge rate and speed of insiders and others (QRY95, STA11)."""
    from tallyhall.functions.dates import days_between

    q = _counted(spark, d).withColumn("days", days_between(F.col("created"), F.col("first")))
    return q.groupBy((F.col("author") % 10 == 0).alias("insider")).agg(F.count("*").alias("n"), r6(F.count_if(F.col("state") == "F") / F.count("*")).alias("merge_rate"), r6(F.percentile("days", F.lit(0.5))).alias("median_days"))


@query("reviewer_profiles", "WITH a AS (SELECT l_suppkey AS reviewer, count(*) AS n, avg(l_quantity) AS q, count(*) FILTER (WHERE l_returnflag = 'A') / CAST(count(*) AS DOUBLE) AS ap FROM lineitem GROUP BY 1 HAVING count(*) >= 10) SELECT reviewer, n, round(q, 6) AS mean_lines, round(ap, 6) AS approval_rate FROM a ORDER BY a.q DESC, reviewer LIMIT 20")
def reviewer_profiles(spark, d):
    """Twenty most thorough reviewers with at least ten reviews (QRY68, QRY72)."""
    a = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("reviewer")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("q"), (F.count_if(F.col("l_returnflag") == "A") / F.count("*")).alias("ap")).filter("n >= 10")
    return a.orderBy(F.desc("q"), "reviewer").limit(20).select("reviewer", "n", r6(F.col("q")).alias("mean_lines"), r6(F.col("ap")).alias("approval_rate"))


@query("review_types_by_year", "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) FILTER (WHERE l_returnflag = 'A') AS approved, count(*) FILTER (WHERE l_returnflag = 'R') AS changes_requested, count(*) FILTER (WHERE l_returnflag = 'N') AS commented, round(avg(l_quantity), 6) AS mean_lines FROM lineitem GROUP BY 1")
def review_types_by_year(spark, d):
    """Kinds of review per year (QRY69, QRY71)."""
    p = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year"))
    f = F.col("l_returnflag")
    return p.agg(F.count_if(f == "A").alias("approved"), F.count_if(f == "R").alias("changes_requested"), F.count_if(f == "N").alias("commented"), r6(F.avg("l_quantity")).alias("mean_lines"))


_LATER = "(o_orderdate + INTERVAL 16 YEAR)"


@query("era_counts", f"SELECT CASE WHEN t BETWEEN TIMESTAMP '2009-01-03' AND TIMESTAMP '2011-04-23' THEN 'founding' WHEN t BETWEEN TIMESTAMP '2011-04-24' AND TIMESTAMP '2014-12-31' THEN 'early' WHEN t BETWEEN TIMESTAMP '2015-01-01' AND TIMESTAMP '2017-08-23' THEN 'transition' WHEN t BETWEEN TIMESTAMP '2017-08-24' AND TIMESTAMP '2021-11-13' THEN 'modern' WHEN t BETWEEN TIMESTAMP '2021-11-14' AND TIMESTAMP '2099-12-31' THEN 'current' ELSE 'unknown' END AS era, CASE WHEN year(t) BETWEEN 2012 AND 2020 THEN 'historical' WHEN year(t) BETWEEN 2021 AND 2025 THEN 'recent' ELSE 'other' END AS period, count(*) AS n FROM (SELECT {_LATER} AS t FROM orders) GROUP BY 1, 2")
def era_counts(spark, d):
    """Changes per era and period, dates moved sixteen years on (DAT6, DAT11)."""
    t = table(spark, d, "orders").select((F.col("o_orderdate") + F.expr("INTERVAL 16 YEARS")).alias("t"))
    return t.groupBy(era(F.col("t")).alias("era"), period(F.year("t")).alias("period")).agg(F.count("*").alias("n"))


@query("behaviour_clusters", "WITH a AS (SELECT o_custkey, count(*) n, count(*) FILTER (WHERE o_orderstatus = 'F') / CAST(count(*) AS DOUBLE) m, avg(o_totalprice) s FROM orders GROUP BY 1) SELECT CASE WHEN m > 0.6 AND n >= 10 THEN 'insider' WHEN m > 0.6 THEN 'selective' WHEN s > 200000 THEN 'ambitious' ELSE 'regular' END AS cluster, count(*) AS actors FROM a GROUP BY 1")
def behaviour_clusters(spark, d):
    """Authors by their habits (QRY16)."""
    a = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), (F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("m"), F.avg("o_totalprice").alias("s"))
    m = F.col("m") > 0.6
    return a.groupBy(F.when(m & (F.col("n") >= 10), "insider").when(m, "selective").when(F.col("s") > 200000, "ambitious").otherwise("regular").alias("cluster")).agg(F.count("*").alias("actors"))


@query("attention", f"WITH {_PER}, q AS (SELECT CASE WHEN size < 100000 AND n <= 2 THEN 'simple' WHEN size < 250000 AND n <= 10 THEN 'medium' ELSE 'complex' END AS complexity, state, n, date_diff('microsecond', created, first) / 3600000000.0 AS h FROM p) SELECT complexity, count(*) AS n, round(avg(h), 6) AS mean_hours, round(quantile_cont(h, 0.5), 6) AS median_hours, round(avg(n) FILTER (WHERE state = 'F'), 6) AS merged_reviews FROM q GROUP BY 1")
def attention(spark, d):
    """Response by complexity (QRY19-QRY21, CLS31)."""
    from tallyhall.functions.dates import hours_between

    size, n = F.col("size"), F.col("n")
    kind = F.when((size < 100000) & (n <= 2), "simple").when((size < 250000) & (n <= 10), "medium").otherwise("complex")
    q = _counted(spark, d).withColumn("h", hours_between(F.col("created"), F.col("first")))
    return q.groupBy(kind.alias("complexity")).agg(F.count("*").alias("n"), r6(F.avg("h")).alias("mean_hours"), r6(F.percentile("h", F.lit(0.5))).alias("median_hours"), r6(F.avg(F.when(F.col("state") == "F", n))).alias("merged_reviews"))


@query("exhaustion_filter", "WITH a AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') m, count(*) n FROM orders GROUP BY 1) SELECT count(*) AS actors, count(*) FILTER (WHERE m >= 10) AS persistent, round(avg(n) FILTER (WHERE m >= 10), 6) AS mean_tries FROM a")
def exhaustion_filter(spark, d):
    """Outsiders who get ten or more changes in (QRY27)."""
    a = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("m"), F.count("*").alias("n"))
    return a.agg(F.count("*").alias("actors"), F.count_if(F.col("m") >= 10).alias("persistent"), r6(F.avg(F.when(F.col("m") >= 10, F.col("n")))).alias("mean_tries"))


@query("year_sum_check", "SELECT CAST(sum(n) AS BIGINT) AS by_year, (SELECT count(*) FROM orders) AS total, sum(n) = (SELECT count(*) FROM orders) AS consistent FROM (SELECT count(*) AS n FROM orders GROUP BY year(o_orderdate))")
def year_sum_check(spark, d):
    """Sums of years against the total (DQ15, DQ16, DQ24)."""
    o = table(spark, d, "orders")
    years = o.groupBy(F.year("o_orderdate")).agg(F.count("*").alias("n"))
    return years.agg(F.sum("n").alias("by_year")).crossJoin(o.agg(F.count("*").alias("total"))).withColumn("consistent", F.col("by_year") == F.col("total"))


@query("attribution_coverage", "SELECT o_orderstatus, round(count(s_suppkey) / CAST(count(*) AS DOUBLE), 6) AS coverage, count(s_suppkey) / CAST(count(*) AS DOUBLE) BETWEEN 0.0 AND 0.35 AS in_band FROM orders LEFT JOIN supplier ON s_suppkey = o_orderkey % (SELECT 10 * (max(s_suppkey) + 1) FROM supplier) GROUP BY 1")
def attribution_coverage(spark, d):
    """Share of changes with a known merger among all suppliers; one key in ten is known (DQ21, DQ22)."""
    s = table(spark, d, "supplier").select("s_suppkey")
    o = table(spark, d, "orders").crossJoin(s.agg((10 * (F.max("s_suppkey") + 1)).alias("size"))).withColumn("k", F.col("o_orderkey") % F.col("size"))
    share = ratio(F.count("s_suppkey"), F.count("*"))
    return o.join(s, F.col("k") == F.col("s_suppkey"), "left").groupBy("o_orderstatus").agg(r6(share).alias("coverage"), Q.within(share, 0.0, 0.35).alias("in_band"))


@query("importance_trend", "WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, avg(o_totalprice) AS v FROM orders GROUP BY 1), s AS (SELECT *, row_number() OVER (ORDER BY y) u, row_number() OVER (ORDER BY y DESC) w FROM y), a AS (SELECT avg(v) FILTER (WHERE u <= 3) e, avg(v) FILTER (WHERE w <= 3) r FROM s) SELECT round(e, 4) AS early, round(r, 4) AS recent, CASE WHEN (r - e) / e * 100 > 10 THEN 'increasing' WHEN (r - e) / e * 100 < -10 THEN 'decreasing' ELSE 'stable' END AS direction FROM a")
def importance_trend(spark, d):
    """Trend of mean size per year (QRY59, QRY101, QRY102, WIN16)."""
    y = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("v"))
    return W.trend(y, "y", "v").select(F.round("early", 4).alias("early"), F.round("recent", 4).alias("recent"), "direction")


@query("zero_review_rates", f"WITH {_PER} SELECT state, round(count(*) FILTER (WHERE a * 0.5 + r * 0.5 + c * 0.3 < 0.5) / CAST(count(*) AS DOUBLE) * 100, 6) AS zero_review_rate FROM p GROUP BY 1")
def zero_review_rates(spark, d):
    """Share of changes whose summed review score is under the threshold (AGG26-AGG28, CLS10, STA14)."""
    score = F.col("a") * 0.5 + F.col("r") * 0.5 + F.col("c") * 0.3
    return _counted(spark, d).groupBy("state").agg(r6(F.count_if(~C.has_meaningful_review(score)) / F.count("*") * 100).alias("zero_review_rate"))


@query("gini_words", "WITH c AS (SELECT o_orderstatus AS g, o_custkey AS actor, count(*) AS x FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY x, actor) i FROM c), m AS (SELECT g, (2.0 * sum(i * x) - (count(*) + 1) * sum(x)) / (count(*) * CAST(sum(x) AS DOUBLE)) AS v FROM r GROUP BY 1) SELECT g AS state, round(v, 6) AS gini, CASE WHEN v >= 0.9 THEN 'Extreme concentration (near-monopoly)' WHEN v >= 0.8 THEN 'Very high concentration' WHEN v >= 0.6 THEN 'High concentration' WHEN v >= 0.4 THEN 'Moderate concentration' WHEN v >= 0.2 THEN 'Low concentration' ELSE 'Very low concentration (near-equality)' END AS words FROM m")
def gini_words(spark, d):
    """Concentration in words (CON7)."""
    c = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("state"), F.col("o_custkey").alias("actor")).agg(F.count("*").alias("x"))
    return concentration(c, ["state"]).select("state", "gini", C.gini_words(F.col("gini")).alias("words"))


@query("concatenated_text", "SELECT conv_id, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS chars, bool_or(contains(lower(text), 'the')) AS has_keyword FROM conversations GROUP BY 1")
def concatenated_text(spark, d):
    """Per-thread text features without concatenating the text (AGG21, QRY91)."""
    return table(spark, d, "conversations").groupBy("conv_id").agg((F.sum(F.length("text")) + F.count("*") - 1).alias("chars"), F.bool_or(F.lower("text").contains("the")).alias("has_keyword"))
