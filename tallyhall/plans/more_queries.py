"""Filters, lookups, classes and composites that complete the inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyhall.functions import keywords as K
from tallyhall.functions import text as T
from tallyhall.functions.dates import epoch, parse, year_of_prefix
from tallyhall.functions.numbers import clamp, percent_change, r6, ratio
from tallyhall.operators import classify as C
from tallyhall.operators import identity as I
from tallyhall.operators import relational as R
from tallyhall.operators import stats as S
from tallyhall.operators import windows as W
from tallyhall.plans.record_queries import _PER, _counted
from tallyhall.plans.registry import query, table
from tallyhall.plans.text_queries import _sql_any, _sql_hits


def _t(spark, d, name):
    return table(spark, d, name)


@query("range_filters", "SELECT o_orderstatus, count(*) FILTER (WHERE year(o_orderdate) BETWEEN 1996 AND 1998) AS in_years, count(*) FILTER (WHERE o_orderdate BETWEEN TIMESTAMP '1996-06-01' AND TIMESTAMP '1997-06-01') AS in_days FROM orders GROUP BY 1")
def range_filters(spark, d):
    """Year and timestamp ranges, ends included (FIL7-FIL9, QRY47)."""
    days = F.col("o_orderdate").between(F.lit("1996-06-01").cast("timestamp_ntz"), F.lit("1997-06-01").cast("timestamp_ntz"))
    return _t(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_if(F.year("o_orderdate").between(1996, 1998)).alias("in_years"), F.count_if(days).alias("in_days"))


@query("membership", "SELECT lower(n_name) IN ('france', 'china', 'nation_3') OR n_nationkey IN (1, 3, 5) AS listed, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def membership(spark, d):
    """Case-folded membership in a list (FIL10-FIL12)."""
    listed = F.lower("n_name").isin("france", "china", "nation_3") | F.col("n_nationkey").isin(1, 3, 5)
    return _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(listed.alias("listed")).agg(F.count("*").alias("n"))


@query("rejected", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND NOT o_orderstatus = 'F' GROUP BY 1")
def rejected(spark, d):
    """Closed without a merge (FIL13, FIL22)."""
    s = F.col("o_orderstatus")
    return _t(spark, d, "orders").filter((s == "O") & ~(s == "F")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("actor_counts", "SELECT o_custkey AS actor, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 8) AS share FROM orders GROUP BY 1")
def actor_counts(spark, d):
    """Counts and shares of the total (AGG1, WIN10)."""
    return W.share(_t(spark, d, "orders").groupBy(F.col("o_custkey").alias("actor")).agg(F.count("*").alias("n")), "n").withColumn("share", F.round("share", 8))


@query("rows_by_period", "SELECT CAST(year(ts) AS INTEGER) AS year, event_type, array_to_string(list_sort(list(event_id))[1:5], ',') AS first_ids, count(*) AS n FROM events GROUP BY 1, 2")
def rows_by_period(spark, d):
    """Rows grouped by period, a few shown (AGG3, MAP2)."""
    ids = F.slice(F.sort_array(F.collect_list("event_id")), 1, 5).cast("array<string>")
    return _t(spark, d, "events").groupBy(F.year("ts").alias("year"), "event_type").agg(F.array_join(ids, ",").alias("first_ids"), F.count("*").alias("n"))


@query("mean_and_median", "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(quantile_cont(l_quantity, 0.5), 6) AS median, max(l_quantity) AS most FROM lineitem GROUP BY 1")
def mean_and_median(spark, d):
    """Mean and interpolated median (AGG8, QRY73)."""
    return _t(spark, d, "lineitem").groupBy("l_returnflag").agg(r6(F.avg("l_quantity")).alias("mean"), r6(F.percentile("l_quantity", F.lit(0.5))).alias("median"), F.max("l_quantity").alias("most"))


@query("exploded_labels", "SELECT label, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS merge_rate FROM (SELECT o_orderstatus, unnest([o_orderpriority, CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END]) AS label FROM orders) GROUP BY 1")
def exploded_labels(spark, d):
    """Labels and their merge rates (AGG18, ARR4)."""
    labels = F.array("o_orderpriority", F.when(F.col("o_totalprice") > 200000, "large").otherwise("small"))
    o = _t(spark, d, "orders").select("o_orderstatus", F.explode(labels).alias("label"))
    return o.groupBy("label").agg(F.count("*").alias("n"), r6(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0))).alias("merge_rate"))


@query("rank_by_position", "SELECT o_custkey AS actor, CAST(row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS INTEGER) AS rank FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10")
def rank_by_position(spark, d):
    """Top ten with their place (SRC6, WIN14, JOIN4, TOP3): ranked after the limit."""
    top = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("actor")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "actor").limit(10)
    return top.select("actor", F.row_number().over(Window.orderBy(F.desc("n"), "actor")).alias("rank"))


@query("timestamp_forms", "SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(substring(CAST(ts AS VARCHAR), 1, 4) AS INTEGER) AS prefix_year, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds FROM events")
def timestamp_forms(spark, d):
    """Text to time and back, years, epoch seconds (DAT1-DAT3, DAT7, DAT10, DAT12)."""
    text = F.col("ts").cast("string")
    at = parse(text)
    return _t(spark, d, "events").select("event_id", F.year(at).alias("year"), year_of_prefix(text).alias("prefix_year"), F.unix_seconds(at).alias("seconds"))


@query("epoch_counts", "SELECT CASE WHEN y BETWEEN 2009 AND 2013 THEN 'early_development' WHEN y BETWEEN 2014 AND 2017 THEN 'blocksize_wars' WHEN y BETWEEN 2018 AND 2020 THEN 'post_segwit' WHEN y BETWEEN 2021 AND 2024 THEN 'recent_era' END AS epoch, count(*) AS n FROM (SELECT year(o_orderdate) + 18 AS y FROM orders) GROUP BY 1")
def epoch_counts(spark, d):
    """Changes per epoch, years moved on (DAT13, QRY67)."""
    return _t(spark, d, "orders").groupBy(epoch(F.year("o_orderdate") + 18).alias("epoch")).agg(F.count("*").alias("n"))


@query("change_between_periods", "WITH a AS (SELECT avg(o_totalprice) FILTER (WHERE year(o_orderdate) < 1998) AS x, avg(o_totalprice) FILTER (WHERE year(o_orderdate) >= 1998) AS y FROM orders) SELECT round((y - x) / x * 100, 6) AS change_pct, round(least(1.0, greatest(0.0, y / x - 0.5)), 6) AS clamped FROM a")
def change_between_periods(spark, d):
    """Percent change and a clamp (MTH2, MTH4, MTH5)."""
    early = F.year("o_orderdate") < 1998
    a = _t(spark, d, "orders").agg(F.avg(F.when(early, F.col("o_totalprice"))).alias("x"), F.avg(F.when(~early, F.col("o_totalprice"))).alias("y"))
    return a.select(r6(percent_change(F.col("x"), F.col("y"))).alias("change_pct"), r6(clamp(F.col("y") / F.col("x") - 0.5)).alias("clamped"))


_TEXT = "lower(text)"
_IMPORTANCE = f"CASE WHEN {_sql_any('t', K.CRITICAL)} OR n > 1000 THEN 'critical' WHEN {_sql_any('t', K.HOUSEKEEPING)} AND n < 10 THEN 'trivial' WHEN {_sql_any('t', K.HOUSEKEEPING)} THEN 'low' WHEN n < 5 THEN 'trivial' WHEN n >= 500 THEN 'high' WHEN n < 50 THEN 'low' WHEN n >= 200 THEN 'high' ELSE 'normal' END"


@query("text_importance", f"SELECT {_IMPORTANCE} AS importance, count(*) AS n FROM (SELECT lower(text) || ' ' AS t, n_chars // 20 AS n FROM documents) GROUP BY 1")
def text_importance(spark, d):
    """Importance by words and size, of whole documents (CLS1, CLS2, CLS36, QRY4)."""
    none = F.array().cast("array<string>")
    i = C.importance(F.col("text"), F.lit(""), none, F.floor(F.col("n_chars") / 20), none)
    return _t(spark, d, "documents").groupBy(i.alias("importance")).agg(F.count("*").alias("n"))


_TYPES = "CASE WHEN " + _sql_any("t", K.CONSENSUS_RELATED) + " THEN 'consensus' " + " ".join(f"WHEN {_sql_any('t', ks)} THEN '{n}'" for n, (ks, _, _) in K.CHANGE_TYPES.items()) + " ELSE 'unknown' END"


@query("change_types", f"SELECT {_TYPES} AS primary_type, count(*) AS n FROM (SELECT lower(text) AS t FROM conversations) GROUP BY 1")
def change_types(spark, d):
    """Types of messages read as changes (CLS4)."""
    none = F.array().cast("array<string>")
    return _t(spark, d, "conversations").groupBy(C.change_type(F.lit(None).cast("string"), F.col("text"), none)["primary_type"].alias("primary_type")).agg(F.count("*").alias("n"))


@query("issue_types", f"SELECT CASE WHEN {_sql_any('t', ['question', 'how to', 'help'])} THEN 'question' WHEN {_sql_any('t', ['feature', 'request', 'enhancement'])} THEN 'feature' WHEN {_sql_any('t', ['bug', 'crash', 'error'])} THEN 'bug' ELSE 'unknown' END AS kind, count(*) AS n FROM (SELECT lower(text) AS t FROM conversations) GROUP BY 1")
def issue_types(spark, d):
    """Types of messages read as issues (CLS5)."""
    none = F.array().cast("array<string>")
    return _t(spark, d, "conversations").groupBy(C.issue_type(F.lit(None).cast("string"), F.col("text"), none).alias("kind")).agg(F.count("*").alias("n"))


@query("review_classes", f"WITH c AS (SELECT lower(text) AS t, role FROM conversations) SELECT CASE WHEN role = 'assistant' THEN 'approval' ELSE 'comment' END AS review_type, CASE WHEN {_sql_any('t', K.REVIEW_POSITIVE)} THEN 'positive' WHEN {_sql_any('t', K.REVIEW_NEGATIVE)} THEN 'negative' ELSE 'neutral' END AS sentiment, CASE WHEN length(t) > 200 OR {_sql_any('t', K.REVIEW_STRONG)} THEN 'strong' WHEN length(t) < 50 THEN 'weak' ELSE 'medium' END AS strength, count(*) AS n FROM c GROUP BY 1, 2, 3")
def review_classes(spark, d):
    """Type, sentiment and strength of messages read as reviews (CLS6, CLS17, QRY65)."""
    c = C.review_class(F.when(F.col("role") == "assistant", "APPROVED").otherwise("COMMENTED"), F.col("text"))
    return _t(spark, d, "conversations").select(c.alias("c")).groupBy("c.review_type", "c.sentiment", "c.strength").agg(F.count("*").alias("n"))


@query("rubber_stamps", f"WITH c AS (SELECT role, lower(trim(coalesce(text, ''))) AS t FROM conversations) SELECT role, count(*) FILTER (WHERE length(t) < 10 OR ({_sql_any('t', ['lgtm', 'looks good', 'ack', 'approved', '+1'])} AND length(t) < 50)) AS stamps FROM c GROUP BY 1")
def rubber_stamps(spark, d):
    """Approvals without substance, by whole messages (CLS18)."""
    s = C.is_rubber_stamp(F.lit("APPROVED"), F.col("text"))
    return _t(spark, d, "conversations").groupBy("role").agg(F.count_if(s).alias("stamps"))


@query("contribution_quality", f"WITH {_PER}, q AS (SELECT author, least(1.0, CASE WHEN state = 'F' THEN 0.3 ELSE 0 END + CASE WHEN size / 1000 > 10 THEN 0.2 ELSE 0 END + CASE WHEN size / 1000 > 100 THEN 0.1 ELSE 0 END + CASE WHEN n > 0 THEN 0.1 ELSE 0 END + CASE WHEN u > 1 THEN 0.05 ELSE 0 END + CASE WHEN c > 0 THEN 0.05 ELSE 0 END) AS q FROM p) SELECT author, count(*) AS n, round(CAST(avg(q) AS DOUBLE), 9) AS quality FROM q GROUP BY 1 HAVING count(*) >= 5 AND avg(q) >= 0.3")
def contribution_quality(spark, d):
    """Authors with enough changes of enough quality (CLS30, QRY43, QRY45)."""
    q = C.contribution_quality(F.col("size") / 1000, F.col("u"), F.lit(""), F.col("n"), F.col("c"), F.col("state") == "F")
    a = _counted(spark, d).select("author", q.alias("q")).groupBy("author").agg(F.count("*").alias("n"), F.avg("q").alias("q"))
    return a.filter("n >= 5 AND round(q, 9) >= 0.3").select("author", "n", F.round("q", 9).alias("quality"))


@query("archive_filter", "SELECT source, count(*) AS n FROM documents WHERE contains(lower(text), 'license') OR regexp_matches(text, '(?i)^the ') OR contains(source, 'src1') GROUP BY 1")
def archive_filter(spark, d):
    """Rows by any of several rules on content and path (CLS32, CLS33, QRY81, QRY82)."""
    t = F.col("text")
    return _t(spark, d, "documents").filter(F.lower(t).contains("license") | t.rlike("(?i)^the ") | F.col("source").contains("src1")).groupBy("source").agg(F.count("*").alias("n"))


@query("influence_network", "SELECT user_id AS actor, count(*) AS replies FROM events WHERE event_type = 'click' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def influence_network(spark, d):
    """Most active repliers (GRA15)."""
    return _t(spark, d, "events").filter("event_type = 'click'").groupBy(F.col("user_id").alias("actor")).agg(F.count("*").alias("replies")).orderBy(F.desc("replies"), "actor").limit(10)


@query("network_size", "WITH e AS (SELECT DISTINCT 'a' || CAST(c_nationkey AS VARCHAR) AS x, 'b' || CAST(o_custkey AS VARCHAR) AS y FROM orders JOIN customer ON o_custkey = c_custkey) SELECT (SELECT count(*) FROM (SELECT x FROM e UNION SELECT y FROM e)) AS nodes, (SELECT count(*) FROM e) AS edges")
def network_size(spark, d):
    """Distinct nodes and edges of a network (GRA16, GRA18)."""
    j = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    e = j.select(F.concat(F.lit("a"), "c_nationkey").alias("x"), F.concat(F.lit("b"), F.col("o_custkey")).alias("y")).distinct()
    nodes = e.select(F.explode(F.array("x", "y")).alias("v")).agg(F.countDistinct("v").alias("nodes"))
    return nodes.crossJoin(e.agg(F.count("*").alias("edges")))


@query("difference_interval", "WITH s AS (SELECT avg(l_quantity) FILTER (WHERE l_returnflag = 'R') - avg(l_quantity) FILTER (WHERE l_returnflag <> 'R') AS d, sqrt(var_samp(l_quantity) FILTER (WHERE l_returnflag = 'R') / count(*) FILTER (WHERE l_returnflag = 'R') + var_samp(l_quantity) FILTER (WHERE l_returnflag <> 'R') / count(*) FILTER (WHERE l_returnflag <> 'R')) AS se FROM lineitem) SELECT round(d - 1.96 * se, 6) AS low, round(d + 1.96 * se, 6) AS high, CASE WHEN abs(d / se) < 0.2 THEN 'negligible' WHEN abs(d / se) < 0.5 THEN 'small' WHEN abs(d / se) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM s")
def difference_interval(spark, d):
    """Interval of a difference and its size in words (STA6, STA10)."""
    t = S.t_test(_t(spark, d, "lineitem"), F.col("l_returnflag") == "R", "l_quantity")
    se = F.col("difference") / F.col("t")
    return t.select(r6(F.col("difference") - 1.96 * F.abs(se)).alias("low"), r6(F.col("difference") + 1.96 * F.abs(se)).alias("high"), S.effect_words(F.col("t")).alias("effect"))


@query("co_mentions", "SELECT CAST(user_id AS VARCHAR) AS nick, CAST(c_nationkey AS VARCHAR) AS author, count(*) AS n FROM events JOIN customer ON event_id % (SELECT max(c_custkey) + 1 FROM customer) = c_custkey GROUP BY 1, 2 HAVING count(*) >= 3")
def co_mentions(spark, d):
    """Names that go with the same items three times or more, over all customers (IDR6)."""
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("a"))
    size = c.agg((F.max("c_custkey") + 1).alias("size"))
    e = _t(spark, d, "events").crossJoin(size).select(F.col("user_id").cast("string").alias("nick"), (F.col("event_id") % F.col("size")).alias("k"))
    return I.co_mentions(e, "nick", "k", c, "c_custkey", "a")


@query("importance_by_period", "SELECT CASE WHEN year(o_orderdate) < 1998 THEN 'early' ELSE 'late' END AS period, o_orderpriority AS importance, count(*) AS n, round(count(*) FILTER (WHERE o_orderstatus = 'F') / CAST(count(*) AS DOUBLE), 6) AS merge_rate FROM orders GROUP BY 1, 2")
def importance_by_period(spark, d):
    """Outcome by importance and period (QRY14, QRY15)."""
    p = F.when(F.year("o_orderdate") < 1998, "early").otherwise("late")
    g = R.rate_by(_t(spark, d, "orders"), [p.alias("period"), F.col("o_orderpriority").alias("importance")], F.col("o_orderstatus") == "F")
    return g.select("period", "importance", "n", r6(F.col("rate")).alias("merge_rate"))


@query("arbitrage_by_status", f"WITH {_PER}, s AS (SELECT author % 10 = 0 AS insider, count(*) AS n, count(*) FILTER (WHERE n = 0) / CAST(count(*) AS DOUBLE) AS unreviewed, count(*) FILTER (WHERE r > 0 AND state = 'F') / CAST(count(*) AS DOUBLE) AS overruled FROM p GROUP BY 1) SELECT insider, n, round(unreviewed, 6) AS unreviewed, round(overruled, 6) AS overruled, CASE WHEN overruled > 0.4 THEN 'high' WHEN overruled > 0.2 THEN 'moderate' ELSE 'low' END AS words FROM s")
def arbitrage_by_status(spark, d):
    """Rule gaps of insiders and others, in words (QRY18, QRY36, QRY78, CLS46, CLS47)."""
    n = F.count("*")
    s = _counted(spark, d).groupBy((F.col("author") % 10 == 0).alias("insider")).agg(n.alias("n"), (F.count_if(F.col("n") == 0) / n).alias("u"), (F.count_if((F.col("r") > 0) & (F.col("state") == "F")) / n).alias("o"))
    return s.select("insider", "n", r6(F.col("u")).alias("unreviewed"), r6(F.col("o")).alias("overruled"), C.ratio_words(F.col("o"), 0.4, 0.2).alias("words"))


@query("actor_timeline", "WITH y AS (SELECT o_custkey AS actor, CAST(year(o_orderdate) AS VARCHAR) AS y, count(*) AS n FROM orders GROUP BY 1, 2) SELECT actor, CAST(sum(n) AS BIGINT) AS total, string_agg(y || '=' || CAST(n AS VARCHAR), ',' ORDER BY y) AS by_year FROM y GROUP BY 1")
def actor_timeline(spark, d):
    """Counts by year of every author (QRY44, AGG29, AGG30)."""
    y = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("actor"), F.year("o_orderdate").cast("string").alias("y")).agg(F.count("*").alias("n"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("y", "n"))), lambda x: F.concat(x["y"], F.lit("="), x["n"]))
    return y.groupBy("actor").agg(F.sum("n").alias("total"), F.array_join(parts, ",").alias("by_year"))


@query("item_selection", "SELECT lang, count(*) AS n FROM documents WHERE (contains(lower(text), 'license') OR regexp_matches(lower(text), '\\bbip ?\\d+')) AND doc_id >= 0 GROUP BY 1")
def item_selection(spark, d):
    """Items by words or number (QRY48, QRY98, FIL19, FIL25)."""
    low = F.lower("text")
    return _t(spark, d, "documents").filter((T.contains_any(low, ["license"]) | low.rlike(r"\bbip ?\d+")) & (F.col("doc_id") >= 0)).groupBy("lang").agg(F.count("*").alias("n"))


@query("compliance_score", f"WITH {_PER}, r AS (SELECT count(*) FILTER (WHERE n > 0) / CAST(count(*) AS DOUBLE) AS a, count(*) FILTER (WHERE u > 1) / CAST(count(*) AS DOUBLE) AS b, count(*) FILTER (WHERE r = 0 OR a > 0) / CAST(count(*) AS DOUBLE) AS c FROM p) SELECT round((CASE WHEN a > 0.7 THEN 1.0 WHEN a > 0.3 THEN 0.5 ELSE 0 END + CASE WHEN b > 0.7 THEN 1.0 WHEN b > 0.3 THEN 0.5 ELSE 0 END + CASE WHEN c > 0.7 THEN 1.0 WHEN c > 0.3 THEN 0.5 ELSE 0 END) / 3, 6) AS score FROM r".replace("round((", "round(CAST((").replace(") / 3, 6)", ") AS DOUBLE) / 3, 6)"))
def compliance_score(spark, d):
    """Weighted level of three principles (QRY77)."""
    n = F.count("*")
    r = _counted(spark, d).agg((F.count_if(F.col("n") > 0) / n).alias("x"), (F.count_if(F.col("u") > 1) / n).alias("y"), (F.count_if((F.col("r") == 0) | (F.col("a") > 0)) / n).alias("z"))

    def level(c):
        return F.when(F.col(c) > 0.7, 1.0).when(F.col(c) > 0.3, 0.5).otherwise(0.0)

    return r.select(r6((level("x") + level("y") + level("z")) / 3).alias("score"))


@query("list_comparison", "WITH a AS (SELECT n_nationkey AS k FROM nation), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier) SELECT k, CASE WHEN a.k IS NULL THEN 'second' WHEN b.k IS NULL THEN 'first' ELSE 'both' END AS side FROM a FULL JOIN b USING (k)".replace("SELECT k, CASE", "SELECT coalesce(a.k, b.k) AS k, CASE").replace("USING (k)", "ON a.k = b.k"))
def list_comparison(spark, d):
    """Names in one list, the other or both (SET8, QRY93): one aggregation of tagged rows."""
    a = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.lit("first").alias("s"))
    b = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("second").alias("s"))
    g = a.unionByName(b).groupBy("k").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    return g.select("k", F.when(F.col("lo") != F.col("hi"), "both").otherwise(F.col("lo")).alias("side"))


@query("participants", "SELECT conv_id, count(*) AS comments, count(DISTINCT role) AS participants FROM conversations GROUP BY 1")
def participants(spark, d):
    """Comments and distinct participants of every thread (FIL21, FIL23)."""
    return _t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("comments"), F.countDistinct("role").alias("participants"))


@query("release_components", "SELECT o_custkey AS release, CAST(list_count(list_distinct(list(l_suppkey))) AS BIGINT) AS reviewers, count(DISTINCT o_orderkey) AS changes FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
def release_components(spark, d):
    """Changes and people of a release (QRY86, QRY87)."""
    j = _t(spark, d, "orders").filter("o_orderstatus = 'F'").join(_t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy(F.col("o_custkey").alias("release")).agg(F.countDistinct("l_suppkey").alias("reviewers"), F.countDistinct("o_orderkey").alias("changes"))


@query("agreement_matrix", "WITH t AS (SELECT DISTINCT source, event FROM (SELECT source, CASE WHEN contains(lower(text), 'license') THEN 'license' WHEN contains(text, '@') THEN 'mail' ELSE 'plain' END AS event FROM documents)) SELECT source, max(CASE WHEN event = 'license' THEN 1 ELSE 0 END) AS license, max(CASE WHEN event = 'mail' THEN 1 ELSE 0 END) AS mail, max(CASE WHEN event = 'plain' THEN 1 ELSE 0 END) AS plain FROM t GROUP BY 1")
def agreement_matrix(spark, d):
    """Which themes each source has (QRY100, AGG24)."""
    e = F.when(F.lower("text").contains("license"), "license").when(F.col("text").contains("@"), "mail").otherwise("plain")
    g = _t(spark, d, "documents").select("source", e.alias("e")).groupBy("source")
    return g.agg(*[F.max((F.col("e") == x).cast("int")).alias(x) for x in ("license", "mail", "plain")])


@query("proposal_activity", "WITH a AS (SELECT user_id AS actor, count(*) AS n FROM events GROUP BY 1), b AS (SELECT o_custkey AS actor, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS r FROM orders GROUP BY 1) SELECT b.actor, b.n + coalesce(a.n, 0) AS activity, b.r AS opposed FROM b LEFT JOIN a USING (actor)")
def proposal_activity(spark, d):
    """Activity over two sources and opposed proposals (QRY50-QRY52, QRY6)."""
    a = _t(spark, d, "events").groupBy(F.col("user_id").alias("actor")).agg(F.count("*").alias("e"))
    b = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("actor")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("opposed"))
    return b.join(a, "actor", "left").select("actor", (F.col("n") + F.coalesce("e", F.lit(0))).alias("activity"), "opposed")


@query("score_flags", "SELECT l_linestatus, count(*) FILTER (WHERE s < 0.5) AS zero_reviews, round(CAST(avg(s) AS DOUBLE), 6) AS mean FROM (SELECT l_linestatus, l_orderkey, sum(CASE WHEN l_returnflag = 'N' THEN 0.3 ELSE 1.0 END) AS s FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def score_flags(spark, d):
    """Keyword scores summed per change and the zero flag (CLS38-CLS41)."""
    s = _t(spark, d, "lineitem").groupBy("l_linestatus", "l_orderkey").agg(F.sum(F.when(F.col("l_returnflag") == "N", 0.3).otherwise(1.0)).alias("s"))
    return s.groupBy("l_linestatus").agg(F.count_if(F.col("s") < 0.5).alias("zero_reviews"), r6(F.avg("s")).alias("mean"))


@query("correlation_words", "WITH c AS (SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1) SELECT l_returnflag, CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.3 THEN 'moderate' ELSE 'weak' END || CASE WHEN r >= 0 THEN ' positive' ELSE ' negative' END AS words FROM c")
def correlation_words(spark, d):
    """Correlations in words (CLS44, CLS45)."""
    c = _t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.corr("l_quantity", "l_extendedprice").alias("r"))
    return c.select("l_returnflag", C.correlation_words(F.col("r")).alias("words"))


@query("pressure_context", f"WITH p AS (SELECT count(*) FILTER (WHERE {_sql_hits('lower(text)', ['license', 'token'])} > 0) AS hits FROM documents) SELECT o_orderpriority, max(hits) AS hits, count(*) AS n FROM orders CROSS JOIN p GROUP BY 1")
def pressure_context(spark, d):
    """A one-row result put beside every group (FIL24)."""
    p = _t(spark, d, "documents").agg(F.count_if(T.hits(F.lower("text"), ["license", "token"]) > 0).alias("hits"))
    return _t(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).crossJoin(F.broadcast(p)).select("o_orderpriority", "hits", "n")


@query("chart_series", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(DISTINCT o_custkey) AS mergers, round(count(*) / CAST(count(DISTINCT o_custkey) AS DOUBLE), 6) AS per_merger FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def chart_series(spark, d):
    """Series for charts (QRY103, QRY104, SRC29)."""
    m = _t(spark, d, "orders").filter("o_orderstatus = 'F'").groupBy(F.year("o_orderdate").alias("year"))
    return m.agg(F.countDistinct("o_custkey").alias("mergers"), r6(ratio(F.count("*"), F.countDistinct("o_custkey"))).alias("per_merger"))
