"""Pairs, periods, scores with thresholds, importance variants, prose and exports over the case tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyhall.functions import dates as D
from tallyhall.functions import keywords as K
from tallyhall.functions import text as T
from tallyhall.functions.numbers import r6
from tallyhall.operators import audit as A
from tallyhall.operators import classify as C
from tallyhall.operators import relational as R
from tallyhall.operators import stats as S
from tallyhall.operators import windows as W
from tallyhall.plans.case_queries import _TB, _TEAM, _year, is_team
from tallyhall.plans.cases import case, given
from tallyhall.plans.registry import query
from tallyhall.plans.text_queries import _sql_any
from tallyhall.sources import readers

_MERGES = "SELECT lower(merged_by) AS src, lower(author) AS dst, count(*) AS w FROM changes WHERE merged AND coalesce(author, '') <> '' AND coalesce(merged_by, '') <> '' AND lower(author) <> lower(merged_by) GROUP BY 1, 2"


@query("coalitions", given("changes") + f", e AS ({_MERGES}) SELECT a.src AS a, a.dst AS b, a.w AS a_to_b, b.w AS b_to_a, round(least(a.w, b.w) / CAST(greatest(a.w, b.w) AS DOUBLE), 6) AS reciprocity FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def coalitions(spark, d):
    """Pairs who merge each other's changes, by one aggregation of unordered pairs (JOIN11)."""
    e = case(spark, "changes").filter("merged AND author <> '' AND merged_by <> ''").groupBy(F.lower("merged_by").alias("src"), F.lower("author").alias("dst")).agg(F.count("*").alias("w"))
    return R.reciprocity(e, "src", "dst", "w").filter("a_to_b > 0 AND b_to_a > 0").withColumn("reciprocity", r6(F.col("reciprocity")))


@query("returned_reviews", given("changes", "reviews") + ", e AS (SELECT DISTINCT lower(r.author) AS src, lower(c.author) AS dst FROM reviews r JOIN changes c USING (number) WHERE coalesce(c.author, '') <> '' AND lower(r.author) <> lower(c.author)) SELECT src, dst, EXISTS (SELECT 1 FROM e f WHERE f.src = e.dst AND f.dst = e.src) AS returned FROM e")
def returned_reviews(spark, d):
    """Whether the other side reviews back (JOIN10)."""
    c = case(spark, "changes").filter("author <> ''").select("number", F.lower("author").alias("dst"))
    e = case(spark, "reviews").select("number", F.lower("author").alias("src")).join(c, "number").filter("src <> dst").select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("returned"))
    return e.join(back, ["src", "dst"], "left").withColumn("returned", F.coalesce("returned", F.lit(False)))


@query("contributor_periods", given("changes") + ", e AS (SELECT lower(author) AS who, TRY_CAST(created AS TIMESTAMP) AS ts FROM changes WHERE coalesce(author, '') <> '' AND TRY_CAST(created AS TIMESTAMP) IS NOT NULL), g AS (SELECT *, CASE WHEN floor(date_diff('second', lag(ts) OVER w, ts) / 86400) > 180 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY who ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY who ORDER BY ts) AS k FROM g) SELECT who, CAST(k AS BIGINT) AS session, count(*) AS n, CAST(floor(date_diff('second', min(ts), max(ts)) / 86400) AS BIGINT) AS days FROM s GROUP BY 1, 2")
def contributor_periods(spark, d):
    """Periods of contributing, cut at gaps of more than 180 days (WIN3)."""
    e = case(spark, "changes").filter("author <> ''").select(F.lower("author").alias("who"), D.parse(F.col("created")).alias("ts")).filter("ts IS NOT NULL")
    return W.gap_sessions(e, "who", "ts").select("who", F.col("session").cast("long").alias("session"), "n", D.whole_days(F.col("start"), F.col("end")).alias("days"))


_SAID = ["ACK deadbeef1", "utACK abc1234 after tests", "tested 0123456789abcdef0123456789abcdef01234567", "no hash here", "back in 2014", "#1234 and pull/5678, PR 91011 or pull request #1213", "see https://forge.example/pull/1415 and #12", "fixes #1617; closes PR#1819"]
_SAID_SQL = "WITH s AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{t}')" for k, t in enumerate(_SAID)) + ") t(id, t))"


@query("hash_mentions", _SAID_SQL + " SELECT id, regexp_matches(t, '(?i)[a-f0-9]{7,40}') AS has_hash, regexp_matches(t, '(?im)(?:^|\\s)ack(?:\\s|$|[,:])') AS is_ack FROM s")
def hash_mentions(spark, d):
    """Texts that name a commit, and acknowledgements (STR8, STR7)."""
    t = F.col("t")
    return spark.createDataFrame(list(enumerate(_SAID)), "id int, t string").select("id", t.rlike(T.HASH).alias("has_hash"), C.is_ack(t).alias("is_ack"))


_FORMS = {"hash_or_pull": r"(?:#|pull/)(\d{4,6})", "hash": r"#(\d+)", "words": r"(?i)(?:PR|pull request)\s*#?(\d+)"}


@query("mention_forms", _SAID_SQL + " " + " UNION ALL ".join(f"SELECT '{k}' AS form, id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '{p}', 1))), ',') AS numbers FROM s WHERE regexp_matches(t, '{p}')" for k, p in _FORMS.items()))
def mention_forms(spark, d):
    """Numbers of changes in the three forms in which texts name them (STR10, STR9)."""
    s = spark.createDataFrame(list(enumerate(_SAID)), "id int, t string")
    found = F.array(*[F.struct(F.lit(k).alias("form"), F.array_sort(F.array_distinct(F.regexp_extract_all("t", F.lit(p), 1))).alias("n")) for k, p in _FORMS.items()])
    return s.select("id", F.explode(found).alias("f")).filter(F.size("f.n") > 0).select("f.form", "id", F.array_join("f.n", ",").alias("numbers"))


@query("premium_tests", given("changes") + f""", p AS (SELECT coalesce(lower(author), '') IN ({_TEAM}) AS team, merged, date_diff('second', TRY_CAST(created AS TIMESTAMP), TRY_CAST(merged_at AS TIMESTAMP)) / 86400.0 AS days FROM changes),
c AS (SELECT team, merged, count(*) AS n FROM p GROUP BY 1, 2), m AS (SELECT a.n AS n, (SELECT sum(n) FROM c x WHERE x.team = a.team) AS ra, (SELECT sum(n) FROM c x WHERE x.merged = a.merged) AS rb, (SELECT sum(n) FROM c) AS t FROM c a),
g AS (SELECT avg(days) FILTER (WHERE team) AS m1, var_samp(days) FILTER (WHERE team) AS v1, count(days) FILTER (WHERE team) AS n1, avg(days) FILTER (WHERE NOT team) AS m2, var_samp(days) FILTER (WHERE NOT team) AS v2, count(days) FILTER (WHERE NOT team) AS n2 FROM p WHERE days >= 0)
SELECT round((SELECT sum(pow(greatest(abs(n - CAST(ra AS DOUBLE) * rb / t) - 0.5, 0), 2) / (CAST(ra AS DOUBLE) * rb / t)) FROM m), 6) AS chi2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t FROM g""")
def premium_tests(spark, d):
    """Whether maintainers' changes are merged more often, and sooner (STA11)."""
    days = D.days_between(D.parse(F.col("created")), D.parse(F.col("merged_at")))
    p = case(spark, "changes").select(is_team(F.col("author")).alias("team"), F.col("merged").cast("string").alias("merged"), days.alias("days"))
    chi = S.chi_square(S.crosstab(p.withColumn("team", F.col("team").cast("string")), "team", "merged")).select(r6(F.col("chi2")).alias("chi2"), F.lit(None).cast("double").alias("t"))

    def of(fn, on):
        return fn(F.when(F.col("team") == on, F.col("days")))

    g = p.filter("days >= 0").agg(of(F.avg, True).alias("m1"), of(F.var_samp, True).alias("v1"), of(F.count, True).alias("n1"), of(F.avg, False).alias("m2"), of(F.var_samp, False).alias("v2"), of(F.count, False).alias("n2"))
    t = g.select(F.lit(None).cast("double").alias("chi2"), r6((F.col("m1") - F.col("m2")) / F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2"))).alias("t"))
    return chi.unionByName(t).agg(F.max("chi2").alias("chi2"), F.max("t").alias("t"))


_FORMAL = "CASE WHEN state NOT IN ('APPROVED', 'CHANGES_REQUESTED') THEN CASE WHEN n > 0 THEN 0.5 ELSE 0.3 END WHEN n > {long} THEN 1.0 WHEN n > {short} THEN 0.8 WHEN n > 0 THEN 0.7 ELSE 0.5 END"


def _scores_sql(long: int = 50, short: int = 10) -> str:
    return f"s AS (SELECT number, lower(author) AS who, CAST({_FORMAL.format(long=long, short=short)} AS DOUBLE) AS s FROM (SELECT *, length(trim(coalesce(body, ''))) AS n FROM reviews))"


def _scores(spark, long=50, short=10):
    return case(spark, "reviews").select("number", F.lower("author").alias("who"), C.formal_score(F.col("state"), F.col("body"), long, short).alias("s"))


@query("reducer_comparison", given("changes", "reviews") + f", {_scores_sql()}, b AS (SELECT number, who, max(s) AS best, sum(s) AS every FROM s GROUP BY 1, 2), w AS (SELECT number, sum(best) AS best, sum(every) AS every FROM b GROUP BY 1) SELECT {_year('created')} < 2018 AS early, count(*) AS merged, round(avg(CAST(coalesce(best, 0) < 0.5 AS INTEGER)) * 100, 6) AS zero_by_best, round(avg(CAST(coalesce(every, 0) < 0.5 AS INTEGER)) * 100, 6) AS zero_by_sum, round(avg(coalesce(best, 0)), 6) AS mean_best, round(avg(coalesce(every, 0)), 6) AS mean_sum FROM changes LEFT JOIN w USING (number) WHERE merged GROUP BY 1")
def reducer_comparison(spark, d):
    """Best or summed scores of each reviewer: two reducers in one pass (STA13, AGG27, CLS41)."""
    b = _scores(spark).groupBy("number", "who").agg(F.max("s").alias("best"), F.sum("s").alias("every"))
    w = b.groupBy("number").agg(F.sum("best").alias("best"), F.sum("every").alias("every"))
    m = case(spark, "changes").filter("merged").join(w, "number", "left").select((D.year_of_prefix(F.col("created")) < 2018).alias("early"), F.coalesce("best", F.lit(0.0)).alias("best"), F.coalesce("every", F.lit(0.0)).alias("every"))
    zero = lambda c: r6(F.avg((F.col(c) < 0.5).cast("int")) * 100)
    return m.groupBy("early").agg(F.count("*").alias("merged"), zero("best").alias("zero_by_best"), zero("every").alias("zero_by_sum"), r6(F.avg("best")).alias("mean_best"), r6(F.avg("every")).alias("mean_sum"))


@query("uniform_thresholds", given("changes", "reviews") + f", {_scores_sql()}, w AS (SELECT number, sum(s) AS s FROM (SELECT number, who, max(s) AS s FROM s GROUP BY 1, 2) GROUP BY 1), m AS (SELECT {_year('created')} < 2018 AS early, coalesce(s, 0) AS s FROM changes LEFT JOIN w USING (number) WHERE merged), t AS (SELECT * FROM (VALUES ('by_era', 0.3, 0.5), ('uniform', 0.5, 0.5)) t(name, a, b)) SELECT name, early, count(*) AS n, count(*) FILTER (WHERE s < CASE WHEN early THEN a ELSE b END) AS zero FROM m, t GROUP BY 1, 2")
def uniform_thresholds(spark, d):
    """Changes without a meaningful review under thresholds by era and under one threshold (STA14, AGG26, AGG28)."""
    w = _scores(spark).groupBy("number", "who").agg(F.max("s").alias("s")).groupBy("number").agg(F.sum("s").alias("s"))
    m = case(spark, "changes").filter("merged").join(w, "number", "left").select((D.year_of_prefix(F.col("created")) < 2018).alias("early"), F.coalesce("s", F.lit(0.0)).alias("s"))
    low = [("by_era", F.when(F.col("early"), 0.3).otherwise(0.5)), ("uniform", F.lit(0.5))]
    each = m.select("early", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), (F.col("s") < x).alias("z")) for k, x in low])).alias("r"))
    return each.groupBy("r.name", "early").agg(F.count("*").alias("n"), F.count_if("r.z").alias("zero"))


_CUTS = [(50, 10), (100, 20), (30, 5)]


@query("length_sensitivity", given("reviews") + " " + " UNION ALL ".join(f"SELECT {lo} AS detailed, {sh} AS good, round(avg(CAST({_FORMAL.format(long=lo, short=sh)} AS DOUBLE)), 6) AS mean_score FROM (SELECT *, length(trim(coalesce(body, ''))) AS n FROM reviews)" for lo, sh in _CUTS))
def length_sensitivity(spark, d):
    """Mean scores under several cut-offs of length, in one pass over the reviews (CLS40, STA12)."""
    each = F.array(*[F.struct(F.lit(lo).alias("detailed"), F.lit(sh).alias("good"), C.formal_score(F.col("state"), F.col("body"), lo, sh).alias("s")) for lo, sh in _CUTS])
    return case(spark, "reviews").select(F.explode(each).alias("r")).groupBy("r.detailed", "r.good").agg(r6(F.avg("r.s")).alias("mean_score"))


@query("keyword_review_scores", given("changes", "reviews") + ", w AS (SELECT number, sum(CASE WHEN contains(lower(coalesce(body, '')), 'ack') OR contains(lower(coalesce(body, '')), 'lgtm') THEN 0.3 ELSE 1.0 END) AS s FROM reviews GROUP BY 1) SELECT number, round(CAST(coalesce(s, 0) AS DOUBLE), 6) AS score, coalesce(s, 0) < 0.5 AS is_zero FROM changes LEFT JOIN w USING (number) WHERE coalesce(number, 0) <> 0")
def keyword_review_scores(spark, d):
    """Scores of changes by the words of their reviews alone, and which have none to speak of (CLS38, CLS39)."""
    one = T.lowered(F.col("body"), lambda b: F.when(T.contains_any(b, ["ack", "lgtm"]), F.lit("0.3")).otherwise(F.lit("1.0")).cast("decimal(10,1)"))
    w = case(spark, "reviews").groupBy("number").agg(F.sum(one).alias("s"))
    s = F.coalesce("s", F.lit(0).cast("decimal(10,1)"))
    return case(spark, "changes").filter("number <> 0").join(w, "number", "left").select("number", r6(s.cast("double")).alias("score"), (s < 0.5).alias("is_zero"))


@query("baseline_comparison", given("changes") + f", w AS (SELECT * FROM (VALUES ('first', 2012, 2016), ('second', 2019, 2023)) t(name, lo, hi)) SELECT name, count(*) AS changes, round(avg(CAST(merged AS INTEGER)), 6) AS merge_rate, round(avg(CAST(merged AS INTEGER)) - (SELECT avg(CAST(merged AS INTEGER)) FROM changes), 6) AS over_baseline FROM changes JOIN w ON {_year('created')} BETWEEN lo AND hi GROUP BY name")
def baseline_comparison(spark, d):
    """Merge rates of fixed windows against the whole (QRY47)."""
    y = D.year_of_prefix(F.col("created"))
    name = F.when(y.between(2012, 2016), "first").when(y.between(2019, 2023), "second")
    c = case(spark, "changes").select(name.alias("name"), F.col("merged").cast("int").alias("m")).groupBy("name").agg(F.count("*").alias("changes"), F.sum("m").alias("m"))
    whole = Window.partitionBy(F.lit(1))  # at most three rows
    rate = F.col("m") / F.col("changes")
    return c.select("name", "changes", r6(rate).alias("merge_rate"), r6(rate - F.sum("m").over(whole) / F.sum("changes").over(whole)).alias("over_baseline")).filter("name IS NOT NULL")


_VARIANT = f"CASE WHEN {_sql_any(_TB, K.CRITICAL)} OR n > 1000 THEN 'critical' WHEN {_sql_any(_TB, K.HOUSEKEEPING)} AND n < 10 THEN 'trivial' WHEN {_sql_any(_TB, K.HOUSEKEEPING)} THEN 'low' WHEN n >= 200 THEN 'high' WHEN n < 5 THEN 'trivial' ELSE 'normal' END"


@query("importance_variant", given("changes") + f", c AS (SELECT *, additions + deletions AS n FROM changes) SELECT {_VARIANT} AS importance, count(*) AS changes, count(*) FILTER (WHERE merged) AS merged FROM c GROUP BY 1")
def importance_variant(spark, d):
    """Importance by the variant without the rule for core files (CLS36, AGG24)."""
    i = C.importance_variant(F.col("title"), F.col("body"), F.col("additions") + F.col("deletions"))
    return case(spark, "changes").select(i.alias("importance"), "merged").groupBy("importance").agg(F.count("*").alias("changes"), F.count_if("merged").alias("merged"))


_LEVELS = [0.95, 0.7, 0.65, 0.6, 0.55, 0.5, 0.3]


@query("scale_words", "WITH v AS (SELECT * FROM (VALUES " + ", ".join(f"(CAST({x} AS DOUBLE))" for x in _LEVELS) + ") t(x)) SELECT x, CASE WHEN x > 0.7 THEN 'strong' WHEN x > 0.5 THEN 'moderate' ELSE 'weak' END AS homophily, CASE WHEN x >= 0.7 THEN 'very high' WHEN x >= 0.6 THEN 'high' WHEN x >= 0.5 THEN 'moderate' ELSE 'low' END AS edges, CASE WHEN x * 2 > 1.5 THEN 'high' WHEN x * 2 > 1.2 THEN 'moderate' ELSE 'low' END AS toxicity, CASE WHEN x * 3 > 2.0 THEN 'high' WHEN x * 3 > 1.5 THEN 'moderate' ELSE 'low' END AS privilege FROM v")
def scale_words(spark, d):
    """Words for coefficients and ratios on their four scales (CLS45, CLS46, CLS47)."""
    x = F.col("x")
    edges = F.when(x >= 0.7, "very high").when(x >= 0.6, "high").when(x >= 0.5, "moderate").otherwise("low")
    return spark.createDataFrame([(v,) for v in _LEVELS], "x double").select("x", C.homophily_level(x).alias("homophily"), edges.alias("edges"), C.ratio_words(x * 2, 1.5, 1.2).alias("toxicity"), C.ratio_words(x * 3, 2.0, 1.5).alias("privilege"))


_PROSE = [
    ("a", "The rate is 30.2 %.\nIt probably fell, as it seems.\nMany people left; a few came.\n**Note** it might be wrong"), ("b", "The rate is 34.4 %.\nIf so, it should be lower, several say.\nsee [x](data/x.json) and [y](https://z.example) and [z](notes.md#top)"),
    ("c", "Nothing to see.\nSome numbers, a lot of them, could indicate it.\nlikely likely"), ("d", "plain text\n```maybe code```"),
]
_PROSE_SQL = "WITH p AS (SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(k, t.replace("\n", "' || chr(10) || '")) for k, t in _PROSE) + ") t(name, body))"


def _prose(spark):
    return spark.createDataFrame(_PROSE, "name string, body string")


@query("speculation", _PROSE_SQL + ", l AS (SELECT name, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS k FROM p), h AS (SELECT *, " + " + ".join(f"len(regexp_extract_all(line, '(?i){p}'))" for p in A.SPECULATIVE) + " AS hits FROM l) SELECT name, CAST(k AS INTEGER) AS line_number, line, CAST(hits AS INTEGER) AS hits FROM h WHERE hits > 0 AND NOT contains(line, '```') AND NOT contains(line, '**Note**') AND NOT contains(line, '**Limitation**')")
def speculation(spark, d):
    """Lines with speculative wording, with the true patterns (TXT1)."""
    return A.speculative(_prose(spark), "name", "body")


@query("vague_words", _PROSE_SQL + " " + " UNION ALL ".join(f"SELECT name, '{p}' AS pattern, trim(replace(unnest(regexp_extract_all(body, '(?is)(.{{0,30}})({p})(.{{0,30}})')), chr(10), ' ')) AS context FROM p" for p in A.VAGUE))
def vague_words(spark, d):
    """Vague quantifiers with what stands around them, with the true patterns (TXT3, TXT6)."""
    return A.vague(_prose(spark), "name", "body")


@query("stated_rates", _PROSE_SQL + r", v AS (SELECT name, unnest(regexp_extract_all(body, 'rate is ([0-9.]+)', 1)) AS v FROM p) SELECT 'rate' AS metric, count(DISTINCT v) AS n_values, count(DISTINCT name) AS n_documents FROM v HAVING count(DISTINCT v) > 1")
def stated_rates(spark, d):
    """A figure that two texts state differently (TXT2, TXT7)."""
    return A.conflicting_values(_prose(spark), "name", "body", {"rate": r"rate is ([0-9.]+)"})


@query("dead_links", _PROSE_SQL + r", l AS (SELECT name, unnest(regexp_extract_all(body, '\[[^\]]*\]\(([^)#\s]+)', 1)) AS target FROM p) SELECT name, target FROM l WHERE NOT regexp_matches(target, '^(https?|mailto):') AND target NOT IN ('notes.md')")
def dead_links(spark, d):
    """Links to files that aren't there (TXT7)."""
    return A.broken_links(_prose(spark), "name", "body", spark.createDataFrame([("notes.md",)], "path string"), "path")


@query("graph_rows", given("changes") + f", e AS ({_MERGES}), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), s AS (SELECT id, CAST((SELECT coalesce(sum(w), 0) FROM e WHERE src = id OR dst = id) AS BIGINT) AS degree FROM n) SELECT 'node' AS kind, '{{\"id\":\"' || id || '\",\"degree\":' || degree || '}}' AS json FROM s UNION ALL SELECT 'edge', '{{\"src\":\"' || src || '\",\"dst\":\"' || dst || '\",\"w\":' || w || '}}' FROM e")
def graph_rows(spark, d):
    """Nodes and edges of the merge graph as rows of JSON for a chart (SRC29)."""
    e = case(spark, "changes").filter("merged AND author <> '' AND merged_by <> '' AND lower(author) <> lower(merged_by)").groupBy(F.lower("merged_by").alias("src"), F.lower("author").alias("dst")).agg(F.count("*").alias("w"))
    n = e.select(F.explode(F.array("src", "dst")).alias("id"), "w").groupBy("id").agg(F.sum("w").alias("degree"))
    return readers.graph_json(n, e)


@query("alias_resolution", given("chat", "aliases") + ", e AS (SELECT lower(nickname) AS n FROM chat WHERE coalesce(nickname, '') <> ''), k AS (SELECT lower(id) AS id, max(unified) AS unified FROM aliases GROUP BY 1) SELECT coalesce(unified, n) AS who, count(*) AS messages, count(DISTINCT n) AS names, bool_or(unified IS NOT NULL) AS known FROM e LEFT JOIN k ON id = n GROUP BY 1")
def alias_resolution(spark, d):
    """Chat by person: known names of people become one, others stay (IDR5, IDR10, IDR11)."""
    k = case(spark, "aliases").groupBy(F.lower("id").alias("id")).agg(F.max("unified").alias("unified"))
    e = case(spark, "chat").filter("nickname <> ''").select(F.lower("nickname").alias("n"), F.lower("nickname").alias("who"))
    known = R.resolve(e, k.withColumn("unified", F.concat(F.lit("\u0001"), "unified")), "who", "id", "unified")
    return known.select("n", F.replace("who", F.lit("\u0001"), F.lit("")).alias("who"), F.col("who").startswith("\u0001").alias("k")).groupBy("who").agg(F.count("*").alias("messages"), F.countDistinct("n").alias("names"), F.bool_or("k").alias("known"))


@query("merge_reach", given("changes") + " SELECT lower(merged_by) AS who, count(*) AS merges, count(DISTINCT lower(author)) AS authors FROM changes WHERE merged AND coalesce(merged_by, '') <> '' GROUP BY 1")
def merge_reach(spark, d):
    """How much everybody merges and for how many authors (GRA7, GRA2)."""
    return case(spark, "changes").filter("merged AND merged_by <> ''").groupBy(F.lower("merged_by").alias("who")).agg(F.count("*").alias("merges"), F.countDistinct(F.lower("author")).alias("authors"))
