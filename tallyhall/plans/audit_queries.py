"""Audits of prose, limits and scores over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhall.functions import text as T
from tallyhall.functions.numbers import r6
from tallyhall.operators import audit as A
from tallyhall.plans.registry import query, table


@query("speculative_lines", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS lines FROM l WHERE regexp_matches(line, '(?i)\\b(likely|probably|perhaps|maybe|might|could|possibly|seems|appears|suggests|indicates)\\b|\\b(if|assuming|suppose|presumably|presume)\\b|\\b(would|should|may|can)\\s+(be|have|mean|indicate|suggest)') AND NOT contains(line, '```') AND NOT contains(line, '**Note**') AND NOT contains(line, '**Limitation**') GROUP BY 1")
def speculative_lines(spark, d):
    """Lines with speculative wording (TXT1)."""
    return A.speculative(table(spark, d, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("vague_quantifiers", "SELECT CAST(sum(len(regexp_extract_all(lower(text), '(?s)(.{0,30})(license)(.{0,30})'))) AS BIGINT) AS hits FROM documents")
def vague_quantifiers(spark, d):
    """Phrase hits with their surroundings (TXT3, TXT6)."""
    return A.vague(table(spark, d, "documents").withColumn("t", F.lower("text")), "doc_id", "t", ["license"]).agg(F.count("*").alias("hits"))


@query("conflicting_values", "SELECT 'token' AS metric, count(DISTINCT v) AS n_values, count(DISTINCT doc_id) AS n_documents FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'token = \"([0-9a-f]+)', 1)) AS v FROM documents) HAVING count(DISTINCT v) > 1")
def conflicting_values(spark, d):
    """A metric that documents state differently (TXT2)."""
    return A.conflicting_values(table(spark, d, "documents"), "doc_id", "text", {"token": r'token = "([0-9a-f]+)'})


@query("long_sentences", "WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]+\\s')) AS sentence FROM documents), n AS (SELECT doc_id, len(list_filter(regexp_split_to_array(trim(sentence), '\\s+'), lambda x: x <> '')) AS k FROM s) SELECT doc_id, count(*) AS sentences, CAST(max(k) AS INTEGER) AS longest FROM n WHERE k > 100 GROUP BY 1")
def long_sentences(spark, d):
    """Sentences of more than a hundred words (TXT5)."""
    s = A.long_sentences(table(spark, d, "documents"), "doc_id", "text")
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max("n_words").alias("longest"))


@query("call_limit", "WITH w AS (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS k FROM events) SELECT user_id, max(k) AS busiest, count(*) FILTER (WHERE k > 3) AS refused FROM w GROUP BY 1")
def call_limit(spark, d):
    """Calls over a sliding hourly limit (DQ13)."""
    a = A.admitted(table(spark, d, "events"), "ts", 3, 3600, ["user_id"])
    return a.groupBy("user_id").agg(F.max("in_window").alias("busiest"), F.count_if(~F.col("within")).alias("refused"))


@query("message_scores", "WITH m AS (SELECT role, text, role = 'assistant' AS k, contains(lower(text), 'tion') AS hi, contains(lower(text), 'the') AS mid, length(text) AS n FROM conversations), s AS (SELECT role, CASE WHEN k AND hi THEN CASE WHEN n > 100 THEN 1.0 WHEN n > 50 THEN 0.8 ELSE 0.7 END WHEN k OR hi THEN CASE WHEN n > 50 THEN 0.6 ELSE 0.5 END WHEN mid THEN 0.3 ELSE 0.2 END AS c, CASE WHEN hi THEN CASE WHEN n > 200 THEN 1.0 WHEN n > 100 THEN 0.8 ELSE 0.7 END WHEN mid THEN CASE WHEN n > 100 THEN 0.6 ELSE 0.5 END ELSE 0.3 END AS e FROM m) SELECT role, round(CAST(avg(c) AS DOUBLE), 6) AS chat, round(CAST(avg(e) AS DOUBLE), 6) AS mail FROM s GROUP BY 1")
def message_scores(spark, d):
    """Messages scored as chat and as mail reviews (CLS13, CLS14, CLS42)."""
    low, body = F.lower("text"), F.col("text")
    hi, mid = T.contains_any(low, ["tion"]), T.contains_any(low, ["the"])
    s = table(spark, d, "conversations").select("role", A.chat_score(body, F.col("role") == "assistant", hi, mid).alias("c"), A.mail_score(body, hi, mid).alias("e"))
    return s.groupBy("role").agg(r6(F.avg("c")).alias("chat"), r6(F.avg("e")).alias("mail"))


@query("report_errors", "SELECT CAST(count(*) FILTER (WHERE json_extract(props, '$.k') IS NULL) AS BIGINT) AS without_k, CAST(count(*) FILTER (WHERE json_extract(props, '$.missing') IS NULL) AS BIGINT) AS without_missing FROM events")
def report_errors(spark, d):
    """Required parts of JSON text (JSN3)."""
    body = F.concat(F.lit('{"metadata": '), F.col("props"), F.lit(', "data": {}}'))
    e = table(spark, d, "events").select(A.report_errors(body, ["k", "missing"], []).alias("e"))
    return e.agg(F.count_if(F.array_contains("e", "metadata.k")).alias("without_k"), F.count_if(F.array_contains("e", "metadata.missing")).alias("without_missing"))


@query("name_matches", "SELECT n_name, count(*) AS n FROM nation JOIN region ON contains(lower(n_name), lower(substring(r_name, 1, 1))) GROUP BY 1")
def name_matches(spark, d):
    """Substring match of a small dimension against another (JOIN15, JOIN16, IDR5)."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(F.broadcast(r), F.contains(F.lower("n_name"), F.lower(F.substring("r_name", 1, 1)))).groupBy("n_name").agg(F.count("*").alias("n"))


@query("signing_by_year", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS releases, count(*) FILTER (WHERE o_orderstatus <> 'P') AS signed, count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus <> 'P') AS signers, round(count(*) FILTER (WHERE o_orderstatus <> 'P') / CAST(count(*) AS DOUBLE), 6) AS rate FROM orders GROUP BY 1")
def signing_by_year(spark, d):
    """Signed releases, signers and rate per year (SRC8, QRY74, QRY75, QRY97)."""
    signed = F.col("o_orderstatus") != "P"
    g = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"))
    return g.agg(F.count("*").alias("releases"), F.count_if(signed).alias("signed"), F.countDistinct(F.when(signed, F.col("o_custkey"))).alias("signers"), r6(F.count_if(signed) / F.count("*")).alias("rate"))


@query("repository_compare", "WITH c AS (SELECT r_name AS repo, o_custkey AS actor, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS m FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, actor) AS i FROM c) SELECT repo, count(*) AS authors, CAST(sum(n) AS BIGINT) AS changes, round(sum(m) / CAST(sum(n) AS DOUBLE), 6) AS merge_rate, round(sum(n) FILTER (WHERE i <= 3) / CAST(sum(n) AS DOUBLE), 6) AS top3_share FROM r GROUP BY 1")
def repository_compare(spark, d):
    """Repositories side by side (QRY53, QRY54, QRY94): authors are reduced before the dimension joins."""
    from pyspark.sql import Window

    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("m"))
    geo = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("repo"))
    c = per.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    r = c.withColumn("i", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("n"), "o_custkey")))
    return r.groupBy("repo").agg(F.count("*").alias("authors"), F.sum("n").alias("changes"), r6(F.sum("m") / F.sum("n")).alias("merge_rate"), r6(F.sum(F.when(F.col("i") <= 3, F.col("n"))) / F.sum("n")).alias("top3_share"))
