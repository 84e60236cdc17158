"""Networks, channels, periods, histories, archives and checks over the case tables; inequality over orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyhall.functions import dates as D
from tallyhall.functions import keywords as K
from tallyhall.functions import text as T
from tallyhall.functions.numbers import r6, ratio
from tallyhall.operators import classify as C
from tallyhall.operators import concentration as N
from tallyhall.operators import people
from tallyhall.operators import quality as Q
from tallyhall.plans.case_queries import _NEAR, _TB, _TEAM, _title_body, _year, is_team
from tallyhall.plans.cases import case, given
from tallyhall.plans.registry import query, table
from tallyhall.plans.text_queries import _sql_any, _sql_hits


def _forms(values: str, by: str = "") -> str:
    """SQL of the forms over ``values`` (by, x): ranks by row numbers."""
    b, part, lead = (f"{by}, ", f"PARTITION BY {by} ", f"{by}, ") if by else ("", "", "")
    return f""", u AS (SELECT {b}CAST(x AS DOUBLE) AS x, row_number() OVER ({part}ORDER BY x) AS i, row_number() OVER ({part}ORDER BY x DESC) AS j, CASE WHEN x > 0 THEN row_number() OVER ({part}ORDER BY CASE WHEN x > 0 THEN 1 ELSE 0 END DESC, x) END AS k FROM {values})
SELECT {lead}count(*) AS actors, round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1.0) / count(*), 6) AS gini_zeros, round((2 * sum(k * x) - (count(k) + 1) * sum(x)) / (count(k) * sum(x)), 6) AS gini_positive,
round(1 - 2 * sum(j * x) / (count(*) * sum(x)), 6) AS gini_descending, round(2 * sum(j * x) / (count(*) * sum(x)) - (count(*) + 1.0) / count(*), 6) AS gini_flipped,
{', '.join(f'round(sum(x) FILTER (WHERE j <= {t}) / sum(x), 6) AS top{t}_share' for t in (1, 3, 5, 10))} FROM u""" + (f" GROUP BY {by}" if by else "")


@query("winner_take_all", "WITH c AS (SELECT c_custkey, count(o_orderkey) AS x FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)" + _forms("c"))
def winner_take_all(spark, d):
    """Shares of the first, five and ten first actors, and the other published forms of the coefficient (CON9, CON11, CON13, CON17)."""
    c = table(spark, d, "customer").select("c_custkey")
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("x"))
    return N.gini_forms(c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("x", F.lit(0)).alias("x")))


_PERIOD = "CASE WHEN y BETWEEN 2012 AND 2020 THEN 'historical' WHEN y BETWEEN 2021 AND 2025 THEN 'recent' ELSE 'other' END"


@query("merger_control", given("changes") + f", e AS (SELECT {_year('merged_at')} AS y, merged_by FROM changes WHERE merged AND coalesce(merged_by, '') <> '' AND merged_at IS NOT NULL), c AS (SELECT {_PERIOD} AS period, lower(merged_by) AS who, count(*) AS x FROM e GROUP BY 1, 2)" + _forms("c", "period"))
def merger_control(spark, d):
    """How far the mergers of each period control it (CON14)."""
    e = case(spark, "changes").filter("merged AND merged_by <> '' AND merged_at IS NOT NULL")
    return N.gini_forms(e.groupBy(D.period(D.year_of_prefix(F.col("merged_at"))).alias("period"), F.lower("merged_by").alias("who")).agg(F.count("*").alias("x")), ["period"])


@query("mention_network", given("chat") + r", e AS (SELECT lower(nickname) AS src, lower(unnest(regexp_extract_all(message, '@([\w.-]+)', 1))) AS dst FROM chat WHERE coalesce(nickname, '') <> '') SELECT src, dst, count(*) AS weight FROM e WHERE src <> dst GROUP BY 1, 2")
def mention_network(spark, d):
    """Who mentions whom in chat (GRA13, STR11)."""
    e = case(spark, "chat").filter("nickname <> ''").select(F.lower("nickname").alias("src"), F.explode(T.mentions(F.col("message"))).alias("dst"))
    return e.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


@query("influence_in_channels", given("chat", "mails") + r""", e AS (SELECT channel, lower(nickname) AS who, len(regexp_extract_all(message, '@([\w.-]+)', 1)) AS n FROM chat WHERE coalesce(nickname, '') <> '' UNION ALL SELECT 'mail', lower(sender), CAST(coalesce(in_reply_to, '') <> '' AS INTEGER) FROM mails WHERE coalesce(sender, '') <> ''),
c AS (SELECT channel, who, CAST(sum(n) AS BIGINT) AS links FROM e GROUP BY 1, 2 HAVING sum(n) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY links DESC, who) AS place FROM c) SELECT channel, who, links, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5""")
def influence_in_channels(spark, d):
    """The five who mention or answer most in each channel (GRA15, GRA14)."""
    chat = case(spark, "chat").filter("nickname <> ''").select("channel", F.lower("nickname").alias("who"), F.size(T.mentions(F.col("message"))).alias("n"))
    mails = case(spark, "mails").filter("sender <> ''").select(F.lit("mail").alias("channel"), F.lower("sender").alias("who"), (T.or_empty(F.col("in_reply_to")) != "").cast("int").alias("n"))
    c = chat.unionByName(mails).groupBy("channel", "who").agg(F.sum("n").alias("links")).filter("links > 0")
    return c.withColumn("place", F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("links"), "who"))).filter("place <= 5")


_EDGES = "SELECT DISTINCT 'review' AS network, lower(r.author) AS src, lower(c.author) AS dst FROM reviews r JOIN changes c USING (number) WHERE coalesce(c.author, '') <> '' AND lower(r.author) <> lower(c.author)"


@query("network_sizes", given("changes", "reviews", "chat", "mails") + f""", e AS ({_EDGES} UNION ALL SELECT DISTINCT 'chat', lower(nickname), lower(m) FROM (SELECT nickname, unnest(regexp_extract_all(message, '@([\\w.-]+)', 1)) AS m FROM chat WHERE coalesce(nickname, '') <> '') WHERE lower(nickname) <> lower(m)
UNION ALL SELECT DISTINCT 'mail', a.sender, b.sender FROM mails a JOIN mails b ON a.in_reply_to = b.message_id WHERE a.sender <> b.sender), n AS (SELECT network, src AS x FROM e UNION SELECT network, dst FROM e)
SELECT network, (SELECT count(*) FROM n WHERE n.network = q.network) AS nodes, count(*) AS edges FROM e q GROUP BY network""")
def network_sizes(spark, d):
    """Nodes and edges of the networks of reviews, chat and mail (GRA12, GRA16, GRA18)."""
    changes = case(spark, "changes").filter("author <> ''").select("number", F.lower("author").alias("dst"))
    review = case(spark, "reviews").select("number", F.lower("author").alias("src")).join(changes, "number").select(F.lit("review").alias("network"), "src", "dst")
    chat = case(spark, "chat").filter("nickname <> ''").select(F.lit("chat").alias("network"), F.lower("nickname").alias("src"), F.explode(T.mentions(F.col("message"))).alias("dst"))
    mails = case(spark, "mails")
    mail = mails.select(F.col("sender").alias("src"), F.col("in_reply_to").alias("k")).join(mails.select(F.col("sender").alias("dst"), F.col("message_id").alias("k")), "k").select(F.lit("mail").alias("network"), "src", "dst")
    e = review.unionByName(chat).unionByName(mail).filter("src <> dst").distinct()
    ends = e.select("network", F.explode(F.array("src", "dst")).alias("x"))
    return e.groupBy("network").agg(F.count("*").alias("edges")).join(ends.groupBy("network").agg(F.countDistinct("x").alias("nodes")), "network")


@query("homophily_by_year", given("changes", "reviews") + f""", e AS (SELECT DISTINCT {_year('c.created')} AS year, lower(r.author) AS src, lower(c.author) AS dst FROM reviews r JOIN changes c USING (number) WHERE coalesce(c.author, '') <> '' AND lower(r.author) <> lower(c.author)),
y AS (SELECT {_year('created')} AS year FROM changes WHERE coalesce(author, '') <> '' GROUP BY 1 HAVING count(*) >= 5)
SELECT year, count(*) AS edges, round(avg(CAST((src IN ({_TEAM})) = (dst IN ({_TEAM})) AS INTEGER)), 6) AS homophily FROM e JOIN y USING (year) GROUP BY year""")
def homophily_by_year(spark, d):
    """Share of review edges between people of one status, in years of five changes or more (GRA11)."""
    c = case(spark, "changes").filter("author <> ''").select("number", D.year_of_prefix(F.col("created")).alias("year"), F.lower("author").alias("dst"))
    e = case(spark, "reviews").select("number", F.lower("author").alias("src")).join(c, "number").filter("src <> dst").select("year", "src", "dst").distinct()
    years = c.groupBy("year").agg(F.count("*").alias("n")).filter("n >= 5").select("year")
    return e.join(years, "year").groupBy("year").agg(F.count("*").alias("edges"), r6(F.avg((is_team(F.col("src")) == is_team(F.col("dst"))).cast("int"))).alias("homophily"))


@query("platform_by_year", given("changes", "mails", "chat") + f", e AS (SELECT {_year('created')} AS year, 'forge' AS p FROM changes UNION ALL SELECT {_year('date')}, 'mail' FROM mails UNION ALL SELECT {_year('ts')}, 'chat' FROM chat) SELECT year, count(*) FILTER (WHERE p = 'forge') AS forge, count(*) FILTER (WHERE p = 'mail') AS mail, count(*) FILTER (WHERE p = 'chat') AS chat FROM e WHERE year IS NOT NULL GROUP BY year")
def platform_by_year(spark, d):
    """Activity on each platform by year (QRY56)."""
    e = None
    for name, ts, p in (("changes", "created", "forge"), ("mails", "date", "mail"), ("chat", "ts", "chat")):
        one = case(spark, name).select(D.year_of_prefix(F.col(ts)).alias("year"), F.lit(p).alias("p"))
        e = one if e is None else e.unionByName(one)
    return e.filter("year IS NOT NULL").groupBy("year").pivot("p", ["forge", "mail", "chat"]).count().na.fill(0)


_EPOCHS = "CASE " + " ".join(f"WHEN y BETWEEN {lo} AND {hi} THEN '{n}'" for n, lo, hi in K.EPOCHS) + " END"
_SAID = f"SELECT {_year('created')} AS y, {_TB} AS t FROM changes UNION ALL SELECT {_year('date')}, lower(coalesce(subject, '') || ' ' || coalesce(body, '')) FROM mails UNION ALL SELECT {_year('ts')}, lower(coalesce(message, '')) FROM chat"


@query("narratives_by_epoch", given("changes", "mails", "chat") + f""", s AS ({_SAID}), e AS (SELECT {_EPOCHS} AS epoch, t FROM s), n AS (SELECT epoch, count(*) AS total FROM e WHERE epoch IS NOT NULL GROUP BY 1),
c AS ({' UNION ALL '.join(f"SELECT epoch, '{k}' AS theme, count(*) AS n FROM e WHERE epoch IS NOT NULL AND {_sql_any('t', ks)} GROUP BY 1" for k, ks in K.THEMES.items())})
SELECT epoch, theme, n, round(CAST(n AS DOUBLE) / total * 100, 6) AS percent FROM c JOIN n USING (epoch)""")
def narratives_by_epoch(spark, d):
    """Themes by epoch over all platforms, in percent of the epoch's texts (QRY67)."""
    s = case(spark, "changes").select(F.col("created").alias("moment"), _title_body().alias("t")).unionByName(case(spark, "mails").select(F.col("date").alias("moment"), F.concat_ws(" ", T.or_empty(F.col("subject")), T.or_empty(F.col("body"))).alias("t"))).unionByName(case(spark, "chat").select(F.col("ts").alias("moment"), F.col("message").alias("t")))
    e = s.select(D.epoch(D.year_of_prefix(F.col("moment"))).alias("epoch"), C.themes(F.col("t")).alias("themes")).filter("epoch IS NOT NULL")
    # The total goes along as a theme of its own: one aggregation, no join.
    c = e.select("epoch", F.explode(F.concat(F.array(F.lit("")), "themes")).alias("theme")).groupBy("epoch", "theme").agg(F.count("*").alias("n"))
    whole = F.max(F.when(F.col("theme") == "", F.col("n"))).over(Window.partitionBy("epoch"))
    return c.withColumn("_t", whole).filter("theme <> ''").select("epoch", "theme", "n", r6(F.col("n") / F.col("_t") * 100).alias("percent"))


_CHAT_MOOD = f"CASE WHEN {_sql_hits('lower(message)', K.CHANNEL_POSITIVE)} > {_sql_hits('lower(message)', K.CHANNEL_NEGATIVE)} THEN 'positive' WHEN {_sql_hits('lower(message)', K.CHANNEL_NEGATIVE)} > {_sql_hits('lower(message)', K.CHANNEL_POSITIVE)} THEN 'negative' ELSE 'neutral' END"


@query("sentiment_by_month", given("chat") + f", s AS (SELECT channel, substring(ts, 1, 7) AS month, {_CHAT_MOOD} AS sentiment FROM chat WHERE ts IS NOT NULL) SELECT channel, month, sentiment, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY channel, month), 6) AS share FROM s GROUP BY 1, 2, 3")
def sentiment_by_month(spark, d):
    """Distribution of sentiment in each channel and month (QRY58)."""
    c = case(spark, "chat").filter("ts IS NOT NULL").groupBy("channel", F.substring("ts", 1, 7).alias("month"), C.channel_sentiment(F.col("message")).alias("sentiment")).agg(F.count("*").alias("n"))
    return c.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("channel", "month"))))


@query("sentiment_leaders", given("chat") + f", s AS (SELECT lower(nickname) AS who, {_CHAT_MOOD} AS m FROM chat WHERE coalesce(nickname, '') <> '') SELECT who, count(*) AS messages, count(*) FILTER (WHERE m = 'positive') AS positive, count(*) FILTER (WHERE m = 'negative') AS negative FROM s GROUP BY who ORDER BY messages DESC, who LIMIT 10")
def sentiment_leaders(spark, d):
    """Tone of the ten who write most (QRY58)."""
    s = case(spark, "chat").filter("nickname <> ''").select(F.lower("nickname").alias("who"), C.channel_sentiment(F.col("message")).alias("m"))
    return s.groupBy("who").agg(F.count("*").alias("messages"), F.count_if(F.col("m") == "positive").alias("positive"), F.count_if(F.col("m") == "negative").alias("negative")).orderBy(F.desc("messages"), "who").limit(10)


_SOM = {k: _sql_hits("t", K.STATE_OF_MIND[k]) for k in ("som1", "som2", "som5", "som6")}


def _states_sql(name: str, tables: tuple[str, str, str, str]) -> str:
    near = _NEAR
    for old, new in zip(("changes", "reviews", "comments", "issues"), tables, strict=True):
        near = near.replace(f"FROM {old}", f"FROM {new}")
    return f"""{name}_a AS (SELECT actor, lower(string_agg(coalesce(t, ''), ' ' ORDER BY kind, k, j)) AS t, count(*) FILTER (WHERE j = 0) AS n FROM {near} WHERE coalesce(actor, '') <> '' GROUP BY actor), {name} AS (SELECT actor, CASE WHEN som6 > 0 THEN 'som6' WHEN som1 > 0 OR (n >= 5 AND som2 >= 3) THEN 'som1' WHEN som5 > 0 THEN 'som5' WHEN som2 > 0 OR n >= 3 THEN 'som2' ELSE 'som3' END AS som FROM (SELECT actor, n, {', '.join(f'{v} AS {k}' for k, v in _SOM.items())} FROM {name}_a))"""


_HALVES = ", ".join(f"{n}{k} AS (SELECT * FROM {n} WHERE {c} {op} '2018')" for n, c in (("changes", "created"), ("reviews", "ts"), ("comments", "ts"), ("issues", "created")) for k, op in ((1, "<"), (2, ">=")))
_STATES = given("changes", "reviews", "comments", "issues") + f", {_HALVES}, {_states_sql('p', ('changes1', 'reviews1', 'comments1', 'issues1'))}, {_states_sql('q', ('changes2', 'reviews2', 'comments2', 'issues2'))}"


def _half(spark, first: bool):
    op = "<" if first else ">="
    parts = [case(spark, n).filter(f"{c} {op} '2018'") for n, c in (("changes", "created"), ("reviews", "ts"), ("comments", "ts"), ("issues", "created"))]
    return people.actor_states(people.spoken(*parts)).select("actor", "som")


@query("state_shifts", _STATES + " SELECT p.som AS before, q.som AS after, CASE WHEN substring(q.som, 4, 1) < substring(p.som, 4, 1) THEN 'more_supportive' WHEN substring(q.som, 4, 1) > substring(p.som, 4, 1) THEN 'less_supportive' ELSE 'no_change' END AS shift, count(*) AS actors FROM p JOIN q USING (actor) GROUP BY 1, 2, 3")
def state_shifts(spark, d):
    """How actors' states of mind moved between two periods (JOIN12, CLS24)."""
    p, q = _half(spark, True).withColumnRenamed("som", "before"), _half(spark, False).withColumnRenamed("som", "after")
    return p.join(q, "actor").groupBy("before", "after", C.shift_type(F.col("before"), F.col("after")).alias("shift")).agg(F.count("*").alias("actors"))


@query("state_distribution", _STATES + ", e AS (SELECT 'first' AS period, som FROM p UNION ALL SELECT 'second', som FROM q) SELECT period, som, count(*) AS actors, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY period) * 100, 6) AS percent FROM e GROUP BY 1, 2")
def state_distribution(spark, d):
    """States of mind in each period, in percent of its actors (QRY49)."""
    e = _half(spark, True).select(F.lit("first").alias("period"), "som").unionByName(_half(spark, False).select(F.lit("second").alias("period"), "som")).groupBy("period", "som").agg(F.count("*").alias("actors"))
    return e.withColumn("percent", r6(F.col("actors") / F.sum("actors").over(Window.partitionBy("period")) * 100))


_HIGH, _MEDIUM = K.MESSAGE_REVIEW["high"], K.MESSAGE_REVIEW["medium"]


@query("chat_review_scores", given("chat") + f", s AS (SELECT seq, lower(message) AS b, lower(coalesce(nickname, '')) IN ({_TEAM}) AS team FROM chat), h AS (SELECT *, {_sql_any('b', _HIGH)} AS high, {_sql_any('b', _MEDIUM)} AS medium, length(b) AS n FROM s) SELECT seq, CAST(CASE WHEN team AND high THEN CASE WHEN n > 100 THEN 1.0 WHEN n > 50 THEN 0.8 ELSE 0.7 END WHEN team OR high THEN CASE WHEN n > 50 THEN 0.6 ELSE 0.5 END WHEN medium THEN 0.3 ELSE 0.2 END AS DOUBLE) AS score FROM h")
def chat_review_scores(spark, d):
    """Chat messages scored as reviews, with the true words (CLS13)."""
    return case(spark, "chat").select("seq", C.chat_review_score(F.col("message"), is_team(F.col("nickname"))).alias("score"))


_MAIL_SCORE = f"CAST(CASE WHEN {_sql_any('t', _HIGH)} THEN CASE WHEN n > 200 THEN 1.0 WHEN n > 100 THEN 0.8 ELSE 0.7 END WHEN {_sql_any('t', _MEDIUM)} THEN CASE WHEN n > 100 THEN 0.6 ELSE 0.5 END ELSE 0.3 END AS DOUBLE)"


@query("mail_review_scores", given("mails") + f", s AS (SELECT message_id, lower(coalesce(body, '') || ' ' || coalesce(subject, '')) AS t, length(coalesce(body, '')) AS n FROM mails) SELECT message_id, {_MAIL_SCORE} AS score FROM s")
def mail_review_scores(spark, d):
    """Mails scored as reviews, with the true words (CLS14)."""
    return case(spark, "mails").select("message_id", C.mail_review_score(F.col("subject"), F.col("body")).alias("score"))


@query("cross_platform_scores", given("changes", "mails") + f""", s AS (SELECT lower(sender) AS who, TRY_CAST(date AS TIMESTAMP) AS moment, lower(coalesce(body, '') || ' ' || coalesce(subject, '')) AS t, length(coalesce(body, '')) AS n, coalesce(body, '') || ' ' || coalesce(subject, '') AS raw FROM mails),
e AS (SELECT DISTINCT who, moment, {_MAIL_SCORE} AS score, CAST(unnest(regexp_extract_all(raw, '(?:#|pull/)(\\d{{4,6}})', 1)) AS BIGINT) AS number FROM s), b AS (SELECT number, who, max(score) AS score FROM e JOIN changes USING (number) WHERE moment < TRY_CAST(merged_at AS TIMESTAMP) GROUP BY 1, 2) SELECT number, round(sum(score), 6) AS score FROM b GROUP BY number""")
def cross_platform_scores(spark, d):
    """Best score of each sender before the merge, summed for each change (CLS42, JOIN6)."""
    text = F.concat_ws(" ", T.or_empty(F.col("body")), T.or_empty(F.col("subject")))
    e = case(spark, "mails").select(F.lower("sender").alias("who"), D.parse(F.col("date")).alias("moment"), C.mail_review_score(F.col("subject"), F.col("body")).alias("score"), F.explode(F.array_distinct(T.change_mentions(text))).alias("number"))
    j = e.join(case(spark, "changes").select("number", D.parse(F.col("merged_at")).alias("end")), "number").filter("moment < end")
    return j.groupBy("number", "who").agg(F.max("score").alias("score")).groupBy("number").agg(r6(F.sum("score")).alias("score"))


@query("decision_channels", given("changes", "mails", "chat") + f" SELECT 'forge' AS channel, count(*) AS n FROM changes WHERE merged UNION ALL SELECT 'mail', count(*) FROM mails WHERE {_sql_any(f'lower(coalesce(body, {chr(39)}{chr(39)}) || coalesce(subject, {chr(39)}{chr(39)}))', K.MAIL_DECISIONS)} UNION ALL SELECT 'chat', count(*) FROM chat WHERE {_sql_any('lower(message)', K.CHAT_DECISIONS)}")
def decision_channels(spark, d):
    """Where decisions are taken and spoken of (QRY76)."""
    hit = [case(spark, "changes").select(F.lit("forge").alias("channel"), F.col("merged").alias("h")), case(spark, "mails").select(F.lit("mail").alias("channel"), T.lowered(F.concat(T.or_empty(F.col("body")), T.or_empty(F.col("subject"))), lambda b: T.contains_any(b, K.MAIL_DECISIONS)).alias("h")), case(spark, "chat").select(F.lit("chat").alias("channel"), T.lowered(F.col("message"), lambda b: T.contains_any(b, K.CHAT_DECISIONS)).alias("h"))]
    return hit[0].unionByName(hit[1]).unionByName(hit[2]).groupBy("channel").agg(F.count_if("h").alias("n"))


@query("channel_preference", given("changes", "chat") + f", r AS (SELECT (SELECT avg(CAST({_sql_any(_TB, K.GOVERNANCE)} AS INTEGER)) FROM changes) AS forge_rate, (SELECT avg(CAST({_sql_any('lower(message)', K.GOVERNANCE)} AS INTEGER)) FROM chat) AS chat_rate) SELECT round(forge_rate, 6) AS forge_rate, round(chat_rate, 6) AS chat_rate, round(chat_rate / forge_rate, 6) AS ratio FROM r")
def channel_preference(spark, d):
    """How much more freely governance is spoken of in chat (QRY78, QRY99)."""
    forge = case(spark, "changes").select(F.lit(True).alias("f"), T.lowered(_title_body(), lambda b: T.contains_any(b, K.GOVERNANCE)).alias("h"))
    e = forge.unionByName(case(spark, "chat").select(F.lit(False).alias("f"), T.lowered(F.col("message"), lambda b: T.contains_any(b, K.GOVERNANCE)).alias("h")))
    rate = lambda on: F.avg(F.when(F.col("f") == on, F.col("h").cast("int")))
    return e.agg(rate(True).alias("a"), rate(False).alias("b")).select(r6(F.col("a")).alias("forge_rate"), r6(F.col("b")).alias("chat_rate"), r6(ratio(F.col("b"), F.col("a"))).alias("ratio"))


_RESULTS = [("homophily_analysis", '{"data": {"homophily": 0.91}}'), ("schelling_points", '{"data": {"mentions": 12}}'), ("toxicity_gradients", '{"data": {"ratio": 1.4, "high": {"n": 3}}}'), ("unknown_framework", '{"data": {}}'), ("survivorship_bias", '{"metadata": {}}')]
_RESULTS_SQL = "WITH r AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{j}')" for k, j in _RESULTS) + ") t(framework, json))"


@query("framework_ranking", _RESULTS_SQL + ", s AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in K.SEVERITY.items()) + ") t(framework, severity)), e AS (SELECT framework, CAST(coalesce(severity, 0) AS INTEGER) AS severity FROM r LEFT JOIN s USING (framework)) SELECT framework, severity, CAST(row_number() OVER (ORDER BY severity DESC, framework) AS INTEGER) AS place FROM e")
def framework_ranking(spark, d):
    """Stored results by the severity of their framework (QRY79)."""
    sev = F.create_map(*[F.lit(x) for kv in K.SEVERITY.items() for x in kv])
    r = spark.createDataFrame(_RESULTS, "framework string, json string").select("framework", F.coalesce(F.try_element_at(sev, "framework"), F.lit(0)).alias("severity"))
    return r.withColumn("place", F.row_number().over(Window.orderBy(F.desc("severity"), "framework")))


_PATHS = {"homophily": "$.data.homophily", "mentions": "$.data.mentions", "ratio": "$.data.ratio", "high_n": "$.data.high.n"}


@query("framework_metrics", _RESULTS_SQL + " " + " UNION ALL ".join(f"SELECT framework, '{k}' AS metric, CAST(json_extract_string(json, '{p}') AS DOUBLE) AS value FROM r WHERE json_extract_string(json, '{p}') IS NOT NULL" for k, p in _PATHS.items()))
def framework_metrics(spark, d):
    """Key figures picked by path from stored results (QRY80, QRY103)."""
    r = spark.createDataFrame(_RESULTS, "framework string, json string")
    picked = F.array(*[F.struct(F.lit(k).alias("metric"), F.get_json_object("json", p).cast("double").alias("value")) for k, p in _PATHS.items()])
    return r.select("framework", F.explode(picked).alias("m")).select("framework", "m.*").filter("value IS NOT NULL")


_EVENTS = "SELECT lower(author) AS who, created AS moment, 'change' AS kind FROM changes UNION ALL SELECT lower(author), ts, 'review' FROM reviews UNION ALL SELECT lower(author), ts, 'comment' FROM comments UNION ALL SELECT lower(author), created, 'issue' FROM issues UNION ALL SELECT lower(nickname), ts, 'chat' FROM chat"


def _events(spark):
    e = None
    for name, who, at, kind in (("changes", "author", "created", "change"), ("reviews", "author", "ts", "review"), ("comments", "author", "ts", "comment"), ("issues", "author", "created", "issue"), ("chat", "nickname", "ts", "chat")):
        one = case(spark, name).select(F.lower(who).alias("who"), F.col(at).alias("moment"), F.lit(kind).alias("kind"))
        e = one if e is None else e.unionByName(one)
    return e.filter("who <> '' AND moment IS NOT NULL")


@query("developer_histories", given("changes", "reviews", "comments", "issues", "chat") + f", e AS ({_EVENTS}), f AS (SELECT * FROM e WHERE coalesce(who, '') <> '' AND moment IS NOT NULL) SELECT who, who IN ({_TEAM}) AS team, count(*) AS activities, {', '.join(f'''count(*) FILTER (WHERE kind = '{k}') AS {k}s''' for k in ('change', 'review', 'comment', 'issue', 'chat'))}, min(moment) AS first, max(moment) AS last, count(DISTINCT substring(moment, 1, 4)) AS years FROM f GROUP BY who")
def developer_histories(spark, d):
    """Every person's history in one aggregation, by kind and with first and last day (QRY105, QRY83, SET6)."""
    kinds = ("change", "review", "comment", "issue", "chat")
    h = _events(spark).groupBy("who").agg(F.count("*").alias("activities"), *[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in kinds], F.min("moment").alias("first"), F.max("moment").alias("last"), F.countDistinct(F.substring("moment", 1, 4)).alias("years"))
    return h.withColumn("team", is_team(F.col("who")))


@query("timeline_of_events", given("changes", "reviews", "comments", "issues", "chat") + f", e AS ({_EVENTS}), f AS (SELECT DISTINCT moment, who, kind FROM e WHERE coalesce(who, '') <> '' AND moment IS NOT NULL) SELECT CAST(row_number() OVER (ORDER BY moment, who, kind) AS INTEGER) AS place, moment, who, kind FROM f")
def timeline_of_events(spark, d):
    """Events of all kinds in one order of time (TOP8, FIL19)."""
    return _events(spark).distinct().withColumn("place", F.row_number().over(Window.orderBy("moment", "who", "kind")))


_FOUNDER = ["founder@first.example"]


@query("archive_selection", given("archive") + ", s AS (SELECT *, contains(lower(sender), 'founder@first.example') AS a, starts_with(path, 'forum/') AND contains(lower(content[:500]), 'governance') AS b FROM archive) SELECT path, content, a AS by_sender, b AS by_path FROM s WHERE a OR b")
def archive_selection(spark, d):
    """Archive texts by their sender, or by path and content (CLS32)."""
    a = T.lowered(F.col("sender"), lambda s: T.contains_any(s, _FOUNDER))
    b = F.col("path").startswith("forum/") & F.lower(F.substring("content", 1, 500)).contains("governance")
    return case(spark, "archive").select("path", "content", a.alias("by_sender"), b.alias("by_path")).filter("by_sender OR by_path")


_KINDS = {"decision": K.DECISIONS, "authority": K.AUTHORITY, "protocol": K.PROTOCOL}
_KIND_SQL = {k: "(" + " OR ".join(f"regexp_matches(lower(content), '{p}')" for p in ps) + ")" for k, ps in _KINDS.items()}


@query("archive_themes", given("archive") + f" SELECT {_year('date')} AS year, {', '.join(f'count(*) FILTER (WHERE {c}) AS {k}' for k, c in _KIND_SQL.items())}, count(*) AS texts FROM archive WHERE length(content) >= 30 GROUP BY 1")
def archive_themes(spark, d):
    """Decision, authority and protocol statements by year (CLS33, QRY81)."""
    hit = {k: F.lower("content").rlike("|".join(f"(?:{p})" for p in ps)) for k, ps in _KINDS.items()}
    a = case(spark, "archive").filter(F.length("content") >= 30).select(D.year_of_prefix(F.col("date")).alias("year"), *[c.alias(k) for k, c in hit.items()])
    return a.groupBy("year").agg(*[F.count_if(k).alias(k) for k in hit], F.count("*").alias("texts"))


@query("key_moments", given("archive") + f""", m AS (SELECT 'authority' AS kind, path, date, content FROM archive WHERE length(content) >= 30 AND {_KIND_SQL['authority']} AND regexp_matches(lower(content), 'control|maintain|responsible|decision') UNION ALL SELECT 'protocol', path, date, content FROM archive WHERE length(content) >= 30 AND {_KIND_SQL['protocol']} AND regexp_matches(lower(content), 'fork|upgrade|change|compatibility'))
SELECT CAST(row_number() OVER (ORDER BY date, kind, path) AS INTEGER) AS place, kind, path, substring(content, 1, 300) AS excerpt FROM m""")
def key_moments(spark, d):
    """Statements of authority and of protocol changes in order of time (QRY82)."""
    low = F.lower("content")
    a = case(spark, "archive").filter(F.length("content") >= 30)
    m = a.filter(low.rlike("|".join(K.AUTHORITY)) & low.rlike("control|maintain|responsible|decision")).withColumn("kind", F.lit("authority")).unionByName(a.filter(low.rlike("|".join(K.PROTOCOL)) & low.rlike("fork|upgrade|change|compatibility")).withColumn("kind", F.lit("protocol")))
    return m.select(F.row_number().over(Window.orderBy("date", "kind", "path")).alias("place"), "kind", "path", F.substring("content", 1, 300).alias("excerpt"))


_CONSENSUS = r"(consensus|soft fork|bip\s*-?\s*\d+)"


@query("consensus_items", given("changes", "issues") + f" SELECT 'change' AS kind, number FROM changes WHERE created >= '2014-01-01' AND created < '2021-01-01' AND regexp_matches({_TB}, '{_CONSENSUS}') UNION ALL SELECT 'issue', number FROM issues WHERE created >= '2014-01-01' AND created < '2021-01-01' AND regexp_matches({_TB}, '{_CONSENSUS}')")
def consensus_items(spark, d):
    """Changes and issues of a period that speak of consensus or a numbered proposal (QRY48, FIL25)."""
    def pick(name, kind):
        return case(spark, name).filter((F.col("created") >= "2014-01-01") & (F.col("created") < "2021-01-01") & F.lower(_title_body()).rlike(_CONSENSUS)).select(F.lit(kind).alias("kind"), "number")

    return pick("changes", "change").unionByName(pick("issues", "issue"))


@query("topic_process", given("changes", "mails", "chat") + f", s AS (SELECT 'forge' AS channel, {_TB} AS t FROM changes UNION ALL SELECT 'mail', lower(coalesce(subject, '') || ' ' || coalesce(body, '')) FROM mails UNION ALL SELECT 'chat', lower(message) FROM chat) SELECT channel, count(*) FILTER (WHERE contains(t, 'unfair') OR contains(t, 'consensus')) AS on_topic, bool_or((contains(t, 'unfair') OR contains(t, 'consensus')) AND {_sql_any('t', K.PROCESS)}) AS documented FROM s GROUP BY channel")
def topic_process(spark, d):
    """Whether a topic's process is documented in each channel (QRY98)."""
    s = case(spark, "changes").select(F.lit("forge").alias("channel"), _title_body().alias("t")).unionByName(case(spark, "mails").select(F.lit("mail").alias("channel"), F.concat_ws(" ", T.or_empty(F.col("subject")), T.or_empty(F.col("body"))).alias("t"))).unionByName(case(spark, "chat").select(F.lit("chat").alias("channel"), F.col("message").alias("t")))
    h = s.select("channel", T.lowered(F.col("t"), lambda b: T.contains_any(b, ["unfair", "consensus"])).alias("a"), T.lowered(F.col("t"), lambda b: T.contains_any(b, K.PROCESS)).alias("b"))
    return h.groupBy("channel").agg(F.count_if("a").alias("on_topic"), F.bool_or(F.expr("a AND b")).alias("documented"))


@query("self_merge_bands", given("changes") + ", s AS (SELECT lower(author) AS who, avg(CAST(lower(author) = lower(merged_by) AS INTEGER)) * 100 AS rate, count(*) AS n FROM changes WHERE merged AND coalesce(author, '') <> '' GROUP BY 1), b AS (SELECT * FROM (VALUES ('alice', 0.0, 10.0), ('bob', 5.0, 20.0), ('carol', 0.0, 5.0), ('dave', 50.0, 100.0)) t(who, low, high)) SELECT who, n, round(rate, 6) AS rate, rate BETWEEN low AND high AS valid FROM s JOIN b USING (who)")
def self_merge_bands(spark, d):
    """Every listed author's share of self-merges against the band expected (DQ15, DQ22)."""
    bands = spark.createDataFrame([("alice", 0.0, 10.0), ("bob", 5.0, 20.0), ("carol", 0.0, 5.0), ("dave", 50.0, 100.0)], "who string, low double, high double")
    s = case(spark, "changes").filter("merged AND author <> ''").groupBy(F.lower("author").alias("who")).agg((F.avg((F.lower("author") == F.lower("merged_by")).cast("int")) * 100).alias("rate"), F.count("*").alias("n"))
    return s.join(F.broadcast(bands), "who").select("who", "n", r6(F.col("rate")).alias("rate"), F.col("rate").between(F.col("low"), F.col("high")).alias("valid"))


@query("calculation_checks", given("changes") + " SELECT count(*) FILTER (WHERE coalesce(author, '') = '') AS missing_author, count(*) FILTER (WHERE coalesce(author, '') = '') * 100.0 / count(*) > 5 AS too_many_missing, count(*) FILTER (WHERE author <> merged_by AND lower(author) = lower(merged_by)) AS case_mismatch, count(*) FILTER (WHERE TRY_CAST(merged_at AS TIMESTAMP) < TRY_CAST(created AS TIMESTAMP)) AS negative_times FROM changes")
def calculation_checks(spark, d):
    """Missing values, letters in other cases and negative times (DQ23)."""
    blank = T.or_empty(F.col("author")) == ""
    other = (F.col("author") != F.col("merged_by")) & (F.lower("author") == F.lower("merged_by"))
    return case(spark, "changes").agg(F.count_if(blank).alias("missing_author"), (F.count_if(blank) * 100.0 / F.count("*") > 5).alias("too_many_missing"), F.count_if(other).alias("case_mismatch"), F.count_if(D.parse(F.col("merged_at")) < D.parse(F.col("created"))).alias("negative_times"))


@query("contributor_timeline", given("changes", "reviews", "comments") + f""", r AS (SELECT number, count(*) AS n FROM reviews GROUP BY 1), c AS (SELECT number, count(*) AS n FROM comments GROUP BY 1),
q AS (SELECT lower(author) AS who, {_year('created')} AS year, merged, least(1.0, CASE WHEN merged THEN 0.3 ELSE 0.0 END + CASE WHEN additions + deletions > 10 THEN 0.2 ELSE 0.0 END + CASE WHEN additions + deletions > 100 THEN 0.1 ELSE 0.0 END + CASE WHEN length(coalesce(body, '')) > 100 THEN 0.2 ELSE 0.0 END + CASE WHEN coalesce(r.n, 0) > 0 THEN 0.1 ELSE 0.0 END + CASE WHEN files > 1 THEN 0.05 ELSE 0.0 END + CASE WHEN coalesce(c.n, 0) > 0 THEN 0.05 ELSE 0.0 END) AS s FROM changes LEFT JOIN r USING (number) LEFT JOIN c USING (number) WHERE coalesce(author, '') <> '' AND {_year('created')} IS NOT NULL),
p AS (SELECT who, count(*) AS changes, count(*) FILTER (WHERE merged) AS merged, round(CAST(avg(s) AS DOUBLE), 6) AS quality, count(DISTINCT year) AS years FROM q GROUP BY who HAVING count(*) >= 5 AND avg(s) >= 0.3) SELECT who, changes, merged, quality, years, (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM q WHERE q.who = p.who GROUP BY year)) = changes AS years_add_up FROM p""")
def contributor_timeline(spark, d):
    """Contributors of five changes or more of some quality; their years add up to their changes (QRY45, QRY43, DQ24)."""
    r = case(spark, "reviews").groupBy("number").agg(F.count("*").alias("r"))
    c = case(spark, "comments").groupBy("number").agg(F.count("*").alias("c"))
    j = case(spark, "changes").filter("author <> ''").join(r, "number", "left").join(c, "number", "left")
    s = C.contribution_quality(F.col("additions") + F.col("deletions"), F.col("files"), F.col("body"), F.coalesce("r", F.lit(0)), F.coalesce("c", F.lit(0)), F.col("merged"))
    q = j.select(F.lower("author").alias("who"), D.year_of_prefix(F.col("created")).alias("year"), "merged", s.alias("s")).filter("year IS NOT NULL")
    y = q.groupBy("who", "year").agg(F.count("*").alias("n"), F.count_if("merged").alias("m"), F.sum("s").alias("s"))
    whole = q.groupBy("who").agg(F.count("*").alias("all"))
    p = y.groupBy("who").agg(F.sum("n").alias("changes"), F.sum("m").alias("merged"), (F.sum("s") / F.sum("n")).alias("_q"), F.count("*").alias("years")).filter((F.col("changes") >= 5) & (F.col("_q") >= 0.3))
    return p.join(whole, "who").select("who", "changes", "merged", r6(F.col("_q")).alias("quality"), "years", (F.col("all") == F.col("changes")).alias("years_add_up"))


@query("contributor_attributes", given("changes", "reviews", "comments", "issues", "chat") + f""", e AS ({_EVENTS}), f AS (SELECT who, count(*) AS activities, date_diff('second', min(TRY_CAST(moment AS TIMESTAMP)), max(TRY_CAST(moment AS TIMESTAMP))) / 86400 AS days, date_diff('second', max(TRY_CAST(moment AS TIMESTAMP)), TIMESTAMP '2025-01-01') / 86400 AS idle FROM e WHERE coalesce(who, '') <> '' AND TRY_CAST(moment AS TIMESTAMP) IS NOT NULL GROUP BY 1), m AS (SELECT lower(author) AS who, round(avg(CAST(merged AS INTEGER)), 6) AS merge_rate FROM changes GROUP BY 1)
SELECT who, activities, activities = 1 AS one_time, CAST(floor(days) AS BIGINT) AS tenure_days, floor(idle) < 365 AS active, coalesce(merge_rate, 0) AS merge_rate FROM f LEFT JOIN m USING (who)""")
def contributor_attributes(spark, d):
    """Activities, tenure, merge rate and whether still active, of everybody (CTB1)."""
    at = D.parse(F.col("moment"))
    f = _events(spark).filter(at.isNotNull()).groupBy("who").agg(F.count("*").alias("activities"), F.min(at).alias("a"), F.max(at).alias("b"))
    m = case(spark, "changes").groupBy(F.lower("author").alias("who")).agg(r6(F.avg(F.col("merged").cast("int"))).alias("merge_rate"))
    idle = D.whole_days(F.col("b"), F.lit("2025-01-01").cast("timestamp"))
    return f.join(m, "who", "left").select("who", "activities", (F.col("activities") == 1).alias("one_time"), D.whole_days(F.col("a"), F.col("b")).alias("tenure_days"), (idle < 365).alias("active"), F.coalesce("merge_rate", F.lit(0.0)).alias("merge_rate"))


@query("two_repositories", given("changes", "issues") + ", e AS (SELECT 'first' AS repo, lower(author) AS who, state FROM changes WHERE coalesce(author, '') <> '' UNION ALL SELECT 'second', lower(author), state FROM issues WHERE coalesce(author, '') <> ''), c AS (SELECT repo, who, count(*) AS n FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, who) AS i, row_number() OVER (PARTITION BY repo ORDER BY n) AS j FROM c), p AS (SELECT repo, count(*) AS authors, CAST(sum(n) FILTER (WHERE i <= 3) AS DOUBLE) / sum(n) AS top3, CAST(2 * sum(j * n) - (count(*) + 1) * sum(n) AS DOUBLE) / (count(*) * sum(n)) AS gini FROM r GROUP BY repo), s AS (SELECT repo, avg(CAST(state = 'closed' AS INTEGER)) AS closed FROM e GROUP BY 1) SELECT repo, authors, round(top3, 6) AS top3_share, round(gini, 6) AS gini, round(closed, 6) AS closed_rate, round(gini - avg(gini) OVER (), 6) AS from_mean, (SELECT count(*) FROM c a JOIN c b USING (who) WHERE a.repo < b.repo) AS shared_authors FROM p JOIN s USING (repo)")
def two_repositories(spark, d):
    """Concentration, process and shared authors of two repositories (QRY53, QRY54, QRY93, QRY94)."""
    e = case(spark, "changes").select(F.lit("first").alias("repo"), F.lower("author").alias("who"), "state").unionByName(case(spark, "issues").select(F.lit("second").alias("repo"), F.lower("author").alias("who"), "state")).filter("who <> ''")
    c = e.groupBy("repo", "who").agg(F.count("*").alias("x"), F.count_if(F.col("state") == "closed").alias("k"))
    forms = N.gini_forms(c, ["repo"]).select("repo", F.col("actors").alias("authors"), "top3_share", F.col("gini_positive").alias("gini"))
    both = c.groupBy("who").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("shared_authors"))
    closed = c.groupBy("repo").agg(r6(F.sum("k") / F.sum("x")).alias("closed_rate"))
    raw = N.rank_sums(c, ["repo"]).select("repo", ((2 * F.col("_weighted") - (F.col("contributors") + 1) * F.col("total")) / (F.col("contributors") * F.col("total"))).alias("_g"))
    mean = raw.withColumn("from_mean", r6(F.col("_g") - F.avg("_g").over(Window.partitionBy(F.lit(1))))).select("repo", "from_mean")
    return forms.join(closed, "repo").join(mean, "repo").crossJoin(F.broadcast(both))  # one row on the right


@query("reviewer_types", given("reviews") + f", s AS (SELECT coalesce(lower(author), '') IN ({_TEAM}) AS team, length(trim(coalesce(body, ''))) AS n, len(list_filter(regexp_split_to_array(trim(coalesce(body, '')), '\\s+'), lambda x: x <> '')) AS w, state FROM reviews) SELECT team, count(*) AS reviews, round(avg(n), 6) AS mean_length, round(avg(w), 6) AS mean_words, round(avg(CAST(state = 'APPROVED' AS INTEGER)), 6) AS approval_rate FROM s GROUP BY team")
def reviewer_types(spark, d):
    """Reviews by maintainers and by others (QRY72)."""
    b = F.trim(T.or_empty(F.col("body")))
    s = case(spark, "reviews").select(is_team(F.col("author")).alias("team"), F.length(b).alias("n"), T.word_count(b).alias("w"), (F.col("state") == "APPROVED").cast("int").alias("a"))
    return s.groupBy("team").agg(F.count("*").alias("reviews"), r6(F.avg("n")).alias("mean_length"), r6(F.avg("w")).alias("mean_words"), r6(F.avg("a")).alias("approval_rate"))


@query("review_coverage", given("changes", "reviews") + ", n AS (SELECT number, count(*) AS n, count(DISTINCT lower(author)) AS who FROM reviews GROUP BY 1), p AS (SELECT coalesce(n, 0) AS n, coalesce(who, 0) AS who FROM changes LEFT JOIN n USING (number)) SELECT count(*) AS changes, round(avg(n), 6) AS mean_reviews, CAST(median(n) AS DOUBLE) AS median_reviews, round(avg(who), 6) AS mean_reviewers, round(avg(CAST(n > 0 AS INTEGER)), 6) AS reviewed FROM p")
def review_coverage(spark, d):
    """How many reviews and reviewers a change gets (QRY73)."""
    n = case(spark, "reviews").groupBy("number").agg(F.count("*").alias("n"), F.countDistinct(F.lower("author")).alias("who"))
    p = case(spark, "changes").select("number").join(n, "number", "left").select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("who", F.lit(0)).alias("who"))
    return p.agg(F.count("*").alias("changes"), r6(F.avg("n")).alias("mean_reviews"), F.percentile("n", 0.5).alias("median_reviews"), r6(F.avg("who")).alias("mean_reviewers"), r6(F.avg((F.col("n") > 0).cast("int"))).alias("reviewed"))


@query("maintainer_timelines", given("changes") + f", m AS (SELECT lower(merged_by) AS who, {_year('merged_at')} AS year FROM changes WHERE merged AND coalesce(merged_by, '') <> '' AND merged_at IS NOT NULL), y AS (SELECT who, year, count(*) AS n FROM m GROUP BY 1, 2) SELECT who, CAST(sum(n) AS BIGINT) AS merges, min(year) AS first_year, max(year) AS last_year, string_agg(year || ':' || n, ',' ORDER BY year) AS by_year, CASE WHEN sum(n) >= 10 THEN 'high' WHEN sum(n) >= 5 THEN 'medium' ELSE 'low' END AS confidence FROM y GROUP BY who")
def maintainer_timelines(spark, d):
    """Merges of everybody who merges, by year (QRY44, AGG29, AGG30)."""
    m = case(spark, "changes").filter("merged AND merged_by <> '' AND merged_at IS NOT NULL").groupBy(F.lower("merged_by").alias("who"), D.year_of_prefix(F.col("merged_at")).alias("year")).agg(F.count("*").alias("n"))
    years = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("year", "n"))), lambda x: F.concat(x["year"], F.lit(":"), x["n"])), ",")
    s = m.groupBy("who").agg(F.sum("n").alias("merges"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), years.alias("by_year"))
    return s.withColumn("confidence", F.when(F.col("merges") >= 10, "high").when(F.col("merges") >= 5, "medium").otherwise("low"))


_ROSTER = [(1, "# the list"), (2, "GENERAL"), (3, "Alice A: <alice@mail.example> (@Alice)"), (4, ""), (5, "Bob B: <bob@mail.example> (@bob)"), (6, "QA"), (7, "Carol: <c@mail.example>"), (8, "Dave: (@dave-x)")]


@query("roster_by_category", "WITH l AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in _ROSTER) + r") t(line, value)), k AS (SELECT line, trim(value) AS v, CASE WHEN upper(trim(value)) = trim(value) AND lower(trim(value)) <> trim(value) OR NOT contains(value, ':') THEN trim(value) END AS head FROM l WHERE trim(value) <> '' AND NOT starts_with(trim(value), '#')), c AS (SELECT *, last_value(head IGNORE NULLS) OVER (ORDER BY line) AS category FROM k) SELECT category, nullif(lower(regexp_extract(v, '\(@([\w-]+)\)', 1)), '') AS username, nullif(regexp_extract(v, '<([^>]+)>', 1), '') AS email FROM c WHERE head IS NULL AND contains(v, '@')")
def roster_by_category(spark, d):
    """Maintainers of a list whose category headers carry forward (SRC34, SRC35)."""
    return people.roster(spark.createDataFrame(_ROSTER, "line int, value string"))


@query("arbitrage", given("changes", "reviews") + f", r AS (SELECT DISTINCT number, true AS reviewed FROM reviews), p AS (SELECT coalesce(lower(author), '') IN ({_TEAM}) AS team, reviewed IS NULL AND (coalesce(lower(author), '') = coalesce(lower(merged_by), '-') OR (coalesce(lower(author), '') IN ({_TEAM}) AND coalesce(lower(merged_by), '') IN ({_TEAM}))) AS h FROM changes LEFT JOIN r USING (number) WHERE merged) SELECT team, count(*) AS merged, count(*) FILTER (WHERE h) AS unreviewed_self_merges, round(CAST(count(*) FILTER (WHERE h) AS DOUBLE) / count(*), 6) AS rate FROM p GROUP BY team")
def arbitrage(spark, d):
    """Merged changes without a review that their author, or a fellow maintainer, merged (QRY36)."""
    r = case(spark, "reviews").select("number", F.lit(True).alias("reviewed")).distinct()
    own = F.coalesce(F.lower("author") == F.lower("merged_by"), F.lit(False)) | (is_team(F.col("author")) & is_team(F.col("merged_by")))
    p = case(spark, "changes").filter("merged").join(r, "number", "left").select(is_team(F.col("author")).alias("team"), (F.col("reviewed").isNull() & own).alias("h"))
    return p.groupBy("team").agg(F.count("*").alias("merged"), F.count_if("h").alias("unreviewed_self_merges"), r6(C.rate(F.col("h"))).alias("rate"))


@query("quality_by_source", given("changes", "issues", "mails") + """, e AS (SELECT 'changes' AS source, CAST(coalesce(author, '') = '' AS INTEGER) + CAST(coalesce(number, 0) = 0 AS INTEGER) AS n FROM changes UNION ALL SELECT 'issues', CAST(coalesce(author, '') = '' AS INTEGER) + CAST(coalesce(number, 0) = 0 AS INTEGER) FROM issues UNION ALL SELECT 'mails', CAST(coalesce(sender, '') = '' AS INTEGER) FROM mails),
s AS (SELECT source, count(*) AS records, CAST(sum(n) AS BIGINT) AS issues FROM e GROUP BY 1) SELECT source, records, issues, CASE WHEN issues = 0 THEN 'excellent' WHEN issues <= 2 THEN 'good' WHEN issues <= 4 THEN 'fair' ELSE 'poor' END AS status FROM s""")
def quality_by_source(spark, d):
    """Faults found in every source and what they make its status (DQ9, DQ20)."""
    def faults(name, *blank):
        return case(spark, name).select(F.lit(name).alias("source"), sum((b.cast("int") for b in blank), F.lit(0)).alias("n"))

    author, number = T.or_empty(F.col("author")) == "", F.coalesce("number", F.lit(0)) == 0
    e = faults("changes", author, number).unionByName(faults("issues", author, number)).unionByName(faults("mails", T.or_empty(F.col("sender")) == ""))
    return e.groupBy("source").agg(F.count("*").alias("records"), F.sum("n").alias("issues")).withColumn("status", Q.status(F.col("issues")))


@query("rank_lookup", given("changes", "reviews") + ", c AS (SELECT lower(author) AS who, count(*) AS n FROM changes WHERE coalesce(author, '') <> '' GROUP BY 1), k AS (SELECT who, row_number() OVER (ORDER BY n DESC, who) AS place FROM c) SELECT r.seq, CAST(place AS INTEGER) AS place, coalesce(place <= 10, false) AS is_top FROM reviews r LEFT JOIN k ON who = lower(r.author)")
def rank_lookup(spark, d):
    """The place of every reviewer among contributors, null without one (JOIN4)."""
    c = case(spark, "changes").filter("author <> ''").groupBy(F.lower("author").alias("who")).agg(F.count("*").alias("n"))
    k = c.select("who", F.row_number().over(Window.orderBy(F.desc("n"), "who")).alias("place"))
    return case(spark, "reviews").select("seq", F.lower("author").alias("who")).join(k, "who", "left").select("seq", "place", F.coalesce(F.col("place") <= 10, F.lit(False)).alias("is_top"))


@query("issue_activity", given("issues", "comments") + " SELECT author, count(*) AS issues, count(*) FILTER (WHERE state = 'closed') AS closed, min(created) AS first FROM issues WHERE coalesce(author, '') <> '' GROUP BY author")
def issue_activity(spark, d):
    """Issues by author, with how many are closed (FIL21, SRC20)."""
    return case(spark, "issues").filter("author <> ''").groupBy("author").agg(F.count("*").alias("issues"), F.count_if(F.col("state") == "closed").alias("closed"), F.min("created").alias("first"))
