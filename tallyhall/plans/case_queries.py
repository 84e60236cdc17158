"""Cleaning, validation, identities, mentions, tone, funding, proposals and releases over the case tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyhall.functions import dates as D
from tallyhall.functions import keywords as K
from tallyhall.functions import text as T
from tallyhall.functions.numbers import r6, ratio
from tallyhall.operators import classify as C
from tallyhall.operators import cleaning, people, validate
from tallyhall.plans.cases import MAINTAINERS, case, given
from tallyhall.plans.registry import query
from tallyhall.plans.text_queries import _sql_any, _sql_hits

_TEAM = ", ".join(f"'{m}'" for m in MAINTAINERS)


def _clean(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN trim(regexp_replace(regexp_replace({c}, '\\s+', ' ', 'g'), '[\\x00-\\x08\\x0B-\\x0C\\x0E-\\x1F]', '', 'g')) END"


def _iso(c: str) -> str:
    return f"strftime(TRY_CAST(nullif({c}, '') AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S')"


def _year(c: str) -> str:
    return f"TRY_CAST(substring({c}, 1, 4) AS INTEGER)"


def is_team(c):
    return F.coalesce(F.lower(c).isin(MAINTAINERS), F.lit(False))


@query("clean_changes", given("changes") + f" SELECT number, author, {_iso('created')} AS created, {_iso('merged_at')} AS merged_at, {_clean('title')} AS title, {_clean('body')} AS body FROM changes WHERE coalesce(number, 0) <> 0 AND coalesce(author, '') <> ''")
def clean_changes(spark, d):
    """Changes that have a number and an author (FIL1)."""
    return cleaning.clean_records(case(spark, "changes"), ["number", "author"], ["title", "body"], ["created", "merged_at"]).select("number", "author", "created", "merged_at", "title", "body")


@query("clean_issues", given("issues") + f" SELECT number, author, {_iso('created')} AS created, {_clean('title')} AS title, {_clean('body')} AS body FROM issues WHERE coalesce(number, 0) <> 0 AND coalesce(author, '') <> ''")
def clean_issues(spark, d):
    """Issues that have a number and an author (FIL2)."""
    return cleaning.clean_records(case(spark, "issues"), ["number", "author"], ["title", "body"], ["created"]).select("number", "author", "created", "title", "body")


@query("clean_mails", given("mails") + f" SELECT message_id, sender, {_iso('date')} AS date, {_clean('subject')} AS subject, {_clean('body')} AS body FROM mails WHERE coalesce(sender, '') <> '' AND {_iso('date')} IS NOT NULL")
def clean_mails(spark, d):
    """Mails that have a sender and a readable date (FIL3)."""
    return cleaning.clean_records(case(spark, "mails"), ["sender", "date"], ["subject", "body"], ["date"]).select("message_id", "sender", "date", "subject", "body")


@query("clean_chat", given("chat") + f" SELECT seq, nickname, {_iso('ts')} AS ts, {_clean('message')} AS message FROM chat WHERE coalesce(nickname, '') <> '' AND {_iso('ts')} IS NOT NULL")
def clean_chat(spark, d):
    """Chat messages that have a nick and a time (FIL4)."""
    return cleaning.clean_records(case(spark, "chat"), ["nickname", "ts"], ["message"], ["ts"]).select("seq", "nickname", "ts", "message")


@query("clean_commits", given("commits") + f" SELECT sha, {_iso('date')} AS date, {_clean('message')} AS message FROM commits WHERE coalesce(sha, '') <> ''")
def clean_commits(spark, d):
    """Commits that have a hash (FIL5)."""
    return cleaning.clean_records(case(spark, "commits"), ["sha"], ["message"], ["date"]).select("sha", "date", "message")


@query("clean_signers", given("signers") + f" SELECT tag, lower(trim(signer_email)) AS signer_email, {_clean('signer_name')} AS signer_name, {_iso('date')} AS date FROM signers WHERE coalesce(tag, '') <> ''")
def clean_signers(spark, d):
    """Releases that have a tag, addresses in one form (FIL6)."""
    return cleaning.clean_records(case(spark, "signers"), ["tag"], ["signer_name"], ["date"], ["signer_email"]).select("tag", "signer_email", "signer_name", "date")


@query("cleaning_report", given("changes", "mails") + f""", c AS (SELECT 'changes' AS source, count(*) FILTER (WHERE coalesce(number, 0) <> 0 AND coalesce(author, '') <> '') AS processed, count(*) AS n FROM changes
UNION ALL SELECT 'mails', count(*) FILTER (WHERE coalesce(sender, '') <> '' AND {_iso('date')} IS NOT NULL), count(*) FROM mails)
SELECT source, CAST(processed AS BIGINT) AS processed, CAST(n - processed AS BIGINT) AS errors, round(CAST(processed AS DOUBLE) / n * 100, 2) AS rate FROM c""")
def cleaning_report(spark, d):
    """How many records cleaning kept (DQ17)."""
    changes, mails = case(spark, "changes"), case(spark, "mails")
    return cleaning.cleaning_report({"changes": (changes, cleaning.clean_records(changes, ["number", "author"])), "mails": (mails, cleaning.clean_records(mails, ["sender", "date"], times=["date"]))})


_MISSING = " UNION ALL ".join(f"SELECT id, 'Missing required field: {f}' AS error FROM raw WHERE json_type(json, '$.{f}') IS NULL" for f in ("number", "author", "created_at", "state"))
_LISTS = " UNION ALL ".join(f"SELECT id, 'Field ''{f}'' must be a list' FROM raw WHERE json_type(json, '$.{f}') <> 'ARRAY'" for f in ("reviews", "comments"))


@query("change_errors", given("raw") + f""" {_MISSING} UNION ALL SELECT id, 'Field ''number'' must be integer' FROM raw WHERE json_type(json, '$.number') NOT IN ('BIGINT', 'UBIGINT', 'BOOLEAN')
UNION ALL SELECT id, 'Field ''created_at'' must be valid ISO timestamp' FROM raw WHERE json_type(json, '$.created_at') IS NOT NULL AND TRY_CAST(json ->> '$.created_at' AS TIMESTAMP) IS NULL
UNION ALL SELECT id, 'Field ''state'' must be one of open, closed, merged' FROM raw WHERE json_type(json, '$.state') IS NOT NULL AND coalesce(json ->> '$.state', '') NOT IN ('open', 'closed', 'merged')
UNION ALL {_LISTS}""")
def change_errors(spark, d):
    """Faults of raw records: missing fields, types, times, states (DQ2)."""
    return case(spark, "raw").select("id", F.explode(validate.change_errors(F.col("json"))).alias("error"))


_PROPERTIES = {"number": "integer", "author": "string", "reviews": "array", "comments": "array", "state": "string"}
_JSON_TYPE = {"integer": "'BIGINT', 'UBIGINT'", "string": "'VARCHAR'", "array": "'ARRAY'"}


@query("schema_errors", given("raw") + f", e AS (SELECT id, CASE {' '.join(f'''WHEN json_type(json, '$.{f}') IS NULL THEN 'Missing required field: {f}' ''' for f in ('number', 'author', 'state'))} {' '.join(f'''WHEN json_type(json, '$.{f}') NOT IN ({_JSON_TYPE[t]}) THEN 'Field ''{f}'' type mismatch: expected {t}' ''' for f, t in _PROPERTIES.items())} END AS error FROM raw) SELECT * FROM e WHERE error IS NOT NULL")
def schema_errors(spark, d):
    """The first breach of a small schema by every raw record (DQ5)."""
    return case(spark, "raw").select("id", validate.schema_error(F.col("json"), ["number", "author", "state"], _PROPERTIES).alias("error")).filter("error IS NOT NULL")


_MAPS = [(1, '{"u1": {"forge": ["a", "b"], "chat": ["a_"]}}'), (2, '{"u1": ["a"], "u2": {"forge": "b"}}'), (3, '[1, 2]'), (4, '{"u3": {"forge": ["x", 7], "chat": []}, "u4": {}}'), (5, '{"u5": {"mail": {"a": 1}}}'), (6, "{}")]
_MAP_SQL = "WITH m AS (SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{j}')" for i, j in _MAPS) + ") t(id, json))"


@query("mapping_errors", _MAP_SQL + """, u AS (SELECT id, unnest(json_keys(json)) AS p, json FROM m WHERE json_type(json) = 'OBJECT'), v AS (SELECT id, p, json_extract(json, '$.' || p) AS j FROM u),
w AS (SELECT id, unnest(json_keys(j)) AS q, j FROM v WHERE json_type(j) = 'OBJECT'), x AS (SELECT id, q, json_extract(j, '$.' || q) AS j FROM w)
SELECT id, 'Identity mapping must be a dictionary' AS error FROM m WHERE json_type(json) <> 'OBJECT' UNION ALL SELECT id, 'Platforms for ' || p || ' must be a dictionary' FROM v WHERE json_type(j) <> 'OBJECT'
UNION ALL SELECT id, 'IDs for ' || q || ' must be a list' FROM x WHERE json_type(j) <> 'ARRAY' UNION ALL SELECT id, 'All IDs for ' || q || ' must be strings' FROM x WHERE json_type(j) = 'ARRAY' AND len(list_filter(json_extract(j, '$[*]'), lambda e: json_type(e) <> 'VARCHAR')) > 0""")
def mapping_errors(spark, d):
    """Faults of identity mappings (DQ3)."""
    return validate.mapping_errors(spark.createDataFrame(_MAPS, "id long, json string"))


_LINES = [(1, '{"maintainer_timeline": {"a": {"estimated_start": "2012-01-01", "periods": [{"start": "2012-01-01T00:00:00"}, {"end": "2013-01-01"}, {"start": "soon"}]}}}'), (2, '{"other": {}}'), (3, '{"maintainer_timeline": {"b": {"periods": []}, "c": {"estimated_start": "2014-01-01", "periods": "none"}}}'), (4, '{"maintainer_timeline": {}}')]
_LINE_SQL = "WITH m AS (SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{j}')" for i, j in _LINES) + ") t(id, json))"


@query("timeline_errors", _LINE_SQL + """, t AS (SELECT id, json_extract(json, '$.maintainer_timeline') AS j FROM m), u AS (SELECT id, unnest(json_keys(j)) AS p, j FROM t WHERE j IS NOT NULL), v AS (SELECT id, p, json_extract(j, '$.' || p) AS j FROM u),
w AS (SELECT id, p, unnest(json_extract(j, '$.periods[*]')) AS e FROM v WHERE json_type(j, '$.periods') = 'ARRAY')
SELECT id, 'Missing ''maintainer_timeline'' key' AS error FROM t WHERE j IS NULL UNION ALL SELECT id, 'Missing ''estimated_start'' for ' || p FROM v WHERE json_type(j, '$.estimated_start') IS NULL
UNION ALL SELECT id, '''periods'' must be a list for ' || p FROM v WHERE json_type(j, '$.periods') <> 'ARRAY' UNION ALL SELECT id, 'Period missing ''start'' for ' || p FROM w WHERE json_type(e, '$.start') IS NULL
UNION ALL SELECT id, 'Invalid ''start'' timestamp for ' || p FROM w WHERE json_type(e, '$.start') IS NOT NULL AND TRY_CAST(e ->> '$.start' AS TIMESTAMP) IS NULL""")
def timeline_errors(spark, d):
    """Faults of tenure records (DQ4)."""
    return validate.timeline_errors(spark.createDataFrame(_LINES, "id long, json string"))


@query("integrity_report", given("changes", "reviews", "issues") + """ SELECT 'duplicates' AS "check", count(*) AS found FROM (SELECT author FROM issues GROUP BY author, title HAVING count(*) > 1)
UNION ALL SELECT 'timestamps', count(*) FROM changes WHERE TRY_CAST(merged_at AS TIMESTAMP) < TRY_CAST(created AS TIMESTAMP) UNION ALL SELECT 'references', count(*) FROM reviews WHERE number NOT IN (SELECT number FROM changes WHERE merged AND number IS NOT NULL)
UNION ALL SELECT 'completeness', count(*) FROM changes WHERE body IS NULL""")
def integrity_report(spark, d):
    """Four named checks and what each finds (DQ18, DQ8)."""
    changes, reviews, issues = case(spark, "changes"), case(spark, "reviews"), case(spark, "issues")
    merged = changes.filter("merged AND number IS NOT NULL").select("number")
    return validate.integrity({
        "duplicates": issues.groupBy("author", "title").count().filter("count > 1"), "timestamps": changes.filter(D.parse(F.col("merged_at")) < D.parse(F.col("created"))),
        "references": reviews.join(merged, "number", "left_anti"), "completeness": changes.filter("body IS NULL"),
    })


_NEAR = "(SELECT lower(author) AS actor, 1 AS kind, number AS k, 0 AS j, title AS t FROM changes UNION ALL SELECT lower(author), 1, number, 1, body FROM changes UNION ALL SELECT lower(author), 2, seq, 0, body || CASE lower(state) WHEN 'approved' THEN ' ack approve support' WHEN 'changes_requested' THEN ' nack oppose concern' ELSE '' END FROM reviews UNION ALL SELECT lower(author), 3, seq, 0, body FROM comments UNION ALL SELECT lower(author), 4, number, 0, title FROM issues UNION ALL SELECT lower(author), 4, number, 1, body FROM issues)"
_SOM_SCORES = {k: _sql_hits("t", K.STATE_OF_MIND[k]) for k in ("som1", "som2", "som5", "som6")}


@query("actor_states", given("changes", "reviews", "comments", "issues") + f""", e AS {_NEAR}, a AS (SELECT actor, lower(string_agg(coalesce(t, ''), ' ' ORDER BY kind, k, j)) AS t, count(*) FILTER (WHERE j = 0) AS n FROM e WHERE coalesce(actor, '') <> '' GROUP BY actor),
s AS (SELECT actor, n, {', '.join(f'{v} AS {k}' for k, v in _SOM_SCORES.items())} FROM a)
SELECT actor, n AS activities, som1, som2, som5, som6, CASE WHEN som6 > 0 THEN 'som6' WHEN som1 > 0 OR (n >= 5 AND som2 >= 3) THEN 'som1' WHEN som5 > 0 THEN 'som5' WHEN som2 > 0 OR n >= 3 THEN 'som2' WHEN n >= 1 THEN 'som3' ELSE 'som4' END AS som,
CASE WHEN som6 > 0 THEN CASE WHEN som6 >= 2 THEN 'high' ELSE 'medium' END WHEN som1 > 0 OR (n >= 5 AND som2 >= 3) THEN CASE WHEN som1 >= 2 OR n >= 10 THEN 'high' ELSE 'medium' END WHEN som5 > 0 OR som2 > 0 OR n >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM s""")
def actor_states(spark, d):
    """State of mind of every actor over all their texts, also where a phrase runs from one into the next (CLS23, QRY91, AGG21)."""
    return people.actor_states(people.spoken(case(spark, "changes"), case(spark, "reviews"), case(spark, "comments"), case(spark, "issues")))


@query("platform_users", given("changes", "issues", "reviews", "comments", "mails", "chat", "signers") + r""", g AS (SELECT author AS id, number AS c, NULL AS i, created AS t FROM changes UNION ALL SELECT author, NULL, number, created FROM issues UNION ALL SELECT author, NULL, NULL, NULL FROM reviews UNION ALL SELECT author, NULL, NULL, NULL FROM comments),
m AS (SELECT CASE WHEN contains(sender, '<') THEN regexp_extract(sender, '<([^>]+)>', 1) ELSE trim(sender) END AS id, message_id, date FROM mails)
SELECT 'forge' AS platform, id, count(c) AS items, count(i) AS more, min(t) AS first_seen FROM g WHERE coalesce(id, '') <> '' GROUP BY id UNION ALL SELECT 'mail', id, count(message_id), 0, min(date) FROM m WHERE contains(id, '@') GROUP BY id
UNION ALL SELECT 'chat', nickname, count(*), 0, min(ts) FROM chat WHERE coalesce(nickname, '') <> '' GROUP BY nickname UNION ALL SELECT 'signing', signer_email, count(tag), 0, min(date) FROM signers WHERE is_signed AND coalesce(signer_email, '') <> '' GROUP BY signer_email""")
def platform_users(spark, d):
    """Users of each platform with what they did and when they came (IDR4, IDR12)."""
    return people.platform_users(*(case(spark, n) for n in ("changes", "issues", "reviews", "comments", "mails", "chat", "signers")))


@query("overlap_improvement", given("changes", "chat", "aliases") + """, g AS (SELECT DISTINCT lower(author) AS u FROM changes WHERE coalesce(author, '') <> ''), c AS (SELECT DISTINCT lower(nickname) AS u FROM chat WHERE coalesce(nickname, '') <> ''),
p AS (SELECT unified, bool_or(platform = 'forge' AND lower(id) IN (SELECT u FROM g)) AS on_forge, bool_or(platform = 'chat' AND lower(id) IN (SELECT u FROM c)) AS on_chat, bool_or(platform = 'forge' AND lower(id) IN (SELECT u FROM c)) AS counted FROM aliases GROUP BY unified),
n AS (SELECT (SELECT count(*) FROM g WHERE u IN (SELECT u FROM c)) AS original, (SELECT count(*) FROM p WHERE on_forge AND on_chat AND NOT counted) AS more, (SELECT count(*) FROM g) AS forge_users, (SELECT count(*) FROM c) AS chat_users)
SELECT original, original + more AS improved, more AS improvement, forge_users, chat_users FROM n""")
def overlap_improvement(spark, d):
    """Users on two platforms before and after known aliases (IDR7)."""
    return people.overlap_improvement(case(spark, "changes").select("author"), case(spark, "chat").select("nickname"), case(spark, "aliases"))


def _mentions_sql(texts: str, source: str, who: str, name: str) -> str:
    return f", e AS (SELECT DISTINCT {source} AS id, {who} AS actor, CAST(unnest(regexp_extract_all({texts}, '(?:#|pull/)(\\d{{4,6}})', 1)) AS BIGINT) AS number FROM {name})"


@query("chat_mentions", given("changes", "chat") + _mentions_sql("message", "seq", "nickname", "chat") + " SELECT number, count(*) AS messages, count(DISTINCT lower(actor)) AS nicks, bool_or(merged) AS merged FROM e JOIN changes USING (number) GROUP BY number")
def chat_mentions(spark, d):
    """Changes that chat mentions, joined to their outcome (JOIN7, STR10)."""
    return people.mentioned(case(spark, "chat"), F.col("message"), "nickname", case(spark, "changes")).withColumnRenamed("actors", "nicks")


@query("mail_mentions", given("changes", "mails") + _mentions_sql("coalesce(body, '') || ' ' || coalesce(subject, '')", "message_id", "sender", "mails") + " SELECT number, count(*) AS messages, count(DISTINCT lower(actor)) AS senders, bool_or(merged) AS merged FROM e JOIN changes USING (number) GROUP BY number")
def mail_mentions(spark, d):
    """Changes that mails mention in body or subject (JOIN8, STR10)."""
    return people.mentioned(case(spark, "mails"), F.concat_ws(" ", T.or_empty(F.col("body")), T.or_empty(F.col("subject"))), "sender", case(spark, "changes")).withColumnRenamed("actors", "senders")


@query("proposal_mentions", given("changes", "proposals") + r""", e AS (SELECT DISTINCT number AS change, merged, CAST(unnest(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(body, '')), '\bbip\s*-?\s*(\d+)\b', 1)) AS BIGINT) AS p FROM changes)
SELECT number, count(change) AS changes, count(*) FILTER (WHERE merged) AS merged FROM proposals LEFT JOIN e ON p = number GROUP BY number""")
def proposal_mentions(spark, d):
    """Changes that carry out each proposal: numbers are extracted once and joined by value (JOIN14)."""
    text = F.lower(F.concat_ws(" ", T.or_empty(F.col("title")), T.or_empty(F.col("body"))))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\bbip\s*-?\s*(\d+)\b"), 1))
    e = case(spark, "changes").select(F.col("number").alias("change"), "merged", F.explode(found.cast("array<long>")).alias("p"))
    p = case(spark, "proposals")
    return p.join(e, p["number"] == e["p"], "left").groupBy(p["number"]).agg(F.count("change").alias("changes"), F.count_if("merged").alias("merged"))


_REPLY = "(SELECT number, body AS t FROM comments UNION ALL SELECT number, body FROM reviews)"
_SCORE = f"({_sql_hits('lower(t)', K.NEGATIVE)} + {_sql_hits('lower(t)', K.HARSH)} - {_sql_hits('lower(t)', K.POLITE)})"


@query("toxicity_by_year", given("changes", "reviews", "comments") + f""", f AS {_REPLY}, s AS (SELECT {_year('created')} AS year, coalesce(lower(author), '') IN ({_TEAM}) AS team, {_SCORE} AS s FROM f JOIN changes USING (number) WHERE coalesce(t, '') <> '')
SELECT year, round(avg(s) FILTER (WHERE team), 6) AS team_mean, round(avg(s) FILTER (WHERE NOT team), 6) AS other_mean, count(*) FILTER (WHERE team) AS team_n, count(*) FILTER (WHERE NOT team) AS other_n FROM s WHERE year IS NOT NULL GROUP BY year""")
def toxicity_by_year(spark, d):
    """Tone of the answers to changes by year and status of their author (QRY29, QRY28)."""
    s = people.answers(case(spark, "changes"), case(spark, "comments"), case(spark, "reviews")).filter("t <> ''").select(D.year_of_prefix(F.col("created")).alias("year"), is_team(F.col("author")).alias("team"), C.toxicity_score(F.col("t")).alias("s"))
    return s.filter("year IS NOT NULL").groupBy("year").agg(r6(F.avg(F.when(F.col("team"), F.col("s")))).alias("team_mean"), r6(F.avg(F.when(~F.col("team"), F.col("s")))).alias("other_mean"), F.count_if("team").alias("team_n"), F.count_if(~F.col("team")).alias("other_n"))


@query("cumulative_toxicity", given("changes", "reviews", "comments") + f""", f AS {_REPLY}, s AS (SELECT number, sum({_SCORE}) AS s FROM f WHERE coalesce(t, '') <> '' GROUP BY number), a AS (SELECT author, CAST(sum(coalesce(s, 0)) AS BIGINT) AS total, avg(coalesce(s, 0)) AS mean, count(*) AS changes FROM changes LEFT JOIN s USING (number) WHERE coalesce(author, '') <> '' GROUP BY author)
SELECT author, total, round(mean, 6) AS mean, changes FROM a WHERE mean > 2 ORDER BY total DESC, author LIMIT 20""")
def cumulative_toxicity(spark, d):
    """Authors whose changes draw a mean score over 2, the 20 with the largest sum (QRY30)."""
    s = people.answers(case(spark, "changes"), case(spark, "comments"), case(spark, "reviews")).filter("t <> ''").groupBy("number").agg(F.sum(C.toxicity_score(F.col("t"))).alias("s"))
    per = case(spark, "changes").filter("author <> ''").join(s, "number", "left").groupBy("author").agg(F.sum(F.coalesce("s", F.lit(0))).alias("total"), F.avg(F.coalesce("s", F.lit(0))).alias("mean"), F.count("*").alias("changes"))
    return per.filter("mean > 2").orderBy(F.desc("total"), "author").limit(20).withColumn("mean", r6(F.col("mean")))


_TB = "lower(coalesce(title, '') || ' ' || coalesce(body, ''))"


def _title_body():
    return F.concat_ws(" ", T.or_empty(F.col("title")), T.or_empty(F.col("body")))


@query("coordination_by_year", given("changes", "comments") + f""", c AS (SELECT number, count(*) AS n FROM comments WHERE {_sql_any("lower(coalesce(body, ''))", K.ALTERNATIVES)} GROUP BY number),
y AS (SELECT {_year('created')} AS year, CAST({_sql_any(_TB, K.ALTERNATIVES)} AS INTEGER) + coalesce(n, 0) AS m FROM changes LEFT JOIN c USING (number)) SELECT year, CAST(sum(m) AS BIGINT) AS mentions, count(*) AS total, round(CAST(sum(m) AS DOUBLE) / count(*), 6) AS rate FROM y WHERE year IS NOT NULL GROUP BY year""")
def coordination_by_year(spark, d):
    """Mentions of alternatives in changes and their comments by year (QRY31)."""
    said = case(spark, "comments").filter(T.lowered(F.col("body"), lambda b: T.contains_any(b, K.ALTERNATIVES))).groupBy("number").agg(F.count("*").alias("n"))
    own = T.lowered(_title_body(), lambda b: T.contains_any(b, K.ALTERNATIVES)).cast("int")
    y = case(spark, "changes").join(said, "number", "left").select(D.year_of_prefix(F.col("created")).alias("year"), (own + F.coalesce("n", F.lit(0))).alias("m"))
    return y.filter("year IS NOT NULL").groupBy("year").agg(F.sum("m").alias("mentions"), F.count("*").alias("total"), r6(F.sum("m") / F.count("*")).alias("rate"))


@query("alternative_mentions", given("changes") + " " + " UNION ALL ".join(f"SELECT '{k}' AS alternative, count(*) FILTER (WHERE contains({_TB}, '{k}')) AS changes FROM changes" for k in ("knots", "fork", "alternative", "competing")))
def alternative_mentions(spark, d):
    """Changes that name each alternative: one pass for all names (QRY32)."""
    names = ["knots", "fork", "alternative", "competing"]
    one = case(spark, "changes").select(T.lowered(_title_body(), lambda b: F.array(*[b.contains(k) for k in names])).alias("h")).agg(*[F.count_if(F.col("h")[i]).alias(k) for i, k in enumerate(names)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("alternative"), F.col(k).alias("changes")) for k in names])).alias("r")).select("r.*")


@query("legitimacy_by_year", given("changes") + f" SELECT {_year('created')} AS year, count(*) FILTER (WHERE {_sql_any(_TB, K.LEGITIMACY)}) AS concerns, count(*) AS total, round(CAST(count(*) FILTER (WHERE {_sql_any(_TB, K.LEGITIMACY)}) AS DOUBLE) / count(*), 6) AS rate FROM changes WHERE {_year('created')} IS NOT NULL GROUP BY 1")
def legitimacy_by_year(spark, d):
    """Changes that raise concerns about the process, by year (QRY33)."""
    hit = T.lowered(_title_body(), lambda b: T.contains_any(b, K.LEGITIMACY))
    return case(spark, "changes").select(D.year_of_prefix(F.col("created")).alias("year"), hit.alias("h")).filter("year IS NOT NULL").groupBy("year").agg(F.count_if("h").alias("concerns"), F.count("*").alias("total"), r6(C.rate(F.col("h"))).alias("rate"))


_ISO = " UNION ALL ".join(f"SELECT '{k}' AS pressure, count(*) FILTER (WHERE {_sql_any(_TB, ks)}) AS n, count(*) AS total FROM changes" for k, ks in K.ISOMORPHISM.items())


@query("isomorphism", given("changes") + f", p AS ({_ISO}) SELECT pressure, n, round(CAST(n AS DOUBLE) / total, 6) AS rate, n = max(n) OVER () AS dominant FROM p")
def isomorphism(spark, d):
    """Pressures to conform, their rates and the dominant one (QRY40)."""
    kinds = T.lowered(_title_body(), lambda b: T.matching(b, K.ISOMORPHISM))
    c = case(spark, "changes").select(kinds.alias("k")).agg(F.count("*").alias("total"), *[F.count_if(F.array_contains("k", k)).alias(k) for k in K.ISOMORPHISM])
    each = c.select("total", F.explode(F.array(*[F.struct(F.lit(k).alias("pressure"), F.col(k).alias("n")) for k in K.ISOMORPHISM])).alias("r"), F.greatest(*K.ISOMORPHISM).alias("most"))
    return each.select("r.pressure", "r.n", r6(ratio(F.col("r.n"), F.col("total"))).alias("rate"), (F.col("r.n") == F.col("most")).alias("dominant"))


_AUTHORS = "(SELECT number, status, trim(lower(regexp_replace(unnest(string_split(author, ',')), '<[^>]+>', '', 'g'))) AS who FROM proposals)"


@query("proposal_proposers", given("proposals") + f", a AS {_AUTHORS}, t AS (SELECT count(*) AS n FROM proposals) SELECT who, count(*) AS proposals, list_sort(list(number))[1] AS first_number, {' OR '.join(f'''contains(who, '{m}') OR contains('{m}', who)''' for m in MAINTAINERS)} AS team, round(CAST(count(*) AS DOUBLE) / max(n), 6) AS share FROM a, t WHERE who <> '' GROUP BY who")
def proposal_proposers(spark, d):
    """Who proposes how much, and whether the name is a maintainer's (QRY50, STR14)."""
    p = case(spark, "proposals")
    named = p.select("number", F.explode(T.author_list(F.col("author"))).alias("who"))
    team = F.lit(False)
    for m in MAINTAINERS:
        team = team | F.col("who").contains(m) | F.lit(m).contains(F.col("who"))
    total = F.lit(p.count())
    return named.groupBy("who").agg(F.count("*").alias("proposals"), F.min("number").alias("first_number")).select("who", "proposals", "first_number", team.alias("team"), r6(F.col("proposals") / total).alias("share"))


@query("proposal_champions", given("changes", "comments") + ", c AS (SELECT number, count(*) AS n FROM comments GROUP BY number) SELECT lower(author) AS who, CAST(count(*) + sum(coalesce(n, 0)) AS BIGINT) AS activity, count(DISTINCT number) AS changes FROM changes LEFT JOIN c USING (number) WHERE coalesce(author, '') <> '' GROUP BY 1 ORDER BY activity DESC, who LIMIT 10")
def proposal_champions(spark, d):
    """The ten authors whose changes see most activity (QRY51)."""
    c = case(spark, "comments").groupBy("number").agg(F.count("*").alias("n"))
    a = case(spark, "changes").filter("author <> ''").join(c, "number", "left").groupBy(F.lower("author").alias("who"))
    return a.agg((F.count("*") + F.sum(F.coalesce("n", F.lit(0)))).alias("activity"), F.countDistinct("number").alias("changes")).orderBy(F.desc("activity"), "who").limit(10)


_OPPOSED = ["nack", "oppose", "against", "object", "reject", "veto"]


@query("proposal_opposition", given("changes", "issues", "comments") + f" SELECT (SELECT count(*) FROM changes WHERE state = 'closed' AND NOT merged) AS rejected_changes, (SELECT count(*) FROM issues WHERE state = 'closed') AS rejected_issues, (SELECT count(*) FROM comments WHERE {_sql_any('lower(coalesce(body, chr(32)))', _OPPOSED)}) AS opposing_comments")
def proposal_opposition(spark, d):
    """Rejections and opposing comments (QRY52)."""
    kinds = case(spark, "changes").select((C.rejected(F.col("state"), F.col("merged"))).cast("int").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"))
    kinds = kinds.unionByName(case(spark, "issues").select(F.lit(0).alias("a"), (F.col("state") == "closed").cast("int").alias("b"), F.lit(0).alias("c")))
    kinds = kinds.unionByName(case(spark, "comments").select(F.lit(0).alias("a"), F.lit(0).alias("b"), T.lowered(F.col("body"), lambda t: T.contains_any(t, _OPPOSED)).cast("int").alias("c")))
    return kinds.agg(F.sum("a").alias("rejected_changes"), F.sum("b").alias("rejected_issues"), F.sum("c").alias("opposing_comments"))


_FUND = {k: p.replace("\\b", r"\b") for k, p in K.FUNDING.items()}
_FUND_ANY = "(" + " OR ".join(f"regexp_matches({_TB}, '{p}')" for p in _FUND.values()) + ")"


@query("funding_in_changes", given("changes") + " " + " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS changes FROM changes WHERE regexp_matches({_TB}, '{p}') HAVING count(*) > 0" for k, p in _FUND.items()))
def funding_in_changes(spark, d):
    """Kinds of funding that changes name (CLS26, CLS27, QRY88)."""
    return case(spark, "changes").select(F.explode(C.funding_types(_title_body())).alias("kind")).groupBy("kind").agg(F.count("*").alias("changes"))


@query("funding_outcome", given("changes", "reviews") + f""", n AS (SELECT number, count(*) AS n FROM reviews GROUP BY number), f AS (SELECT {_FUND_ANY} AS funded, merged, coalesce(n, 0) AS n, date_diff('second', TRY_CAST(created AS TIMESTAMP), TRY_CAST(merged_at AS TIMESTAMP)) / 86400.0 AS days FROM changes LEFT JOIN n USING (number))
SELECT funded, count(*) AS changes, round(avg(CAST(merged AS INTEGER)), 6) AS merge_rate, round(avg(n), 6) AS mean_reviews, round(avg(days) FILTER (WHERE days >= 0), 6) AS mean_days FROM f GROUP BY funded""")
def funding_outcome(spark, d):
    """Merge rate, reviews and days with and without funding words (QRY60, QRY62, QRY90)."""
    n = case(spark, "reviews").groupBy("number").agg(F.count("*").alias("n"))
    days = D.days_between(D.parse(F.col("created")), D.parse(F.col("merged_at")))
    f = case(spark, "changes").join(n, "number", "left").select((F.size(C.funding_types(_title_body())) > 0).alias("funded"), "merged", F.coalesce("n", F.lit(0)).alias("n"), days.alias("days"))
    return f.groupBy("funded").agg(F.count("*").alias("changes"), r6(F.avg(F.col("merged").cast("int"))).alias("merge_rate"), r6(F.avg("n")).alias("mean_reviews"), r6(F.avg(F.when(F.col("days") >= 0, F.col("days")))).alias("mean_days"))


@query("funding_by_maintainer", given("changes") + f" SELECT lower(author) AS who, count(*) FILTER (WHERE {_FUND_ANY}) AS funded, count(*) AS changes, round(CAST(count(*) FILTER (WHERE {_FUND_ANY}) AS DOUBLE) / count(*), 6) AS rate FROM changes WHERE lower(author) IN ({_TEAM}) GROUP BY 1")
def funding_by_maintainer(spark, d):
    """How often each maintainer's changes name funding (QRY61)."""
    f = case(spark, "changes").filter(is_team(F.col("author"))).select(F.lower("author").alias("who"), (F.size(C.funding_types(_title_body())) > 0).alias("f"))
    return f.groupBy("who").agg(F.count_if("f").alias("funded"), F.count("*").alias("changes"), r6(C.rate(F.col("f"))).alias("rate"))


@query("funding_by_year", given("changes") + f", y AS (SELECT {_year('created')} AS year, count(*) FILTER (WHERE {_FUND_ANY}) AS funded, count(*) AS changes FROM changes WHERE {_year('created')} IS NOT NULL GROUP BY 1 HAVING count(*) >= 5) SELECT year, funded, changes, round(CAST(funded AS DOUBLE) / changes, 6) AS rate, round(CAST(funded AS DOUBLE) / changes - lag(CAST(funded AS DOUBLE) / changes) OVER (ORDER BY year), 6) AS change FROM y")
def funding_by_year(spark, d):
    """Share of changes that name funding by year, years of 5 changes or more, and its change (QRY59, QRY63)."""
    f = case(spark, "changes").select(D.year_of_prefix(F.col("created")).alias("year"), (F.size(C.funding_types(_title_body())) > 0).alias("f")).filter("year IS NOT NULL")
    y = f.groupBy("year").agg(F.count_if("f").alias("funded"), F.count("*").alias("changes")).filter("changes >= 5").withColumn("_r", F.col("funded") / F.col("changes"))
    return y.select("year", "funded", "changes", r6(F.col("_r")).alias("rate"), r6(F.col("_r") - F.lag("_r").over(Window.orderBy("year"))).alias("change"))


@query("funding_mentions", given("changes", "comments", "mails") + f""", s AS (SELECT 'change' AS source, {_TB} AS t FROM changes UNION ALL SELECT 'comment', lower(coalesce(body, '')) FROM comments UNION ALL SELECT 'mail', lower(coalesce(subject, '') || ' ' || coalesce(body, '')) FROM mails)
SELECT source, CASE {' '.join(f"WHEN regexp_matches(t, '{p}') THEN '{k}'" for k, p in reversed(_FUND.items()))} END AS category, count(*) AS n FROM s WHERE {' OR '.join(f"regexp_matches(t, '{p}')" for p in _FUND.values())} GROUP BY 1, 2""")
def funding_mentions(spark, d):
    """Texts by source and the last kind of funding that they name (CLS28, QRY89)."""
    s = case(spark, "changes").select(F.lit("change").alias("source"), _title_body().alias("t")).unionByName(case(spark, "comments").select(F.lit("comment").alias("source"), F.col("body").alias("t"))).unionByName(case(spark, "mails").select(F.lit("mail").alias("source"), F.concat_ws(" ", T.or_empty(F.col("subject")), T.or_empty(F.col("body"))).alias("t")))
    return s.select("source", F.try_element_at(C.funding_types(F.col("t")), F.lit(-1)).alias("category")).filter("category IS NOT NULL").groupBy("source", "category").agg(F.count("*").alias("n"))


@query("rejection_reasons_named", given("changes", "comments", "reviews") + f""", r AS (SELECT number, coalesce(title, '') || ' ' || coalesce(body, '') AS t FROM changes WHERE state = 'closed' AND NOT merged), e AS (SELECT number, t FROM r UNION ALL SELECT number, body FROM comments WHERE number IN (SELECT number FROM r) UNION ALL SELECT number, body FROM reviews WHERE number IN (SELECT number FROM r)),
{', '.join(f"c{i} AS (SELECT '{k}' AS reason, count(DISTINCT number) AS changes FROM e WHERE {_sql_any('lower(t)', ks)} HAVING count(*) > 0)" for i, (k, ks) in enumerate(K.REJECTION.items()))} {' UNION ALL '.join(f'SELECT * FROM c{i}' for i in range(len(K.REJECTION)))}""")
def rejection_reasons_named(spark, d):
    """Rejected changes by the reasons that they and their answers name (CLS29, QRY92)."""
    gone = case(spark, "changes").filter(C.rejected(F.col("state"), F.col("merged"))).select("number", _title_body().alias("t"))
    said = case(spark, "comments").select("number", F.col("body").alias("t")).unionByName(case(spark, "reviews").select("number", F.col("body").alias("t"))).join(gone.select("number"), "number", "left_semi")
    return gone.unionByName(said).select("number", F.explode(C.rejection_reasons(F.col("t"))).alias("reason")).distinct().groupBy("reason").agg(F.count("*").alias("changes"))


@query("release_links", given("signers") + " SELECT tag, lag(tag) OVER (ORDER BY date, tag) AS previous FROM signers WHERE tag IS NOT NULL")
def release_links(spark, d):
    """Each release and the one before it (QRY84)."""
    return case(spark, "signers").filter("tag IS NOT NULL").select("tag", F.lag("tag").over(Window.orderBy("date", "tag")).alias("previous"))


_SPAN = "v AS (SELECT tag, date, lag(date) OVER (ORDER BY date, tag) AS since FROM signers WHERE tag IS NOT NULL)"
_PART = r"coalesce(nullif(regexp_extract(message, 'Merge (?:pull request )?#(\d+)', 1), ''), nullif(regexp_extract(message, '#(\d+)', 1), ''))"


@query("release_parts", given("signers", "commits", "changes") + f""", {_SPAN}, c AS (SELECT date, CAST({_PART} AS BIGINT) AS number FROM commits WHERE parents > 1 AND coalesce(sha, '') <> ''), p AS (SELECT DISTINCT tag, number FROM v JOIN c ON c.date <= v.date AND (since IS NULL OR c.date > since) WHERE number IS NOT NULL)
SELECT p.tag, p.number, substring(title, 1, 100) AS title, merged FROM p LEFT JOIN changes USING (number)""")
def release_parts(spark, d):
    """The changes that each release brought, by its merge commits since the last one (QRY86, QRY87)."""
    return people.release_parts(case(spark, "signers"), case(spark, "commits"), case(spark, "changes"))


@query("signer_maintainers", given("signers") + f", s AS (SELECT lower(trim(signer_email)) AS email, count(*) AS releases FROM signers WHERE is_signed AND tag IS NOT NULL GROUP BY 1), m AS (SELECT * FROM (VALUES {', '.join(f'''('{m}')''' for m in MAINTAINERS)}) t(m)) SELECT email, releases, (SELECT min(m) FROM m WHERE contains(email, m)) AS maintainer FROM s")
def signer_maintainers(spark, d):
    """Signers whose address holds a maintainer's name (JOIN15, JOIN16, IDR5)."""
    s = case(spark, "signers").filter("is_signed AND tag IS NOT NULL").groupBy(F.lower(F.trim("signer_email")).alias("email")).agg(F.count("*").alias("releases"))
    return s.withColumn("maintainer", F.array_min(F.filter(F.array(*[F.lit(m) for m in MAINTAINERS]), lambda m: F.col("email").contains(m))))


@query("decision_patterns", given("changes", "reviews") + f""", r AS (SELECT number, count(*) AS n, bool_or(state = 'APPROVED') AS approved, bool_or(contains(lower(body), 'nack')) AS nacked FROM reviews GROUP BY number),
p AS (SELECT coalesce(lower(author), '') IN ({_TEAM}) AS team, CASE WHEN merged THEN 'merged' ELSE 'rejected' END AS outcome, coalesce(n, 0) AS n, coalesce(approved, false) AS approved, coalesce(nacked, false) AS nacked, date_diff('second', TRY_CAST(created AS TIMESTAMP), TRY_CAST(merged_at AS TIMESTAMP)) / 86400.0 AS days FROM changes LEFT JOIN r USING (number) WHERE merged OR state = 'closed')
SELECT team, outcome, count(*) AS changes, round(avg(n), 6) AS mean_reviews, round(avg(CAST(approved AS INTEGER)), 6) AS approval_rate, round(avg(CAST(nacked AS INTEGER)), 6) AS nack_rate, round(avg(days) FILTER (WHERE days >= 0), 6) AS mean_days FROM p GROUP BY team, outcome""")
def decision_patterns(spark, d):
    """What sets merged changes apart from rejected ones, by status of the author (QRY18)."""
    r = case(spark, "reviews").groupBy("number").agg(F.count("*").alias("n"), F.bool_or(F.col("state") == "APPROVED").alias("approved"), F.bool_or(F.lower("body").contains("nack")).alias("nacked"))
    days = D.days_between(D.parse(F.col("created")), D.parse(F.col("merged_at")))
    p = case(spark, "changes").filter(F.col("merged") | (F.col("state") == "closed")).join(r, "number", "left").select(is_team(F.col("author")).alias("team"), F.when(F.col("merged"), "merged").otherwise("rejected").alias("outcome"), F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(c, F.lit(False)).cast("int").alias(c) for c in ("approved", "nacked")], days.alias("days"))
    return p.groupBy("team", "outcome").agg(F.count("*").alias("changes"), r6(F.avg("n")).alias("mean_reviews"), r6(F.avg("approved")).alias("approval_rate"), r6(F.avg("nacked")).alias("nack_rate"), r6(F.avg(F.when(F.col("days") >= 0, F.col("days")))).alias("mean_days"))


@query("escalation", given("changes", "reviews") + f""", r AS (SELECT number, count(*) AS n, bool_or(contains(lower(body), 'nack')) AS nacked, min(TRY_CAST(ts AS TIMESTAMP)) AS first FROM reviews GROUP BY number),
p AS (SELECT CASE WHEN coalesce(n, 0) <= 1 THEN 'low' WHEN n <= 4 THEN 'medium' ELSE 'high' END AS reviews, coalesce(lower(author), '') IN ({_TEAM}) AS team, files, coalesce(nacked, false) AS nacked, {_sql_any("lower(coalesce(body, ''))", ['funding', 'grant', 'sponsor'])} AS funded, date_diff('second', TRY_CAST(created AS TIMESTAMP), first) / 3600.0 AS hours FROM changes LEFT JOIN r USING (number))
SELECT reviews, count(*) AS changes, round(avg(CAST(team AS INTEGER)), 6) AS team_rate, round(avg(files), 6) AS mean_files, round(avg(CAST(nacked AS INTEGER)), 6) AS nack_rate, round(avg(CAST(funded AS INTEGER)), 6) AS funding_rate, round(coalesce(avg(hours) FILTER (WHERE hours >= 0), 0), 4) AS mean_hours FROM p GROUP BY reviews""")
def escalation(spark, d):
    """What goes with few, some and many reviews (QRY17)."""
    r = case(spark, "reviews").groupBy("number").agg(F.count("*").alias("n"), F.bool_or(F.lower("body").contains("nack")).alias("nacked"), F.min(D.parse(F.col("ts"))).alias("first"))
    n = F.coalesce("n", F.lit(0))
    hours = D.hours_between(D.parse(F.col("created")), F.col("first"))
    p = case(spark, "changes").join(r, "number", "left").select(F.when(n <= 1, "low").when(n <= 4, "medium").otherwise("high").alias("reviews"), is_team(F.col("author")).cast("int").alias("team"), "files", F.coalesce("nacked", F.lit(False)).cast("int").alias("nacked"), T.lowered(F.col("body"), lambda b: T.contains_any(b, ["funding", "grant", "sponsor"])).cast("int").alias("funded"), hours.alias("hours"))
    return p.groupBy("reviews").agg(F.count("*").alias("changes"), r6(F.avg("team")).alias("team_rate"), r6(F.avg("files")).alias("mean_files"), r6(F.avg("nacked")).alias("nack_rate"), r6(F.avg("funded")).alias("funding_rate"), F.round(F.coalesce(F.avg(F.when(F.col("hours") >= 0, F.col("hours"))), F.lit(0.0)), 4).alias("mean_hours"))


@query("nack_by_status", given("changes", "reviews", "comments") + f", n AS (SELECT number, author FROM comments WHERE contains(lower(coalesce(body, '')), 'nack') UNION ALL SELECT number, author FROM reviews WHERE contains(lower(coalesce(body, '')), 'nack')) SELECT coalesce(lower(n.author), '') IN ({_TEAM}) AS team, count(*) AS nacks, count(*) FILTER (WHERE state = 'closed' AND NOT merged) AS kills, round(CAST(count(*) FILTER (WHERE state = 'closed' AND NOT merged) AS DOUBLE) / count(*), 6) AS kill_rate FROM n JOIN changes USING (number) GROUP BY 1")
def nack_by_status(spark, d):
    """How often a maintainer's objection ends a change, and others' (QRY42, CLS34)."""
    said = case(spark, "comments").select("number", "author", "body").unionByName(case(spark, "reviews").select("number", "author", "body")).filter(F.lower("body").contains("nack"))
    j = said.join(case(spark, "changes").select("number", "state", "merged"), "number").select(is_team(F.col("author")).alias("team"), C.rejected(F.col("state"), F.col("merged")).alias("k"))
    return j.groupBy("team").agg(F.count("*").alias("nacks"), F.count_if("k").alias("kills"), r6(C.rate(F.col("k"))).alias("kill_rate"))


_MOOD = f"CASE WHEN {_sql_any('lower(r.body)', K.REVIEW_POSITIVE)} THEN 'positive' WHEN {_sql_any('lower(r.body)', K.REVIEW_NEGATIVE)} THEN 'negative' ELSE 'neutral' END"


@query("sentiment_by_outcome", given("changes", "reviews") + f", s AS (SELECT CASE WHEN merged THEN 'merged' ELSE 'closed' END AS outcome, {_MOOD} AS sentiment FROM reviews r JOIN changes USING (number)), c AS (SELECT outcome, sentiment, count(*) AS n FROM s GROUP BY 1, 2) SELECT outcome, sentiment, n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY outcome), 6) AS rate FROM c")
def sentiment_by_outcome(spark, d):
    """Sentiment of reviews of merged and of other changes (QRY65)."""
    s = case(spark, "reviews").select("number", C.review_class(F.col("state"), F.col("body"))["sentiment"].alias("sentiment")).join(case(spark, "changes").select("number", F.when(F.col("merged"), "merged").otherwise("closed").alias("outcome")), "number")
    c = s.groupBy("outcome", "sentiment").agg(F.count("*").alias("n"))
    return c.withColumn("rate", r6(F.col("n") / F.sum("n").over(Window.partitionBy("outcome"))))
