"""Text cleaning, extraction, themes and message classes over documents, threads and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyhall.functions import keywords as K
from tallyhall.functions import text as T
from tallyhall.functions.numbers import r6, ratio
from tallyhall.operators import classify as C
from tallyhall.operators import windows as W
from tallyhall.plans.registry import query, spread, table

_WS = "[ \\t\\n\\r\\x0B\\f]+"


def _sql_any(column: str, keywords: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(column, k.replace("'", "''")) for k in dict.fromkeys(keywords)) + ")"


def _sql_hits(column: str, keywords: list[str]) -> str:
    return "(" + " + ".join("CAST(contains({}, '{}') AS INTEGER)".format(column, k.replace("'", "''")) for k in keywords) + ")"


def _docs(spark, d):
    return spread(table(spark, d, "documents"))


def _talk(spark, d):
    return table(spark, d, "conversations")


@query("text_cleaning", "SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\\s\\x{00A0}\\x{0085}]+', ' ', 'g'), '[\\x00-\\x08\\x0B-\\x0C\\x0E-\\x1F]', '', 'g')) AS cleaned FROM documents")
def text_cleaning(spark, d):
    """White space and control characters (STR1, FIL1-FIL6)."""
    return _docs(spark, d).select("doc_id", T.clean(F.col("text")).alias("cleaned"))


@query("text_features", "SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, CAST(len(list_filter(regexp_split_to_array(trim(text, ' '), '\\s+'), lambda x: x <> '')) AS INTEGER) AS words, CAST(length(text) - length(replace(text, '?', '')) AS BIGINT) AS questions, substring(text, 1, 100) AS preview FROM documents")
def text_features(spark, d):
    """Lengths, words, question marks, preview (STR2-STR4)."""
    t = F.col("text")
    return _docs(spark, d).select("doc_id", F.length(t).alias("chars"), T.word_count(t).alias("words"), T.count_of(t, "?").alias("questions"), F.substring(t, 1, 100).alias("preview"))


@query("review_depth", """WITH c AS (SELECT conv_id, turn, trim(text) AS t FROM conversations) SELECT conv_id, turn, CAST(length(t) AS INTEGER) AS body_length, CAST(len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) AS INTEGER) AS word_count,
CAST(len(regexp_extract_all(t, '(?i)L\\d+|line \\d+|file:|\\.(cpp|h|py|rs)')) AS INTEGER) AS code_references, CAST(length(t) - length(replace(t, '?', '')) AS BIGINT) AS question_count, """ + _sql_hits("lower(t)", K.SUGGESTION) + " AS suggestion_count FROM c")
def review_depth(spark, d):
    """Depth of each message read as a review (CLS15, STR5)."""
    c = _talk(spark, d).select("conv_id", "turn", C.review_depth(F.col("text"), F.array().cast("array<string>")).alias("d"))
    return c.select("conv_id", "turn", "d.body_length", "d.word_count", "d.code_references", "d.question_count", "d.suggestion_count")


@query("code_references", "SELECT doc_id, CAST(len(regexp_extract_all(text, '#\\d+')) AS INTEGER) AS numbers, CAST(len(regexp_extract_all(text, 'https?://[^ \\n]+')) AS INTEGER) AS addresses FROM documents")
def code_references(spark, d):
    """Counts of references and addresses (STR6)."""
    t = F.col("text")
    return _docs(spark, d).select("doc_id", F.regexp_count(t, F.lit(r"#\d+")).alias("numbers"), F.regexp_count(t, F.lit(r"https?://[^ \n]+")).alias("addresses"))


@query("mention_extraction", "SELECT doc_id, lower(m) AS mention, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '@([\\w.-]+)', 1)) AS m FROM documents) GROUP BY 1, 2")
def mention_extraction(spark, d):
    """Names after '@' (STR11, GRA13)."""
    return _docs(spark, d).select("doc_id", F.explode(T.mentions(F.col("text"))).alias("mention")).groupBy("doc_id", "mention").agg(F.count("*").alias("n"))


@query("link_extraction", "SELECT page_id, u AS url, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS u FROM pages) GROUP BY 1, 2")
def link_extraction(spark, d):
    """Addresses of links (STR10, TXT7)."""
    return table(spark, d, "pages").select("page_id", F.explode(T.links(F.col("html"))).alias("url")).groupBy("page_id", "url").agg(F.count("*").alias("n"))


@query("issue_links", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '#(\\d+)', 1), lambda x: CAST(x AS BIGINT)))), ',') AS links FROM documents WHERE regexp_matches(text, '#\\d+')")
def issue_links(spark, d):
    """Numbers that a text refers to (STR9, JOIN7, JOIN8, JOIN14)."""
    return _docs(spark, d).filter(F.col("text").rlike(r"#\d+")).select("doc_id", F.array_join(T.issue_links(F.col("text")).cast("array<string>"), ",").alias("links"))


@query("email_parts", "SELECT doc_id, lower(regexp_extract(text, '([\\w.+-]+)@', 1)) AS local_part FROM documents WHERE contains(text, '@')")
def email_parts(spark, d):
    """Local part of the first address (STR12, STR13)."""
    t = F.col("text")
    return _docs(spark, d).filter(t.contains("@")).select("doc_id", F.lower(F.regexp_extract(t, r"([\w.+-]+)@", 1)).alias("local_part"))


@query("quoted_text_split", "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*>'))) AS INTEGER) AS quoted, CAST(len(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\\s*>'))) AS INTEGER) AS own FROM documents")
def quoted_text_split(spark, d):
    """Quoted and own lines (STR15, STR16)."""
    lines = F.split("text", "\n")
    return _docs(spark, d).select("doc_id", F.size(F.filter(lines, lambda x: x.rlike(r"^\s*>"))).alias("quoted"), F.size(F.filter(lines, lambda x: ~x.rlike(r"^\s*>"))).alias("own"))


@query("html_strip", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS stripped FROM pages")
def html_strip(spark, d):
    """Pages without tags (STR21)."""
    return table(spark, d, "pages").select("page_id", T.strip_tags(F.col("html")).alias("stripped"))


@query("html_title", "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def html_title(spark, d):
    """Titles of pages (SRC10, SRC11)."""
    return table(spark, d, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


_THEME_ROWS = " UNION ALL ".join(f"SELECT source, '{n}' AS theme, count(*) FILTER (WHERE {_sql_any('t', ks)}) AS documents FROM d GROUP BY 1" for n, ks in K.THEMES.items())


@query("keyword_themes", f"WITH d AS (SELECT source, lower(text) AS t FROM documents) SELECT * FROM ({_THEME_ROWS}) WHERE documents > 0")
def keyword_themes(spark, d):
    """Documents per source and theme (FIL14, QRY66): one scan, then a count of exploded names."""
    return _docs(spark, d).select("source", F.explode(C.themes(F.col("text"))).alias("theme")).groupBy("source", "theme").agg(F.count("*").alias("documents"))


@query("dominant_theme", f"WITH d AS (SELECT source, lower(text) AS t FROM documents), c AS ({_THEME_ROWS}), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY documents DESC, theme) AS rank FROM c WHERE documents > 0) SELECT source, theme, documents, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def dominant_theme(spark, d):
    """Five leading themes of every source (WIN17)."""
    return W.top_per_group(keyword_themes(spark, d), ["source"], [F.desc("documents"), "theme"], 5)


@query("theme_word_hits", "SELECT lang, CAST(sum(len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}\\p{M}_]+'), lambda x: x IN ('open', 'in', 'de')))) AS BIGINT) AS hits FROM documents GROUP BY 1")
def theme_word_hits(spark, d):
    """Whole-word hits (FIL15, STR8)."""
    return _docs(spark, d).groupBy("lang").agg(F.sum(T.word_hits(F.lower("text"), ["open", "in", "de"])).alias("hits"))


@query("toxicity_by_source", f"WITH d AS (SELECT source, lower(text) AS t FROM documents), s AS (SELECT source, {_sql_hits('t', K.NEGATIVE)} + {_sql_hits('t', K.HARSH)} - {_sql_hits('t', K.POLITE)} AS s FROM d) SELECT source, round(avg(s), 6) AS mean_score, max(s) AS most FROM s GROUP BY 1")
def toxicity_by_source(spark, d):
    """Keyword toxicity (CLS20, QRY28-QRY30)."""
    return _docs(spark, d).select("source", C.toxicity_score(F.col("text")).alias("s")).groupBy("source").agg(r6(F.avg("s")).alias("mean_score"), F.max("s").alias("most"))


_MOOD = f"CASE WHEN {_sql_hits('t', K.CHANNEL_POSITIVE)} > {_sql_hits('t', K.CHANNEL_NEGATIVE)} THEN 'positive' WHEN {_sql_hits('t', K.CHANNEL_NEGATIVE)} > {_sql_hits('t', K.CHANNEL_POSITIVE)} THEN 'negative' ELSE 'neutral' END"


@query("channel_sentiment", f"WITH d AS (SELECT role, lower(text) AS t FROM conversations) SELECT role, {_MOOD} AS sentiment, count(*) AS n FROM d GROUP BY 1, 2")
def channel_sentiment(spark, d):
    """Sentiment of messages (CLS21, QRY58)."""
    return _talk(spark, d).groupBy("role", C.channel_sentiment(F.col("text")).alias("sentiment")).agg(F.count("*").alias("n"))


_SOM = {k: _sql_hits("t", ks) for k, ks in K.STATE_OF_MIND.items()}
_SOM_SQL = f"CASE WHEN greatest({', '.join(_SOM.values())}) = 0 THEN NULL " + " ".join(f"WHEN {s} = greatest({', '.join(_SOM.values())}) THEN '{k}'" for k, s in _SOM.items()) + " END"


@query("state_of_mind", f"WITH d AS (SELECT role, lower(text) AS t FROM conversations) SELECT role, {_SOM_SQL} AS som, count(*) AS n FROM d GROUP BY 1, 2")
def state_of_mind(spark, d):
    """State-of-mind class of messages (CLS22, QRY49)."""
    return _talk(spark, d).groupBy("role", C.state_of_mind(F.col("text")).alias("som")).agg(F.count("*").alias("n"))


_REASONS = " UNION ALL ".join(f"SELECT '{n}' AS reason, count(*) AS n FROM d WHERE {_sql_any('t', ks)} HAVING count(*) > 0" for n, ks in K.REJECTION.items())


@query("rejection_reasons", f"WITH d AS (SELECT lower(text) AS t FROM documents) {_REASONS}")
def rejection_reasons(spark, d):
    """Reasons named in texts (CLS29, QRY92)."""
    return _docs(spark, d).select(F.explode(C.rejection_reasons(F.col("text"))).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_TOPICS = " UNION ALL ".join(f"SELECT '{n}' AS topic, count(*) AS n FROM d WHERE {_sql_any('t', ks)} HAVING count(*) > 0" for n, ks in K.TOPICS.items())


@query("review_topics", f"WITH d AS (SELECT lower(text) AS t FROM conversations) {_TOPICS}")
def review_topics(spark, d):
    """Topics of messages (CLS16)."""
    return _talk(spark, d).select(F.explode(C.topics(F.col("text"))).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


_PRESSURE = {f"{k}_{g}": ks for k, gs in K.PRESSURE.items() for g, ks in gs.items()}
_KINDS = {k: [x for ks in gs.values() for x in ks] for k, gs in K.PRESSURE.items()}


@query("pressure_summary", f"""WITH d AS (SELECT source, lower(text) AS t FROM documents), s AS (SELECT source, {' + '.join(_sql_hits('t', ks) for ks in _PRESSURE.values())} AS score, {_sql_any('t', _KINDS['regulatory'])} AS a, {_sql_any('t', _KINDS['corporate'])} AS b, {_sql_any('t', _KINDS['threat'])} AS c FROM d)
SELECT source, count(*) AS total, count(*) FILTER (WHERE a OR b OR c) AS with_pressure, count(*) FILTER (WHERE a) AS regulatory, count(*) FILTER (WHERE b) AS corporate, count(*) FILTER (WHERE c) AS threat, CAST(sum(score) AS BIGINT) AS score FROM s GROUP BY 1""")
def pressure_summary(spark, d):
    """Outside pressure by source (CLS25, AGG31, QRY85)."""
    p = _docs(spark, d).select("source", C.pressure(F.col("text")).alias("p"))

    def kind(k):
        return F.count_if(F.array_contains("p.types", k)).alias(k)

    return p.groupBy("source").agg(F.count("*").alias("total"), F.count_if("p.has_pressure").alias("with_pressure"), kind("regulatory"), kind("corporate"), kind("threat"), F.sum("p.score").alias("score"))


_FUNDS = " UNION ALL ".join("SELECT '{}' AS kind, count(*) AS n FROM d WHERE regexp_matches(t, '{}') HAVING count(*) > 0".format(k, p) for k, p in {**K.FUNDING, "preposition": r"\b(of|de|der)\b"}.items())


@query("funding_types", f"WITH d AS (SELECT lower(text) AS t FROM documents) {_FUNDS}")
def funding_types(spark, d):
    """Kinds of funding named in texts, with a control word class (CLS26-CLS28, QRY88-QRY89)."""
    low = F.lower("text")
    kinds = F.concat(C.funding_types(F.col("text")), F.when(low.rlike(r"\b(of|de|der)\b"), F.array(F.lit("preposition"))).otherwise(F.array().cast("array<string>")))
    return _docs(spark, d).select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


_DOMAIN_SQL = "CASE " + " ".join(f"WHEN {_sql_any('lower(url)', ks)} THEN '{n}'" for n, ks in K.DOMAINS.items()) + " END"


@query("domain_expertise", f"SELECT {_DOMAIN_SQL} AS domain, count(*) AS n FROM pages GROUP BY 1")
def domain_expertise(spark, d):
    """First matching domain of a path (MAP1, QRY10)."""
    return table(spark, d, "pages").groupBy(C.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@query("review_scores", """WITH c AS (SELECT role, trim(text) AS t FROM conversations), s AS (SELECT role, CASE WHEN role = 'assistant' THEN CASE WHEN length(t) > 50 THEN 1.0 WHEN length(t) > 10 THEN 0.8 WHEN length(t) > 0 THEN 0.7 ELSE 0.5 END ELSE CASE WHEN length(t) > 0 THEN 0.5 ELSE 0.3 END END AS f,
CASE WHEN length(t) > 100 THEN 0.5 WHEN length(t) > 20 THEN 0.4 WHEN regexp_matches(t, '(?i)[a-f0-9]{7,40}') THEN 0.3 ELSE 0.2 END AS a FROM c)
SELECT role, round(CAST(avg(f) AS DOUBLE), 6) AS formal, round(CAST(avg(a) AS DOUBLE), 6) AS ack FROM s GROUP BY 1""")
def review_scores(spark, d):
    """Formal and acknowledgement scores (CLS7, CLS8)."""
    state = F.when(F.col("role") == "assistant", "APPROVED").otherwise("COMMENTED")
    s = _talk(spark, d).select("role", C.formal_score(state, F.col("text")).alias("f"), C.ack_score(F.col("text")).alias("a"))
    return s.groupBy("role").agg(r6(F.avg("f")).alias("formal"), r6(F.avg("a")).alias("ack"))


@query("ack_detector", "SELECT role, count(*) FILTER (WHERE regexp_matches(text, '(?im)(^|\\s)(ack|the)(\\s|$|[,:])')) AS n FROM conversations GROUP BY 1")
def ack_detector(spark, d):
    """Lines that acknowledge, with a control word (STR7)."""
    return _talk(spark, d).groupBy("role").agg(F.count_if(F.col("text").rlike(T.ACK.replace("ack", "(ack|the)"))).alias("n"))


@query("quality_categories", "WITH s AS (SELECT l_orderkey, sum(CASE l_returnflag WHEN 'R' THEN 0.3 WHEN 'A' THEN 0.5 ELSE 0.1 END) AS s FROM lineitem GROUP BY 1), r AS (SELECT round(CAST(s AS DOUBLE), 4) AS s FROM s) SELECT CASE WHEN s = 0 THEN 'none' WHEN s < 0.3 THEN 'minimal' WHEN s < 0.5 THEN 'low' WHEN s < 1.0 THEN 'medium' WHEN s < 2.0 THEN 'high' ELSE 'very_high' END AS category, count(*) AS n FROM r GROUP BY 1")
def quality_categories(spark, d):
    """Categories of summed review scores (CLS9, CLS11, CLS12)."""
    f = F.col("l_returnflag")
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.when(f == "R", 0.3).when(f == "A", 0.5).otherwise(0.1)), 4).alias("s"))
    return s.groupBy(C.quality_category(F.col("s")).alias("category")).agg(F.count("*").alias("n"))


@query("message_ids", "SELECT conv_id, turn, concat_ws(':', role, CAST(turn AS VARCHAR), substring(md5(text), 1, 8)) AS message_id FROM conversations")
def message_ids(spark, d):
    """Stable short ids (STR18, STR19)."""
    return _talk(spark, d).select("conv_id", "turn", T.short_id(F.col("role"), F.col("turn").cast("string"), body=F.col("text")).alias("message_id"))


@query("checksums", "SELECT doc_id, sha256(text) AS digest FROM documents")
def checksums(spark, d):
    """SHA-256 of every text (STR20, DQ11)."""
    return _docs(spark, d).select("doc_id", F.sha2(F.col("text"), 256).alias("digest"))


@query("context_window", "SELECT doc_id, CASE WHEN strpos(text, 'token') > 0 THEN substring(text, CAST(greatest(1, strpos(text, 'token') - 100) AS BIGINT), 200) ELSE substring(text, 1, 200) END AS context FROM documents")
def context_window(spark, d):
    """Text around the first match (STR17, TXT3)."""
    return _docs(spark, d).select("doc_id", T.context(F.col("text"), "token").alias("context"))


@query("repeated_sections", "SELECT substring(text, 1, 60) AS section, count(*) AS n FROM documents WHERE length(text) >= 60 GROUP BY 1 HAVING count(*) > 1")
def repeated_sections(spark, d):
    """Openings that several documents share (TXT4)."""
    return _docs(spark, d).filter(F.length("text") >= 60).groupBy(F.substring("text", 1, 60).alias("section")).agg(F.count("*").alias("n")).filter("n > 1")


@query("repeated_words", "SELECT doc_id, CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1] AND length(w[i]) > 3)) AS BIGINT) AS n FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def repeated_words(spark, d):
    """Equal neighbours of more than three letters (TXT5); neighbours are zipped, so no row is exploded."""
    w = F.split("text", " ")
    pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: (a == b) & (F.length(a) > 3))
    return _docs(spark, d).select("doc_id", F.size(F.filter(pairs, lambda x: x)).cast("long").alias("n"))


@query("platform_patterns", "SELECT role AS platform, count(DISTINCT conv_id) AS threads, count(*) AS messages, round(avg(length(text)), 6) AS mean_length FROM conversations GROUP BY 1")
def platform_patterns(spark, d):
    """Participation by channel (QRY55, QRY56)."""
    return _talk(spark, d).groupBy(F.col("role").alias("platform")).agg(F.countDistinct("conv_id").alias("threads"), F.count("*").alias("messages"), r6(F.avg(F.length("text"))).alias("mean_length"))


@query("funding_correlation", f"WITH d AS (SELECT doc_id, {_sql_any('lower(text)', ['worthless', 'token', 'license'])} AS flag FROM documents) SELECT flag, count(*) AS n, round(avg(quality), 6) AS quality FROM d JOIN labels USING (doc_id) GROUP BY 1")
def funding_correlation(spark, d):
    """Outcome of documents with and without some words (QRY60-QRY63, QRY90)."""
    flag = T.contains_any(F.lower("text"), ["worthless", "token", "license"]).alias("flag")
    return _docs(spark, d).select("doc_id", flag).join(table(spark, d, "labels"), "doc_id").groupBy("flag").agg(F.count("*").alias("n"), r6(F.avg("quality")).alias("quality"))


@query("mention_outcome", "WITH m AS (SELECT DISTINCT doc_id FROM documents WHERE regexp_matches(text, '#\\d+')) SELECT m.doc_id IS NOT NULL AS mentioned, count(*) AS n, round(avg(toxic), 6) AS rate FROM labels LEFT JOIN m USING (doc_id) GROUP BY 1")
def mention_outcome(spark, d):
    """Outcome of items that are mentioned (JOIN17, JOIN3)."""
    m = _docs(spark, d).filter(F.col("text").rlike(r"#\d+")).select("doc_id", F.lit(True).alias("m")).distinct()
    return table(spark, d, "labels").join(m, "doc_id", "left").groupBy(F.col("m").isNotNull().alias("mentioned")).agg(F.count("*").alias("n"), r6(F.avg("toxic")).alias("rate"))


@query("json_props", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def json_props(spark, d):
    """A field of JSON text (JSN1, JSN2)."""
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@query("response_gaps", """WITH t AS (SELECT conv_id, turn, role, length(text) - length(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS g FROM conversations) SELECT role, count(g) AS n, round(avg(g), 6) AS mean_gap FROM t GROUP BY 1""")
def response_gaps(spark, d):
    """Change from one message to the next (QRY57)."""
    prev = F.lag(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    t = _talk(spark, d).select("role", (F.length("text") - prev).alias("g"))
    return t.groupBy("role").agg(F.count("g").alias("n"), r6(F.avg("g")).alias("mean_gap"))


@query("coordination_signals", "SELECT lang, count(*) AS total, count(*) FILTER (WHERE contains(lower(text), 'license') OR contains(lower(text), 'copyright')) AS mentions, round(count(*) FILTER (WHERE contains(lower(text), 'license') OR contains(lower(text), 'copyright')) / CAST(count(*) AS DOUBLE), 6) AS rate FROM documents GROUP BY 1")
def coordination_signals(spark, d):
    """Share of texts that name a common standard (QRY31-QRY33, QRY40, QRY76, QRY99)."""
    hit = T.contains_any(F.lower("text"), ["license", "copyright"])
    return _docs(spark, d).groupBy("lang").agg(F.count("*").alias("total"), F.count_if(hit).alias("mentions"), r6(ratio(F.count_if(hit), F.count("*"))).alias("rate"))
