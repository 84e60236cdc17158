"""Checks of prose and of stored reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Wording that a report should avoid.
SPECULATIVE = [
    r"\b(likely|probably|perhaps|maybe|might|could|possibly|seems|appears|suggests|indicates)\b",
    r"\b(if|assuming|suppose|presumably|presume)\b",
    r"\b(would|should|may|can)\s+(be|have|mean|indicate|suggest)",
]
VAGUE = [r"\bmany\b", r"\bfew\b", r"\bseveral\b", r"\bsome\b", r"\ba lot\b", r"\ba few\b"]
QUALIFIED = ["```", "**Note**", "**Limitation**"]


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_number, line`` of every line."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).select(key, (F.col("pos") + 1).alias("line_number"), "line")


def speculative(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines with speculative wording and how often; qualified lines are left out."""
    hits = F.lit(0)
    for p in SPECULATIVE:
        hits = hits + F.regexp_count("line", F.lit("(?i)" + p))
    qualified = F.lit(False)
    for q in QUALIFIED:
        qualified = qualified | F.col("line").contains(q)
    return lines(docs, key, text).withColumn("hits", hits).filter((F.col("hits") > 0) & ~qualified)


def vague(docs: DataFrame, key: str, text: str, patterns: list[str] | None = None, width: int = 30) -> DataFrame:
    """One row per vague quantifier with its surroundings."""

    def hits(p: str) -> Column:
        around = F.regexp_extract_all(text, F.lit(f"(?is)(.{{0,{width}}})({p})(.{{0,{width}}})"), 0)
        return F.transform(around, lambda x: F.struct(F.lit(p).alias("pattern"), F.trim(F.replace(x, F.lit("\n"), F.lit(" "))).alias("context")))

    found = [hits(p) for p in patterns or VAGUE]
    return docs.select(key, F.explode(F.concat(*found)).alias("v")).select(key, "v.pattern", "v.context")


def conflicting_values(docs: DataFrame, key: str, text: str, metrics: dict[str, str]) -> DataFrame:
    """Metrics for which documents state more than one value. metrics: name -> pattern with one group."""

    def values(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda v: F.struct(F.lit(name).alias("metric"), v.alias("value")))

    rows = F.concat(*[values(n, p) for n, p in metrics.items()])
    return docs.select(key, F.explode(rows).alias("m")).groupBy("m.metric").agg(F.countDistinct("m.value").alias("n_values"), F.countDistinct(key).alias("n_documents")).filter("n_values > 1")


def long_sentences(docs: DataFrame, key: str, text: str, words: int = 100) -> DataFrame:
    s = docs.select(key, F.explode(F.split(text, r"[.!?]+\s")).alias("sentence"))
    return s.withColumn("n_words", F.size(F.filter(F.split(F.trim("sentence"), r"\s+"), lambda x: x != ""))).filter(F.col("n_words") > words)


def broken_links(docs: DataFrame, key: str, text: str, files: DataFrame, path: str) -> DataFrame:
    """Relative links of documents to files that aren't listed."""
    links = docs.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(([^)#\s]+)"), 1)).alias("target")).filter(~F.col("target").rlike("^(https?|mailto):"))
    return links.join(files.select(F.col(path).alias("target")).distinct(), "target", "left_anti").select(key, "target")


def report_errors(report: Column, metadata: list[str], data: list[str]) -> Column:
    """Names of required parts that a report (JSON text) lacks."""
    parts = ["metadata", "data", *[f"metadata.{m}" for m in metadata], *[f"data.{x}" for x in data]]
    return F.array_compact(F.array(*[F.when(F.get_json_object(report, f"$.{p}").isNull(), F.lit(p)) for p in parts]))


def coverage(files: Column, comments: Column, bodies: Column) -> Column:
    """struct(total_files, reviewed_files, files_coverage): files with an inline comment or named in a review's text."""
    said = F.flatten(F.transform(bodies, lambda b: F.regexp_extract_all(F.coalesce(b, F.lit("")), F.lit(r"(?i)([\w/]+\.(?:cpp|h|py|rs|md))"), 1)))
    seen = F.filter(files, lambda f: F.array_contains(comments, f) | F.exists(said, lambda s: F.contains(f, s)))
    n, k = F.size(files), F.size(F.array_distinct(seen))
    return F.struct(n.alias("total_files"), k.alias("reviewed_files"), F.when(n > 0, k / n).otherwise(0.0).alias("files_coverage"))


def chat_score(body: Column, is_maintainer: Column, technical: Column, casual: Column) -> Column:
    """Score of a chat message as a review."""
    n = F.length(body)
    return (
        F.when(is_maintainer & technical, F.when(n > 100, 1.0).when(n > 50, 0.8).otherwise(0.7))
        .when(is_maintainer | technical, F.when(n > 50, 0.6).otherwise(0.5))
        .when(casual, 0.3)
        .otherwise(0.2)
    )


def mail_score(body: Column, technical: Column, casual: Column) -> Column:
    """Score of a mail as a review."""
    n = F.length(body)
    return F.when(technical, F.when(n > 200, 1.0).when(n > 100, 0.8).otherwise(0.7)).when(casual, F.when(n > 100, 0.6).otherwise(0.5)).otherwise(0.3)


def admitted(calls: DataFrame, ts: str, most: int, seconds: int, by: list[str] | None = None) -> DataFrame:
    """How many calls each call's trailing window holds, and whether it stays within a limit."""
    w = Window.partitionBy(*(by or [])).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return calls.withColumn("in_window", F.count("*").over(w)).withColumn("within", F.col("in_window") <= most)
