"""Document quality rules as a short-circuit cascade of native expressions.

The counts are columns that every row gets. The verdict asks rule after rule
and stops at the first that rejects; rules stand in descending order of
rejections per second, both measured on a sample. The order changes how long
the verdict takes, never what it is. All expressions are built-in functions:
no Python runs on the executors.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhall.llm.common import discard, documents, stash, tuned

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
MIN_WORDS = 50
#: Rows of the sample that costs and selectivities are estimated on.
SAMPLE_ROWS = 1000


@dataclass(frozen=True)
class Rule:
    """``spark`` rejects a row; ``sql`` says the same over the oracle's columns."""

    name: str
    spark: str
    sql: str


_RULES = [
    Rule("mean_word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("symbols_per_word", "10 * n_symbols > n_words", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * n_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("capitals", f"2 * (length(_text) - length(translate(_text, '{UPPER}', ''))) > word_chars", f"2 * (length(t) - length(translate(t, '{UPPER}', ''))) > word_chars"),
    Rule("digits", f"10 * (length(_text) - length(translate(_text, '{DIGITS}', ''))) > 3 * word_chars", f"10 * (length(t) - length(translate(t, '{DIGITS}', ''))) > 3 * word_chars"),
    Rule("ellipsis_lines", "10 * size(filter(_lines, l -> l rlike '(\\\\.\\\\.\\\\.|…)[ \\\\t\\\\r]*$')) > 3 * n_lines", "10 * len(list_filter(lines, lambda l: regexp_matches(l, '(\\.\\.\\.|…)[ \\t\\r]*$'))) > 3 * n_lines"),
    Rule("bullet_lines", "10 * size(filter(_lines, l -> l rlike '^[ \\\\t]*[-*•]')) > 9 * n_lines", "10 * len(list_filter(lines, lambda l: regexp_matches(l, '^[ \\t]*[-*•]'))) > 9 * n_lines"),
]


def rules() -> list[Rule]:
    return list(_RULES)


def counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts (and the working columns ``_text``, ``_lines``) to every row.

    Null texts are empty. A window is known by the 64-bit hash of its three
    words; windows are compared only within a text, by sorting.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = df.withColumn("_text", text)
    trimmed = F.btrim("_text", F.lit(WHITE))
    d = d.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+")))
    d = d.withColumn("_lines", F.expr("filter(split(_text, '\\n'), l -> l rlike '[^ \\\\t-\\\\r]')"))
    n = F.size("_words")
    word = F.col("_words")
    hashes = F.when(n > 2, F.transform(F.slice("_words", F.lit(1), n - 2), lambda w, i: F.xxhash64(w, F.get(word, i + 1), F.get(word, i + 2))))
    d = d.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.translate("_text", WHITE, "")).cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hashes": hashes,
        }
    )
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    # (hash, place) sorted; a window repeats if a neighbour has its hash.
    d = d.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    m = F.size("_sorted")
    ties = F.zip_with(F.slice("_sorted", F.lit(1), m - 1), F.slice("_sorted", F.lit(2), m - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    d = d.withColumn("_at", F.when(F.col("_sorted").isNotNull(), F.array_distinct(F.sort_array(F.flatten(F.filter(ties, lambda x: x.isNotNull()))))))
    k = F.size("_at")
    steps = F.zip_with(F.slice("_at", F.lit(1), k - 1), F.slice("_at", F.lit(2), k - 1), lambda a, b: F.least(F.lit(3), b - a))
    covered = F.aggregate(steps, F.lit(3), lambda s, x: s + x)
    repeated = F.coalesce(F.when(F.col("_at").isNotNull(), covered), F.lit(0)).cast("long")
    # A filter on these columns must not be pushed below them, where each would be computed anew
    # for every reference: a row number, which base_failed() reads, holds it above.
    return d.withColumns({"n_repeat_words": repeated, "_place": F.monotonically_increasing_id()}).drop("_words", "_hashes", "_sorted", "_at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")) | (F.col("_place") < 0)


def order_by_gain(counted: DataFrame, asked: list[Rule], sample_rows: int = SAMPLE_ROWS, repeats: int = 10) -> list[Rule]:
    """Rules by rejections per second on a sample of the rows that reach the cascade.

    A rule is asked ``repeats`` times of every row, and the time of a job that
    asks nothing is taken off, so its cost isn't that of starting a job.
    """
    sample = stash(counted.filter(~base_failed()).limit(sample_rows), "rules")
    n = sample.count()
    many = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def asked_of_all(rule: str) -> tuple[int, float]:
        began = time.perf_counter()
        hits = many.agg(F.count_if(F.expr(rule))).first()[0]
        return hits / repeats, time.perf_counter() - began

    asked_of_all(asked[0].spark)  # warms up
    idle = min(asked_of_all("_again < 0")[1] for _ in range(2))
    gains = []
    for k, rule in enumerate(asked):
        rejected, took = asked_of_all(rule.spark)
        gains.append(((rejected / max(n, 1)) / max(took - idle, 1e-4), -k, rule))
    discard(sample)
    return [rule for _, _, rule in sorted(gains, key=lambda g: g[:2], reverse=True)]


def verdict(ordered: list[Rule]) -> Column:
    """False at the first rule that rejects; later rules aren't evaluated for that row."""
    out = F.when(base_failed(), F.lit(False))
    for rule in ordered:
        out = out.when(F.expr(rule.spark), F.lit(False))
    return out.otherwise(F.lit(True))


def judge(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` for every row.

    Null and empty texts have no words and fail the base. An empty table keeps
    the given order of rules. Columns of the input other than ``doc_id`` and
    the text are dropped, so none can clash. Repeated rows are judged alike.
    """
    tuned(df.sparkSession)
    src = df.select(F.col("doc_id"), F.col(text_col).alias("text"))
    few = src.sample(min(1.0, 2.0 * SAMPLE_ROWS / max(1, src.count())), seed=11)
    ordered = order_by_gain(counts(few), rules())
    counted = counts(src)
    return counted.withColumns({"base_failed": base_failed(), "kept": verdict(ordered)}).drop("text", "_text", "_lines", "_place")


def keep(df: DataFrame) -> DataFrame:
    """The rows whose text passes every rule, with the input's columns."""
    tuned(df.sparkSession)
    few = df.select("doc_id", "text").sample(min(1.0, 2.0 * SAMPLE_ROWS / max(1, df.count())), seed=11)
    ordered = order_by_gain(counts(few), rules())
    packed = df.select(F.struct(*df.columns).alias("_row"), F.col("text").alias("text"))
    return counts(packed).filter(verdict(ordered)).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_W = "[\\x20\\x09-\\x0D]+"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '{_W}'), lambda x: x <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
p AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
c AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM p) GROUP BY r),
f AS (SELECT w.r, doc_id, t, lines, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_W}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c ON c.r = w.r),
b AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed {"".join(f" OR ({r.sql})" for r in _RULES)}) AS kept FROM b
"""
