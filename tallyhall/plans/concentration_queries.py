"""Who holds how much of an activity: Gini, HHI, top-N shares and levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhall.operators.concentration import concentration
from tallyhall.plans.registry import query, table

_CONCENTRATION_SQL = """
WITH c AS ({counts}),
r AS (SELECT x, row_number() OVER (ORDER BY x, actor) AS i, row_number() OVER (ORDER BY x DESC, actor) AS d FROM c WHERE x > 0),
a AS (SELECT count(*) AS n, sum(x) AS total, sum(i * x) AS weighted, sum(x * x) AS squares,
  sum(CASE WHEN d <= 5 THEN x ELSE 0 END) AS s5, sum(CASE WHEN d <= 10 THEN x ELSE 0 END) AS s10, sum(CASE WHEN d <= 20 THEN x ELSE 0 END) AS s20 FROM r),
m AS (SELECT CAST(n AS BIGINT) AS contributors, CAST(total AS DOUBLE) AS total,
  greatest(0.0, least(1.0, (2.0 * weighted - (n + 1) * CAST(total AS DOUBLE)) / (n * CAST(total AS DOUBLE)))) AS gini,
  CAST(squares AS DOUBLE) / (CAST(total AS DOUBLE) * total) AS hhi, s5 / CAST(total AS DOUBLE) AS top5, s10 / CAST(total AS DOUBLE) AS top10, s20 / CAST(total AS DOUBLE) AS top20 FROM a)
SELECT contributors, total, round(gini, 6) AS gini, round(hhi, 6) AS hhi, round(top5, 6) AS top5_share, round(top10, 6) AS top10_share, round(top20, 6) AS top20_share,
  CASE WHEN gini >= 0.8 OR hhi >= 0.25 OR top5 >= 0.7 THEN 'very_high' WHEN gini >= 0.6 OR hhi >= 0.15 OR top5 >= 0.5 THEN 'high'
       WHEN gini >= 0.4 OR hhi >= 0.10 OR top5 >= 0.35 THEN 'moderate' ELSE 'low' END AS level FROM m
"""


@query("merge_concentration", _CONCENTRATION_SQL.format(counts="SELECT o_custkey AS actor, count(*) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1"))
def merge_concentration(spark, sf_dir):
    """Merge authority: merged proposals per actor (CON1-CON5)."""
    merged = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
    return concentration(merged.groupBy(F.col("o_custkey").alias("actor")).agg(F.count("*").alias("x")))


@query("review_concentration", _CONCENTRATION_SQL.format(counts="SELECT l_suppkey AS actor, count(*) AS x FROM lineitem GROUP BY 1"))
def review_concentration(spark, sf_dir):
    """Review influence: review rows per reviewer."""
    reviews = table(spark, sf_dir, "lineitem")
    return concentration(reviews.groupBy(F.col("l_suppkey").alias("actor")).agg(F.count("*").alias("x")))
