"""Audits of prose, limits and reports on small fixtures."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyhall.operators import audit as A
from tallyhall.operators import classify as C


def test_wording(spark):
    df = spark.createDataFrame([("a", "It is likely so.\nplain\n**Note** maybe"), ("b", "many\nsome people")], "f string, t string")
    assert [(r.f, r.line_number) for r in A.speculative(df, "f", "t").collect()] == [("a", 1)]
    got = {(r.f, r.pattern): r.context for r in A.vague(df, "f", "t").collect()}
    assert set(got) == {("b", r"\bmany\b"), ("b", r"\bsome\b")} and got["b", r"\bmany\b"].startswith("many")


def test_conflicts_and_links(spark):
    df = spark.createDataFrame([("a", "rate 10% [x](m.md)"), ("b", "rate 12% [y](https://z) [z](gone.md)")], "f string, t string")
    r = A.conflicting_values(df, "f", "t", {"rate": r"rate (\d+)%", "none": r"none (\d+)"}).collect()
    assert [(x.metric, x.n_values, x.n_documents) for x in r] == [("rate", 2, 2)]
    files = spark.createDataFrame([("m.md",)], "p string")
    assert [x.target for x in A.broken_links(df, "f", "t", files, "p").collect()] == ["gone.md"]


def test_limit(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t + dt.timedelta(seconds=s),) for s in (0, 1, 2, 100)], "ts timestamp")
    assert sorted(r.in_window for r in A.admitted(df, "ts", 2, 10).collect()) == [1, 1, 2, 3]


def test_reports_and_coverage(spark):
    df = spark.createDataFrame([('{"metadata": {"name": "x"}, "data": {}}', ["a.cpp", "b.h"], ["a.cpp"], ["see src/b.h"])], "j string, f array<string>, c array<string>, b array<string>")
    r = df.select(A.report_errors(F.col("j"), ["name", "version"], []).alias("e"), A.coverage(F.col("f"), F.col("c"), F.col("b")).alias("v")).first()
    assert r.e == ["metadata.version"] and (r.v.total_files, r.v.reviewed_files, r.v.files_coverage) == (2, 1, 0.5)


def test_classes(spark):
    df = spark.createDataFrame([("Concern: NACK, strongly oppose",)], "t string")
    r = df.select(C.state_of_mind(F.col("t")).alias("s"), C.nack_type(F.col("t")).alias("n"), C.shift_type(F.lit("som5"), F.lit("som2")).alias("m"), C.domain(F.lit("src/wallet/x.cpp")).alias("d"), C.gini_words(F.lit(0.85)).alias("g")).first()
    assert (r.s, r.n, r.m, r.d, r.g) == ("som5", "general", "more_supportive", "wallet", "Very high concentration")
