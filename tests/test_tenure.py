"""Periods against their SQL on rows without a date, with times of day and at one time."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tallyhall.plans import registry

entry.queries()
ORDERS = """SELECT * FROM (VALUES (1, 7, TIMESTAMP '1999-01-01 23:00:00'), (2, 7, TIMESTAMP '1999-07-01 01:00:00'), (3, 7, NULL), (4, 7, TIMESTAMP '2000-12-31 00:00:00'),
(5, 7, TIMESTAMP '2000-12-31 00:00:00'), (6, 7, NULL), (7, 8, TIMESTAMP '2001-05-04 13:00:00'), (8, 8, TIMESTAMP '2000-01-01 00:00:00'), (9, NULL, TIMESTAMP '2001-08-01 05:00:00'),
(10, 9, NULL), (11, 9, TIMESTAMP '1998-03-03 00:00:00'), (12, 9, TIMESTAMP '1999-03-03 00:00:00')) t(o_orderkey, o_custkey, o_orderdate)"""
EVENTS = """SELECT * FROM (VALUES (1, 7, TIMESTAMP '2024-01-01 00:00:00'), (2, 7, TIMESTAMP '2024-01-02 00:00:00'), (3, 7, NULL), (4, 7, TIMESTAMP '2024-01-02 00:00:00')) t(event_id, user_id, ts)"""


@pytest.mark.parametrize("name,table,sql", [("inferred_tenure", "orders", ORDERS), ("activity_sessions", "events", EVENTS)])
def test_periods_match_their_sql(spark, tmp_path, name, table, sql):
    c = duckdb.connect()
    c.sql("SET threads = 1")
    c.sql(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet'")
    c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    want = c.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
