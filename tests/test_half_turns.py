"""Angles half a circle apart, whose difference rounds to just below it: the queries turn the way their SQL does."""

import datetime

import duckdb
import pytest

from eventloom.plans import catalogue, grid_queries  # noqa: F401

DAY = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """For each user errors at 0 and 4 hours with values 50 apart, a click after one hour, and views around it."""
    at = lambda h: DAY + datetime.timedelta(hours=h)
    pairs = [(v, round(v - 50, 2)) for v in (50 + 0.37 * i for i in range(400)) for v in [round(v, 2)]]
    assert any(-1e-12 < b - a + 50 < 0 for a, b in pairs)
    events = []
    for u, (a, b) in enumerate(pairs):
        events += [(u, "error", at(0), a), (u, "error", at(4), b), (u, "view", at(0), 10.0), (u, "view", at(2), 20.0), (u, "click", at(1), 0.0)]
    events = [(i, ts, u, kind, v) for i, (u, kind, ts, v) in enumerate(events)]
    d = str(tmp_path_factory.mktemp("turns"))
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{d}/events.parquet")
    spark.createDataFrame([(1, 2.0, 3)], "c_custkey long, c_acctbal double, c_nationkey int").coalesce(1).write.parquet(f"{d}/customer.parquet")
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in ("events", "customer"):
        con.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet/*.parquet')")
    return d, con


def test_pointing(spark, tables, same):
    d, con = tables
    same(catalogue.queries()["event_pointing"](spark, d), con, catalogue.oracle_sql()["event_pointing"])


def test_values(spark, tables, same):
    d, con = tables
    same(catalogue.queries()["monitoring_values"](spark, d), con, catalogue.oracle_sql()["monitoring_values"])
