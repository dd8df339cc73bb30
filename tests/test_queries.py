"""Every query of the event engine against its SQL in DuckDB."""

import pytest

from eventloom.plans import catalogue, chain_queries, event_queries, fit_queries, grid_queries, series_queries, store_queries, table_queries, variant_queries  # noqa: F401

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, small, duck, same):
    same(QUERIES[name](spark, small), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, small):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
