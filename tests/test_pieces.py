"""Pieces of a series as groups of one pass."""

from pyspark.sql import functions as F

from eventloom.plans import catalogue, store_queries
from eventloom.sources.tables import TableLoader


def test_numbers_are_those_of_the_pieces(spark):
    load = TableLoader(store_queries.new_store(spark))
    rows = spark.range(25).select(F.col("id"), (F.col("id") * 7 % 25).alias("t"), (F.col("id") % 2).alias("k")).repartition(5)
    want = {(start // 4, r.id) for start, _, p in load.chunked(rows, 4, ["k", "t"]) for r in p.collect()}
    got = load.numbered(rows, 4, ["k", "t"])
    assert {(r.chunk, r.id) for r in got.collect()} == want and set(got.columns) == {*rows.columns, "chunk"}
    assert load.numbered(rows.limit(0), 4, ["t"]).count() == 0


def test_plan_does_not_grow_with_the_series(spark, tmp_path, same):
    import duckdb

    d = str(tmp_path)
    e = spark.range(9001).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 37 % 4001).cast("timestamp_ntz").alias("ts"), (F.col("id") % 101 / 4).alias("value"))
    e.coalesce(1).write.parquet(f"{d}/events.parquet")
    got = catalogue.queries()["store_chunks"](spark, d)
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{d}/events.parquet/*.parquet')")
    same(got, con, catalogue.oracle_sql()["store_chunks"])
