"""The angle of an image's axis in shower_geometry is that of its SQL to the last bit."""

import duckdb
from pyspark.sql import functions as F

from eventloom.plans import chain_queries


def test_angles_are_those_of_the_sql(spark):
    rows = [(line, k / 100) for line in range(1, 8) for k in range(11)]
    got = spark.createDataFrame(rows, "line int, discount double").select("line", "discount", chain_queries._psi(F.col("line"), F.col("discount")).alias("psi")).collect()
    sql = "SELECT line, discount, line * 0.7 + discount * 15 FROM (SELECT unnest(range(1, 8))::INT AS line) CROSS JOIN (SELECT unnest(range(11)) / 100 AS discount)"
    want = {(a, b): c for a, b, c in duckdb.connect().execute(sql).fetchall()}
    assert {(r.line, r.discount): r.psi for r in got} == want
