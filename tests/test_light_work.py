"""The light of rings costs what its pixels cost: shared values once, orders of one small file over many tasks."""

from pyspark.sql import functions as F

from eventloom.functions import muon, special
from eventloom.plans import table_queries


def test_arguments_are_written_once(spark):
    a, b, m, s = (F.col(f"place_{c}") for c in "abms")
    share = str(special.normal_between(a, b, m, s))
    assert [share.count(f"place_{c}") for c in "abms"] == [1, 1, 2, 2]
    ring = [F.col(f"ring_{i}") for i in range(6)]
    light = str(muon.pixel_light([0.0, 0.01], [0.0, 0.01], *ring, 0.005, 12.0, 2.0))
    assert all(light.count(f"ring_{i}") <= 2 for i in range(6))


def test_one_file_is_many_tasks(spark, small):
    light = table_queries.muon_pixel_light(spark, small)
    assert light.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
