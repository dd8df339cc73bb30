"""Queries of the event engine that must not leave out rows or gather them on the driver."""

from eventloom.plans import catalogue, event_queries, series_queries  # noqa: F401

QUERIES = catalogue.queries()


def test_ml_classify_scores_every_type(spark, small):
    d = QUERIES["ml_classify"](spark, small)
    rows = spark.read.parquet(f"{small}/lineitem.parquet")
    assert rows.select("l_returnflag").distinct().count() == 3
    assert d.count() == rows.count() and d.where("not gammaness_is_valid or not gammaness between 0 and 1").count() == 0


def test_stream_time_chunk_reads_files(spark, small):
    d = QUERIES["stream_time_chunk"](spark, small)
    assert d.inputFiles() and all(f.endswith(".parquet") for f in d.inputFiles())
    assert not spark.catalog.tableExists("stream_time_chunk")
    assert d.agg({"n_events": "sum"}).first()[0] == spark.read.parquet(f"{small}/events.parquet").where("value is not null").count()
