"""The table store: codecs, appending, merging, reading in pieces."""

import pytest
from pyspark.sql import functions as F

from eventloom.operators.relational import CannotMerge
from eventloom.sources.tables import TableLoader, TableStore, merge_stores, unit_of, with_units


@pytest.fixture
def events(spark):
    return spark.createDataFrame([(o, e, o + e / 100, "a" if e % 2 else "b") for o in (1, 2) for e in range(50)], "obs_id long, event_id long, energy double, kind string")


def store(spark, tmp_path, name):
    return TableStore(spark, f"file://{tmp_path}/{name}")


def test_write_append_read(spark, tmp_path, events):
    s = store(spark, tmp_path, "one")
    assert s.nodes() == [] and not s.exists("r1/events")
    s.write(with_units(events, {"energy": "TeV"}), "r1/events", fixed={"energy": (100.0, 0.0)}, enums={"kind": {"a": 1, "b": 2}}, meta={"by": "test"})
    assert s.nodes() == ["r1/events"] and s.exists("r1/events") and s.meta("r1/events")["by"] == "test"
    s.append(events.withColumn("obs_id", F.lit(7)).select("kind", "energy", "event_id", "obs_id"), "r1/events")
    got = s.read("r1/events", condition="(energy > 1.2) & (obs_id == 7)", decode_enums=True)
    assert {(r.event_id, round(r.energy, 9), r.kind) for r in s.read("r1/events", decode_enums=True).where("obs_id = 7").collect()} == {(r.event_id, round(r.energy, 9), r.kind) for r in events.collect()}
    assert unit_of(s.read("r1/events"), "energy") == "TeV" and got.columns == events.columns
    assert {(r.obs_id, r.event_id) for r in got.collect()} == {(7, r.event_id) for r in events.collect() if r.energy > 1.2}
    with pytest.raises(CannotMerge, match="columns differ"):
        s.append(events.drop("kind"), "r1/events")
    s.append(events.limit(0), "r1/events")
    assert s.read("r1/events").count() == 200


def test_pieces_and_observations(spark, tmp_path, events):
    s = store(spark, tmp_path, "two")
    s.write(events, "events")
    load = TableLoader(s)
    pieces = [(a, b, [(r.obs_id, r.event_id) for r in p.orderBy("obs_id", "event_id").collect()]) for a, b, p in load.chunked(load.subarray_events(["events", "not there"], "nor there"), 30, ["obs_id", "event_id"])]
    assert [(a, b) for a, b, _ in pieces] == [(0, 30), (30, 60), (60, 90), (90, 100)]
    assert [k for *_, p in pieces for k in p] == [(o, e) for o in (1, 2) for e in range(50)]
    assert load.of_observations(s.read("events"), [2, 9]).select("obs_id").distinct().collect() == [(2,)]
    assert list(load.chunked(events.limit(0), 5, ["event_id"])) == []
    with pytest.raises(ValueError, match="no scheduling"):
        load.information("scheduling")
    with pytest.raises(ValueError):
        next(load.chunked(events, 0, ["event_id"]))


def test_merge(spark, tmp_path, events):
    a, b, to = (store(spark, tmp_path, n) for n in ("a", "b", "to"))
    array = spark.createDataFrame([(1, "x"), (2, "y")], "tel_id int, name string")
    for s, o in ((a, 1), (b, 2)):
        s.write(events.where(F.col("obs_id") == o).withColumn("extra", F.lit(o)), "events")
        s.write(array, "array")
    b.write(events, "only b")
    assert merge_stores(to, [a, b], once=["array"], required=["events"], drop={"events": ["extra"]}, events="events") == ["array", "events", "only b"]
    assert to.read("events").count() == 100 and to.read("array").count() == 2 and "extra" not in to.read("events").columns
    with pytest.raises(CannotMerge, match="both"):
        merge_stores(to, [a], once=["array"], drop={"events": ["extra"]}, events="events")
    with pytest.raises(CannotMerge, match="has no shower"):
        merge_stores(to, [a], required=["shower"])
    other = store(spark, tmp_path, "other")
    other.write(array.limit(1), "array")
    with pytest.raises(CannotMerge, match="differ"):
        merge_stores(to, [other], once=["array"])
