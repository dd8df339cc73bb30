"""Queries that write, merge and read through the table store and its loader."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from eventloom.plans.catalogue import query
from eventloom.plans.event_queries import r6, s6
from eventloom.runtime import checkpoint_dir, table
from eventloom.sources.tables import TableLoader, TableStore, merge_stores, with_units

STATUS = {"F": 1, "O": 2, "P": 3}


def new_store(spark: SparkSession) -> TableStore:
    return TableStore(spark, f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")


def order_store(spark: SparkSession, d: str, status: str | None = None) -> TableStore:
    """Orders as array events (prices as scaled integers, states as numbers), lines as telescope events, customers as observations."""
    s = new_store(spark)
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("obs_id"), F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("energy"), F.col("o_orderstatus").alias("state"))
    o = o if status is None else o.where(F.col("state") == status)
    s.write(with_units(o, {"energy": "TeV"}), "events", fixed={"energy": (100.0, 0.0, "uint32")}, enums={"state": STATUS})
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("tel_id"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("energy"))
    s.write(lines.join(o.select("obs_id", "event_id"), "event_id"), "telescopes")
    s.write(table(spark, d, "customer").select(F.col("c_custkey").alias("obs_id"), F.col("c_mktsegment").alias("segment")), "observations")
    return s


@query("store_events", f"SELECT o_custkey AS obs_id, o_orderkey AS event_id, {s6('o_totalprice')} AS energy, o_orderstatus AS state, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def store_events(spark, d):
    """Array events with their observation, through the loader."""
    s = order_store(spark, d)
    e = TableLoader(s).subarray_events(["events"], "observations")
    states = F.create_map(*[F.lit(x) for k, v in STATUS.items() for x in (v, k)])
    return e.select("obs_id", "event_id", r6(F.col("energy")).alias("energy"), F.element_at(states, F.col("state").cast("int")).alias("state"), "segment")


@query("store_telescopes", f"""SELECT o_custkey AS obs_id, l_orderkey AS event_id, l_suppkey AS tel_id, l_linenumber AS line, {s6('l_extendedprice')} AS energy_mono, {s6('o_totalprice')} AS energy
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN (1, 2, 4, 5, 7, 8, 10, 11, 13, 14, 16, 17, 19, 20)""")
def store_telescopes(spark, d):
    """Telescope events of some observations with their array event, through the loader."""
    s = order_store(spark, d)
    load = TableLoader(s)
    t = load.telescope_events(["telescopes"], load.subarray_events(["events"]).drop("state"))
    t = load.of_observations(t, [1, 2, 4, 5, 7, 8, 10, 11, 13, 14, 16, 17, 19, 20])
    return t.select("obs_id", "event_id", "tel_id", "line", r6(F.col("energy_mono")).alias("energy_mono"), r6(F.col("energy")).alias("energy"))


@query("store_merge", f"SELECT o_custkey AS obs_id, o_orderkey AS event_id, {s6('o_totalprice')} AS energy, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS state, (SELECT count(*) FROM customer) AS observations FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 100000 AND o_totalprice < 300000")
def store_merge(spark, d):
    """Stores of two states merged into one, and read with a condition."""
    to = new_store(spark)
    merge_stores(to, [order_store(spark, d, "F"), order_store(spark, d, "O")], once=["observations"], required=["events", "telescopes"])
    n = to.read("observations").count()
    e = to.read("events").where("energy > 100000 and energy < 300000")
    return e.select("obs_id", "event_id", r6(F.col("energy")).alias("energy"), F.col("state").cast("int").alias("state"), F.lit(n).cast("long").alias("observations"))


@query("store_chunks", f"SELECT i // 4000 AS chunk, count(*) AS n, min(event_id) AS first, max(event_id) AS last, {s6('sum(value)')} AS total FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events) GROUP BY 1")
def store_chunks(spark, d):
    """The series in pieces of 4,000 rows by time."""
    s = new_store(spark)
    s.write(table(spark, d, "events").select("event_id", "ts", "value"), "series")
    rows = TableLoader(s).numbered(s.read("series"), 4000, ["ts", "event_id"])
    return rows.groupBy("chunk").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"), r6(F.sum("value")).alias("total"))
