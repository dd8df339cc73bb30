"""Monitoring values of events by going through sorted lists, also for one key with all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators.monitoring import Series, pointing, values_at


def plain(rows, t, mode, tolerance=None, period=2 * math.pi):
    at = {}
    for u, v in rows:
        if u is not None and v is not None and not math.isnan(v):
            at[u] = max(v, at.get(u, -math.inf))
    if t is None:
        return None
    before = max((u for u in at if u <= t), default=None)
    after = min((u for u in at if u > t), default=None)
    reach = math.inf if tolerance is None else tolerance
    b_ok, a_ok = before is not None and t - before <= reach, after is not None and after - t <= reach
    if mode == "previous":
        return at[before] if b_ok else None
    closer = before if after is None or before is not None and t - before <= after - t else after
    nearest = at[closer] if closer is not None and abs(closer - t) <= reach else None
    if mode == "nearest":
        return nearest
    if before == t:
        out = at[before]
    elif before is not None and after is not None:
        step = at[after] - at[before]
        if mode == "angle":
            step = (step + period / 2) % period - period / 2
        out = at[before] + (t - before) / (after - before) * step if b_ok and a_ok else None
    else:
        out = nearest if tolerance is not None else None
    return out if out is None or mode != "angle" else out % period


CASES = {"p": ("previous", None), "pt": ("previous", 7.0), "n": ("nearest", None), "nt": ("nearest", 5.0), "l": ("linear", None), "lt": ("linear", 9.0), "a": ("angle", None), "at": ("angle", 30.0)}


@pytest.mark.parametrize("bucket", [3.0, 50.0, 1e9])
def test_against_lists(spark, bucket):
    rng = random.Random(int(bucket))
    time = lambda: rng.choice([round(rng.uniform(-50, 300), 1), float(rng.randint(0, 200))])
    data = {n: [(k, time(), rng.choice([rng.uniform(0, 6.28), None, math.nan] if rng.random() < 0.1 else [rng.uniform(0, 6.28)])) for k in (1, 1, 1, 2) for _ in range(15)] for n in CASES}
    data["p"] += [(None, 3.0, 1.0), (1, None, 2.0), (1, 5.0, 1.0), (1, 5.0, 4.0)]
    asked = [(i, rng.choice([1, 1, 2, 3, None]), time() if i % 17 else None, "kept") for i in range(150)] + [(7, 1, 5.0, "twice")] * 2
    frames = {n: spark.createDataFrame([(*r, 9) for r in rows], "k int, u double, v double, other int") for n, rows in data.items()}
    e = spark.createDataFrame(asked, "i int, k int, time double, l string")
    out = values_at(e, ["k"], "time", {n: Series(frames[n], "v", "u", *CASES[n]) for n in CASES}, bucket)
    got = out.collect()
    assert sorted(out.columns) == sorted({"i", "k", "time", *CASES}) and len(got) == len(asked)
    for r in got:
        for n in CASES:
            want = None if r.k is None else plain([(u, v) for k, u, v in data[n] if k == r.k], r.time, *CASES[n])
            assert (r[n] is None) == (want is None) and (want is None or r[n] == pytest.approx(want, abs=1e-9)), (r, n, want)


def test_one_key_runs_in_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        s = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 3.0).alias("time"), F.sin(F.col("id") / 100.0).alias("v"))
        e = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 2.9 + 0.7).alias("time"))
        out = values_at(e, ["k"], "time", {"x": Series(s, "v")}, bucket=500.0).withColumn("task", F.spark_partition_id())
        assert out.select("task").distinct().count() > 4
        whole = values_at(e, ["k"], "time", {"x": Series(s, "v")}, bucket=1e12)
        a, b = ({r.time: r.x for r in d.collect()} for d in (out, whole))
        assert a == b and len(a) == 20_000 and all(v is not None for v in a.values())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pointing_falls_back(spark):
    alt = spark.createDataFrame([(1, 0.0, 1.2), (1, 10.0, 1.3), (2, 0.0, 1.0)], "tel_id int, time double, alt double")
    az = spark.createDataFrame([(1, 0.0, 6.2), (1, 10.0, 0.1), (2, 0.0, None)], "tel_id int, time double, az double")
    constant = spark.createDataFrame([(5, 2, 1.1, 0.4), (5, 2, 1.1, 0.4), (5, 3, None, 0.4)], "obs_id int, tel_id int, altitude double, azimuth double")
    e = spark.createDataFrame([(5, 1, 5.0), (5, 1, 11.0), (5, 2, 0.0), (5, 3, 0.0), (6, 2, 0.0), (5, 1, None)], "obs_id int, tel_id int, time double")
    got = {(r.obs_id, r.tel_id, r.time): (r.pointing_source, r.altitude, r.azimuth) for r in pointing(e, ["tel_id"], "time", Series(alt, "alt"), Series(az, "az", mode="angle"), constant, ["obs_id", "tel_id"]).collect()}
    source, a, z = got[5, 1, 5.0]
    assert source == "monitoring" and a == pytest.approx(1.25) and z == pytest.approx((6.2 + (0.1 + 2 * math.pi - 6.2) / 2) % (2 * math.pi))
    assert got[5, 1, 11.0] == (None, None, None) and got[5, 2, 0.0] == ("constant", 1.1, 0.4) and got[5, 3, 0.0] == (None, None, None) and got[6, 2, 0.0] == (None, None, None) and got[5, 1, None] == (None, None, None)
    tolerant = pointing(e, ["tel_id"], "time", Series(alt, "alt", tolerance=2.0), Series(az, "az", mode="angle", tolerance=2.0)).where("time = 11").first()
    assert tolerant.pointing_source == "monitoring" and tolerant.altitude == 1.3
    assert pointing(e.limit(0), ["tel_id"], "time", Series(alt, "alt"), Series(az, "az", mode="angle")).count() == 0
