"""Monitoring values for events: several series looked up in one pass over the time axis, however long the history of one key.

Rows of all series and the events are dealt by key and bucket of time. Each bucket hands its first and last values on: a table of one row a bucket
carries them forwards and backwards, so that inside a bucket a window sees what lies before and after it. One key with all rows
is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("previous", "nearest", "linear", "angle")


@dataclass(frozen=True)
class Series:
    """A table of values over time, and how a value between its rows is told.

    previous: the last row at or before; nearest: the closer one, the earlier of two as close; linear: the line between both neighbours; angle: the same the short
    way round a circle of `period`; angles lie from 0 to `period`, either end where rounding leaves it open. tolerance (seconds): how far the rows that are used may be at most; at the ends of linear and angle series a value
    within the tolerance is that of the only neighbour, without a tolerance there is none (strict).
    """

    rows: DataFrame
    value: str
    time: str = "time"
    mode: str = "linear"
    tolerance: float | None = None
    period: float = 2 * math.pi

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError("mode must be one of " + ", ".join(MODES))


def _seconds(time: Column, kind: str) -> Column:
    return F.unix_micros(time.cast("timestamp")) / 1e6 if kind.startswith(("timestamp", "date")) else time.cast("double")


def _wrapped(x: Column, period: float) -> Column:
    """x less its whole periods. Unlike pmod it does not turn a rounding below 0 into 0: that would send half a circle the other way round."""
    turned = x - period * F.floor(x / period)
    return F.when(F.abs(x) < 1e15 * period, turned).otherwise(F.pmod(x, F.lit(period)))


def _between(s: Series, t: Column, before: Column, after: Column) -> Column:
    """The value at t from the neighbours struct(t, v); before may be at t itself."""
    back, ahead = t - before["t"], after["t"] - t
    reach = F.lit(s.tolerance if s.tolerance is not None else math.inf)
    near_b, near_a = F.coalesce(back <= reach, F.lit(False)), F.coalesce(ahead <= reach, F.lit(False))
    if s.mode == "previous":
        return F.when(near_b, before["v"])
    earlier = F.coalesce(back <= ahead, after.isNull())
    nearest = F.when(earlier & near_b, before["v"]).when(~earlier & near_a, after["v"])
    if s.mode == "nearest":
        return nearest
    share = F.when(after["t"] > before["t"], back / (after["t"] - before["t"]))
    step = after["v"] - before["v"]
    if s.mode == "angle":
        step = _wrapped(step + s.period / 2, s.period) - s.period / 2
    value = F.when(back == 0, before["v"]).when(before.isNotNull() & after.isNotNull() & near_b & near_a, before["v"] + share * step)
    if s.tolerance is not None:
        value = F.when(before.isNotNull() & after.isNotNull(), value).otherwise(nearest)
    return _wrapped(value, s.period) if s.mode == "angle" else value


def values_at(events: DataFrame, by: Sequence[str], time: str, series: Mapping[str, Series], bucket: float = 3600.0) -> DataFrame:
    """events with a column for each series: its value at the event's time, for equal keys; null without one.

    `bucket`: seconds of one task's share of a key. Times are timestamps or numbers of seconds. Rows of a series with a null or NaN value, time or key are left out; of rows with
    one time the largest value counts. Events with a null time or key get nulls; equal events a row each; empty tables are as if there were none. A column of events
    with a series' name is replaced; names that start with `__` are taken.
    """
    by, names = list(by), list(series)
    kind = dict(events.dtypes)[time]
    e = events.drop(*[n for n in names if n in events.columns])
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*by, time]])
    t = _seconds(F.col(time), kind)
    place = lambda c: F.floor(c / bucket).cast("long")
    point = "struct<t:double,v:double>"
    none = lambda: [F.lit(None).cast(point).alias(f"__s{i}") for i in range(len(names))]
    asked = e.where(known).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)], t.alias("__t"), F.struct(*e.columns).alias("__e"), *none())
    rows = asked
    for i, n in enumerate(names):
        s = series[n]
        st = _seconds(F.col(s.time), dict(s.rows.dtypes)[s.time])
        v = F.col(s.value).cast("double")
        good = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*by, s.time]]) & v.isNotNull() & ~F.isnan(v)
        # of equal times the largest value; rows of a series hold their own point, so that sorting by time is enough
        r = s.rows.where(good).groupBy(*by, st.alias("__t")).agg(F.max(v).alias("__v"))
        own = [F.struct(F.col("__t").alias("t"), F.col("__v").alias("v")).cast(point).alias(f"__s{j}") if i == j else F.lit(None).cast(point).alias(f"__s{j}") for j in range(len(names))]
        rows = rows.unionByName(r.select(*[F.col(k).alias(f"__k{j}") for j, k in enumerate(by)], "__t", F.lit(None).cast(asked.schema["__e"].dataType).alias("__e"), *own))
    keys = [f"__k{i}" for i in range(len(by))]
    rows = rows.withColumn("__b", place(F.col("__t"))).repartition(*keys, "__b")
    points = [f"__s{i}" for i in range(len(names))]
    # what buckets carry to others: one row a bucket
    ends = rows.groupBy(*keys, "__b").agg(*[F.max(p).alias(f"{p}l") for p in points], *[F.min(p).alias(f"{p}f") for p in points])
    past = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy(*keys).orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "__b", *[F.last(f"{p}l", True).over(past).alias(f"{p}p") for p in points], *[F.last(f"{p}f", True).over(future).alias(f"{p}n") for p in points])
    # a row of a series comes before an event of its time
    up = Window.partitionBy(*keys, "__b").orderBy("__t", F.col("__e").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, "__b").orderBy(F.col("__t").desc(), F.col("__e").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.select(*keys, "__b", "__t", "__e", *[F.last(p, True).over(up).alias(f"{p}b") for p in points], *[F.last(p, True).over(down).alias(f"{p}a") for p in points])
    seen = seen.where("__e is not null").join(carried, [*keys, "__b"])
    out = []
    for n, p in zip(names, points, strict=True):
        before = F.coalesce(F.col(f"{p}b"), F.col(f"{p}p"))
        after = F.coalesce(F.when(F.col(f"{p}a.t") > F.col("__t"), F.col(f"{p}a")), F.col(f"{p}n"))
        out.append(_between(series[n], F.col("__t"), before, after).alias(n))
    found = seen.select("__e.*", *out)
    return found.unionByName(e.where(~F.coalesce(known, F.lit(False))), allowMissingColumns=True)


def pointing(events: DataFrame, by: Sequence[str], time: str, altitude: Series, azimuth: Series, constant: DataFrame | None = None, constant_by: Sequence[str] = (), bucket: float = 3600.0) -> DataFrame:
    """events with altitude, azimuth and pointing_source: from the monitored series, else the constant pointing of the observation, else null.

    Both angles come from one source: `monitoring` where both series have a value, then `constant` (columns constant_by, altitude, azimuth; of several
    rows the first by value), else null.
    """
    d = values_at(events, by, time, {"__alt": altitude, "__az": azimuth}, bucket)
    alt, az, source = F.col("__alt"), F.col("__az"), F.when(F.col("__alt").isNotNull() & F.col("__az").isNotNull(), "monitoring")
    if constant is not None:
        one = constant.groupBy(*constant_by).agg(F.min(F.struct(F.col("altitude").cast("double").alias("a"), F.col("azimuth").cast("double").alias("z"))).alias("__c"))
        one = one.select(*[F.col(k).alias(f"__c{i}") for i, k in enumerate(constant_by)], "__c")
        d = d.join(one, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__c{i}") for i, k in enumerate(constant_by)]), "left")
        source = F.coalesce(source, F.when(F.col("__c.a").isNotNull() & F.col("__c.z").isNotNull(), "constant"))
        alt, az = (F.when(source == "monitoring", m).when(source == "constant", c) for m, c in ((alt, F.col("__c.a")), (az, F.col("__c.z"))))
    else:
        alt, az = F.when(source.isNotNull(), alt), F.when(source.isNotNull(), az)
    d = d.withColumn("pointing_source", source).withColumns({"altitude": alt, "azimuth": az})
    return d.drop(*[c for c in d.columns if c.startswith("__")])
