"""Values for a time: last before, nearest, valid interval, linear interpolation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], time: str, right_time: str, values: list[str], tie: list[str]) -> DataFrame:
    """Each left row with the values of the last right row at or before its time, null without one.

    Both sides meet in one sort per key: a union and a running last value instead of a range join. `tie` orders
    right rows of equal time.
    """
    r = right.select(*by, F.col(right_time).alias("__t"), F.struct(F.col(right_time), *[c for c in values if c != right_time]).alias("__v"), F.struct(*tie).alias("__o"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("__l"))
    l = left.select(*by, F.col(time).alias("__t"), F.lit(None).cast(r.schema["__v"].dataType).alias("__v"), F.lit(None).cast(r.schema["__o"].dataType).alias("__o"), F.lit(1).alias("__side"), F.struct("*").alias("__l"))
    w = Window.partitionBy(*by).orderBy("__t", "__side", "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = r.unionByName(l).withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    names = [right_time, *[c for c in values if c != right_time]]
    return d.select("__l.*", *[F.col(f"__v.{c}").alias(f"{c}_asof" if c in left.columns else c) for c in names])


def asof_valid(left: DataFrame, right: DataFrame, by: list[str], time: str, right_time: str, values: list[str], tie: list[str], tolerance: Column, strict: bool = False) -> DataFrame:
    """asof, but a key's first right row also counts for `tolerance` (a number or an interval, as the times are) before its time.

    Left rows before that, or with no right row, have nulls; strict raises an error for them.
    """
    first = right.groupBy(*by).agg(F.min(right_time).alias("__first"))
    r = right.join(first, by).withColumn("__from", F.when(F.col(right_time) == F.col("__first"), F.col(right_time) - tolerance).otherwise(F.col(right_time)))
    out = asof(left, r, by, time, "__from", [right_time, *values], tie)
    if strict:
        out = out.withColumn("__from", F.when(F.col("__from").isNull(), F.raise_error(F.concat(F.lit("no values valid at "), F.col(time).cast("string")))).otherwise(F.col("__from")))
        out = out.where("__from is not null")  # the check must not be pruned with its column
    return out.drop("__from")


def nearest(left: DataFrame, right: DataFrame, by: list[str], time: str, right_time: str, value: str) -> DataFrame:
    """Each left row with the value of the right row nearest in time; the later of two equally near ones."""
    both = right.select(*by, F.col(right_time).alias("__t"), F.struct(F.col(right_time).alias("t"), F.col(value).alias("v")).alias("__v"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("__l"))
    both = both.unionByName(left.select(*by, F.col(time).alias("__t"), F.lit(None).cast(both.schema["__v"].dataType).alias("__v"), F.lit(1).alias("__side"), F.struct("*").alias("__l")))
    back = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    d = both.withColumns({"__b": F.last("__v", ignorenulls=True).over(back), "__a": F.first("__v", ignorenulls=True).over(ahead)}).where("__side = 1")
    s = lambda c: F.unix_micros(c.cast("timestamp"))
    before = s(F.col("__t")) - s(F.col("__b.t"))
    after = s(F.col("__a.t")) - s(F.col("__t"))
    pick = F.when(F.col("__a").isNull() | (before < after), F.col("__b.v")).otherwise(F.col("__a.v"))
    return d.select("__l.*", pick.alias("nearest_value"))


def interval_lookup(left: DataFrame, chunks: DataFrame, by: list[str], time: str, value: str, tolerance: float = 0.0) -> DataFrame:
    """left with `value`: that of the latest chunk that started by the row's time and contains it; array elements that are
    NaN there come from the latest earlier containing chunk that has a number. Null without any.

    chunks has time_start and time_end in seconds as numbers. Both sides meet by key and time bucket, about as wide as chunks are
    on average, so neither a long history of one key nor many rows of it meet in one place. Every row of left is kept once, equal rows and
    nulls in any column included; a null key or time has no value.
    """
    c = chunks.where(F.col("time_start").isNotNull() & F.col("time_end").isNotNull()).select(*by, F.col("time_start").cast("double").alias("__s"), F.col("time_end").cast("double").alias("__e"), F.col(value).alias("__v"))
    first = c.groupBy(*by).agg(F.min("__s").alias("__first"))
    c = c.join(first, by).withColumn("__from", F.when(F.col("__s") == F.col("__first"), F.col("__s") - tolerance).otherwise(F.col("__s")))
    mean, low, high = c.agg(F.avg(F.col("__e") - F.col("__s")), F.min("__from"), F.max("__e")).first()
    width = max((mean or 0.0) + tolerance, ((high or 0.0) - (low or 0.0)) / 1e6, 1e-6)
    bucket = lambda t: F.floor(t / F.lit(width)).cast("long")
    c = c.select(*by, "__s", "__e", "__from", "__v", F.explode(F.sequence(bucket(F.col("__from")), bucket(F.col("__e") + tolerance))).alias("__b"))
    l = left.select(*by, F.col(time).cast("double").alias("__t"), F.struct("*").alias("__l"), F.monotonically_increasing_id().alias("__i"))
    l = l.withColumn("__b", bucket(F.col("__t")))
    inside = (F.col("l.__t") >= F.col("c.__from")) & (F.col("l.__t") <= F.col("c.__e") + tolerance)
    same = [F.col(f"l.{k}") == F.col(f"c.{k}") for k in [*by, "__b"]]
    hit = l.alias("l").join(c.alias("c"), [*same, inside], "left").select("l.__i", "l.__l", F.when(F.col("c.__s").isNotNull(), F.struct("c.__s", "c.__v")).alias("__h"))
    # A time lies in few chunks at once: the list of a row is short.
    hit = hit.groupBy("__i").agg(F.first("__l").alias("__l"), F.reverse(F.array_sort(F.collect_list("__h"))).alias("__h"))
    numbers = F.transform("__h", lambda x: F.transform(x["__v"], lambda v: F.when(~F.isnan(v.cast("double")), v.cast("double"))))
    some = F.aggregate(F.slice(numbers, 2, F.size("__h")), numbers[0], lambda best, v: F.zip_with(best, v, lambda x, y: F.coalesce(x, y)))
    filled = F.transform(some, lambda v: F.coalesce(v, F.lit(math.nan)))
    return hit.select("__l.*", F.when(F.size("__h") > 0, filled).alias(value))


def linear(left: DataFrame, points: DataFrame, by: list[str], time: str, point_time: str, value: str, order: list[str], extrapolate: bool = False) -> DataFrame:
    """left with `value`_at: linear between the points around its time; outside of them NaN, or along the last segment.

    Times are numbers; points of one key have different times.
    """
    w = Window.partitionBy(*by).orderBy(point_time)
    p = points.select(*by, F.col(point_time).alias("__t0"), F.col(value).cast("double").alias("__y0"))
    w = Window.partitionBy(*by).orderBy("__t0")
    p = p.withColumns({"__t1": F.lead("__t0").over(w), "__y1": F.lead("__y0").over(w), "__tp": F.lag("__t0").over(w), "__yp": F.lag("__y0").over(w)})
    d = asof(left, p, by, time, "__t0", ["__y0", "__t1", "__y1", "__tp", "__yp"], ["__t0"])
    t = F.col(time)
    inside = F.col("__y0") + F.try_divide((t - F.col("__t0")) * (F.col("__y1") - F.col("__y0")), F.col("__t1") - F.col("__t0"))
    beyond = F.col("__y0") + F.try_divide((t - F.col("__t0")) * (F.col("__y0") - F.col("__yp")), F.col("__t0") - F.col("__tp"))
    out = F.when(t == F.col("__t0"), F.col("__y0")).when(F.col("__t1").isNotNull(), inside)
    out = out.when(F.col("__t0").isNotNull(), beyond) if extrapolate else out
    return d.withColumn(f"{value}_at", F.coalesce(out, F.lit(math.nan))).drop("__t0", "__y0", "__t1", "__y1", "__tp", "__yp")


def unwrap(df: DataFrame, by: list[str], order: list[str], angle: str, period: float = 2 * math.pi) -> DataFrame:
    """df with `angle`_unwrapped: jumps of more than half a period are taken back."""
    w = Window.partitionBy(*by).orderBy(*order)
    step = F.col(angle) - F.lag(angle).over(w)
    turn = -period * F.round(F.coalesce(step, F.lit(0.0)) / period)
    turn = F.when(F.abs(F.coalesce(step, F.lit(0.0))) > period / 2, turn).otherwise(0.0)
    d = df.withColumn("__turn", turn)
    return d.withColumn(f"{angle}_unwrapped", F.col(angle) + F.sum("__turn").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__turn")


def is_time_in(t: Column, start: Column, end: Column, tolerance: float = 0.0) -> Column:
    return (t >= start - tolerance) & (t <= end + tolerance)
