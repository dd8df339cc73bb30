"""Chunks of a time series by row count or duration, statistics per chunk and array element, and outlier masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.common import finite

POLICIES = ("overlap", "truncate", "skip")


def size_chunks(df: DataFrame, by: list[str], order: list[str], size: int, shift: int = 0, last: str = "truncate", allow_undersized: bool = True) -> DataFrame:
    """df with chunk (from 0 per key): `size` rows each, starting every `shift` rows (0: every `size`).

    Rows behind the last full chunk form another one (truncate), make one with the rows before them (overlap), or are left
    out (skip). A series shorter than one chunk is a chunk of its own where allowed.
    """
    if last not in POLICIES or size < 1:
        raise ValueError("size must be positive and last one of " + ", ".join(POLICIES))
    step = shift or size
    n = df.groupBy(*by).agg(F.count("*").alias("__n"))
    d = df.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).join(n, by)
    full = F.when(F.col("__n") >= size, F.floor((F.col("__n") - size) / step) + 1).otherwise(0)
    d = d.withColumn("__k", full.cast("long"))
    lo = F.greatest(F.ceil((F.col("__i") - size + 1) / step), F.lit(0))
    hi = F.least(F.floor(F.col("__i") / step), F.col("__k") - 1)
    ids = F.when(lo <= hi, F.sequence(lo.cast("long"), hi.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    end = F.when(F.col("__k") > 0, (F.col("__k") - 1) * step + size).otherwise(0)
    left = (F.col("__n") > end) & (F.lit(allow_undersized) | (F.col("__k") > 0))
    extra = F.lit(False)
    if last == "truncate":
        extra = left & (F.col("__i") >= F.when(F.col("__k") > 0, F.col("__k") * step).otherwise(0))
    elif last == "overlap":
        extra = left & (F.col("__i") >= F.col("__n") - size)
    ids = F.when(extra, F.concat(ids, F.array("__k"))).otherwise(ids)
    return d.withColumn("chunk", F.explode(ids)).drop("__i", "__n", "__k")


def time_chunks(df: DataFrame, by: list[str], time: str, duration: float, shift: float = 0.0, last: str = "skip") -> DataFrame:
    """df with chunk: windows of `duration` seconds from the key's first time on, every `shift` seconds, closed at both ends.

    A row at a border is in both chunks. `last`: what becomes of the rest behind the windows, as for size_chunks.
    """
    if last not in POLICIES or duration <= 0:
        raise ValueError("duration must be positive and last one of " + ", ".join(POLICIES))
    step = shift or duration
    t = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    span = df.groupBy(*by).agg(F.min(t).alias("__t0"), F.max(t).alias("__t1"))
    d = df.withColumn("__t", t).join(span, by).withColumn("__x", F.col("__t") - F.col("__t0")).withColumn("__all", F.col("__t1") - F.col("__t0"))
    n = F.greatest(F.ceil((F.col("__all") - duration) / step), F.lit(0))
    d = d.withColumn("__k", n.cast("long"))
    lo = F.greatest(F.ceil((F.col("__x") - duration) / step), F.lit(0))
    hi = F.least(F.floor(F.col("__x") / step), F.col("__k") - 1)
    ids = F.when(lo <= hi, F.sequence(lo.cast("long"), hi.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    if last != "skip":
        start = F.col("__k") * step if last == "truncate" else F.greatest(F.col("__all") - duration, F.lit(0.0))
        ids = F.when(F.col("__x") >= start, F.concat(ids, F.array("__k"))).otherwise(ids)
    return d.withColumn("chunk", F.explode(ids)).drop("__t", "__t0", "__t1", "__x", "__all", "__k")


def chunk_bounds(time: str, event: str) -> list[Column]:
    """Aggregates: first and last time and event id of a chunk."""
    key = F.struct(time, event)
    return [F.min(time).alias("time_start"), F.max(time).alias("time_end"), F.min_by(event, key).alias("event_id_start"), F.max_by(event, key).alias("event_id_end")]


def plain_statistics(value: str) -> list[Column]:
    """Aggregates over the finite numbers: n_events, mean, median, std (population)."""
    x = F.when(finite(F.col(value).cast("double")), F.col(value).cast("double"))
    return [F.count(x).alias("n_events"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_pop(x).alias("std")]


def plain(df: DataFrame, keys: list[str], value: str, *more: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*more, *plain_statistics(value))


def sigma_clip(df: DataFrame, keys: list[str], value: str, max_sigma: float = 4.0, iterations: int = 5) -> DataFrame:
    """The rows that stay after clipping around the mean of their group, `iterations` times.

    All rounds run over one partitioning by keys: one shuffle whatever the number of rounds.
    """
    w = Window.partitionBy(*keys)
    d = df.where(finite(F.col(value).cast("double")))
    for _ in range(iterations):
        d = d.withColumns({"__m": F.avg(value).over(w), "__s": F.stddev_pop(value).over(w)})
        d = d.where(F.abs(F.col(value) - F.col("__m")) <= max_sigma * F.col("__s")).drop("__m", "__s")
    return d


def elements(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per array element: keys, pos, x."""
    return df.select(*keys, F.posexplode(value).alias("pos", "x"))


def elementwise(df: DataFrame, keys: list[str], value: str, max_sigma: float | None = None, iterations: int = 5) -> DataFrame:
    """Statistics of each array position per group, packed into arrays again; with max_sigma, after clipping."""
    e = elements(df, keys, value)
    if max_sigma is not None:
        e = sigma_clip(e, [*keys, "pos"], "x", max_sigma, iterations)
    s = plain(e, [*keys, "pos"], "x")
    packed = s.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "n_events", "mean", "median", "std"))).alias("s"))
    return packed.select(*keys, *[F.col(f"s.{c}").alias(c) for c in ("n_events", "mean", "median", "std")])


def histogram(df: DataFrame, keys: list[str], value: str, edges: list[float], flow: bool = False) -> DataFrame:
    """keys, bin, count: every bin of every group, empty ones as 0. Bins are half-open; with flow, -1 and n are what is below and above."""
    n = len(edges) - 1
    at = F.lit(-1)
    for i, e in enumerate(edges):
        at = F.when(F.col(value) >= e, F.lit(i)).otherwise(at)
    binned = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).withColumn("bin", at)
    if not flow:
        binned = binned.where((F.col("bin") >= 0) & (F.col("bin") < n))
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("count"))
    got = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("m"))
    groups = df.select(*keys).distinct().join(got, keys, "left")
    lo, hi = (-1, n) if flow else (0, n - 1)
    return groups.select(*keys, F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("bin"), "m").select(*keys, "bin", F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0)).cast("long").alias("count"))


def range_outlier(x: Column, low: float, high: float) -> Column:
    return (x < low) | (x > high)


def median_outlier(df: DataFrame, keys: list[str], x: str, low: float, high: float, name: str = "outlier") -> DataFrame:
    """Flag where x is under low or over high times the group's median away from it."""
    m = F.median(x).over(Window.partitionBy(*keys))
    d = F.col(x) - m
    return df.withColumn(name, (d < low * m) | (d > high * m))


def std_outlier(df: DataFrame, keys: list[str], x: str, low: float, high: float, name: str = "outlier") -> DataFrame:
    """Flag where x is further from the group's median than low or high standard deviations."""
    w = Window.partitionBy(*keys)
    d, s = F.col(x) - F.median(x).over(w), F.stddev_pop(x).over(w)
    return df.withColumn(name, (d < low * s) | (d > high * s))


def valid_chunks(df: DataFrame, keys: list[str], outlier: str, most: float = 0.1) -> DataFrame:
    """keys, faulty (share of outliers), is_valid (share below `most`)."""
    return df.groupBy(*keys).agg(F.avg(F.col(outlier).cast("int")).alias("faulty")).withColumn("is_valid", F.col("faulty") < most)


def second_pass(df: DataFrame, by: list[str], order: list[str], value: str, faulty: DataFrame, size: int, shift: int, last: str = "overlap") -> DataFrame:
    """by, faulty (number of a first-pass chunk of `size` rows), chunk: statistics of shifted chunks around each faulty chunk by itself.

    A faulty chunk is covered from its start, or from that of the chunk before if that is sound, to the end of the chunk after it, both ends moved
    inwards by one shift (the end by one row less; the last row is out where the series ends before). Stretches of no more than `size` rows are left
    out; others are cut every `shift` rows, and what remains is treated as `last` says. Every stretch is bounded, whatever the length of the series. Faulty chunks are
    counted once; those beyond the series give nothing.
    """
    if not 0 < shift < size:
        raise ValueError("the shift must be between 0 and the size")
    bad = faulty.select(*by, F.col("chunk").cast("long").alias("faulty")).where("faulty is not null").distinct()
    before = F.coalesce(F.lag("faulty").over(Window.partitionBy(*by).orderBy("faulty")) == F.col("faulty") - 1, F.lit(False))
    bad = bad.withColumn("__from", F.greatest(F.when(before, F.col("faulty")).otherwise(F.col("faulty") - 1), F.lit(0)) * size + shift)
    n = df.groupBy(*by).agg(F.count("*").alias("__n"))
    rows = df.withColumn("__i", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long")).join(n, by)
    chunk = F.floor(F.col("__i") / size)
    rows = rows.withColumn("faulty", F.explode(F.array(chunk - 1, chunk, chunk + 1))).join(bad, [*by, "faulty"])
    end = F.least(F.col("__n") - 1, (F.col("faulty") + 2) * size) - (shift - 1)
    part = rows.where((F.col("__i") >= F.col("__from")) & (F.col("__i") < end) & (end - F.col("__from") > size)).drop("__i", "__n", "__from")
    return plain(size_chunks(part, [*by, "faulty"], order, size, shift, last), [*by, "faulty", "chunk"], value)
