"""Straight lines through points, least squares and least trimmed squares, inside array functions."""

from __future__ import annotations

import random
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.common import finite, let, ratio

_EPS = sys.float_info.epsilon


def points(x: Column, y: Column) -> Column:
    """Arrays x and y as structs (x, y); pairs that are not finite are left out."""
    pairs = F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    return F.filter(pairs, lambda p: finite(p["x"]) & finite(p["y"]))


def _sum(p: Column, f) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda s, v: s + f(v))


def line(p: Column) -> Column:
    """struct(slope, intercept) of least squares through points; nulls for fewer than two places."""
    n = F.size(p)

    def about(m: Column) -> Column:
        xx, xy = _sum(p, lambda v: (v["x"] - m["x"]) * (v["x"] - m["x"])), _sum(p, lambda v: (v["x"] - m["x"]) * (v["y"] - m["y"]))
        slope = xy / F.when(n * xx >= _EPS, xx)
        return let(slope, lambda s: F.struct(s.alias("slope"), (m["y"] - s * m["x"]).alias("intercept")))

    return let(F.struct(ratio(_sum(p, lambda v: v["x"]), n).alias("x"), ratio(_sum(p, lambda v: v["y"]), n).alias("y")), about)


def draws(starts: int, seed: int = 0) -> list[int]:
    """Two random numbers below 2^31 for each start."""
    r = random.Random(seed)
    return [r.getrandbits(31) for _ in range(2 * starts)]


def trimmed_line(p: Column, starts: int = 20, share: float = 0.85, steps: int = 20, eps: float = 1e-12, seed: int = 0) -> Column:
    """struct(slope, intercept, error) of least trimmed squares: the least sum of the smallest `share` of squared residuals found.

    From the line through each of `starts` random pairs of points, the best `share` is fitted again until the error changes by under
    eps, `steps` times at most (Rousseeuw and van Driessen's concentration steps). Of equal residuals the lesser x, then y, counts. All
    null where no start gives a line: fewer than two places, or a share of fewer than two points.
    """
    numbers = F.array(*[F.lit(v).cast("long") for v in draws(starts, seed)])
    state = "struct<slope:double,intercept:double,error:double,done:boolean>"

    def from_start(a: Column) -> Column:
        n = F.size(a)
        used = F.floor(n * share).cast("int")

        def error(best: Column, f: Column) -> Column:
            return _sum(best, lambda v: (v["y"] - f["slope"] * v["x"] - f["intercept"]) * (v["y"] - f["slope"] * v["x"] - f["intercept"]))

        def concentrate(s: Column) -> Column:
            residual = lambda v: F.struct(((v["y"] - s["slope"] * v["x"] - s["intercept"]) * (v["y"] - s["slope"] * v["x"] - s["intercept"])).alias("r"), v["x"].alias("x"), v["y"].alias("y"))
            best = F.slice(F.array_sort(F.transform(a, residual)), 1, used)
            fitted = lambda b: let(line(b), lambda f: let(error(b, f), lambda e: F.struct(f["slope"].alias("slope"), f["intercept"].alias("intercept"), e.alias("error"), F.coalesce(F.abs(e - s["error"]) < eps, F.lit(True)).alias("done"))))
            return F.when(s["done"], s).otherwise(let(best, fitted)).cast(state)

        def start(k: Column) -> Column:
            i = F.pmod(numbers[2 * k], n).cast("int")
            j = F.pmod(numbers[2 * k + 1], n - 1).cast("int")
            j = F.when(j >= i, j + 1).otherwise(j)
            pair = let(F.array(a[i], a[j]), line)
            first = let(pair, lambda f: F.struct(f["slope"].alias("slope"), f["intercept"].alias("intercept"), F.lit(0.0).alias("error"), f["slope"].isNull().alias("done")).cast(state))
            return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, lambda s, _: concentrate(s))

        def better(best: Column, k: Column) -> Column:
            take = lambda s: F.when(s["slope"].isNotNull() & ~F.isnan(s["error"]) & (best["error"].isNull() | (s["error"] < best["error"])), s).otherwise(best).cast(state)
            return let(start(k), take)

        none = F.struct(F.lit(None).alias("slope"), F.lit(None).alias("intercept"), F.lit(None).alias("error"), F.lit(True).alias("done")).cast(state)
        found = F.aggregate(F.sequence(F.lit(0), F.lit(starts - 1)), none, better)
        found = F.when((n >= 2) & (used >= 2), found).otherwise(none)
        return let(found, lambda s: F.struct(s["slope"].alias("slope"), s["intercept"].alias("intercept"), s["error"].alias("error")))

    return let(p, from_start)
