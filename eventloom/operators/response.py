"""Binned cuts on scores and angles, and response tables: histograms, resolutions, areas, rates and weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.common import ratio


def bins_per_decade(low: float, high: float, n: int) -> list[float]:
    """Log-spaced edges including both ends, at least n per decade."""
    k = math.ceil(math.log10(high / low) * n)
    return [low * (high / low) ** (i / k) for i in range(k)] + [high]


def check_bins(edges: list[float], low: float, high: float) -> None:
    if min(edges) < low or max(edges) > high:
        raise ValueError(f"bins reach beyond {low} to {high}")


def bin_of(x: Column, edges: list[float]) -> Column:
    """Index of the half-open bin, -1 outside."""
    out = F.lit(-1)
    for i, e in enumerate(edges[:-1]):
        out = F.when(x >= e, i).otherwise(out)
    return F.when(x.isNull() | F.isnan(x.cast("double")) | (x >= edges[-1]), -1).otherwise(out)


def grid(spark, **edges: list[float]) -> DataFrame:
    """All bins of one or more axes: columns <axis>, <axis>_low, <axis>_high. Its size is fixed by the edges."""
    rows, names = [()], []
    for a, e in edges.items():
        rows = [(*r, i, float(e[i]), float(e[i + 1])) for r in rows for i in range(len(e) - 1)]
        names.append(f"{a} int, {a}_low double, {a}_high double")
    return spark.createDataFrame(rows, ", ".join(names))


def percentile_cut(events: DataFrame, value: str, energy: str, edges: list[float], percentile: float, fill: float, least: int = 10, low: float | None = None, high: float | None = None) -> DataFrame:
    """bin, low, high, n, cut: the value's percentile in each energy bin; `fill` where there are under `least` events."""
    d = events.withColumn("bin", bin_of(F.col(energy), edges)).where("bin >= 0")
    got = d.groupBy("bin").agg(F.count("*").alias("n"), F.percentile(F.col(value).cast("double"), percentile / 100).alias("cut"))
    out = grid(events.sparkSession, bin=edges).withColumnsRenamed({"bin_low": "low", "bin_high": "high"}).join(F.broadcast(got), "bin", "left")
    cut = F.when(F.coalesce("n", F.lit(0)) >= least, F.col("cut")).otherwise(F.lit(float(fill)))
    if low is not None:
        cut = F.greatest(cut, F.lit(float(low)))
    if high is not None:
        cut = F.least(cut, F.lit(float(high)))
    return out.select("bin", "low", "high", F.coalesce("n", F.lit(0)).cast("long").alias("n"), cut.alias("cut"))


def apply_cut(events: DataFrame, value: str, energy: str, edges: list[float], cuts: DataFrame, name: str, keep: str = ">=") -> DataFrame:
    """events with a boolean `name`: value against the cut of its energy bin, false outside of all bins."""
    d = events.withColumn("__bin", bin_of(F.col(energy), edges)).join(F.broadcast(cuts.select(F.col("bin").alias("__bin"), F.col("cut").alias("__cut"))), "__bin", "left")
    ok = F.col(value) >= F.col("__cut") if keep == ">=" else F.col(value) <= F.col("__cut")
    return d.withColumn(name, F.coalesce(ok, F.lit(False))).drop("__bin", "__cut")


def percentile_cuts(events: DataFrame, score: str, theta: str, energy: str, edges: list[float], score_efficiency: float, theta_efficiency: float, least: int = 10) -> DataFrame:
    """bin, score_cut, theta_cut: the angle's cut is made from what passes the score's."""
    scores = percentile_cut(events, score, energy, edges, 100 - score_efficiency, 1.0, least)
    passed = apply_cut(events, score, energy, edges, scores, "__ok").where("__ok")
    thetas = percentile_cut(passed, theta, energy, edges, theta_efficiency, 0.3, least)
    return scores.select("bin", F.col("cut").alias("score_cut")).join(thetas.select("bin", F.col("cut").alias("theta_cut")), "bin")


def bias_resolution(events: DataFrame, true: str, reco: str, edges: list[float]) -> DataFrame:
    """bin, n, bias (mean of reco / true - 1), resolution (half of the central 68 %)."""
    d = events.withColumn("bin", bin_of(F.col(true), edges)).where("bin >= 0").withColumn("__d", F.try_divide(F.col(reco), F.col(true)) - 1)
    q = lambda p: F.percentile("__d", p)
    return d.groupBy("bin").agg(F.count("*").alias("n"), F.avg("__d").alias("bias"), ((q(0.84) - q(0.16)) / 2).alias("resolution"))


def angular_resolution(events: DataFrame, theta: str, energy: str, edges: list[float], quantiles=(0.25, 0.5, 0.68, 0.95)) -> DataFrame:
    d = events.withColumn("bin", bin_of(F.col(energy), edges)).where("bin >= 0")
    return d.groupBy("bin").agg(F.count("*").alias("n"), *[F.percentile(F.col(theta).cast("double"), q).alias(f"q{round(q * 100)}") for q in quantiles])


def energy_dispersion(events: DataFrame, true: str, reco: str, edges: list[float], migration: list[float]) -> DataFrame:
    """bin, migration, density: histogram of reco / true per true energy, normalised to 1 over the migration axis."""
    d = events.withColumn("bin", bin_of(F.col(true), edges)).withColumn("migration", bin_of(F.try_divide(F.col(reco), F.col(true)), migration)).where("bin >= 0 and migration >= 0")
    n = d.groupBy("bin", "migration").agg(F.count("*").alias("n"))
    n = n.join(F.broadcast(n.groupBy("bin").agg(F.sum("n").alias("all"))), "bin")
    g = grid(events.sparkSession, bin=edges, migration=migration)
    width = F.col("migration_high") - F.col("migration_low")
    return g.join(F.broadcast(n), ["bin", "migration"], "left").select("bin", "migration", F.coalesce(F.col("n") / F.col("all") / width, F.lit(0.0)).alias("density"))


def point_spread(events: DataFrame, theta: str, energy: str, edges: list[float], angles: list[float]) -> DataFrame:
    """bin, ring, density: share of events per ring and solid angle (angles in degrees)."""
    d = events.withColumn("bin", bin_of(F.col(energy), edges)).withColumn("ring", bin_of(F.col(theta), angles)).where("bin >= 0 and ring >= 0")
    n = d.groupBy("bin", "ring").agg(F.count("*").alias("n"))
    n = n.join(F.broadcast(n.groupBy("bin").agg(F.sum("n").alias("all"))), "bin")
    solid = 2 * math.pi * (F.cos(F.radians("ring_low")) - F.cos(F.radians("ring_high")))
    return grid(events.sparkSession, bin=edges, ring=angles).join(F.broadcast(n), ["bin", "ring"], "left").select("bin", "ring", F.coalesce(F.col("n") / F.col("all") / solid, F.lit(0.0)).alias("density"))


def background_rate(events: DataFrame, energy: str, offset: str, weight: str, edges: list[float], offsets: list[float], seconds: float) -> DataFrame:
    """bin, ring, rate: weighted events per energy, time and solid angle of the offset ring (degrees)."""
    d = events.withColumn("bin", bin_of(F.col(energy), edges)).withColumn("ring", bin_of(F.col(offset), offsets)).where("bin >= 0 and ring >= 0")
    n = d.groupBy("bin", "ring").agg(F.sum(weight).alias("w"))
    solid = 2 * math.pi * (F.cos(F.radians("ring_low")) - F.cos(F.radians("ring_high")))
    rate = F.col("w") / ((F.col("bin_high") - F.col("bin_low")) * seconds * solid)
    return grid(events.sparkSession, bin=edges, ring=offsets).join(F.broadcast(n), ["bin", "ring"], "left").select("bin", "ring", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def effective_area(selected: DataFrame, simulated: DataFrame, energy: str, edges: list[float], area: float) -> DataFrame:
    """bin, n_selected, n_simulated, area: the share of simulated events that is selected, times the area they fell on."""
    per = lambda d, c: d.withColumn("bin", bin_of(F.col(energy), edges)).where("bin >= 0").groupBy("bin").agg(F.count("*").alias(c))
    both = per(simulated, "n_simulated").join(per(selected, "n_selected"), "bin", "left").withColumn("n_selected", F.coalesce("n_selected", F.lit(0)).cast("long"))
    return both.select("bin", "n_selected", "n_simulated", (F.col("n_selected") / F.col("n_simulated") * area).alias("area"))


def simulated_in_bin(n: float, index: float, e_min: float, e_max: float, low: Column, high: Column) -> Column:
    """How many of n events drawn from a power law between e_min and e_max fall between low and high."""
    k = index + 1
    cdf = lambda e: (F.pow(F.least(F.greatest(e, F.lit(e_min)), F.lit(e_max)), F.lit(k)) - e_min**k) / (e_max**k - e_min**k)
    return n * (cdf(high) - cdf(low))


def power_law_weight(energy: Column, from_norm: float, from_index: float, to_norm: float, to_index: float, reference: float = 1.0) -> Column:
    """Ratio of the target to the simulated spectrum at an energy."""
    return F.lit(to_norm / from_norm) * F.pow(energy / reference, F.lit(to_index - from_index))


def ring_weight(offset: Column, weight: Column, rings: list[float], factors: list[float]) -> Column:
    """weight times the factor of the half-open offset ring, 0 outside."""
    out = F.lit(0.0)
    for low, high, f in zip(rings[:-1], rings[1:], factors, strict=True):
        out = F.when((offset >= low) & (offset < high), weight * f).otherwise(out)
    return out


def li_ma(n_on: Column, n_off: Column, alpha: float) -> Column:
    """Significance of an excess of on over alpha times off counts; negative for a deficit."""
    total = n_on + n_off
    a = n_on * F.ln(F.when(n_on > 0, (1 + alpha) / alpha * n_on / total).otherwise(1.0))
    b = n_off * F.ln(F.when(n_off > 0, (1 + alpha) * n_off / total).otherwise(1.0))
    return F.when(total > 0, F.signum(n_on - alpha * n_off) * F.sqrt(2 * F.greatest(a + b, F.lit(0.0)))).otherwise(0.0)


def relative_sensitivity(signal: Column, background: Column, alpha: float, significance: float = 5.0, least: float = 10.0, share: float = 0.05, steps: int = 60) -> Column:
    """The factor on the signal at which it is just significant, has `least` events and `share` of the background.

    The factor's significance rises with it, so halving an interval of logarithms `steps` times finds it, all in one expression.
    """
    off = background / alpha

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        enough = li_ma(signal * F.pow(F.lit(10.0), mid) + background, off, alpha) >= significance
        return F.struct(F.when(enough, acc["lo"]).otherwise(mid).alias("lo"), F.when(enough, mid).otherwise(acc["hi"]).alias("hi"))

    start = F.struct(F.lit(-8.0).alias("lo"), F.lit(8.0).alias("hi"))
    by_significance = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda a: F.pow(F.lit(10.0), a["hi"]))
    return F.when(signal > 0, F.greatest(by_significance, F.lit(least) / signal, share * background / signal))


def scan_efficiencies(signal: DataFrame, background: DataFrame, score: str, energy: str, edges: list[float], efficiencies: list[float], alpha: float) -> DataFrame:
    """bin, efficiency, cut, sensitivity: of the scanned signal efficiencies the most sensitive one in each energy bin."""
    s = signal.withColumn("bin", bin_of(F.col(energy), edges)).where("bin >= 0")
    b = background.withColumn("bin", bin_of(F.col(energy), edges)).where("bin >= 0")
    cuts = s.groupBy("bin").agg(F.percentile(F.col(score).cast("double"), F.array(*[F.lit(1 - e) for e in efficiencies])).alias("c"))
    cuts = cuts.select("bin", F.posexplode("c").alias("i", "cut")).withColumn("efficiency", F.element_at(F.array(*[F.lit(e) for e in efficiencies]), F.col("i") + 1))
    per = lambda d, c: d.join(F.broadcast(cuts), "bin").where(F.col(score) >= F.col("cut")).groupBy("bin", "i").agg(F.count("*").alias(c))
    both = cuts.join(per(s, "n_signal"), ["bin", "i"], "left").join(per(b, "n_background"), ["bin", "i"], "left").na.fill(0, ["n_signal", "n_background"])
    both = both.withColumn("sensitivity", relative_sensitivity(F.col("n_signal").cast("double"), F.col("n_background") * alpha, alpha)).where("sensitivity is not null")
    return both.groupBy("bin").agg(F.min_by(F.struct("efficiency", "cut", "sensitivity"), F.struct("sensitivity", "i")).alias("x")).select("bin", "x.*")


def annulus_area(low: float, high: float) -> float:
    return math.pi * (high**2 - low**2)


def safe_share(part: Column, whole: Column) -> Column:
    return F.coalesce(ratio(part, whole), F.lit(0.0))
