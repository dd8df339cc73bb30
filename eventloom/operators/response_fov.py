"""Response tables in bins of energy and offset from the centre of the field of view, and the sensitivity to a point source.

Every table covers the whole grid of its bins: counts are 0 and other values null where a bin has no events. Rows whose
value on an axis is null, NaN or outside of its edges belong to no bin.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.common import ratio
from eventloom.operators.response import bin_of, bins_per_decade, grid, relative_sensitivity

ONE_SIGMA = 0.5 * (1 + math.erf(math.sqrt(0.5)))

# default axes (fixed values): energies in TeV, offsets in degrees
TRUE_ENERGIES = bins_per_decade(0.015, 150.0, 10)
RECO_ENERGIES = bins_per_decade(0.015, 150.0, 5)
OFFSETS = [0.0, 5.0]


def binned(events: DataFrame, **axes: tuple[str, list[float]]) -> DataFrame:
    """The events inside of all axes, with the index of their bin in a column named like the axis."""
    out = events
    for name, (value, edges) in axes.items():
        out = out.withColumn(name, bin_of(F.col(value), edges))
    return out.where(" and ".join(f"{a} >= 0" for a in axes))


def _table(events: DataFrame, axes: dict[str, tuple[str, list[float]]], values: dict[str, Column]) -> DataFrame:
    """The values of each bin, on the whole grid; what is broadcast has at most a row for each bin."""
    got = binned(events, **axes).groupBy(*axes).agg(*[v.alias(k) for k, v in values.items()])
    return grid(events.sparkSession, **{a: e for a, (_, e) in axes.items()}).join(F.broadcast(got), list(axes), "left")


def _solid_angle(low: Column, high: Column) -> Column:
    """Steradians between two cones about the same axis, their half opening angles in degrees."""
    return 2 * math.pi * (F.cos(F.radians(low)) - F.cos(F.radians(high)))


def _n() -> Column:
    return F.coalesce("n", F.lit(0)).cast("long").alias("n")


def bias_resolution(events: DataFrame, true: str, reco: str, offset: str, edges: list[float], offsets: list[float]) -> DataFrame:
    """bin, ring, n, bias (mean of reco / true - 1), resolution (half of the range within one standard deviation of a normal distribution)."""
    d = F.try_divide(F.col(reco), F.col(true)) - 1
    q = F.percentile(d, F.array(F.lit(1 - ONE_SIGMA), F.lit(ONE_SIGMA)))
    t = _table(events, {"bin": (true, edges), "ring": (offset, offsets)}, {"n": F.count("*"), "bias": F.avg(d), "q": q})
    return t.select("bin", "ring", _n(), "bias", ((F.col("q")[1] - F.col("q")[0]) / 2).alias("resolution"))


def angular_resolution(events: DataFrame, theta: str, energy: str, offset: str, edges: list[float], offsets: list[float], quantiles=(0.25, 0.5, 0.68, 0.95)) -> DataFrame:
    q = F.percentile(F.col(theta).cast("double"), F.array(*[F.lit(x) for x in quantiles]))
    t = _table(events, {"bin": (energy, edges), "ring": (offset, offsets)}, {"n": F.count("*"), "q": q})
    return t.select("bin", "ring", _n(), *[F.col("q")[i].alias(f"q{round(x * 100)}") for i, x in enumerate(quantiles)])


def effective_area(selected: DataFrame, simulated: DataFrame, energy: str, offset: str, edges: list[float], offsets: list[float], area: float) -> DataFrame:
    """bin, ring, n_selected, n_simulated, area: share of the simulated events of the bin that is selected, times the area they fell on."""
    axes = {"bin": (energy, edges), "ring": (offset, offsets)}
    s = _table(selected, axes, {"n_selected": F.count("*")}).select("bin", "ring", "n_selected")
    both = _table(simulated, axes, {"n_simulated": F.count("*")}).join(s, ["bin", "ring"]).na.fill(0, ["n_selected", "n_simulated"])
    return both.select("bin", "ring", "n_selected", "n_simulated", (ratio(F.col("n_selected"), F.col("n_simulated")) * area).alias("area"))


def energy_dispersion(events: DataFrame, true: str, reco: str, offset: str, edges: list[float], migration: list[float], offsets: list[float]) -> DataFrame:
    """bin, migration, ring, density: histogram of reco / true, normalised to 1 over the migration axis of each energy and ring."""
    e = events.withColumn("__m", F.try_divide(F.col(reco), F.col(true)))
    t = _table(e, {"bin": (true, edges), "migration": ("__m", migration), "ring": (offset, offsets)}, {"n": F.count("*")})
    all_ = t.groupBy("bin", "ring").agg(F.sum("n").alias("all"))
    share = ratio(F.col("n"), F.col("all")) / (F.col("migration_high") - F.col("migration_low"))
    return t.join(F.broadcast(all_), ["bin", "ring"]).select("bin", "migration", "ring", F.coalesce(share, F.lit(0.0)).alias("density"))


def point_spread(events: DataFrame, theta: str, energy: str, offset: str, edges: list[float], angles: list[float], offsets: list[float]) -> DataFrame:
    """bin, ring, theta, density: share of a bin's events in each ring of theta, by solid angle (angles in degrees)."""
    t = _table(events, {"bin": (energy, edges), "ring": (offset, offsets), "theta": (theta, angles)}, {"n": F.count("*")})
    all_ = t.groupBy("bin", "ring").agg(F.sum("n").alias("all"))
    share = ratio(F.col("n"), F.col("all")) / _solid_angle(F.col("theta_low"), F.col("theta_high"))
    return t.join(F.broadcast(all_), ["bin", "ring"]).select("bin", "ring", "theta", F.coalesce(share, F.lit(0.0)).alias("density"))


def _knots(cuts: DataFrame) -> DataFrame:
    """One row with the centres of the cuts' bins and their cuts, in order; as many as energy bins."""
    knots = cuts.select(((F.col("low") + F.col("high")) / 2).alias("x"), F.col("cut").alias("y"))
    return knots.agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("knots")).withColumn("__all", F.lit(0))


def _between(x: Column, knots: Column) -> Column:
    """Linear between the knots, flat beyond the first and last."""
    below, above = F.filter(knots, lambda k: k["x"] <= x), F.filter(knots, lambda k: k["x"] > x)
    a, b = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    inside = a["y"] + (x - a["x"]) * ratio(b["y"] - a["y"], b["x"] - a["x"])
    return F.when(a.isNull(), b["y"]).when(b.isNull(), a["y"]).otherwise(inside)


def background_counts(events: DataFrame, energy: str, offset: str, weight: str, edges: list[float], offsets: list[float], cuts: DataFrame, alpha: float) -> DataFrame:
    """bin, ring, n_background: weighted events of the offset ring, scaled from its solid angle to that of an off region 1 / alpha
    times as large as the cone of the angular cut (cuts: bin, low, high, cut; in degrees) at the centre of the energy bin."""
    t = _table(events, {"bin": (energy, edges), "ring": (offset, offsets)}, {"w": F.sum(weight)})
    t = t.withColumn("__all", F.lit(0)).join(F.broadcast(_knots(cuts)), "__all").withColumn("__cut", _between((F.col("bin_low") + F.col("bin_high")) / 2, F.col("knots")))
    scale = _solid_angle(F.lit(0.0), F.col("__cut")) / _solid_angle(F.col("ring_low"), F.col("ring_high")) / alpha
    return t.select("bin", "bin_low", "bin_high", "ring", (F.coalesce("w", F.lit(0.0)) * scale).alias("n_background"))


def sensitivity(signal: DataFrame, background: DataFrame, energy: str, offset: str, weight: str, edges: list[float], offsets: list[float], cuts: DataFrame, alpha: float, background_offset: str | None = None, norm: float = 1.0, index: float = -2.0, reference: float = 1.0) -> DataFrame:
    """bin, ring, n_signal, n_background, relative_sensitivity, flux_sensitivity, energy_flux_sensitivity.

    Signal that passed its cuts, by weight; background scaled to the off region; the factor on the signal that is just
    significant; that factor times the source's power law at the bin's centre, and times the centre's square.
    """
    s = _table(signal, {"bin": (energy, edges), "ring": (offset, offsets)}, {"n_signal": F.sum(weight)}).select("bin", "ring", F.coalesce("n_signal", F.lit(0.0)).alias("n_signal"))
    b = background_counts(background, energy, background_offset or offset, weight, edges, offsets, cuts, alpha)
    centre = (F.col("bin_low") + F.col("bin_high")) / 2
    flux = F.col("relative_sensitivity") * norm * F.pow(centre / reference, F.lit(index))
    both = s.join(F.broadcast(b), ["bin", "ring"]).withColumn("relative_sensitivity", relative_sensitivity(F.col("n_signal"), F.col("n_background") * alpha, alpha))
    return both.select("bin", "ring", "n_signal", "n_background", "relative_sensitivity", flux.alias("flux_sensitivity"), (flux * centre * centre).alias("energy_flux_sensitivity"))


def valid_energies(bins: list[tuple[float, float, bool]]) -> tuple[float, float]:
    """First and last edge of the usable bins (low, high, usable), which must have no gap; for a table of a few bins."""
    used = [i for i, b in enumerate(bins) if b[2]]
    if not used or used[-1] - used[0] + 1 != len(used):
        raise ValueError("the usable bins are none or have a gap")
    return bins[used[0]][0], bins[used[-1]][1]
