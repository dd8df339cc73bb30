"""Cuts of multiplicity, angle and score of the best point-source sensitivity, from one pass over the events.

Events are counted on a cube of multiplicity, angle and score for each bin of energy; cumulative sums over it give what every combination of
cuts keeps. The cube's size depends on its edges only, so the events are read once whatever is scanned.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.response import bin_of, relative_sensitivity


def _level(x: Column, edges: Sequence[float]) -> Column:
    """How many edges are at most x."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= x))


def _first_at_least(x: Column, edges: Sequence[float]) -> Column:
    """Number of the first edge that is x at least, len(edges) if none is."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < x))


def optimise(
    signal: DataFrame, background: DataFrame, energy: str, multiplicity: str, theta: str, score: str, weight: str, offset: str, energies: Sequence[float], multiplicities: Sequence[int], thetas: Sequence[float],
    scores: Sequence[float], theta_efficiencies: Sequence[float], score_efficiencies: Sequence[float], ring: tuple[float, float] = (0.0, 1.0), alpha: float = 0.2,
) -> DataFrame:
    """bin, multiplicity, theta, score, n_signal, n_background, sensitivity: the best combination of cuts in each bin of energy.

    Kept are events of at least the multiplicity, an angle of at most theta and at least the score. Scanned are all multiplicities; for each the smallest theta that keeps
    each of theta_efficiencies of the signal of this multiplicity, and for each of these the highest score that keeps each of score_efficiencies of what the theta keeps.
    The background is that of the ring of offsets [low, high), in proportion to the area within theta; half of both in degrees. Cuts are edges of thetas and scores
    (ascending): finer edges come closer to quantiles. Bins without a combination that finds signal give no row; of equal sensitivities the lowest multiplicity, theta and
    then score efficiency. Rows with a null or non-finite number, outside of the bins or under the lowest multiplicity or score do not count.
    """
    levels = sorted(multiplicities)
    known = lambda *cs: [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cs]

    def cells(d: DataFrame, *more: Column) -> DataFrame:
        d = d.withColumn("bin", bin_of(F.col(energy), list(energies))).where("bin >= 0")
        d = d.select("bin", (_level(F.col(multiplicity), levels) - 1).alias("m"), (_level(F.col(score), scores) - 1).alias("s"), F.col(weight).cast("double").alias("w"), *more)
        return d.where("m >= 0 and s >= 0")

    own = signal
    for k in known(energy, multiplicity, theta, score, weight):
        own = own.where(k)
    other = background.where((F.col(offset) >= ring[0]) & (F.col(offset) < ring[1]))
    for k in known(energy, multiplicity, score, weight):
        other = other.where(k)
    here = cells(own, _first_at_least(F.col(theta), thetas).alias("t")).groupBy("bin", "m", "t", "s").agg(F.sum("w").alias("w"), F.lit(True).alias("signal"))
    there = cells(other).groupBy("bin", "m", "s").agg(F.sum("w").alias("w"), F.lit(False).alias("signal")).withColumn("t", F.lit(0))
    shape = (len(levels), len(thetas) + 1, len(scores))
    area = np.array([t * t for t in thetas]) / (ring[1] ** 2 - ring[0] ** 2)

    def combinations(g: pd.DataFrame) -> pd.DataFrame:
        n, b = np.zeros(shape), np.zeros((shape[0], shape[2]))
        own = g["signal"].to_numpy(bool)
        np.add.at(n, tuple(g[c].to_numpy()[own] for c in "mts"), g["w"].to_numpy()[own])
        np.add.at(b, tuple(g[c].to_numpy()[~own] for c in "ms"), g["w"].to_numpy()[~own])
        n = n[::-1, :, ::-1].cumsum(0).cumsum(1).cumsum(2)[::-1, :, ::-1]
        b = b[::-1, ::-1].cumsum(0).cumsum(1)[::-1, ::-1]
        out = []
        for m in range(shape[0]):
            every = n[m, :, 0]
            for i, e in enumerate(theta_efficiencies):
                enough = np.flatnonzero(every[:-1] >= e * every[-1] * (1 - 1e-12))
                if every[-1] <= 0 or not len(enough):
                    continue
                t = int(enough[0])
                for j, f in enumerate(score_efficiencies):
                    s = int(np.flatnonzero(n[m, t] >= f * n[m, t, 0] * (1 - 1e-12))[-1])
                    out.append((int(g["bin"].iloc[0]), levels[m], float(thetas[t]), float(scores[s]), float(n[m, t, s]), float(b[m, s] * area[t]), m, i, j))
        return pd.DataFrame(out, columns=["bin", "multiplicity", "theta", "score", "n_signal", "n_background", "m", "i", "j"])

    tried = here.unionByName(there).groupBy("bin").applyInPandas(combinations, "bin int, multiplicity int, theta double, score double, n_signal double, n_background double, m int, i int, j int")
    tried = tried.withColumn("sensitivity", relative_sensitivity(F.col("n_signal"), F.col("n_background") * alpha, alpha)).where("sensitivity is not null")
    best = tried.groupBy("bin").agg(F.min_by(F.struct("multiplicity", "theta", "score", "n_signal", "n_background", "sensitivity"), F.struct("sensitivity", "m", "i", "j")).alias("x"))
    return best.select("bin", "x.*")
