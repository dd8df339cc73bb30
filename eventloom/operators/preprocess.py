"""Reconstructed events made ready for response tables: one set of names, derived columns, and the simulated sample behind them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions import coords

#: Columns of the result besides those that are renamed.
KEPT = ("obs_id", "event_id", "true_energy", "true_az", "true_alt")


@dataclass(frozen=True)
class Reconstruction:
    """Prefixes of the columns of the energy, geometry and classification in use."""

    energy: str
    geometry: str
    score: str

    def names(self) -> dict[str, str]:
        return {
            f"{self.energy}_energy": "reco_energy", f"{self.geometry}_az": "reco_az", f"{self.geometry}_alt": "reco_alt",
            f"{self.score}_prediction": "gh_score", "subarray_pointing_lat": "pointing_alt", "subarray_pointing_lon": "pointing_az",
        }

    def telescopes(self) -> list[str]:
        return [f"{p}_telescopes" for p in dict.fromkeys((self.energy, self.geometry, self.score))]


def normalise(events: DataFrame, r: Reconstruction, names: dict[str, str] | None = None, kept=KEPT, derived: bool = True, any_pointing: bool = False, altaz: int = 0) -> DataFrame:
    """The columns kept and renamed; ValueError names one that is missing.

    Unless any_pointing, one pass over two columns makes sure that the pointing's altitude spreads by at most 1e-3 and that all rows
    are in the altitude-azimuth frame (code altaz), and raises NotImplementedError else. Without rows, nothing is wrong.
    """
    names = r.names() if names is None else names
    more = r.telescopes() if derived else []
    for c in [*kept, *names, *more]:
        if c not in events.columns:
            raise ValueError(f"required column {c} is missing")
    if not any_pointing:
        s = events.agg(F.stddev_pop("subarray_pointing_lat").alias("spread"), F.max(~F.col("subarray_pointing_frame").eqNullSafe(altaz)).alias("other")).first()
        if s.spread is not None and s.spread > 1e-3:
            raise NotImplementedError("events with varying pointings")
        if s.other:
            raise NotImplementedError("pointings outside the altitude-azimuth frame")
    return events.select(*[c for c in kept if c not in names.values()], *[F.col(c).alias(n) for c, n in names.items()], *more)


def derive(events: DataFrame, r: Reconstruction) -> DataFrame:
    """Adds theta, true_source_fov_offset, reco_source_fov_offset, reco_fov_lon, reco_fov_lat, weight and multiplicity; angles in degrees.

    multiplicity is the least number of telescopes in the three reconstructions, whose columns go. Nulls give nulls.
    """
    rad = lambda c: F.radians(F.col(c))
    apart = lambda a, b: F.degrees(coords.separation(rad(f"{a}_az"), rad(f"{a}_alt"), rad(f"{b}_az"), rad(f"{b}_alt")))
    lon, lat = coords.to_offset(rad("reco_az"), rad("reco_alt"), rad("pointing_az"), rad("pointing_alt"))
    counts = [F.size(F.filter(c, lambda x: x)) for c in r.telescopes()]
    return events.withColumns({
        "theta": apart("reco", "true"), "true_source_fov_offset": apart("true", "pointing"), "reco_source_fov_offset": apart("reco", "pointing"),
        "reco_fov_lon": -F.degrees(lon), "reco_fov_lat": F.degrees(lat), "weight": F.lit(1.0), "multiplicity": F.least(*counts) if len(counts) > 1 else counts[0],
    }).drop(*r.telescopes())


#: Settings that all runs of a simulated sample must share.
SHARED = ("spectral_index", "energy_range_min", "energy_range_max", "max_scatter_range", "max_viewcone_radius", "min_viewcone_radius")


def simulated_sample(runs: DataFrame, showers: DataFrame | None = None) -> DataFrame:
    """One row: n_showers and the shared settings of all runs.

    NotImplementedError if a setting differs between runs; ValueError if the showers of the histograms (n_entries) are not as many as
    those of the runs (n_showers * shower_reuse). Without histogram entries the runs' number stands; without runs it is null.
    """
    one = runs.agg(
        F.sum(F.col("n_showers") * F.col("shower_reuse")).cast("long").alias("n_showers"),
        *[F.min(c).alias(c) for c in SHARED], *[(F.max(c) > F.min(c)).alias(f"__{c}") for c in SHARED],
    )
    row = one.first()
    for c in SHARED:
        if row[f"__{c}"]:
            raise NotImplementedError(f"{c} differs between runs")
    if showers is not None:
        n = showers.agg(F.sum("n_entries")).first()[0]
        if n and n != row.n_showers:
            raise ValueError(f"inconsistent number of showers: {n} and {row.n_showers}")
    return one.select("n_showers", *SHARED)
