"""Spread of a point source over the camera of a telescope whose aberration grows away from the axis."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.common import let


@dataclass(frozen=True)
class Coma:
    """Density over the camera in 1 / square degree, angles in degrees: across the radius a Laplace distribution, along it an asymmetric one.

    asymmetry: largest value, rate and linear term; radial: coefficients of the scale from power 0 to 3; polar: amplitude,
    decay and offset of the scale; pixel_width: a source nearer to the centre than half of it is spread evenly over one pixel.
    """

    asymmetry: tuple[float, float, float]
    radial: tuple[float, float, float, float]
    polar: tuple[float, float, float]
    pixel_width: float

    def density(self, lon: Column, lat: Column, lon0: Column, lat0: Column) -> Column:
        """At (lon, lat), of a source at (lon0, lat0). Null for a null."""
        c0, c1, c2 = self.asymmetry
        b1, b2, b3, b4 = self.radial
        a1, a2, a3 = self.polar
        half = self.pixel_width / 2

        def at(q: Column) -> Column:
            r, r0 = q["r"], q["r0"]
            k = 1 - c0 * F.tanh(c1 * r0) - c2 * r0
            along = b1 + r0 * (b2 + r0 * (b3 + r0 * b4))
            across = a1 * F.exp(-a2 * r0) + a3 / (a3 + r0)
            y = (r - r0) / along
            radial = F.exp(F.when(y >= 0, -y * k).otherwise(y / k)) / (k + 1 / k) / along
            turn = F.pmod(q["phi"] - q["phi0"] + math.pi, F.lit(2 * math.pi)) - math.pi
            # a chord of six pixels, or of half the distance from the centre if that is shorter
            widest = F.asin(F.least(F.lit(6 * self.pixel_width), 0.5 * r0) / (2 * r0))
            polar = F.when((r0 > half) & (F.abs(turn) > widest), 0.0).otherwise(F.exp(-F.abs(turn) / across) / (2 * across))
            return F.when(r0 < half, F.when(r < half, 1 / (math.pi * half**2)).otherwise(0.0)).when(r == 0, 0.0).otherwise(radial * polar / r)

        polar = F.struct(F.hypot(lon, lat).alias("r"), F.atan2(lat, lon).alias("phi"), F.hypot(lon0, lat0).alias("r0"), F.atan2(lat0, lon0).alias("phi0"))
        return let(polar, at)
