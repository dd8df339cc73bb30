"""Places on the earth's ellipsoid and in a ground frame about a reference location; radians and metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.common import let

# The ellipsoid WGS84.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
_E2 = FLATTENING * (2 - FLATTENING)


def geocentric(lat: Column, lon: Column, height: Column) -> tuple[Column, Column, Column]:
    """Cartesian x, y, z from geodetic latitude, longitude and height."""
    n = AXIS / F.sqrt(1 - _E2 * F.sin(lat) * F.sin(lat))
    return (n + height) * F.cos(lat) * F.cos(lon), (n + height) * F.cos(lat) * F.sin(lon), (n * (1 - _E2) + height) * F.sin(lat)


def geodetic(x: Column, y: Column, z: Column, rounds: int = 4) -> tuple[Column, Column, Column]:
    """Latitude, longitude and height from Cartesian coordinates: Bowring's iteration of the reduced latitude; right at the poles too.

    Two rounds are good to a nanometre near the surface; more for places far away. The centre of the earth has no latitude: null.
    """
    minor, p = AXIS * (1 - FLATTENING), F.hypot(x, y)
    second = _E2 / (1 - _E2)

    def again(q: Column, _: Column) -> Column:
        def turned(u: Column) -> Column:
            up, out = z + second * minor * u["s"] * u["s"] * u["s"], p - _E2 * AXIS * u["c"] * u["c"] * u["c"]
            return let(F.struct(up.alias("up"), out.alias("out")), lambda v: F.struct(((1 - FLATTENING) * v["up"]).alias("sin"), v["out"].alias("cos")))

        r = F.hypot(q["sin"], q["cos"])
        unit = let(F.when(r > 0, r), lambda n: F.struct((q["sin"] / n).alias("s"), (q["cos"] / n).alias("c")))
        return let(unit, turned)

    start = F.struct((z * AXIS).cast("double").alias("sin"), (p * minor).cast("double").alias("cos"))
    lat = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, again, lambda q: F.atan2(q["sin"] / (1 - FLATTENING), q["cos"]))
    return lat, F.atan2(y, x), let(lat, lambda t: _height(t, p, z))


def _height(lat: Column, p: Column, z: Column) -> Column:
    n = AXIS / F.sqrt(1 - _E2 * F.sin(lat) * F.sin(lat))
    # along the normal; nothing small is divided by, at the poles neither
    return p * F.cos(lat) + z * F.sin(lat) - AXIS * AXIS / n


def ground_to_earth(x: Column, y: Column, z: Column, lat: Column, lon: Column, height: Column) -> tuple[Column, Column, Column]:
    """Geocentric coordinates of a place in the ground frame (x north, y west, z up) about a geodetic reference location."""
    ox, oy, oz = geocentric(lat, lon, height)
    east = -y
    out = z * F.cos(lat) - x * F.sin(lat)
    return ox + out * F.cos(lon) - east * F.sin(lon), oy + out * F.sin(lon) + east * F.cos(lon), oz + x * F.cos(lat) + z * F.sin(lat)


def earth_to_ground(x: Column, y: Column, z: Column, lat: Column, lon: Column, height: Column) -> tuple[Column, Column, Column]:
    """The inverse of ground_to_earth."""
    ox, oy, oz = geocentric(lat, lon, height)
    dx, dy, dz = x - ox, y - oy, z - oz
    out = dx * F.cos(lon) + dy * F.sin(lon)
    east = dy * F.cos(lon) - dx * F.sin(lon)
    return dz * F.cos(lat) - out * F.sin(lat), -east, out * F.cos(lat) + dz * F.sin(lat)
