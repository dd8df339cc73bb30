"""Light of a muon ring: paths over a round mirror with a round hole, and what each pixel is expected to see."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.common import let, numbers
from eventloom.functions.special import normal_between

# fixed values
FINE_STRUCTURE = 0.0072973525643
CIRCLE_IN_SQUARE = math.pi / 4
CIRCLE_IN_HEXAGON = math.pi / (2 * math.sqrt(3))


def chord(radius: Column, rho: Column, phi: Column) -> Column:
    """Length of the line in direction phi over a circle of this radius, from a point at rho radii from its centre; all of it seen from outside."""

    def along(rho: Column, s: Column, c: Column, inside: Column) -> Column:
        root = F.sqrt(F.greatest(inside, F.lit(0.0)))
        beyond = F.when((F.abs(s) * rho < 1) & (c > 0), 2 * radius * root).otherwise(0.0)
        return F.when(inside < 0, 0.0).when(rho <= 1, radius * (root + rho * c)).otherwise(beyond)

    # every value once: array functions go through their expressions for each element
    given = F.struct(rho.alias("rho"), F.sin(phi).alias("s"), F.cos(phi).alias("c"))
    return let(given, lambda g: let(1 - (g["rho"] * g["s"]) ** 2, lambda inside: along(g["rho"], g["s"], g["c"], inside)))


def mirror_path(impact: Column, phi: Column, mirror: float, hole: float = 0.0) -> Column:
    """chord over the mirror less that over its hole."""
    whole = chord(F.lit(float(mirror)), impact / mirror, phi)
    return whole - chord(F.lit(float(hole)), impact / hole, phi) if hole else whole


def profile(impact: Column, phi: Column, radius: Column, pixel: float, mirror: float, hole: float = 0.0, oversampling: int = 3) -> Column:
    """mirror_path all around the ring, `oversampling` steps a pixel from -pi to pi, as a running mean over as many steps."""

    def around(g: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), g["n"] - 1), lambda i: let(-math.pi + 2 * math.pi * i / (g["n"] - 1) - g["phi"], lambda at: mirror_path(g["impact"], at, mirror, hole)))

    n = F.floor(2 * math.pi * radius / pixel).cast("int") * oversampling
    path = let(F.struct(n.alias("n"), phi.alias("phi"), impact.alias("impact")), around)
    return let(path, lambda a: F.transform(a, lambda _, i: sum((a[F.pmod(i + k - oversampling // 2, F.size(a))] for k in range(oversampling)), F.lit(0.0)) / oversampling))


def pixel_light(x: list[float], y: list[float], impact: Column, phi: Column, centre_x: Column, centre_y: Column, radius: Column, width: Column, pixel: float, mirror: float, hole: float = 0.0, oversampling: int = 3, shape: float = CIRCLE_IN_HEXAGON, shortest: float = 300e-9, longest: float = 600e-9) -> Column:
    """Photons in each pixel, for light between two wavelengths; metres for mirror and impact, radians in the camera.

    Null where the ring is too small for a pixel on its circumference, or for a null.
    """

    def at_place(g: Column, light: Column, r: Column, step: Column, low: Column) -> Column:
        along = light[low] + (light[low + 1] - light[low]) * (step - low)
        across = normal_between(r - pixel / 2, r + pixel / 2, g["radius"], g["width"])
        return along * across * (FINE_STRUCTURE * (1 / shortest - 1 / longest) * pixel * shape) / g["radius"] * 0.5 * F.sin(2 * g["radius"])

    def in_pixel(p: Column, g: Column, light: Column, n: Column) -> Column:
        place = let(F.struct((p["x"] - g["x"]).alias("x"), (p["y"] - g["y"]).alias("y")), lambda d: F.struct(F.hypot(d["x"], d["y"]).alias("r"), ((F.atan2(d["y"], d["x"]) + math.pi) / (2 * math.pi) * (n - 1)).alias("step")))
        return let(place, lambda q: let(F.least(F.floor(q["step"]).cast("int"), n - 2), lambda low: at_place(g, light, q["r"], q["step"], low)))

    # the ring's numbers, its profile and the profile's length once for all pixels
    pixels = F.arrays_zip(numbers(x).alias("x"), numbers(y).alias("y"))
    ring = F.struct(impact.alias("impact"), phi.alias("phi"), centre_x.alias("x"), centre_y.alias("y"), radius.alias("radius"), width.alias("width"))
    lit = lambda g: profile(g["impact"], g["phi"], g["radius"], pixel, mirror, hole, oversampling)
    seen = let(ring, lambda g: let(lit(g), lambda light: let(F.size(light), lambda n: F.transform(pixels, lambda p: in_pixel(p, g, light, n)))))
    return F.when(2 * math.pi * radius / pixel >= 1, seen)
