"""The array as a table of telescopes (tel_id, type, x, y in metres), stars near a pointing, and pixels at a place."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.common import indices, let, numbers
from eventloom.functions.coords import separation
from eventloom.operators.images import Camera


def of_type(telescopes: DataFrame, kind: str) -> DataFrame:
    """The telescopes of a type; an error if the array has none."""
    out = telescopes.where(F.col("type") == kind)
    if out.isEmpty():
        raise ValueError(f"no telescope of type {kind}")
    return out


def select_subarray(telescopes: DataFrame, tel_ids: list[int]) -> DataFrame:
    """The named telescopes; an error if one is not in the array."""
    out = telescopes.where(F.col("tel_id").isin(tel_ids))
    missing = set(tel_ids) - {r[0] for r in out.select("tel_id").distinct().collect()}  # no more rows than tel_ids
    if missing:
        raise ValueError(f"not in the array: {sorted(missing)}")
    return out


def footprint(telescopes: DataFrame) -> DataFrame:
    """One row: area in km2 of the circle about the origin that holds every telescope."""
    return telescopes.agg((F.max(F.col("x") ** 2 + F.col("y") ** 2) * math.pi / 1e6).alias("footprint"))


def multiplicity_by_type(triggers: DataFrame, telescopes: DataFrame, by: list[str]) -> DataFrame:
    """by, type, n: different telescopes of each type in each event. An array has some hundred telescopes, which Spark may broadcast by their size."""
    t = telescopes.select("tel_id", "type")
    return triggers.select(*by, "tel_id").join(t, "tel_id").groupBy(*by, "type").agg(F.countDistinct("tel_id").alias("n"))


def select_stars(stars: DataFrame, band: str = "Vmag", brighter: float | None = None, lon: float | None = None, lat: float | None = None, radius: float | None = None, star_lon: str = "ra", star_lat: str = "dec") -> DataFrame:
    """Stars brighter than a magnitude, and within a radius of (lon, lat), all in degrees; the distance as `separation`."""
    out = stars
    if brighter is not None:
        if band not in stars.columns:
            raise ValueError(f"no magnitude {band}")
        out = out.where(F.col(band) < brighter)
    if radius is not None:
        if lon is None or lat is None:
            raise ValueError("a radius needs a pointing")
        r = lambda v: F.radians(F.lit(v) if isinstance(v, float) else F.col(v))
        apart = F.degrees(separation(r(star_lon), r(star_lat), r(float(lon)), r(float(lat))))
        out = out.withColumn("separation", apart).where(F.col("separation") < radius)
    return out


def _within(camera: Camera, reach: float) -> Callable[[Column, Column], Column]:
    """Function of a place: all pixels, in order, that are nearer to it than reach, and a few more.

    A grid of square cells over the camera lists for each cell the pixels whose reach meets it. Its cells are half as wide as reach, or wider,
    so that there are at most some times as many of them as pixels. Places beyond the grid fall to its outer cells; nothing is in their reach.
    """
    if not 0 < reach < math.inf:
        return lambda x, y: indices(camera.n)
    extent = max(max(v) - min(v) for v in (camera.x, camera.y))
    step = max(reach / 2, extent / (4 * math.sqrt(camera.n)))
    margin = reach + 1e-9 * (step + max(map(abs, (*camera.x, *camera.y))))  # rounding at the edge of a cell loses no pixel
    left, low = min(camera.x) - margin, min(camera.y) - margin
    columns, rows = (int((max(v) + margin - start) / step) + 1 for v, start in ((camera.x, left), (camera.y, low)))
    cells = [[] for _ in range(columns * rows)]
    met = lambda v, start: range(max(int((v - margin - start) / step), 0), int((v + margin - start) / step) + 1)
    for i, (a, b) in enumerate(zip(camera.x, camera.y, strict=True)):
        for r in met(b, low):
            for c in met(a, left):
                cells[r * columns + c].append(i)
    table = F.from_json(F.lit(json.dumps(cells)), "array<array<int>>")  # a constant, folded once; literals one by one would slow the planning of large cameras
    of = lambda v, start, n: F.least(F.greatest(F.floor((v - start) / step), F.lit(0)), F.lit(n - 1))
    return lambda x, y: table[of(y, low, rows) * columns + of(x, left, columns)]


def pixel_at(x: Column, y: Column, camera: Camera, circumradius: float) -> Column:
    """Pixel that holds a place, null outside of all; for pixels of one shape and size.

    The nearest centre counts if it is nearer than the circumradius. At the border a place must also lie in an inner pixel
    when moved there, as the nearest centre alone does not bound a pixel without neighbours.
    """
    xs, ys, border = numbers(camera.x), numbers(camera.y), camera.border()
    inner = next((i for i, b in enumerate(border) if not b), None)
    edge = F.array(*[F.lit(b) for b in border])
    near = _within(camera, circumradius)

    def nearest(p: Column) -> Column:
        d = F.transform(near(p["x"], p["y"]), lambda i: F.struct(F.hypot(xs[i] - p["x"], ys[i] - p["y"]).alias("d"), i.alias("i")))
        return let(F.array_min(d), lambda v: F.when(v["d"] < circumradius, v["i"]))

    def place(px: Column, py: Column) -> Column:
        return F.struct(px.alias("x"), py.alias("y"))

    def checked(p: Column, i: Column) -> Column:
        if inner is None:
            return i
        moved = let(place(p["x"] - xs[i] + camera.x[inner], p["y"] - ys[i] + camera.y[inner]), nearest)
        return F.when(~edge[i] | (moved == inner), i)

    return let(place(x, y), lambda p: let(nearest(p), lambda i: F.when(i.isNotNull(), checked(p, i))))
