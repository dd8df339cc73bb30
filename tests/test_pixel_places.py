"""A place is held against the pixels near it; the pixel is the one that a search of the whole camera finds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import images, instrument

HEX = [(a + (b % 2) / 2, b * math.sqrt(3) / 2) for a in range(6) for b in range(6)]
CAMERAS = {
    "square": (images.Camera.rectangular(6, 5), 0.36),
    "hexagons": (images.Camera.from_places(*zip(*HEX, strict=True), 1.2), 1 / math.sqrt(3)),
    "far and turned": (images.Camera(*[tuple(v + 1e4 for v in c) for c in (images.Camera.rectangular(6, 6).rotated(0.4).x, images.Camera.rectangular(6, 6).rotated(0.4).y)], images.Camera.rectangular(6, 6).neighbors), math.sqrt(2) / 5),
    "two pixels at one place": (images.Camera((0.0, 0.0, 1.0, 1.0), (0.0, 0.0, 0.0, 1.0), ((1,), (0,), (3,), (2,))), 0.7),
    "no bound": (images.Camera.rectangular(3, 3), math.inf),
    "no pixel": (images.Camera.rectangular(3, 3), 0.0),
}


def searched(x, y, camera, reach):
    """By the whole camera, the first of the nearest pixels; at the border the place must lie in an inner pixel too."""
    border = camera.border()
    inner = next((i for i, b in enumerate(border) if not b), None)

    def nearest(px, py):
        d = [math.hypot(a - px, b - py) for a, b in zip(camera.x, camera.y, strict=True)]
        return d.index(min(d)) if min(d) < reach else None

    if x is None or y is None or not math.isfinite(x + y):
        return None
    i = nearest(x, y)
    if i is None or inner is None or not border[i]:
        return i
    return i if nearest(x - camera.x[i] + camera.x[inner], y - camera.y[i] + camera.y[inner]) == inner else None


@pytest.mark.parametrize("name", CAMERAS)
def test_pixel_as_by_the_whole_camera(spark, name):
    camera, reach = CAMERAS[name]
    r = random.Random(1)
    span = lambda v: (min(v) - 1.5, max(v) + 1.5)
    places = [(r.uniform(*span(camera.x)), r.uniform(*span(camera.y))) for _ in range(1500)] + [*zip(camera.x, camera.y, strict=True)] * 2
    odd = [None, math.nan, math.inf, -math.inf, 1e300, -1e300, camera.x[0]]
    places += [(a, b) for a in odd for b in odd]
    d = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "i int, x double, y double").coalesce(2)
    got = [q.p for q in d.select("i", instrument.pixel_at(F.col("x"), F.col("y"), camera, reach).alias("p")).orderBy("i").collect()]
    assert got == [searched(*p, camera, reach) for p in places]


def test_no_search_of_the_whole_camera(spark):
    """The places are computed once, and their distances for the pixels of a cell only."""
    camera = images.Camera.rectangular(20, 20)
    plan = spark.range(1).select(instrument.pixel_at(F.sin("id"), F.cos("id"), camera, math.sqrt(2) / 19).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SIN(") == plan.count("COS(") == 1 and "from_json" not in plan
    within = instrument._within(camera, math.sqrt(2) / 19)
    near = spark.range(2000).select(F.size(within(F.sin("id") * 2, F.cos(F.col("id") * 7) * 2)).alias("n"))
    assert near.agg(F.max("n")).first()[0] <= 9
