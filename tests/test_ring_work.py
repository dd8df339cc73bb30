"""The circle through weighted pixels reads its weights once, whatever expression they are."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import images, muon_fit

CAMERA = images.Camera.rectangular(6, 6)


def test_weights_are_computed_once(spark):
    fit = str(images.taubin_circle_fit(F.sqrt(F.col("image_weights")), CAMERA))
    assert fit.count("image_weights") == fit.count("arrays_zip") == 1


def test_circles_of_odd_weights(spark):
    """Missing weights count as 0, also at the end; no circle without weights, for pixels on a line, or for more weights than pixels."""
    rng = np.random.default_rng(1)
    some = [[float(v) if v > 0.3 else 0.0 for v in rng.random(36)] for _ in range(6)]
    holes = [[v or None for v in w] for w in some]
    line = [1.0 + i % 6 if 12 <= i < 18 else 0.0 for i in range(36)]
    none = [[0.0] * 36, [None] * 36, None, line, [], [1.0] * 38]
    d = spark.createDataFrame(list(enumerate(some + some + holes + [[1.0] * 18, [1.0] * 18 + [0.0] * 18] + none)), "i int, w array<double>").coalesce(2)
    got = [tuple(r.c) if r.c else (None,) * 3 for r in d.select("i", images.taubin_circle_fit(F.col("w"), CAMERA).alias("c")).orderBy("i").collect()]
    assert got[:6] == got[6:12] == got[12:18] and got[18] == got[19] != (None,) * 3 and all(r == (None,) * 3 for r in got[20:])
    assert np.allclose(got[:6], muon_fit._circles(np.array(some), np.array(CAMERA.x), np.array(CAMERA.y)), rtol=1e-6)


def test_circle_without_noise(spark):
    """Steps that change nothing are left out: the ring comes out as it went in."""
    arc = [0.3 * i for i in range(12)]
    camera = images.Camera(tuple(2 + 0.5 * math.cos(a) for a in arc), tuple(-1 + 0.5 * math.sin(a) for a in arc), ((),) * 12)
    d = spark.createDataFrame([([1.0 + 0.1 * i for i in range(12)],), ([9.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0],)], "w array<double>")
    for r in d.select(images.taubin_circle_fit(F.col("w"), camera).alias("c")).collect():
        assert tuple(r.c) == pytest.approx((0.5, 2.0, -1.0), abs=1e-9)
