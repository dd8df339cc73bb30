"""Muon rings and their light against plain formulas and known rings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions import muon, special
from eventloom.operators import images, muon_fit

CAMERA = images.Camera.rectangular(27, 27, -0.035, 0.035)
PIXEL = 0.07 / 26
MADE = None
SQUARE = {"pixel": PIXEL, "shape": muon.CIRCLE_IN_SQUARE}


def test_error_function(spark):
    xs = [0.0, 1e-320, 1e-9, 0.1, 0.46874, 0.46876, 0.9, 2.5, 3.9999, 4.0001, 5.5, 9.0, 25.0, 30.0]
    xs += [-x for x in xs]
    d = spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1)
    got = d.select(special.erf(F.col("x")).alias("e"), special.erfc(F.col("x")).alias("c")).collect()
    for x, r, n in zip(xs, got, special.np_erfc(np.array(xs)), strict=True):
        assert r.e == pytest.approx(math.erf(x), rel=1e-15, abs=1e-18), x
        assert r.c == pytest.approx(math.erfc(x), rel=1e-13, abs=1e-290), x
        assert n == pytest.approx(math.erfc(x), rel=1e-13, abs=1e-290), x
    tail = d.limit(1).select(special.normal_between(F.lit(9.0), F.lit(9.5), F.lit(0.0), F.lit(1.0)).alias("t")).first().t
    assert tail == pytest.approx((math.erfc(9 / math.sqrt(2)) - math.erfc(9.5 / math.sqrt(2))) / 2, rel=1e-12)


def rings(spark):
    rows = [(i, 0.002 * (i % 3 - 1), 0.003 * (i % 4 - 1.5), 0.017 + 0.0004 * i, 3.0 + 0.7 * i, -2.5 + 0.7 * i, 0.0009 + 0.00006 * i, 0.12 + 0.02 * i) for i in range(8)]
    d = spark.createDataFrame(rows, "i int, x double, y double, r double, impact double, phi double, width double, eff double")
    light = muon.pixel_light(CAMERA.x, CAMERA.y, F.col("impact"), F.col("phi"), F.col("x"), F.col("y"), F.col("r"), F.col("width"), PIXEL, 12.0, 2.0, shape=muon.CIRCLE_IN_SQUARE)
    global MADE
    if MADE is None:
        MADE = [(*r[:-1], r.image, [v > 0.5 for v in r.image]) for r in d.select("*", F.transform(light, lambda v: v * F.col("eff")).alias("image")).collect()]
    return spark.createDataFrame(MADE, d.schema.simpleString()[7:-1].replace(":", " ") + ", image array<double>, mask array<boolean>"), rows


def test_rings_are_found_beside_a_spot(spark):
    d, rows = rings(spark)
    spot = F.transform("image", lambda v, i: v + F.when(i.isin(0, 1, 27, 28, 54, 729 - 1), 6.0).otherwise(0.0))
    d = d.withColumn("image", spot).withColumn("mask", F.transform("image", lambda v: v > 0.5))
    one = {r.i: r for r in muon_fit.fit_rings(d, CAMERA, rounds=1).collect()}
    got = {r.i: r for r in muon_fit.fit_rings(d, CAMERA, rounds=10).collect()}
    for i, x, y, r, *_ in rows:
        off = lambda ring: math.hypot(ring.x - x, ring.y - y) + abs(ring.radius - r)  # noqa: B023, E731
        assert off(got[i].ring) < min(0.0015, off(one[i].ring) / 2), (i, off(got[i].ring), off(one[i].ring))
        assert 0 < got[i].ring.radius_err == got[i].ring.x_err / 2 and abs(got[i].ring.distance - math.hypot(got[i].ring.x, got[i].ring.y)) < 1e-15
        d2 = np.hypot(np.array(CAMERA.x) - got[i].ring.x, np.array(CAMERA.y) - got[i].ring.y)
        assert got[i].ring_mask == (np.abs(d2 - got[i].ring.radius) < 0.4 * got[i].ring.radius).tolist()
    again = {r.i: r.ring for r in muon_fit.fit_rings(d, CAMERA, rounds=25).collect()}
    assert all(again[i] == got[i].ring for i in got)  # nothing moves any more


def test_light_is_recovered(spark):
    d, rows = rings(spark)
    known = F.struct(F.col("r").alias("radius"), F.col("x").alias("x"), F.col("y").alias("y"))
    d = d.withColumn("ring", known).withColumn("ring_mask", F.transform("image", lambda v: v >= 0))
    got = {r.i: r.efficiency for r in muon_fit.fit_light(d, CAMERA, 12.0, 2.0, **SQUARE).collect()}
    for i, _, _, r, impact, phi, width, eff in rows:
        e = got[i]
        assert e.is_valid and not e.parameters_at_limit
        assert abs(e.impact - impact) < 3 * e.impact_err and abs(math.remainder(e.phi - phi, 2 * math.pi)) < 3 * e.phi_err, i
        assert abs(e.width - width) < 3 * e.width_err and abs(e.optical_efficiency - eff) < 3 * e.optical_efficiency_err, i
        assert e.optical_efficiency == pytest.approx(eff, rel=0.06) and e.impact == pytest.approx(impact, rel=0.1)
        assert (e.impact_x, e.impact_y) == (pytest.approx(e.impact * math.cos(e.phi)), pytest.approx(e.impact * math.sin(e.phi)))
        assert 0 < e.optical_efficiency_err < 0.1 and e.width_err > 0


def test_features_by_hand(spark):
    d, rows = rings(spark)
    d = d.withColumn("image", F.transform("image", lambda v, i: v + (i % 7) * 0.05))
    got = muon_fit.features(muon_fit.fit_rings(d, CAMERA), CAMERA, threshold=3.0).collect()
    for r in got:
        q, m = np.array(r.image), np.array(r.mask)
        x, y, radius = r.ring.x, r.ring.y, r.ring.radius
        dist = np.hypot(np.array(CAMERA.x) - x, np.array(CAMERA.y) - y)
        inner = np.abs(dist - radius) < 0.25 * radius
        outer = ~inner & (np.abs(dist - radius) < 0.45 * radius)
        f = r.muon
        assert f.ring_intensity == pytest.approx(q[inner].sum()) and f.intensity_outside_ring == pytest.approx(q[~inner & m].sum())
        assert f.n_pixels_in_ring == (inner & m).sum() and f.mean_intensity_outside_ring == pytest.approx(q[outer].mean())
        assert f.mean_squared_error == pytest.approx((q * m * (dist - radius) ** 2).sum() / (q * m).sum())
        mean = np.average(dist, weights=q)
        std = math.sqrt(np.average((dist - mean) ** 2, weights=q))
        assert f.radial_std_dev == pytest.approx(std) and f.skewness == pytest.approx(np.average((dist - mean) ** 3, weights=q) / std**3)
        assert f.excess_kurtosis == pytest.approx(np.average((dist - mean) ** 4, weights=q) / std**4 - 3)
        near = np.abs(dist - radius) <= 0.75 * math.sqrt(CAMERA.area)
        assert f.intensity_ratio == pytest.approx((q * m)[near].sum() / (q * m).sum())
        assert 0 < f.completeness <= 1 and 0 < f.containment <= 1


def test_circles_and_errors(spark):
    """Circles as the column expression has them, errors by the formula."""
    rng = np.random.default_rng(0)
    small = images.Camera.rectangular(6, 6)
    x, y = np.array(small.x), np.array(small.y)
    w = rng.random((20, 36)) * (rng.random((20, 36)) < 0.7)
    ring = muon_fit._circles(w, x, y)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(w)], "i int, w array<double>")
    got = {r.i: r.c for r in d.select("i", images.taubin_circle_fit(F.col("w"), small).alias("c")).collect()}
    assert np.allclose(ring, [(got[i].radius, got[i].x, got[i].y) for i in range(20)], rtol=1e-6)
    e = muon_fit._errors(w, x, y, ring)
    for i in range(20):
        d2 = (x - ring[i, 1]) ** 2 + (y - ring[i, 2]) ** 2
        std = lambda a: math.sqrt(np.average((a - np.average(a, weights=w[i])) ** 2, weights=w[i]))  # noqa: B023, E731
        assert e[i] == pytest.approx(std(d2 - ring[i, 0] ** 2) / std(np.sqrt(d2 + ring[i, 0] ** 2 / 4)) / w[i].sum() / 2 / math.sqrt(2))


def test_odd_images(spark):
    n = CAMERA.n
    row = [float(i // 27 == 3) * 9 for i in range(n)]  # pixels on a line
    rows = [(1, None, None), (2, [0.0] * n, None), (3, row, None), (4, [None] * n, [True] * n), (5, [0.0] * n, [False] * n)]
    d = spark.createDataFrame(rows, "i int, image array<double>, mask array<boolean>").coalesce(1)
    got = {r.i: r for r in muon_fit.process(d, CAMERA, 12.0, 2.0, **SQUARE).collect()}
    assert len(got) == 5 and all(r.ring is None and r.muon is None and r.efficiency is None for r in got.values())
    assert muon_fit.process(d.limit(0), CAMERA, 12.0).count() == 0
    full, _ = rings(spark)
    out = muon_fit.process(full, CAMERA, 12.0, 2.0, **SQUARE)
    assert {r.i for r in out.where("efficiency is not null").collect()} == set(range(8))
    assert muon_fit.process(full, CAMERA, 12.0, 2.0, least_pixels=100_000, **SQUARE).where("efficiency is not null").count() == 0
