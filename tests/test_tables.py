"""Small inputs with known results: tables by offset, sensitivity, splines, aberration, values valid early."""

import math

import pytest
from pyspark.sql import functions as F

from eventloom.functions import atmosphere, muon, optics, waveforms
from eventloom.functions.common import nested
from eventloom.operators import images, instrument, lookup, response_fov


def test_spline_keeps_points_and_ends(spark):
    a = atmosphere.Table([-1.0, 0, 3000, 7000, 12000, 20000, 25000], [9.0, 1.2e-3, 9e-4, 6e-4, 3e-4, 9e-5, 0.0], [2000.0, 1000, 700, 420, 200, 60, 5])
    d = spark.createDataFrame([(0.0,), (3000.0,), (7000.0,), (20000.0,), (-1.0,), (20000.1,), (math.nan,), (None,)], "h double").coalesce(1)
    rows = d.select(a.density(F.col("h")), a.overburden(F.col("h")), a.height_from_overburden(a.overburden(F.col("h")))).collect()
    for r, want in zip(rows, [(1.2e-3, 1000, 0), (9e-4, 700, 3000), (6e-4, 420, 7000), (9e-5, 60, 20000)], strict=False):
        assert tuple(r) == pytest.approx(want, rel=1e-9, abs=1e-6)
    assert math.isnan(rows[4][0]) and tuple(rows[5]) == (0.0, 0.0, math.inf) and math.isnan(rows[6][0]) and rows[7][0] is None
    with pytest.raises(ValueError, match="four"):
        atmosphere.Table([0.0, 1, 2], [1.0] * 3, [1.0] * 3).density(F.col("h"))


def test_coma_is_a_density(spark):
    """Its sum over the camera is near 1 but for what lies beyond the chord; within the central pixel it is exactly 1."""
    wide = optics.Coma((0.5, 0.5, 0.0), (0.02, 0.0, 0.0, 0.0), (0.02, 0.5, 1e-4), 0.2)
    step = 0.004
    grid = [(x * step + 1.5, y * step) for x in range(-100, 101) for y in range(-100, 101)]
    d = spark.createDataFrame(grid, "lon double, lat double")
    assert d.agg(F.sum(wide.density(F.col("lon"), F.col("lat"), F.lit(1.5), F.lit(0.0)))).first()[0] * step**2 == pytest.approx(1, abs=0.05)
    one = d.select(wide.density(F.col("lon") - 1.5, F.col("lat"), F.lit(0.01), F.lit(0.0)).alias("p"))
    assert one.agg(F.sum("p")).first()[0] * step**2 == pytest.approx(1, abs=0.02)
    assert d.limit(1).select(wide.density(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0), F.lit(0.0))).first()[0] is None


def test_background_interpolates_the_cuts(spark):
    cuts = spark.createDataFrame([(0, 0.0, 2.0, 0.2), (1, 2.0, 4.0, 0.4)], "bin int, low double, high double, cut double")
    ev = spark.createDataFrame([(0.25, 0.5, 2.0), (1.75, 0.5, 1.0), (3.9, 1.5, 1.0), (9.0, 0.5, 1.0), (None, 0.5, 1.0), (1.75, math.nan, 1.0)], "e double, o double, w double")
    got = {(r.bin, r.ring): r.n_background for r in response_fov.background_counts(ev, "e", "o", "w", [0.0, 1.0, 2.0, 4.0], [0.0, 1.0, 2.0], cuts, 0.2).collect()}

    def cone(a, b=0.0):
        return math.cos(math.radians(b)) - math.cos(math.radians(a))

    want = {(0, 0): 2 * cone(0.2) / cone(1.0) / 0.2, (1, 0): cone(0.25) / cone(1.0) / 0.2, (2, 1): cone(0.4) / cone(2.0, 1.0) / 0.2}
    assert got == pytest.approx({(b, r): want.get((b, r), 0.0) for b in range(3) for r in range(2)})


def test_tables_without_events(spark):
    none = spark.createDataFrame([], "e double, r double, o double, w double")
    edges, rings = [1.0, 2.0, 4.0], [0.0, 1.0]
    assert [(r.n, r.bias, r.resolution) for r in response_fov.bias_resolution(none, "e", "r", "o", edges, rings).collect()] == [(0, None, None)] * 2
    assert {r.area for r in response_fov.effective_area(none, none, "e", "o", edges, rings, 1.0).collect()} == {None}
    assert {r.density for r in response_fov.energy_dispersion(none, "e", "r", "o", edges, [0.0, 2.0], rings).collect()} == {0.0}
    cuts = spark.createDataFrame([(0, 1.0, 4.0, 0.2)], "bin int, low double, high double, cut double")
    assert {r.relative_sensitivity for r in response_fov.sensitivity(none, none, "e", "o", "w", edges, rings, cuts, 0.2).collect()} == {None}


def test_valid_energies():
    assert response_fov.valid_energies([(1.0, 2.0, False), (2.0, 3.0, True), (3.0, 4.0, True)]) == (2.0, 4.0)
    for bins in ([(1.0, 2.0, True), (2.0, 3.0, False), (3.0, 4.0, True)], [(1.0, 2.0, False)], []):
        with pytest.raises(ValueError, match="gap"):
            response_fov.valid_energies(bins)


def test_early_values(spark):
    """Only the first row reaches back, and only by the tolerance."""
    left = spark.createDataFrame([("a", 8.9), ("a", 9.0), ("a", 14.9), ("a", 15.0), ("a", 99.0), ("b", 1.0)], "k string, t double")
    right = spark.createDataFrame([("a", 10.0, 1), ("a", 15.0, 2)], "k string, rt double, v int")
    got = lookup.asof_valid(left, right, ["k"], "t", "rt", ["v"], ["v"], F.lit(1.0))
    assert {(r.k, r.t): (r.rt, r.v) for r in got.collect()} == {("a", 8.9): (None, None), ("a", 9.0): (10.0, 1), ("a", 14.9): (10.0, 1), ("a", 15.0): (15.0, 2), ("a", 99.0): (15.0, 2), ("b", 1.0): (None, None)}
    strict = lambda d: lookup.asof_valid(d, right, ["k"], "t", "rt", ["v"], ["v"], F.lit(1.0), strict=True)
    assert strict(left.where("k = 'a' and t >= 9")).count() == 4
    with pytest.raises(Exception, match="no values valid at 8.9"):
        strict(left.where("k = 'a'")).collect()


def _path(radius, rho, phi):
    inside = 1 - (rho * math.sin(phi)) ** 2
    if inside < 0:
        return 0.0
    if rho <= 1:
        return radius * (math.sqrt(inside) + rho * math.cos(phi))
    return 2 * radius * math.sqrt(inside) if abs(math.sin(phi)) < 1 / rho and math.cos(phi) > 0 else 0.0


@pytest.mark.parametrize("impact", [0.5, 3.0, 15.0])
def test_light_of_a_ring(spark, impact):
    """Each pixel against the same sums in plain Python, with the library's error function."""
    camera, pixel, phi, cx, cy, radius, width = images.Camera.rectangular(9, 9, -0.02, 0.02), 0.005, 0.7, 0.001, -0.002, 0.0131, 0.0012
    one = muon.pixel_light(camera.x, camera.y, F.lit(impact), F.lit(phi), F.lit(cx), F.lit(cy), F.lit(radius), F.lit(width), pixel, 12.0, 2.0)
    got = spark.range(1).select(one).first()[0]
    n = int(2 * math.pi * radius / pixel) * 3
    raw = [_path(12.0, impact / 12, -math.pi + 2 * math.pi * i / (n - 1) - phi) - _path(2.0, impact / 2, -math.pi + 2 * math.pi * i / (n - 1) - phi) for i in range(n)]
    smooth = [(raw[i - 1] + raw[i] + raw[(i + 1) % n]) / 3 for i in range(n)]
    for x, y, g in zip(camera.x, camera.y, got, strict=True):
        r, at = math.hypot(x - cx, y - cy), (math.atan2(y - cy, x - cx) + math.pi) / (2 * math.pi) * (n - 1)
        low = min(int(at), n - 2)
        along = smooth[low] + (smooth[low + 1] - smooth[low]) * (at - low)
        part = [math.erf((r + s * pixel / 2 - radius) / math.sqrt(2) / width) / 2 for s in (1, -1)]
        want = along * (part[0] - part[1]) / 137.035999 * (1 / 300e-9 - 1 / 600e-9) * pixel / radius * math.sin(2 * radius) / 2 * muon.CIRCLE_IN_HEXAGON
        assert g == pytest.approx(want, rel=1e-4, abs=1e-3)
    small = muon.pixel_light(camera.x, camera.y, F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0001), F.lit(width), pixel, 12.0)
    assert spark.range(1).select(small).first()[0] is None


@pytest.mark.parametrize("clipping", [0.0, 0.5])
def test_sharpened_peak(spark, clipping):
    """A decaying pulse becomes a single sample; a pixel takes the peak its neighbours show."""
    pulse = [0.0] * 4 + [8 * 0.5**i for i in range(12)]
    late = [0.0] * 9 + [4 * 0.5**i for i in range(7)]
    d = spark.createDataFrame([([pulse, late, [0.0] * 16],)], "w array<array<double>>")
    got = d.select(waveforms.sharpened_peak(F.col("w"), nested([(0,), (1,), (0,)]), 3, 1, 0.5, 1, 2.0, clipping=clipping, gain=2.0, delay=0.5)).first()[0]
    assert [tuple(r) for r in got] == [pytest.approx(v) for v in ((4.0, 4 / 2 - 0.5), (2.0, 9 / 2 - 0.5), (0.0, 4 / 2 - 0.5))]
    edge = d.select(waveforms.sharpened_peak(F.col("w"), nested([(0,), (1,), (0,)]), 3, 1, 0.5, 1, 2.0, clipping=clipping, limit=0.1)).first()[0]
    assert [r.peak_time for r in edge] == pytest.approx([2.0, 4.5, 2.0])


def test_array_and_stars_refuse(spark):
    t = spark.createDataFrame([(1, "L", 3000.0, 4000.0), (2, "M", 0.0, 10.0)], "tel_id int, type string, x double, y double")
    assert [r.tel_id for r in instrument.of_type(t, "L").collect()] == [1] and instrument.select_subarray(t, [2]).count() == 1
    assert instrument.footprint(t).first()[0] == pytest.approx(25 * math.pi) and instrument.footprint(t.limit(0)).first()[0] is None
    for wrong in (lambda: instrument.of_type(t, "S"), lambda: instrument.select_subarray(t, [2, 3]), lambda: instrument.select_stars(t, brighter=1.0), lambda: instrument.select_stars(t, radius=1.0)):
        with pytest.raises(ValueError):
            wrong()
    places = spark.createDataFrame([(0.0, 0.0), (-1.49, 1.49), (-1.51, 0.0), (9.0, 0.0), (None, 0.0)], "x double, y double").coalesce(1)
    assert [r[0] for r in places.select(instrument.pixel_at(F.col("x"), F.col("y"), images.Camera.rectangular(3, 3), math.sqrt(0.5))).collect()] == [4, 6, None, None, None]
