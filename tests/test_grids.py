"""Hexagonal grids, places on the earth and the scan of cuts against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from eventloom.functions import coords, geodesy
from eventloom.operators import hexgrid, images, optimise, response


@pytest.mark.parametrize("rotation", [0.0, 0.33, math.pi / 2])
def test_hexagonal_camera(spark, rotation):
    x, y = hexgrid.spiral(4, 0.05, rotation)
    order = random.Random(1).sample(range(61), 61)
    x, y = [x[i] + 0.3 for i in order], [y[i] - 0.1 for i in order]
    g = hexgrid.HexGrid.from_places(x, y)
    assert len(x) == 61 and max(g.shape) <= 9 and g.neighbors() == images.Camera.from_places(x, y, 1.2).neighbors
    rng = random.Random(2)
    rows = [(i, [rng.random() for _ in x]) for i in range(5)] + [(9, None)]
    d = spark.createDataFrame(rows, "i int, image array<double>").withColumn("rect", g.to_rectangle(F.col("image"))).withColumn("back", g.from_rectangle(F.col("rect")))
    for r in d.collect():
        assert r.back == r.image
        if r.image:
            assert sum(v is not None for row in r.rect for v in row) == 61 and all(r.rect[a][b] == v for a, b, v in zip(g.q, g.r, r.image, strict=True))
    places = [(rng.uniform(0.0, 0.6), rng.uniform(-0.4, 0.2)) for _ in range(400)] + [(a, b) for a, b in zip(x, y, strict=True)] + [(1e300, 0.0), (None, 1.0), (math.nan, 0.0)]
    got = spark.createDataFrame(places, "x double, y double").coalesce(1).select("x", "y", g.pixel_at(F.col("x"), F.col("y")).alias("p")).collect()
    for r in got:
        if r.x is None or math.isnan(r.x) or r.x > 1e9:
            assert r.p is None
            continue
        # among all cells of the plane the nearest one; its hexagon holds the place
        d, i = min((math.hypot(r.x - a, r.y - b), i) for i, (a, b) in enumerate(zip(x, y, strict=True)))
        if d < 0.024:
            assert r.p == i
        elif d > 0.05 / math.sqrt(3) + 1e-9:
            assert r.p is None
        else:
            assert r.p in (i, None)
    with pytest.raises(ValueError):
        hexgrid.HexGrid.from_places([0.0, 1.0, 0.4], [0.0, 0.0, 0.4])


def test_skewing(spark):
    x, y = hexgrid.spiral(3, 1.0, 0.4 + math.pi / 2)
    d = spark.createDataFrame(list(zip(x, y, strict=True)), "x double, y double").coalesce(1)
    u, v = hexgrid.unskew(F.col("x"), F.col("y"), -0.4)
    got = d.select("x", "y", u.alias("u"), v.alias("v")).collect()
    assert len({round(r.u, 6) for r in got}) == len({round(r.v, 6) for r in got}) == 7
    a, b = hexgrid.reskew(F.col("u"), F.col("v"), -0.4)
    back = spark.createDataFrame(got, "x double, y double, u double, v double").select("x", "y", a.alias("a"), b.alias("b")).collect()
    assert all(r.a == pytest.approx(r.x, abs=1e-12) and r.b == pytest.approx(r.y, abs=1e-12) for r in back)


def test_places_on_the_earth(spark):
    rng = random.Random(3)
    rows = [(rng.uniform(-1.57, 1.57), rng.uniform(-3.14, 3.14), rng.uniform(-100, 9000), rng.uniform(-3e4, 3e4), rng.uniform(-3e4, 3e4), rng.uniform(-500, 500)) for _ in range(200)]
    rows += [(math.pi / 2, 0.0, 10.0, 0.0, 0.0, 0.0), (-math.pi / 2, 1.0, 0.0, 5.0, 5.0, 5.0), (0.0, math.pi, 0.0, 0.0, 0.0, 0.0)]
    d = spark.createDataFrame(rows, "lat double, lon double, h double, x double, y double, z double")
    c = F.col
    d = d.withColumn("e", F.array(*geodesy.ground_to_earth(c("x"), c("y"), c("z"), c("lat"), c("lon"), c("h"))))
    d = d.withColumn("g", F.array(*geodesy.geodetic(c("e")[0], c("e")[1], c("e")[2])))
    d = d.withColumn("f", F.array(*geodesy.geocentric(c("g")[0], c("g")[1], c("g")[2])))
    d = d.withColumn("b", F.array(*geodesy.earth_to_ground(c("f")[0], c("f")[1], c("f")[2], c("lat"), c("lon"), c("h"))))
    for r in d.collect():
        assert r.b == pytest.approx([r.x, r.y, r.z], abs=1e-6)  # a thousandth of a millimetre
        assert r.f == pytest.approx(r.e, abs=1e-6)
    # a point straight up keeps its latitude and longitude; one to the west has less longitude
    up = spark.createDataFrame([(0.5, -0.3, 2200.0)], "lat double, lon double, h double")
    at = lambda x, y, z: F.array(*geodesy.geodetic(*geodesy.ground_to_earth(F.lit(x), F.lit(y), F.lit(z), c("lat"), c("lon"), c("h"))))
    r = up.select(at(0.0, 0.0, 100.0).alias("u"), at(0.0, 100.0, 0.0).alias("w"), at(100.0, 0.0, 0.0).alias("n")).first()
    assert r.u == pytest.approx([0.5, -0.3, 2300.0], abs=1e-9) and r.w[1] < -0.3 and r.n[0] > 0.5
    known = spark.range(1).select(F.array(*geodesy.geocentric(F.radians(F.lit(28.7622)), F.radians(F.lit(-17.8925)), F.lit(2147.0))).alias("p")).first().p
    assert math.sqrt(sum(v * v for v in known)) == pytest.approx(6375395, abs=1500)


def test_impact_distance_in_two_ways(spark):
    """The distance from the axis, and that in the plane across it, are the same."""
    rng = random.Random(4)
    rows = [(rng.uniform(-200, 200), rng.uniform(-200, 200), rng.uniform(0.6, 1.57), rng.uniform(0, 6.28), rng.uniform(-300, 300), rng.uniform(-300, 300), rng.uniform(-20, 20)) for _ in range(100)]
    c = F.col
    d = spark.createDataFrame(rows, "cx double, cy double, alt double, az double, x double, y double, z double")
    a = coords.ground_to_tilted(c("x"), c("y"), c("z"), c("alt"), c("az"))
    b = coords.ground_to_tilted(c("cx"), c("cy"), F.lit(0.0), c("alt"), c("az"))
    got = d.select(coords.impact_distance(c("cx"), c("cy"), c("alt"), c("az"), c("x"), c("y"), c("z")).alias("p"), F.hypot(a[0] - b[0], a[1] - b[1]).alias("q")).collect()
    assert all(r.p == pytest.approx(r.q, rel=1e-9) for r in got)


def sensitivity(s, b, alpha):
    off = b / alpha

    def significance(on):
        total = on + off
        if total <= 0:
            return 0.0
        t = (on * math.log((1 + alpha) / alpha * on / total) if on > 0 else 0) + (off * math.log((1 + alpha) * off / total) if off > 0 else 0)
        return math.copysign(math.sqrt(2 * max(t, 0)), on - alpha * off) if on != alpha * off else 0.0

    lo, hi = -8.0, 8.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if significance(s * 10**mid + b) >= 5 else (mid, hi)
    return max(10**hi, 10 / s, 0.05 * b / s)


def test_scan_of_cuts_by_loops(spark):
    rng = random.Random(5)
    event = lambda good: (10 ** rng.uniform(-1.2, 1.2), rng.randint(1, 6), abs(rng.gauss(0, 0.1)) if good else rng.uniform(0, 1), rng.betavariate(4, 2) if good else rng.betavariate(2, 3), rng.uniform(0.5, 1.5), rng.uniform(0, 1.4))
    signal, background = [event(True) for _ in range(1500)], [event(False) for _ in range(3000)]
    odd = [(None, 3, 0.1, 0.5, 1.0, 0.5), (1.0, 3, math.nan, 0.5, 1.0, 0.5), (1.0, 0, 0.1, 0.5, 1.0, 0.5), (1e9, 3, 0.1, 0.5, 1.0, 0.5)]
    schema = "energy double, mult int, theta double, score double, w double, off double, bin int"
    frame = lambda rows: spark.createDataFrame([(*r, 7) for r in rows], schema)
    energies, mults, thetas, scores = [0.1, 0.5, 2.0, 10.0, 20.0], [2, 3, 4], [0.02 * i for i in range(1, 21)], [0.02 * i for i in range(50)]
    te, se, alpha = [0.3, 0.5, 0.7], [0.2, 0.4, 0.6, 0.8, 0.95], 0.2
    got = {r.bin: r for r in optimise.optimise(frame(signal + odd), frame(background), "energy", "mult", "theta", "score", "w", "off", energies, mults, thetas, scores, te, se, (0.0, 1.0), alpha).collect()}
    for k, (lo, hi) in enumerate(zip(energies, energies[1:], strict=False)):
        s = [e for e in signal if lo <= e[0] < hi]
        b = [e for e in background if lo <= e[0] < hi and 0 <= e[5] < 1]
        best = None
        for m in mults:
            sm = [e for e in s if e[1] >= m and e[3] >= scores[0]]
            for i, f in enumerate(te):
                inside = lambda t: sum(e[4] for e in sm if e[2] <= t)  # noqa: B023, E731
                fits = [t for t in thetas if inside(t) >= f * sum(e[4] for e in sm) * (1 - 1e-12)]
                if not sm or not fits:
                    continue
                t = fits[0]
                for j, h in enumerate(se):
                    keep = lambda c: sum(e[4] for e in sm if e[2] <= t and e[3] >= c)  # noqa: B023, E731
                    c = [c for c in scores if keep(c) >= h * keep(scores[0]) * (1 - 1e-12)][-1]
                    nb = sum(e[4] for e in b if e[1] >= m and e[3] >= c) * t * t
                    if keep(c) > 0:
                        x = (sensitivity(keep(c), nb * alpha, alpha), m, i, j, t, c, keep(c), nb)
                        best = x if best is None or x[0] < best[0] - 1e-12 else best
        assert (k in got) == (best is not None)
        if best:
            r = got[k]
            assert (r.multiplicity, r.theta, r.score) == (best[1], pytest.approx(best[4]), pytest.approx(best[5])), k
            assert (r.n_signal, r.n_background, r.sensitivity) == (pytest.approx(best[6]), pytest.approx(best[7]), pytest.approx(best[0], rel=1e-6))
    assert response.relative_sensitivity is optimise.relative_sensitivity
