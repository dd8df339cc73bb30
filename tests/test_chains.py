"""Chains with known results: a shower of known axis, calibrated waveforms, noisy rings, wrong samples."""

import math

import pytest
from pyspark.sql import functions as F

from eventloom.functions import waveforms
from eventloom.operators import geometry, images, preprocess


def test_geometry_finds_the_shower(spark):
    """Telescopes look straight at the source: lines from each through a point of the axis, images along the plane of the axis."""
    alt0, az0, core = 1.2, 0.4, (30.0, -50.0)
    axis = (math.cos(alt0) * math.cos(-az0), math.cos(alt0) * math.sin(-az0), math.sin(alt0))
    top = [core[0] + axis[0] * 9000, core[1] + axis[1] * 9000, axis[2] * 9000]
    rows = []
    for tel, (x, y) in enumerate([(100.0, 0.0), (-80.0, 60.0), (0.0, -150.0)]):
        sky = []
        for k in (1.0, 1.2):
            v = [core[0] + axis[0] * 9000 * k - x, core[1] + axis[1] * 9000 * k - y, axis[2] * 9000 * k]
            n = math.sqrt(sum(c * c for c in v))
            az, alt = -math.atan2(v[1], v[0]), math.asin(v[2] / n)
            a, b = math.cos(alt) * math.cos(az - az0), math.cos(alt) * math.sin(az - az0)
            sky.append((math.atan2(b, a * math.cos(alt0) + math.sin(alt) * math.sin(alt0)), math.asin(-a * math.sin(alt0) + math.sin(alt) * math.cos(alt0))))
        psi = math.atan2(sky[1][1] - sky[0][1], sky[1][0] - sky[0][0])
        rows.append((1, tel, *sky[0], psi, 0.3, 0.1, 100.0 + tel, alt0, az0, alt0, az0, x, y, 0.0))
    rows += [(2, *rows[0][1:]), (2, *rows[1][1:6], 0.0, *rows[1][7:]), (3, 5, *[None] * 13)]
    names = "event long, tel_id long, " + ", ".join(f"{c} double" for c in ("fov_lon", "fov_lat", "psi", "length", "width", "intensity", "alt", "az", "array_alt", "array_az", "x", "y", "z"))
    out = {r.event: r for r in geometry.reconstruct(spark.createDataFrame(rows, names), ["event"], height=2000.0).collect()}
    r = out[1]
    assert r.is_valid and r.telescopes == [0, 1, 2] and r.average_intensity == pytest.approx(101)
    assert (r.alt, r.az) == pytest.approx((alt0, az0), abs=1e-4)
    assert (r.core_x, r.core_y) == pytest.approx(core, abs=0.5)
    assert r.h_max == pytest.approx(top[2] + 2000, abs=1)
    assert not out[2].is_valid and out[2].alt is None and out[2].telescopes == [0]
    assert not out[3].is_valid and out[3].telescopes == []


def test_geometry_without_rows(spark):
    names = "event long, tel_id long, " + ", ".join(f"{c} double" for c in ("fov_lon", "fov_lat", "psi", "length", "width", "intensity", "alt", "az", "array_alt", "array_az", "x", "y", "z"))
    assert geometry.reconstruct(spark.createDataFrame([], names), ["event"]).count() == 0


def test_taubin_against_a_search(spark):
    """No circle near the fitted one has a smaller loss; pixels on a line give nulls."""
    camera = images.Camera.rectangular(5, 5)
    weights = [[(7 * i * (k + 3)) % 11 / 3.0 for i in range(25)] for k in range(3)] + [[1.0 if 10 <= i < 15 else 0.0 for i in range(25)]]
    d = spark.createDataFrame(list(enumerate(weights)), "k int, w array<double>").select("k", images.taubin_circle_fit(F.col("w"), camera).alias("c"))
    for r in d.collect():
        if r.k == 3:
            assert r.c.x is None
            continue

        def loss(x, y, radius, w=weights[r.k]):
            dist = [(a - x) ** 2 + (b - y) ** 2 for a, b in zip(camera.x, camera.y, strict=True)]
            return sum((v * (q - radius**2)) ** 2 for v, q in zip(w, dist, strict=True)) / sum(v * q for v, q in zip(w, dist, strict=True))

        best = loss(r.c.x, r.c.y, r.c.radius)
        h = 1e-3
        assert all(loss(r.c.x + a * h, r.c.y + b * h, r.c.radius + c * h) >= best - 1e-12 for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1))


def test_centroid(spark):
    d = spark.createDataFrame([([0.0, 1.0, 4.0, 1.0, 0.0], 2), ([0.0, -1.0, -2.0], 1), ([0.0, 0.0, 2.0], 1)], "w array<double>, p int").coalesce(1)
    assert [r[0] for r in d.select(waveforms.centroid(F.col("w"), F.col("p"), 0.1)).collect()] == [2.0, 1.0, 2.0]


def test_preprocessing_refuses(spark):
    r = preprocess.Reconstruction("E", "G", "C")
    names = [*preprocess.KEPT, *r.names(), "subarray_pointing_frame"]
    one = spark.createDataFrame([tuple([1.0] * (len(names) - 1)) + (0,)] * 2, names)
    assert preprocess.normalise(one, r, derived=False).count() == 2
    with pytest.raises(ValueError, match="E_telescopes"):
        preprocess.normalise(one, r)
    with pytest.raises(NotImplementedError):
        preprocess.normalise(one.unionByName(one.withColumn("subarray_pointing_lat", F.lit(2.0))), r, derived=False)
    with pytest.raises(NotImplementedError):
        preprocess.normalise(one.withColumn("subarray_pointing_frame", F.lit(1)), r, derived=False)


def test_simulated_sample_refuses(spark):
    runs = spark.createDataFrame([(10, 2, *[1.0] * 6), (5, 2, *[1.0] * 6)], ["n_showers", "shower_reuse", *preprocess.SHARED])
    assert preprocess.simulated_sample(runs).first().n_showers == 30
    with pytest.raises(ValueError, match="inconsistent"):
        preprocess.simulated_sample(runs, spark.createDataFrame([(29,)], "n_entries int"))
    with pytest.raises(NotImplementedError, match="spectral_index"):
        preprocess.simulated_sample(runs.withColumn("spectral_index", F.col("n_showers") * 1.0))
