"""Trimmed regression, two-pass extraction and the parameters of the deconvolution against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions import regression, waveforms
from eventloom.functions.common import numbers
from eventloom.operators import images, twopass

CAMERA = images.Camera.rectangular(4, 4)


def line(x, y):
    n, dx = len(x), x - x.mean()
    if n * (dx @ dx) < np.finfo(float).eps:
        return None
    slope = dx @ (y - y.mean()) / (dx @ dx)
    return slope, y.mean() - slope * x.mean()


def trimmed(x, y, starts, share=0.85, steps=20):
    """Concentration steps by numpy, from the same pairs of points."""
    n, best = len(x), None
    used = int(n * share)
    if n < 2 or used < 2:
        return None
    r = regression.draws(starts)
    for k in range(starts):
        i, j = r[2 * k] % n, r[2 * k + 1] % (n - 1)
        f, error = line(x[[i, j + (j >= i)]], y[[i, j + (j >= i)]]), 0.0
        if f is None:
            continue
        for _ in range(steps):
            e = (y - f[0] * x - f[1]) ** 2
            keep = np.lexsort([y, x, e])[:used]
            f = line(x[keep], y[keep])
            if f is None:
                break
            last, error = error, ((y[keep] - f[0] * x[keep] - f[1]) ** 2).sum()
            if abs(last - error) < 1e-12:
                break
        if f is not None and (best is None or error < best[2]):
            best = (*f, error)
    return best


def test_trimmed_line(spark):
    rng = np.random.default_rng(1337)
    x = np.linspace(0, 10, 50)
    y = np.polyval([5.0, 2.0], x)
    one, noisy, many = y.copy(), y + rng.normal(0, 0.2, 50), y.copy()
    one[-1] *= 3
    noisy[[3, 20, 40]] += 80
    many[:7] += 40 * x[:7] + 30  # 14 of 100 points are far off
    double = np.repeat(np.linspace(0, 10, 25), 2)
    pairs = np.polyval([5.0, 2.0], double)
    double[:2], pairs[:2] = 0, 1
    cases = [(x, y), (x, one), (x, noisy), (x, many), (double, pairs), (x[:1], y[:1]), (x[:2], y[:2]), (np.ones(5), y[:5]), (x[:0], y[:0]), (x[:3], y[:3])]
    d = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(cases)], "i int, x array<double>, y array<double>")
    got = {r.i: r.f for r in d.select("i", regression.trimmed_line(regression.points(F.col("x"), F.col("y")), starts=30).alias("f")).collect()}
    for i, (a, b) in enumerate(cases):
        want = trimmed(a, b, 30)
        assert (got[i].slope is None) == (want is None), i
        if want:
            assert np.allclose([got[i].slope, got[i].intercept], want[:2], atol=1e-9), i
    for i in (0, 1, 3, 4, 9):
        assert np.allclose([got[i].slope, got[i].intercept], [5, 2]) and got[i].error < 1e-9
    assert abs(got[2].slope - 5) < 0.1 and not np.allclose(np.polyfit(x, one, 1), [5, 2])


def test_points_leave_out_what_is_not_finite(spark):
    d = spark.createDataFrame([([1.0, 2.0, None, 4.0, 5.0], [2.0, math.nan, 1.0, math.inf, 6.0])], "x array<double>, y array<double>")
    assert [tuple(p) for p in d.select(regression.points(F.col("x"), F.col("y")).alias("p")).first().p] == [(1.0, 2.0), (5.0, 6.0)]


def extract(w, threshold, rate, correction, broken):
    """Both passes for one camera of waveforms, pixel by pixel."""
    n, m = w.shape

    def around(p, k, width, shift):
        lo, hi = max(k - shift, 0), min(k - shift + width, m)
        part = w[p, lo:hi]
        up = np.where(part > 0, part, 0)
        return part.sum(), (float((up * np.arange(lo, hi)).sum() / up.sum()) if up.sum() else float(k)) / rate

    q, t = np.zeros(n), np.zeros(n)
    for p in range(n):
        k = max(range(2, m - 2), key=lambda s: (w[p, s - 1] + w[p, s] + w[p, s + 1], -s))
        q[p], t[p] = around(p, k, 5, 2)
    q = q * correction[0]
    for a in (q, t):
        old = a.copy()
        for p in np.flatnonzero(broken):
            good = [j for j in CAMERA.neighbors[p] if not broken[j]]
            a[p] = old[good].mean() if good else 0.0
    near = CAMERA.neighbors
    picture = np.array([q[p] >= threshold and any(q[j] >= threshold for j in near[p]) for p in range(n)])
    low = q >= threshold / 2
    mask = np.array([picture[p] and any(low[j] for j in near[p]) or low[p] and any(picture[j] for j in near[p]) for p in range(n)])
    left, parts = set(np.flatnonzero(mask)), []
    while left:
        todo, part = [min(left)], set()
        while todo:
            p = todo.pop()
            if p in left:
                left.remove(p)
                part.add(p)
                todo += near[p]
        parts.append(sorted(part))
    island = max(parts, key=lambda s: q[s].sum()) if parts else []
    if len(island) < 3:
        return q, t, False
    x, y, c = np.array(CAMERA.x)[island], np.array(CAMERA.y)[island], q[island]
    cx, cy = (c @ x) / c.sum(), (c @ y) / c.sum()
    cov = np.cov(np.stack([x, y]), aweights=c, ddof=0)
    axis = np.linalg.eigh(cov)[1][:, 1]
    along = lambda a, b: (a - cx) * axis[0] + (b - cy) * axis[1]
    if axis[0] < 0 or axis[0] == 0 and axis[1] < 0:
        axis = -axis
    f = trimmed(along(x, y), t[island], 5)
    if f is None:
        return q, t, False
    q2, t2 = q.copy(), t.copy()
    for p in range(n):
        if p in island and q[p] >= threshold:
            continue
        k = int(np.rint((f[0] * along(CAMERA.x[p], CAMERA.y[p]) + f[1]) * rate))
        if k + 3 > m - 1:
            q2[p], t2[p] = around(p, m - 1 if k > m - 3 else k, 6, 4)
            q2[p] *= correction[2]
        elif k < 2:
            q2[p], t2[p] = around(p, 0, 5, 0)
            q2[p] *= correction[1]
        else:
            q2[p], t2[p] = around(p, k, 5, 2)
            q2[p] *= correction[0]
    return q2, t2, True


def test_two_passes(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        slope, start = rng.uniform(-9, 9), rng.uniform(2, 20)
        w = rng.normal(0, 0.4, (16, 22))
        for p in range(16):
            light = rng.uniform(0, 14) * (abs(CAMERA.y[p] - 0.4 * CAMERA.x[p]) < 0.6) * (i % 5 > 0)
            w[p] += light * np.exp(-(((np.arange(22) - start - slope * CAMERA.x[p]) / 1.5) ** 2))
        rows.append((i, w.tolist(), [bool(v) for v in rng.random(16) < 0.1], 3.0))
    d = spark.createDataFrame(rows, "i int, waveform array<array<double>>, broken array<boolean>, image double")
    args = {"threshold": 6.0, "rate": 2.0, "correction": (1.1, 1.3, 1.2)}
    got = {r.i: r for r in twopass.extract(d, CAMERA, broken="broken", **args).collect()}
    valid = 0
    for i, w, broken, _ in rows:
        q, t, ok = extract(np.array(w), args["threshold"], args["rate"], args["correction"], np.array(broken))
        valid += ok
        assert got[i].is_valid == ok, i
        assert np.allclose(got[i].image, q, atol=1e-9) and np.allclose(got[i].peak_time, t, atol=1e-9), i
    assert 20 < valid < 60


def test_odd_waveforms(spark):
    flat = [[0.0] * 6] * 16
    d = spark.createDataFrame([(1, None), (2, [[1.0, 2.0]] * 16), (3, flat), (4, flat[:-1] + [None])], "i int, waveform array<array<double>>").coalesce(1)
    got = {r.i: r for r in twopass.extract(d, CAMERA, 5.0).collect()}
    assert all(not got[i].is_valid for i in got) and got[1].image is None and got[2].image is None and got[4].image is None and got[3].image == [0.0] * 16
    first = {r.i: r for r in twopass.extract(d, CAMERA, 5.0, second_pass=False).collect()}
    assert first[3].is_valid and not first[1].is_valid
    assert twopass.extract(d.limit(0), CAMERA, 5.0).count() == 0


def test_deconvolution_of_a_decay(spark):
    """A pulse that decays by a constant factor is sharpened to a spike; the gain restores the charge of the whole extractor."""
    t = np.arange(400) * 0.5
    pulse = np.where(t < 20, 0, np.exp(-(t - 20) / 12)) * np.minimum(np.maximum((t - 20) / 3, 0), 1)
    p = waveforms.deconvolution(pulse.tolist(), 0.5, 4.0, 4, 7, 3)
    assert abs(p.pole_zero - math.exp(-4 / 12)) < 0.02 and 0 < p.gain < 1 and p.lead == 0
    edge = waveforms.deconvolution(pulse.tolist(), 0.5, 4.0, 4, 7, 3, limit=0.05, profile=2.0)
    assert edge.pole_zero == p.pole_zero and edge.gain < p.gain + 0.05 and edge.lead >= 0
    w = pulse[3::8]
    got = spark.range(1).select(waveforms.deconvolve(numbers(w.tolist()), F.lit(0.0), p.pole_zero, 4).alias("a")).first().a
    assert np.allclose(got, waveforms._sharp(w, p.pole_zero, 4))
    with pytest.raises(ValueError):
        waveforms.deconvolution(pulse.tolist(), 5.0, 4.0, 4, 7, 3)
    with pytest.raises(ValueError):
        waveforms.deconvolution(pulse[:42].tolist(), 0.5, 4.0, 4, 70, 3)


def test_centre_is_that_of_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(rng.normal(0.3, 1, 15).tolist(), int(rng.integers(0, 15))) for _ in range(50)]
    d = spark.createDataFrame(rows, "a array<double>, k int").coalesce(1)
    got = [r.c for r in d.select(waveforms.centroid(F.col("a"), F.col("k"), 0.3).alias("c")).collect()]
    assert np.allclose(got, [waveforms._centre(np.array(a), k, 0.3) for a, k in rows])
