"""Muon rings: ring fit and ring selection in turn, their features, and the maximum-likelihood fit of the ring's light."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import fisher, muon
from eventloom.functions.special import np_normal_between
from eventloom.operators.images import Camera

#: Images that a task fits together; directions that a fit of the light may start from.
TOGETHER, STARTS = 500, 8


def _circles(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(radius, x, y) of images.taubin_circle_fit for rows of weights; nan where pixels lie on a line or there are none.

    The least fit . v / size . v over v: a symmetric eigenproblem once size is factored.
    """
    out = np.full((len(w), 3), np.nan)
    w2 = w * w
    some = np.flatnonzero(w2.sum(axis=1) > 0)
    w, w2 = w[some], w2[some]
    n2 = w2.sum(axis=1)
    cx, cy = w2 @ x / n2, w2 @ y / n2
    dx, dy = x - cx[:, None], y - cy[:, None]
    square = dx * dx + dy * dy
    mean = (w2 * square).sum(axis=1) / n2
    rows = np.stack([square - mean[:, None], dx, dy], axis=1)
    fit = np.einsum("bn,bin,bjn->bij", w2, rows, rows)
    v, vx, vy, vr = w.sum(axis=1), (w * dx).sum(axis=1), (w * dy).sum(axis=1), (w * square).sum(axis=1)
    size = np.zeros((len(w), 3, 3))
    size[:, 0, 0], size[:, 1, 1], size[:, 2, 2] = 4 * vr, v, v
    size[:, 0, 1] = size[:, 1, 0] = 2 * vx
    size[:, 0, 2] = size[:, 2, 0] = 2 * vy
    flat = fit[:, 1, 1] * fit[:, 2, 2] - fit[:, 1, 2] ** 2 <= 1e-12 * (fit[:, 1, 1] + fit[:, 2, 2]) ** 2
    good = np.flatnonzero(~flat & (np.linalg.det(size) > 0))
    # lengths in units of the spread, so that all parts of the matrices are of one size
    unit = np.sqrt(mean[good])
    scale = np.stack([1 / unit**2, 1 / unit, 1 / unit], axis=1)
    one = fit[good] * scale[:, :, None] * scale[:, None, :]
    two = size[good] * scale[:, :, None] * scale[:, None, :]
    factor = np.linalg.inv(np.linalg.cholesky(two))
    _, vectors = np.linalg.eigh(factor @ one @ factor.transpose(0, 2, 1))
    e = np.einsum("bji,bj->bi", factor, vectors[:, :, 0])
    ring = e[:, 0] ** 2 > 1e-20 * (e**2).sum(axis=1)
    a = np.where(ring, e[:, 0], np.nan)
    px, py = -e[:, 1] / (2 * a) * unit, -e[:, 2] / (2 * a) * unit
    out[some[good]] = np.stack([np.sqrt(mean[good] + px * px + py * py), px + cx[good], py + cy[good]], axis=1)
    return out


def _errors(w: np.ndarray, x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Simple error of the centre of weighted circles, twice that of the radius; nan without spread.

    The spread of d^2 - r^2 over that of its derivative sqrt(d^2 + r^2 / 4), d being the pixels' distances, over the summed weight.
    """
    r = ring[:, :1]
    d2 = (x - ring[:, 1:2]) ** 2 + (y - ring[:, 2:3]) ** 2

    def spread(v: np.ndarray) -> np.ndarray:
        mean = (w * v).sum(axis=1) / w.sum(axis=1)
        return np.sqrt((w * (v - mean[:, None]) ** 2).sum(axis=1) / w.sum(axis=1))

    with np.errstate(invalid="ignore", divide="ignore"):
        out = spread(d2 - r * r) / spread(np.sqrt(d2 + r * r / 4)) / w.sum(axis=1) / (2 * math.sqrt(2))
    return np.where(np.isfinite(out), out, np.nan)


def _dense(arrays: pd.Series, n: int, fill: float) -> np.ndarray:
    """Rows of n numbers; null arrays and entries, and missing ends, become fill."""
    out = np.full((len(arrays), n), fill)
    for i, a in enumerate(arrays):
        if a is not None:
            v = np.asarray(a, float)[:n]
            out[i, : len(v)] = np.where(np.isnan(v), fill, v)
    return out


def fit_rings(d: DataFrame, camera: Camera, image: str = "image", mask: str = "mask", rounds: int = 3, band: float = 0.4, weighted: bool = True) -> DataFrame:
    """d with ring: struct(radius, x, y, radius_err, x_err, y_err, phi, distance), and ring_mask: the pixels within `band` radii of it.

    The first fit takes the pixels of the mask (null: those above 0), each further one those within `band` radii of the ring before; it stops after
    `rounds`, or when the pixels no longer change. Circles are Taubin's, weighted by the image (or alike). All images of an Arrow batch are
    fitted together. Where no circle can be fitted, as for pixels on a line, ring is null and no pixel is near. Null images and pixels count as no light.
    """
    xs, ys = np.array(camera.x), np.array(camera.y)
    names = ["radius", "x", "y", "radius_err", "x_err", "y_err", "phi", "distance"]

    @F.pandas_udf("struct<" + ",".join(f"{k}:double" for k in names) + ",near:array<boolean>>")
    def fit(images: pd.Series, masks: pd.Series) -> pd.DataFrame:
        q = _dense(images, len(xs), 0.0)
        use = np.where(np.array([m is not None for m in masks])[:, None], _dense(masks, len(xs), 0.0) > 0, q > 0)
        ring, w = np.full((len(q), 3), np.nan), np.zeros_like(q)
        todo = np.arange(len(q))
        for _ in range(rounds):
            lit = use[todo] & (q[todo] > 0)
            w[todo] = np.where(lit, q[todo] if weighted else 1.0, 0.0)
            ring[todo] = _circles(w[todo], xs, ys)
            distance = np.hypot(xs - ring[todo, 1:2], ys - ring[todo, 2:3])
            near = np.abs(distance - ring[todo, :1]) < band * ring[todo, :1]
            moved = (near != use[todo]).any(axis=1)
            use[todo] = near
            todo = todo[moved & np.isfinite(ring[todo, 0])]
            if not len(todo):
                break
        error = _errors(w, xs, ys, ring)
        out = pd.DataFrame({"radius": ring[:, 0], "x": ring[:, 1], "y": ring[:, 2], "radius_err": error / 2, "x_err": error, "y_err": error})
        out["phi"], out["distance"] = np.arctan2(ring[:, 2], ring[:, 1]), np.hypot(ring[:, 1], ring[:, 2])
        return out.assign(near=list(use & np.isfinite(ring[:, :1])))

    f = F.col("__f")
    d = d.withColumn("__f", fit(F.col(image).cast("array<double>"), F.col(mask).cast("array<double>")))
    known = lambda k: f[k].isNotNull() & ~F.isnan(f[k])
    shown = F.struct(*[F.when(known(k), f[k]).alias(k) for k in names])
    return d.withColumns({"ring": F.when(known("radius"), shown), "ring_mask": f["near"]}).drop("__f")


def _containment(radius: np.ndarray, d: np.ndarray, camera: float) -> np.ndarray:
    """images.ring_containment for numpy."""
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.arccos(np.clip((radius * radius + d * d - camera * camera) / (2 * radius * d), -1, 1)) / math.pi
    return np.where(d <= np.abs(camera - radius), 1.0, np.where(d > radius + camera, 0.0, c))


def features(d: DataFrame, camera: Camera, image: str = "image", mask: str = "mask", threshold: float = 30.0, ratio_width: float = 1.5, inner: float = 0.25, outer: float = 0.2, pixel: float | None = None, bins: int = 30) -> DataFrame:
    """d with muon: struct of what a ring (fit_rings) is worth; null without a ring.

    containment, completeness (share of angular bins whose light is over the threshold), intensity_ratio (light of the mask within half of ratio_width pixels),
    mean_squared_error, ring_intensity (all light within `inner` radii), intensity_outside_ring (of the mask beyond), n_pixels_in_ring,
    mean_intensity_outside_ring (between inner and inner + outer radii), and the spread, skewness and excess kurtosis of the distances from the centre,
    weighted by light. What has no light or pixels to be told from is null. A null mask is that of the pixels with light.
    """
    xs, ys, reach = np.array(camera.x), np.array(camera.y), camera.radius()
    wide = pixel if pixel is not None else math.sqrt(camera.area)
    names = ["containment", "completeness", "intensity_ratio", "mean_squared_error", "ring_intensity", "intensity_outside_ring", "n_pixels_in_ring", "mean_intensity_outside_ring", "radial_std_dev", "skewness", "excess_kurtosis"]

    @F.pandas_udf("struct<" + ",".join(f"{k}:{'long' if k.startswith('n_') else 'double'}" for k in names) + ">")
    def measure(images: pd.Series, masks: pd.Series, radius: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
        q = _dense(images, len(xs), 0.0)
        m = np.where(np.array([v is not None for v in masks])[:, None], _dense(masks, len(xs), 0.0) > 0, q > 0)
        r, cx, cy = (v.fillna(np.nan).to_numpy(float)[:, None] for v in (radius, x, y))
        dist = np.hypot(xs - cx, ys - cy)
        off, clean, light = np.abs(dist - r), np.where(m, q, 0.0), q.sum(axis=1)
        ring = off < inner * r
        around = ~ring & (off < (inner + outer) * r)
        angle = np.minimum(np.floor((np.arctan2(ys - cy, xs - cx) + math.pi) / (2 * math.pi) * bins), bins - 1)
        at = np.where(np.isfinite(angle), angle, 0).astype(int) + bins * np.arange(len(q))[:, None]
        by_angle = np.bincount(at.ravel(), q.ravel(), bins * len(q)).reshape(len(q), bins)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = (q * dist).sum(axis=1) / light
            moment = [(q * (dist - mean[:, None]) ** k).sum(axis=1) / light for k in (2, 3, 4)]
            spread = np.sqrt(moment[0])
            values = [
                _containment(r[:, 0], np.hypot(cx, cy)[:, 0], reach), (by_angle > threshold).mean(axis=1),
                np.where((dist >= r - ratio_width * wide / 2) & (dist <= r + ratio_width * wide / 2), clean, 0).sum(axis=1) / clean.sum(axis=1),
                (clean * (dist - r) ** 2).sum(axis=1) / clean.sum(axis=1), np.where(ring, q, 0).sum(axis=1), np.where(ring, 0, clean).sum(axis=1), (ring & m).sum(axis=1),
                np.where(around, q, 0).sum(axis=1) / around.sum(axis=1), spread, moment[1] / spread**3, moment[2] / spread**4 - 3,
            ]
        return pd.DataFrame(dict(zip(names, values, strict=True)))

    ring = F.col("ring")
    d = d.withColumn("__m", measure(F.col(image).cast("array<double>"), F.col(mask).cast("array<double>"), ring["radius"], ring["x"], ring["y"]))
    return d.withColumn("muon", F.when(ring.isNotNull(), F.col("__m"))).drop("__m")


def _chord(radius: float, rho: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """muon.chord for numpy."""
    inside = 1 - (rho * np.sin(phi)) ** 2
    root = np.sqrt(np.maximum(inside, 0))
    beyond = np.where((np.abs(np.sin(phi)) * rho < 1) & (np.cos(phi) > 0), 2 * radius * root, 0)
    return np.where(inside < 0, 0.0, np.where(rho <= 1, radius * (root + rho * np.cos(phi)), beyond))


class _Rings:
    """Light of rings in pixels, as muon.pixel_light has it, for many rings at once; parameters: impact, phi, width, efficiency."""

    def __init__(self, rows: list[tuple[float, float, float, np.ndarray, np.ndarray, np.ndarray]], pedestal: float, spe_width: float, pixel: float, mirror: float, hole: float, oversampling: int, constant: float):
        self.pixel, self.mirror, self.hole, self.over = pixel, mirror, hole, oversampling
        self.radius = np.array([r[0] for r in rows])
        fit = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
        dx = np.concatenate([r[3] - r[1] for r in rows])
        dy = np.concatenate([r[4] - r[2] for r in rows])
        self.distance = np.hypot(dx, dy)
        steps = (np.floor(2 * np.pi * self.radius / pixel).astype(int) * oversampling)[fit]
        at = (np.arctan2(dy, dx) + np.pi) / (2 * np.pi) * (steps - 1)
        self.low = np.minimum(np.floor(at).astype(int), steps - 2)
        self.share, self.steps = at - self.low, steps
        r = self.radius[fit]
        self.factor = constant / r * 0.5 * np.sin(2 * r)
        self.data = fisher.Pixels(fit, np.concatenate([r[5] for r in rows]), np.full(len(fit), pedestal), spe_width)

    def _path(self, step: np.ndarray, rows: np.ndarray, impact: np.ndarray, phi: np.ndarray) -> np.ndarray:
        steps = self.steps[rows]
        angle = -np.pi + 2 * np.pi * np.mod(step, steps) / (steps - 1) - phi
        whole = _chord(self.mirror, impact / self.mirror, angle)
        return whole - _chord(self.hole, impact / self.hole, angle) if self.hole else whole

    def __call__(self, q: np.ndarray, fits: np.ndarray, rows: np.ndarray, slot: np.ndarray) -> np.ndarray:
        impact, phi, width, efficiency = q[slot].T
        low, share, half = self.low[rows], self.share[rows], self.over // 2
        # the running means at the steps on both sides of the pixel's angle
        first = sum(self._path(low + k - half, rows, impact, phi) for k in range(self.over)) / self.over
        second = sum(self._path(low + 1 + k - half, rows, impact, phi) for k in range(self.over)) / self.over
        d, r = self.distance[rows], self.radius[self.data.fit[rows]]
        across = np_normal_between(d - self.pixel / 2, d + self.pixel / 2, r, np.maximum(width, 1e-12))
        return efficiency * self.factor[rows] * (first + (second - first) * share) * across


def fit_light(
    d: DataFrame, camera: Camera, mirror: float, hole: float = 0.0, pixel: float | None = None, pedestal: float = 1.1, spe_width: float = 0.5, oversampling: int = 3,
    shape: float = muon.CIRCLE_IN_HEXAGON, shortest: float = 300e-9, longest: float = 600e-9, image: str = "image", accept: Column | None = None,
) -> DataFrame:
    """d with efficiency: struct(impact, impact_x, impact_y, width, optical_efficiency, phi and their _err, likelihood, parameters_at_limit, is_valid).

    The ring (fit_rings) stays as it is; impact, direction, width and efficiency are those of the greatest Gaussian likelihood over the pixels of ring_mask, from the
    likeliest of eight directions (an impact within the hole leaves the direction and its opposite alike). Camera places in radians, mirror and hole (radii) in metres. `pixel`: its diameter, by default the side of its area.
    Null where the ring or image is null, too small for a pixel on its circumference, no pixel is near, or `accept` is not true.
    """
    wide = pixel if pixel is not None else math.sqrt(camera.area)
    xs, ys = np.array(camera.x), np.array(camera.y)
    constant = muon.FINE_STRUCTURE * (1 / shortest - 1 / longest) * wide * shape
    names = ["impact", "phi", "width", "optical_efficiency"]
    fields = ["impact", "impact_x", "impact_y", "phi", "width", "optical_efficiency", "impact_err", "phi_err", "width_err", "optical_efficiency_err", "likelihood"]
    schema = "struct<" + ",".join(f"{f}:double" for f in fields) + ",parameters_at_limit:boolean,is_valid:boolean>"
    start_width = 3 * math.sqrt(camera.area / math.pi)

    def some(g: list[tuple]) -> list[dict]:
        rings = _Rings(g, pedestal, spe_width, wide, mirror, hole, oversampling, constant)
        n = len(g)
        low = np.tile([0.0, -2 * np.pi, wide / 50, 0.0], (n, 1))
        high = np.column_stack([np.full(n, 20 * mirror), np.full(n, 2 * np.pi), rings.radius, np.full(n, 20.0)])
        step = np.tile([0.5, 0.1, wide / 10, 0.05], (n, 1))
        every, rows = np.arange(n), np.arange(len(rings.data.fit))
        start = np.tile([mirror / 2, 0.0, start_width, 0.1], (n, 1))
        tried = []
        for k in range(STARTS):
            start[:, 1] = 2 * np.pi * k / STARTS
            tried.append(np.bincount(rings.data.fit, rings.data.terms(rings(start, every, rows, rings.data.fit))[0], n))
        start[:, 1] = 2 * np.pi * np.argmin(tried, axis=0) / STARTS
        best = fisher.minimise(rings, rings.data, start, low, high, step, rounds=50)
        out = []
        for i in range(n):
            v = dict(zip(names, best.values[i].tolist(), strict=True))
            v["phi"] = math.remainder(v["phi"], 2 * math.pi)
            v |= {f"{k}_err": None if np.isnan(e) else float(e) for k, e in zip(names, best.errors[i], strict=True)}
            v |= {"impact_x": v["impact"] * math.cos(v["phi"]), "impact_y": v["impact"] * math.sin(v["phi"]), "likelihood": float(best.likelihood[i])}
            out.append(v | {"parameters_at_limit": bool(best.at_limit[i]), "is_valid": bool(best.converged[i])})
        return out

    @F.pandas_udf(schema)
    def fit(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for radius, x, y, mask, light in parts:
            rows, where = [], []
            for i, (r, cx, cy, m, q) in enumerate(zip(radius, x, y, mask, light, strict=True)):
                if m is None or q is None or pd.isna(r):
                    continue
                use = np.array([bool(v) and w is not None and not np.isnan(w) for v, w in zip(m, q, strict=True)])
                if use.any() and 2 * math.pi * r / wide >= 1:
                    rows.append((r, cx, cy, xs[use], ys[use], np.asarray(q, float)[use]))
                    where.append(i)
            got: list[dict | None] = [None] * len(radius)
            for i in range(0, len(rows), TOGETHER):
                for j, v in zip(where[i : i + TOGETHER], some(rows[i : i + TOGETHER]), strict=True):
                    got[j] = v
            empty = dict.fromkeys([*fields, "parameters_at_limit", "is_valid"])
            yield pd.DataFrame([v or empty for v in got], columns=[*fields, "parameters_at_limit", "is_valid"]).astype({"parameters_at_limit": object, "is_valid": object})

    ring = F.col("ring") if accept is None else F.when(F.coalesce(accept, F.lit(False)), F.col("ring"))
    q = F.transform(F.col(image), lambda v: v.cast("double"))
    d = d.withColumn("__f", fit(ring["radius"], ring["x"], ring["y"], F.col("ring_mask"), q))
    return d.withColumn("efficiency", F.when(F.col("__f.is_valid").isNotNull(), F.col("__f"))).drop("__f")


def process(d: DataFrame, camera: Camera, mirror: float, hole: float = 0.0, least_pixels: int = 50, least_containment: float = 0.5, image: str = "image", mask: str = "mask", **light) -> DataFrame:
    """Rings, their features and, for rings with more than least_pixels pixels near and more than least_containment inside the camera, their light."""
    d = features(fit_rings(d, camera, image, mask), camera, image, mask)
    near = F.size(F.filter("ring_mask", lambda m: m))
    return fit_light(d, camera, mirror, hole, image=image, accept=(near > least_pixels) & (F.col("muon.containment") > least_containment), **light)
