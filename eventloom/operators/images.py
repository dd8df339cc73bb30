"""Camera images as array columns on a pixel graph: cleaning, islands, moments and other parameters.

The camera is a small constant, so its neighbour lists and coordinates are literals of the expressions: an image is cleaned and measured
where it is scanned, without joins or shuffles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import regression
from eventloom.functions.common import finite, indices, let, nested, numbers, ratio, total


@dataclass(frozen=True)
class Camera:
    """Pixel places, areas and the neighbour graph."""

    x: tuple[float, ...]
    y: tuple[float, ...]
    neighbors: tuple[tuple[int, ...], ...]
    area: float = 1.0

    @staticmethod
    def rectangular(nx: int, ny: int, low: float = -1.0, high: float = 1.0) -> Camera:
        """nx by ny square pixels between low and high, row by row; edges make neighbours."""
        at = lambda i, n: low + (high - low) * i / (n - 1) if n > 1 else 0.5 * (low + high)
        place = [(i, j) for j in range(ny) for i in range(nx)]
        near = tuple(tuple(b + a * nx for a, b in ((j - 1, i), (j, i - 1), (j, i + 1), (j + 1, i)) if 0 <= a < ny and 0 <= b < nx) for i, j in place)
        return Camera(tuple(at(i, nx) for i, _ in place), tuple(at(j, ny) for _, j in place), near, ((high - low) / max(nx - 1, 1)) ** 2)

    @staticmethod
    def from_places(x: list[float], y: list[float], factor: float = 1.4) -> Camera:
        """Neighbours are pixels within `factor` times the least distance of two pixels."""
        n = len(x)
        d = [[math.hypot(x[i] - x[j], y[i] - y[j]) for j in range(n)] for i in range(n)]
        least = min(d[i][j] for i in range(n) for j in range(n) if i != j)
        return Camera(tuple(x), tuple(y), tuple(tuple(j for j in range(n) if i != j and d[i][j] <= factor * least) for i in range(n)), least**2)

    @property
    def n(self) -> int:
        return len(self.x)

    @cached_property
    def neighbor_lists(self) -> Column:
        return nested(self.neighbors)

    def border(self, width: int = 1) -> tuple[bool, ...]:
        """Pixels with fewer neighbours than others have at most, and those up to width - 1 steps from them."""
        most = max(map(len, self.neighbors))
        mask = [len(v) < most for v in self.neighbors]
        for _ in range(width - 1):
            mask = [m or any(mask[j] for j in v) for m, v in zip(mask, self.neighbors, strict=True)]
        return tuple(mask)

    def rotated(self, angle: float) -> Camera:
        c, s = math.cos(angle), math.sin(angle)
        return Camera(tuple(a * c - b * s for a, b in zip(self.x, self.y, strict=True)), tuple(a * s + b * c for a, b in zip(self.x, self.y, strict=True)), self.neighbors, self.area)

    def radius(self) -> float:
        """Mean distance of the border from the centre."""
        r = [math.hypot(a, b) for a, b, m in zip(self.x, self.y, self.border(), strict=True) if m]
        return sum(r) / len(r)


def _count(mask: Column, camera: Camera) -> Column:
    """For every pixel, how many neighbours are in the mask."""
    return F.transform(camera.neighbor_lists, lambda v: F.size(F.filter(v, lambda j: mask[j])))


def _any(mask: Column, camera: Camera) -> Column:
    return F.transform(camera.neighbor_lists, lambda v: F.exists(v, lambda j: mask[j]))


def tailcuts(image: Column, camera: Camera, picture: float, boundary: float, keep_isolated: bool = False, least: int = 0) -> Column:
    """Mask of picture pixels with a neighbour over `boundary`, and of pixels over `boundary` with a picture neighbour."""
    above = F.transform(image, lambda v: v >= picture)
    if not keep_isolated and least > 0:
        above = let(above, lambda m: F.zip_with(m, _count(m, camera), lambda a, n: a & (n >= least)))
    low = F.transform(image, lambda v: v >= boundary)

    def body(both: Column) -> Column:
        m, b = both["m"], both["b"]
        near = F.zip_with(b, _any(m, camera), lambda a, n: a & n)
        own = m if keep_isolated else F.zip_with(m, _any(b, camera), lambda a, n: a & n)
        return F.zip_with(near, own, lambda a, c: a | c)

    return let(F.struct(above.alias("m"), low.alias("b")), body)


def dilate(mask: Column, camera: Camera) -> Column:
    return F.zip_with(mask, _any(mask, camera), lambda a, b: a | b)


def mars_cleaning(image: Column, camera: Camera, picture: float, boundary: float, keep_isolated: bool = False, least: int = 0) -> Column:
    """Tailcuts, and one more ring of neighbours over `boundary`."""
    return let(
        tailcuts(image, camera, picture, boundary, keep_isolated, least),
        lambda m: F.zip_with(m, F.zip_with(_any(m, camera), image, lambda n, v: n & (v >= boundary)), lambda a, b: a | b),
    )


def bright_cleaning(image: Column, threshold: float, fraction: float, n: int = 3) -> Column:
    """Pixels over `fraction` of the mean of the n brightest; all pixels where that mean is under `threshold`."""
    return let(
        ratio(total(F.slice(F.sort_array(image, asc=False), 1, n)), F.lit(n)),
        lambda m: F.transform(image, lambda v: (m < threshold) | (v.cast("double") >= fraction * m)),
    )


def time_delta_cleaning(mask: Column, times: Column, camera: Camera, least: int, limit: float) -> Column:
    """Of the mask, pixels with at least `least` neighbours in it whose times differ by under `limit`."""
    near = F.transform(camera.neighbor_lists, lambda v, i: F.size(F.filter(v, lambda j: mask[j] & (F.abs(times[j] - times[i]) < limit))))
    return F.zip_with(mask, near, lambda m, n: m & (n >= least))


def fact_cleaning(image: Column, times: Column, camera: Camera, picture: float, boundary: float, least: int, limit: float) -> Column:
    """Core pixels with enough core neighbours, their ring over `boundary`, time cleaning, enough neighbours, time cleaning."""
    core = F.transform(image, lambda v: v >= picture)
    few = lambda m: F.zip_with(m, _count(m, camera), lambda a, n: a & (n >= least))
    ring = lambda m: F.zip_with(m, F.zip_with(image, _any(m, camera), lambda v, n: n & (v >= boundary)), lambda a, b: a | b)
    timed = lambda m: time_delta_cleaning(m, times, camera, least, limit)
    return let(core, lambda a: let(few(a), lambda b: let(ring(b), lambda c: let(timed(c), lambda d: let(few(d), timed)))))


def tailcuts_reduction(image: Column, camera: Camera, picture: float, boundary: float, rings: int, end_rings: int = 0) -> Column:
    """Pixels worth storing: tailcuts, grown `rings` times within what is over `boundary`, then `end_rings` whole rings."""
    out = tailcuts(image, camera, picture, boundary, keep_isolated=True)
    for _ in range(rings):
        out = let(out, lambda m: F.zip_with(m, F.zip_with(_any(m, camera), image, lambda n, v: n & (v >= boundary)), lambda a, b: a | b))
    for _ in range(end_rings):
        out = let(out, lambda m: dilate(m, camera))
    return out


def masked(image: Column, mask: Column) -> Column:
    """The image with 0 outside of the mask."""
    return F.zip_with(image, mask, lambda v, m: F.when(m, v.cast("double")).otherwise(0.0))


def islands(mask: Column, camera: Camera) -> Column:
    """Labels of connected pixels: 1, 2, ... by first pixel, 0 outside of the mask; null masks and pixels count as outside.

    Labels start as pixel numbers and take the least label around, and the label of their label, until nothing changes; each step is one
    array operation over all images of an Arrow batch.
    """
    most, size = max(map(len, camera.neighbors), default=0), camera.n
    near = np.array([[*v, *[i] * (most - len(v))] for i, v in enumerate(camera.neighbors)], np.int64).reshape(camera.n, most)

    @F.pandas_udf("array<int>")
    def label(masks: pd.Series) -> pd.Series:
        known = masks.notna().to_numpy()
        out = pd.Series([None] * len(masks), dtype=object)
        for lot in np.array_split(np.flatnonzero(known), max(1, len(masks) * size // 4_000_000)):
            if len(lot):
                on = np.stack([np.asarray(m, object) == True for m in masks.iloc[lot]])  # noqa: E712
                out.iloc[lot] = list(_label(on, near))
        return out

    # so called, it stays a step of its own and is never moved into the lambdas of what is made of it, where it could not run
    return label.asNondeterministic()(mask)


def _label(on: np.ndarray, near: np.ndarray) -> np.ndarray:
    n = on.shape[1]
    at = np.where(on, np.arange(n), n)
    while True:
        wide = np.concatenate([at, np.full((len(at), 1), n)], axis=1)
        new = at
        for k in range(near.shape[1]):
            new = np.minimum(new, at[:, near[:, k]])
        new = np.where(on, np.minimum(new, np.take_along_axis(wide, new, axis=1)), n)
        if (new == at).all():
            break
        at = new
    first = on & (at == np.arange(n))
    rank = np.concatenate([np.cumsum(first, axis=1), np.zeros((len(at), 1), int)], axis=1)
    return np.where(on, np.take_along_axis(rank, at, axis=1), 0).astype(np.int32)


def island_sizes(labels: Column) -> Column:
    """struct(n, small, medium, large): up to 2 pixels, up to 50, more."""
    sizes = F.transform(F.sequence(F.lit(1), F.greatest(F.array_max(labels), F.lit(1))), lambda k: F.size(F.filter(labels, lambda v: v == k)))
    count = lambda s, f: F.size(F.filter(s, f))
    return let(
        sizes,
        lambda s: F.struct(
            F.array_max(labels).alias("n"),
            count(s, lambda v: (v > 0) & (v <= 2)).alias("small"),
            count(s, lambda v: (v > 2) & (v <= 50)).alias("medium"),
            count(s, lambda v: v > 50).alias("large"),
        ),
    )


def _best_island(labels: Column, score) -> Column:
    ids = F.transform(F.sequence(F.lit(1), F.greatest(F.array_max(labels), F.lit(1))), lambda k: F.struct(score(k).alias("s"), (-k).alias("k")))
    return let(-F.array_max(ids)["k"], lambda k: F.transform(labels, lambda v: v == k))


def largest_island(labels: Column) -> Column:
    """Mask of the first island with most pixels."""
    return _best_island(labels, lambda k: F.size(F.filter(labels, lambda v: v == k)).cast("double"))


def brightest_island(labels: Column, image: Column) -> Column:
    return _best_island(labels, lambda k: total(F.zip_with(labels, image, lambda v, q: F.when(v == k, q.cast("double")).otherwise(0.0))))


def hillas(image: Column, camera: Camera) -> Column:
    """struct(intensity, x, y, r, phi, length, width, psi, skewness, kurtosis): weighted moments of an image; null for no charge.

    An image without extent (length 0) has NaN for psi, skewness and kurtosis.
    """
    x, y = numbers(camera.x), numbers(camera.y)

    def weighted(coordinate_a: Column, coordinate_b: Column | None = None) -> Column:
        prod = F.zip_with(image, coordinate_a, lambda q, a: q.cast("double") * a)
        if coordinate_b is not None:
            prod = F.zip_with(prod, coordinate_b, lambda p, b: p * b)
        return total(prod)

    def centre(s: Column) -> Column:
        return F.struct(s.alias("s"), (weighted(x) / s).alias("x"), (weighted(y) / s).alias("y"))

    def spread(c: Column) -> Column:
        s = c["s"]
        dx, dy = F.transform(x, lambda v: v - c["x"]), F.transform(y, lambda v: v - c["y"])
        return F.struct(s.alias("s"), c["x"].alias("x"), c["y"].alias("y"), (weighted(dx, dx) / s).alias("xx"), (weighted(dx, dy) / s).alias("xy"), (weighted(dy, dy) / s).alias("yy"))

    def axes(m: Column) -> Column:
        # Eigenvalues of the 2x2 covariance; rounding noise below zero counts as zero.
        half, diff = (m["xx"] + m["yy"]) / 2, (m["xx"] - m["yy"]) / 2
        root = F.sqrt(diff * diff + m["xy"] * m["xy"])
        zero = F.lit(0.0)
        nan = F.lit(math.nan)
        psi = F.when(F.greatest(half + root, zero) == 0, nan).when((m["xy"] == 0) & (diff >= 0), 0.0).when(m["xy"] == 0, math.pi / 2).otherwise(F.atan(F.try_divide(root - diff, m["xy"])))
        return F.struct(
            m["s"].alias("s"), m["x"].alias("x"), m["y"].alias("y"), psi.alias("psi"),
            F.sqrt(F.greatest(half + root, zero)).alias("length"), F.sqrt(F.greatest(half - root, zero)).alias("width"),
        )

    def shape(m: Column) -> Column:
        nan = F.lit(math.nan)
        along = F.zip_with(x, y, lambda a, b: (a - m["x"]) * F.cos(m["psi"]) + (b - m["y"]) * F.sin(m["psi"]))
        moment = lambda k: total(F.zip_with(image, along, lambda q, v: q.cast("double") * F.pow(v, F.lit(float(k))))) / m["s"]
        return F.struct(
            m["s"].alias("intensity"), m["x"].alias("x"), m["y"].alias("y"),
            F.sqrt(m["x"] * m["x"] + m["y"] * m["y"]).alias("r"), F.atan2(m["y"], m["x"]).alias("phi"),
            m["length"].alias("length"), m["width"].alias("width"), m["psi"].alias("psi"),
            F.coalesce(F.try_divide(moment(3), F.pow(m["length"], F.lit(3.0))), nan).alias("skewness"),
            F.coalesce(F.try_divide(moment(4), F.pow(m["length"], F.lit(4.0))), nan).alias("kurtosis"),
        )

    return let(F.when(total(image) != 0, total(image)), lambda s: F.when(s.isNotNull(), let(centre(s), lambda c: let(spread(c), lambda m: let(axes(m), shape)))))


def hillas_uncertainty(image: Column, h: Column, camera: Camera) -> Column:
    """struct(length, width, psi, transverse_cog) uncertainties of moments h; NaN where an extent is 0.

    Length and width from the fourth moments along and across the axis; the axis as a weighted line fit in its own frame, where
    both its slope and the mean across vanish; elongation enters the angle.
    """
    x, y = numbers(camera.x), numbers(camera.y)
    nan, n = F.lit(math.nan), h["intensity"]
    across = F.zip_with(x, y, lambda a, b: (b - h["y"]) * F.cos(h["psi"]) - (a - h["x"]) * F.sin(h["psi"]))
    fourth = total(F.zip_with(image, across, lambda q, v: q.cast("double") * F.pow(v, F.lit(4.0)))) / n
    some = lambda extent, c: F.when(extent > 0, c).otherwise(nan)
    spread = F.sqrt(F.greatest(fourth - F.pow(h["width"], F.lit(4.0)), F.lit(0.0)) / n)
    bend = 1 + F.tan(F.try_divide(h["width"], h["length"]) * (math.pi / 2)) ** 2
    return F.struct(
        some(h["length"], h["length"] * F.sqrt(F.greatest(h["kurtosis"] - 1, F.lit(0.0)) / n) / 2).alias("length"),
        some(h["width"], F.try_divide(spread, 2 * h["width"])).alias("width"),
        some(h["length"], F.try_divide(F.sqrt(camera.area / n), h["length"]) * bend).alias("psi"),
        some(h["length"], F.sqrt(camera.area / n)).alias("transverse_cog"),
    )


def morphology(mask: Column, labels: Column) -> Column:
    """struct(n_pixels, n_islands, n_small_islands, n_medium_islands, n_large_islands) of a cleaned image and the labels of its islands."""
    return let(island_sizes(labels), lambda s: F.struct(
        F.size(F.filter(mask, lambda v: v)).alias("n_pixels"), s["n"].alias("n_islands"), s["small"].alias("n_small_islands"),
        s["medium"].alias("n_medium_islands"), s["large"].alias("n_large_islands"),
    ))


def time_average_cleaning(mask: Column, labels: Column, image: Column, times: Column, picture: float, limit: float) -> Column:
    """Of the mask, pixels whose time is within `limit` of the mean time (by squared charge) of the brightest island.

    `labels` are the islands of the mask. Pixels of twice the picture threshold and more have twice the limit.
    """

    def body(main: Column) -> Column:
        w = F.zip_with(image, main, lambda q, m: F.when(m, q.cast("double") * q).otherwise(0.0))
        mean = F.try_divide(total(F.zip_with(w, times, lambda a, t: a * t)), total(w))
        near = lambda m: F.zip_with(image, times, lambda q, t: F.abs(t - m) < F.when(q < 2 * picture, limit).otherwise(2 * limit))
        return let(mean, lambda m: F.zip_with(mask, near(m), lambda a, b: a & F.coalesce(b, F.lit(False))))

    return let(brightest_island(labels, image), body)


def time_constrained_cleaning(df: DataFrame, image: str, times: str, camera: Camera, picture: float, boundary: float, core_limit: float, edge_limit: float, least: int = 1, name: str = "mask") -> DataFrame:
    """df with `name`: core pixels near the mean time of the core, and pixels over `boundary` with core neighbours close in time."""
    q, t = F.col(image), F.col(times)
    core = let(F.transform(q, lambda v: v >= picture), lambda m: F.zip_with(m, _count(m, camera), lambda a, n: a & (n >= least)))
    d = df.withColumn("__core", core)
    d = d.withColumn("__labels", islands(F.col("__core"), camera))
    d = d.withColumn("__core", time_average_cleaning(F.col("__core"), F.col("__labels"), q, t, picture, core_limit))
    m = F.col("__core")
    close = F.transform(camera.neighbor_lists, lambda v, i: F.size(F.filter(v, lambda j: m[j] & (F.abs(t[j] - t[i]) < edge_limit))))
    edge = F.zip_with(F.zip_with(q, close, lambda v, n: (v >= boundary) & (n >= least)), F.zip_with(m, _any(m, camera), lambda a, n: ~a & n), lambda a, b: a & b)
    return d.withColumn(name, F.zip_with(m, edge, lambda a, b: a | b)).drop("__core", "__labels")


def leakage(image: Column, mask: Column, camera: Camera) -> Column:
    """struct(pixels_width_1, pixels_width_2, intensity_width_1, intensity_width_2) of the outer rings, as shares of the cleaned image.

    Null where no pixel, or no charge, survived cleaning.
    """
    out = []
    kept = F.size(F.filter(mask, lambda v: v))
    for k in (1, 2):
        edge = F.array(*[F.lit(b) for b in camera.border(k)])
        out.append(ratio(F.size(F.filter(F.zip_with(mask, edge, lambda m, e: m & e), lambda v: v)), kept).alias(f"pixels_width_{k}"))
        out.append(ratio(total(masked(image, F.zip_with(mask, edge, lambda m, e: m & e))), total(masked(image, mask))).alias(f"intensity_width_{k}"))
    return F.struct(out[0], out[2], out[1], out[3])


def concentration(image: Column, h: Column, camera: Camera) -> Column:
    """struct(cog, core, pixel): charge shares near the centre of gravity, inside the ellipse and in the brightest pixel."""
    x, y = numbers(camera.x), numbers(camera.y)
    reach = math.sqrt(camera.area)
    place = F.arrays_zip(image.alias("q"), x.alias("x"), y.alias("y"))
    share = lambda inside: total(F.transform(place, lambda p: F.when(inside(p), p["q"].cast("double")).otherwise(0.0))) / h["intensity"]
    near = lambda p: (p["x"] - h["x"]) ** 2 + (p["y"] - h["y"]) ** 2 < reach * reach

    def ellipse(p: Column) -> Column:
        lon = (p["x"] - h["x"]) * F.cos(h["psi"]) + (p["y"] - h["y"]) * F.sin(h["psi"])
        lat = (p["y"] - h["y"]) * F.cos(h["psi"]) - (p["x"] - h["x"]) * F.sin(h["psi"])
        return F.coalesce(F.try_divide(lon, h["length"]) ** 2 + F.try_divide(lat, h["width"]) ** 2 <= 1, F.lit(False))

    return F.struct(share(near).alias("cog"), share(ellipse).alias("core"), (F.array_max(image).cast("double") / h["intensity"]).alias("pixel"))


def neighbor_average(image: Column, broken: Column, camera: Camera) -> Column:
    """Broken pixels get the mean of their sound neighbours, 0 without any."""

    def mean(v: Column) -> Column:
        good = F.filter(v, lambda j: ~broken[j])
        return F.coalesce(ratio(F.aggregate(good, F.lit(0.0), lambda s, j: s + image[j].cast("double")), F.size(good)), F.lit(0.0))

    return F.zip_with(F.zip_with(image, broken, lambda v, b: F.struct(v.cast("double").alias("v"), b.alias("b"))), camera.neighbor_lists, lambda p, v: F.when(p["b"], mean(v)).otherwise(p["v"]))


def timing(image: Column, times: Column, mask: Column, h: Column, camera: Camera, share: float = 0.85, starts: int = 5) -> Column:
    """struct(slope, intercept, deviation): trimmed least squares of the time over the longitudinal place, over pixels of the mask.

    See regression.trimmed_line; the deviation is that of all pixels. NaN for fewer than two pixels with finite times, or where all are at one place.
    """
    x, y = numbers(camera.x), numbers(camera.y)
    nan = F.lit(math.nan)
    along = F.zip_with(x, y, lambda a, b: (a - h["x"]) * F.cos(h["psi"]) + (b - h["y"]) * F.sin(h["psi"]))
    pts = F.transform(F.filter(F.arrays_zip(along.alias("x"), times.alias("y"), mask.alias("m")), lambda p: p["m"]), lambda p: F.struct(p["x"].alias("x"), p["y"].cast("double").alias("y")))
    pts = F.filter(pts, lambda p: finite(p["x"]) & finite(p["y"]))

    def result(p: Column) -> Column:
        def spread(f: Column) -> Column:
            squares = F.aggregate(p, F.lit(0.0), lambda s, v: s + (v["y"] - f["slope"] * v["x"] - f["intercept"]) ** 2)
            rms = F.sqrt(ratio(squares, F.size(p)))
            return F.struct(F.coalesce(f["slope"], nan).alias("slope"), F.coalesce(f["intercept"], nan).alias("intercept"), F.coalesce(rms, nan).alias("deviation"))

        return let(regression.trimmed_line(p, starts, share), spread)

    return let(pts, result)


def circle_fit(weights: Column, camera: Camera) -> Column:
    """struct(radius, x, y): closed-form weighted circle through pixels; null where the pixels lie on a line."""
    pts = F.arrays_zip(numbers(camera.x).alias("x"), numbers(camera.y).alias("y"), weights.alias("w"))
    s = lambda f: F.aggregate(pts, F.lit(0.0), lambda acc, p: acc + p["w"].cast("double") * f(p["x"], p["y"]))
    sums = F.struct(
        s(lambda a, b: F.lit(1.0)).alias("w"), s(lambda a, b: a).alias("x"), s(lambda a, b: b).alias("y"),
        s(lambda a, b: a * a).alias("xx"), s(lambda a, b: b * b).alias("yy"), s(lambda a, b: a * b).alias("xy"),
        s(lambda a, b: a * (a * a + b * b)).alias("xr"), s(lambda a, b: b * (a * a + b * b)).alias("yr"), s(lambda a, b: a * a + b * b).alias("r"),
    )

    def solve(t: Column) -> Column:
        mx, my, mr = F.try_divide(t["x"], t["w"]), F.try_divide(t["y"], t["w"]), F.try_divide(t["r"], t["w"])
        a1, b1, c1 = t["xx"] - mx * t["x"], t["xy"] - mx * t["y"], (t["xr"] - mr * t["x"]) / 2
        a2, b2, c2 = t["xy"] - my * t["x"], t["yy"] - my * t["y"], (t["yr"] - mr * t["y"]) / 2
        det = a1 * b2 - a2 * b1
        det = F.when(F.abs(det) > 1e-12, det)
        x, y = (c1 * b2 - c2 * b1) / det, (a1 * c2 - a2 * c1) / det
        return F.struct(F.sqrt(mr - 2 * x * mx - 2 * y * my + x * x + y * y).alias("radius"), x.alias("x"), y.alias("y"))

    return let(sums, solve)


def _adjugate(m: list[list[Column]]) -> list[list[Column]]:
    """Of a symmetric 3 x 3 matrix, row by row the cross products of its rows."""
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    return [cross(m[1], m[2]), cross(m[2], m[0]), cross(m[0], m[1])]


def _least_gradient_circle(c: Column) -> Column:
    """struct(radius, x, y) from weighted sums about a centre.

    Least fit . v / size . v over v, fit and size being quadratic forms: the least root of a cubic, which Newton's steps reach from 0 from
    one side, and a cross product of two rows of the matrix that is singular there.
    """
    fit = [[c["rr"], c["rx"], c["ry"]], [c["rx"], c["xx"], c["xy"]], [c["ry"], c["xy"], c["yy"]]]
    size = [[4 * c["vr"], 2 * c["vx"], 2 * c["vy"]], [2 * c["vx"], c["v"], F.lit(0.0)], [2 * c["vy"], F.lit(0.0), c["v"]]]
    fa, sa = _adjugate(fit), _adjugate(size)
    paired = lambda a, b: sum((a[i][j] * b[i][j] for i in range(3) for j in range(3)), F.lit(0.0))
    first = lambda a, b: sum((a[0][j] * b[0][j] for j in range(3)), F.lit(0.0))
    cubic = F.struct(first(fit, fa).alias("a"), paired(fa, size).alias("b"), paired(fit, sa).alias("c"), first(size, sa).alias("d"))

    def root(p: Column) -> Column:
        value = lambda t: p["a"] - t * (p["b"] - t * (p["c"] - t * p["d"]))
        slope = lambda t: p["b"] - t * (2 * p["c"] - 3 * t * p["d"])
        step = lambda t: t + F.coalesce(F.try_divide(value(t), slope(t)), F.lit(0.0))
        start = F.struct(F.lit(0.0).alias("t"), F.lit(None).cast("double").alias("before"))
        # where a step changes nothing, none after it does
        return F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, lambda s, _: F.when(s["t"] == s["before"], s).otherwise(F.struct(step(s["t"]).alias("t"), s["t"].alias("before"))), lambda s: s["t"])

    def circle(t: Column) -> Column:
        at = F.struct(*[(fit[i][j] - t * size[i][j]).alias(f"m{i}{j}") for i in range(3) for j in range(i, 3)])
        rows = lambda m: F.array(*[F.struct(*[v.alias(f"e{k}") for k, v in enumerate(r)]) for r in _adjugate([[m[f"m{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)])])
        longest = F.array_max(F.transform(let(at, rows), lambda r: F.struct((r["e0"] * r["e0"] + r["e1"] * r["e1"] + r["e2"] * r["e2"]).alias("n"), r["e0"], r["e1"], r["e2"])))

        def place(e: Column) -> Column:
            a = F.when(e["e0"] * e["e0"] > 1e-20 * e["n"], e["e0"])
            return let(F.struct((-e["e1"] / (2 * a)).alias("x"), (-e["e2"] / (2 * a)).alias("y")), lambda q: F.struct(F.sqrt(c["mr"] + q["x"] * q["x"] + q["y"] * q["y"]).alias("radius"), (q["x"] + c["cx"]).alias("x"), (q["y"] + c["cy"]).alias("y")))

        return let(longest, place)

    return let(let(cubic, root), circle)


def taubin_circle_fit(weights: Column, camera: Camera) -> Column:
    """struct(radius, x, y) of least sum((w (d^2 - r^2))^2) / sum(w d^2), d the distance of a pixel from the centre; nulls where pixels lie on a line.

    The minimum is a small eigenproblem of weighted sums, all in built-in expressions; no search, no starting values.
    """
    pts = F.arrays_zip(numbers(camera.x).alias("x"), numbers(camera.y).alias("y"), weights.alias("w"))
    pts = F.transform(pts, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.coalesce(p["w"].cast("double"), F.lit(0.0)).alias("w")))
    add = lambda a, f: F.aggregate(a, F.lit(0.0), lambda acc, p: acc + f(p))

    def centre(pts: Column) -> Column:
        square = lambda f: add(pts, lambda p: p["w"] * p["w"] * f(p))
        sums = F.struct(add(pts, lambda p: p["w"]).alias("v"), add(pts, lambda p: p["w"] * p["w"]).alias("w"), square(lambda p: p["x"]).alias("x"), square(lambda p: p["y"]).alias("y"))
        place = lambda c: F.struct(c["v"].alias("v"), c["w"].alias("w"), F.try_divide(c["x"], c["w"]).alias("cx"), F.try_divide(c["y"], c["w"]).alias("cy"))
        return let(let(sums, place), lambda c: let(moved(pts, c), lambda m: about(m, c)))

    def moved(pts: Column, c: Column) -> Column:
        """Weights, their squares, places about the centre and the squares of their distances."""

        def one(p: Column) -> Column:
            x, y = p["x"] - c["cx"], p["y"] - c["cy"]
            return F.struct(p["w"].alias("w"), (p["w"] * p["w"]).alias("ww"), x.alias("x"), y.alias("y"), (x * x + y * y).alias("square"))

        return F.transform(pts, one)

    def about(m: Column, c: Column) -> Column:
        mr = F.try_divide(add(m, lambda p: p["ww"] * p["square"]), c["w"])

        def rest(mr: Column) -> Column:
            pair = lambda f: add(m, lambda p: p["ww"] * f(p["x"], p["y"], p["square"] - mr))
            return F.struct(
                c["v"].alias("v"), c["w"].alias("w"), c["cx"].alias("cx"), c["cy"].alias("cy"), mr.alias("mr"),
                pair(lambda x, y, r: r * r).alias("rr"), pair(lambda x, y, r: r * x).alias("rx"), pair(lambda x, y, r: r * y).alias("ry"),
                pair(lambda x, y, r: x * x).alias("xx"), pair(lambda x, y, r: x * y).alias("xy"), pair(lambda x, y, r: y * y).alias("yy"),
                add(m, lambda p: p["w"] * p["square"]).alias("vr"), add(m, lambda p: p["w"] * p["x"]).alias("vx"), add(m, lambda p: p["w"] * p["y"]).alias("vy"),
            )

        return let(mr, rest)

    return let(let(pts, centre), _least_gradient_circle)


def ring_error(weights: Column, radius: Column, x: Column, y: Column, camera: Camera) -> Column:
    """Mean squared distance of the pixels from a ring, by weight; null without weight."""
    r = F.zip_with(numbers(camera.x), numbers(camera.y), lambda a, b: (F.hypot(x - a, y - b) - radius) ** 2)
    return ratio(total(F.zip_with(weights, r, lambda w, v: w.cast("double") * v)), total(weights))


def ring_ratio(weights: Column, radius: Column, x: Column, y: Column, camera: Camera, width: float) -> Column:
    """Share of the charge within half of `width` of a ring; null without charge."""
    r = F.zip_with(numbers(camera.x), numbers(camera.y), lambda a, b: F.hypot(x - a, y - b))
    inside = F.zip_with(weights, r, lambda w, v: F.when((v >= radius - 0.5 * width) & (v <= radius + 0.5 * width), w.cast("double")).otherwise(0.0))
    return ratio(total(inside), total(weights))


def ring_containment(radius: Column, x: Column, y: Column, camera_radius: float) -> Column:
    """Share of a ring inside a round camera: 1 where one circle is within the other, 0 where they are apart."""
    d = F.sqrt(x * x + y * y)
    c = F.try_divide(radius * radius + d * d - camera_radius * camera_radius, 2 * radius * d)
    return F.when(d <= F.abs(camera_radius - radius), 1.0).when(d > radius + camera_radius, 0.0).otherwise(F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))) / math.pi)


def ring_completeness(image: Column, radius: Column, x: Column, y: Column, camera: Camera, threshold: float, bins: int = 30) -> Column:
    """Share of angular bins around the ring's centre whose charge is over `threshold`."""
    angle = F.arrays_zip(numbers(camera.x).alias("x"), numbers(camera.y).alias("y"), image.alias("q"))
    at = F.transform(angle, lambda p: F.struct(F.least(F.floor((F.atan2(p["y"] - y, p["x"] - x) + math.pi) / (2 * math.pi) * bins), F.lit(bins - 1)).alias("b"), p["q"].alias("q")))
    sums = let(at, lambda a: F.transform(indices(bins), lambda k: total(F.transform(a, lambda p: F.when(p["b"] == k, p["q"].cast("double")).otherwise(0.0)))))
    return F.size(F.filter(sums, lambda v: v > threshold)) / bins


def parameters(df: DataFrame, image: str, camera: Camera, picture: float, boundary: float) -> DataFrame:
    """df with mask, hillas, leakage and concentration of the cleaned image; null where nothing is left."""
    d = df.withColumn("mask", tailcuts(F.col(image), camera, picture, boundary))
    d = d.withColumn("__clean", masked(F.col(image), F.col("mask")))
    d = d.withColumn("hillas", hillas(F.col("__clean"), camera))
    d = d.withColumns({"leakage": leakage(F.col(image), F.col("mask"), camera), "concentration": concentration(F.col("__clean"), F.col("hillas"), camera)})
    return d.drop("__clean")
