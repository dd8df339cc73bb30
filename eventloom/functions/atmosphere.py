"""Atmospheres as column functions: density, column density (overburden) and height, along the vertical or a slanted line.

Heights are metres, densities g/cm3, column densities g/cm2, angles radians.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.common import let


def _nan() -> Column:
    return F.lit(math.nan)


class _Profile:
    """What follows from density, overburden and height_from_overburden; Cartesian, so good up to about 70 degrees."""

    def slant_depth(self, height: Column, zenith: Column) -> Column:
        return self.overburden(height) / F.cos(zenith)

    def height_from_slant_depth(self, depth: Column, zenith: Column) -> Column:
        return self.height_from_overburden(depth * F.cos(zenith))


@dataclass(frozen=True)
class Exponential(_Profile):
    """density0 exp(-height / scale); NaN below the ground or for more than the whole overburden."""

    scale: float = 8000.0
    density0: float = 0.00125

    def density(self, height: Column) -> Column:
        return F.when(height >= 0, self.density0 * F.exp(-height / self.scale)).otherwise(_nan())

    def overburden(self, height: Column) -> Column:
        return self.density(height) * (100.0 * self.scale)

    def height_from_overburden(self, x: Column) -> Column:
        whole = 100.0 * self.scale * self.density0
        return F.when((x > 0) & (x <= whole), -self.scale * F.ln(x / whole)).when(x == 0, F.lit(math.inf)).otherwise(_nan())


@dataclass(frozen=True)
class FiveLayers(_Profile):
    """Layers (lower edge in m, a, b in g/cm2, c in m): a + b exp(-h / c) in all but the highest, there a - b h / c, 0 at least.

    NaN below the lowest edge and for more overburden than there.
    """

    layers: tuple[tuple[float, float, float, float], ...]

    def _by_layer(self, value: Column, edges: list[float], forms: list[Column]) -> Column:
        out = _nan()
        for e, f in zip(edges, forms, strict=True):
            out = F.when(value >= e, f).otherwise(out)
        return out

    def _at(self, h: float, i: int) -> float:
        _, a, b, c = self.layers[i]
        return a + b * math.exp(-h / c) if i + 1 < len(self.layers) else max(a - b * h / c, 0.0)

    def density(self, height: Column) -> Column:
        forms = [b / c * F.exp(-height / c) for _, _, b, c in self.layers[:-1]] + [F.lit(self.layers[-1][2] / self.layers[-1][3])]
        return self._by_layer(height, [x[0] for x in self.layers], [f / 100.0 for f in forms])

    def overburden(self, height: Column) -> Column:
        _, a, b, c = self.layers[-1]
        forms = [a + b * F.exp(-height / c) for _, a, b, c in self.layers[:-1]] + [F.greatest(a - b * height / c, F.lit(0.0))]
        return self._by_layer(height, [x[0] for x in self.layers], forms)

    def height_from_overburden(self, x: Column) -> Column:
        _, a, b, c = self.layers[-1]
        out = F.when(x > 0, -c / b * (x - a)).otherwise(F.lit(math.inf))
        for i in range(len(self.layers) - 2, -1, -1):
            _, a, b, c = self.layers[i]
            out = F.when(x >= self._at(self.layers[i + 1][0], i + 1), -c * F.ln((x - a) / b)).otherwise(out)
        return F.when(x >= self._at(self.layers[0][0], 0), _nan()).otherwise(out)


def _spline(x: Column, knots: Sequence[float], values: Sequence[float], below: float, above: float) -> Column:
    """Cubic spline through the knots, its third derivative continuous at the second and the last but one; fills beyond the ends."""
    order = np.argsort(knots)
    k, y = np.asarray(knots, dtype=float)[order], np.asarray(values, dtype=float)[order]
    h, n = np.diff(k), len(k)
    if n < 4 or not (h > 0).all():
        raise ValueError("a cubic needs at least four different points")
    lhs, rhs = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        lhs[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        rhs[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    lhs[0, :3] = h[1], -(h[0] + h[1]), h[0]
    lhs[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(lhs, rhs)
    slopes = np.diff(y) / h - h * (2 * m[:-1] + m[1:]) / 6
    rows = zip(k[:-1], y[:-1], slopes, m[:-1] / 2, np.diff(m) / (6 * h), strict=True)
    pieces = F.array(*[F.struct(*[F.lit(float(v)).alias(c) for c, v in zip("xabcd", r, strict=True)]) for r in rows])
    cubic = lambda p: p["a"] + (x - p["x"]) * (p["b"] + (x - p["x"]) * (p["c"] + (x - p["x"]) * p["d"]))
    inside = let(F.try_element_at(F.filter(pieces, lambda p: p["x"] <= x), F.lit(-1)), cubic)
    return F.when(F.isnan(x), _nan()).when(x < float(k[0]), F.lit(below)).when(x > float(k[-1]), F.lit(above)).otherwise(inside)


class Table(_Profile):
    """A table of some tens of heights, densities and column densities, cubic between them in the logarithms of both.

    Rows with a negative height or without density or column density are left out. Below the table density and column
    density are NaN, above it 0; heights are infinite for less column density than the table has and NaN for more.
    """

    def __init__(self, height: Sequence[float], density: Sequence[float], column_density: Sequence[float]):
        rows = [r for r in zip(height, density, column_density, strict=True) if r[0] >= 0 and r[1] > 0 and r[2] > 0]
        self.km = [r[0] / 1000.0 for r in rows]
        self.log_density = [math.log10(r[1]) for r in rows]
        self.log_column = [math.log10(r[2]) for r in rows]

    def density(self, height: Column) -> Column:
        return F.pow(F.lit(10.0), _spline(height / 1000.0, self.km, self.log_density, math.nan, -math.inf))

    def overburden(self, height: Column) -> Column:
        return F.pow(F.lit(10.0), _spline(height / 1000.0, self.km, self.log_column, math.nan, -math.inf))

    def height_from_overburden(self, x: Column) -> Column:
        inside = _spline(F.log10(x.cast("double")), self.log_column, self.km, math.inf, math.nan) * 1000.0
        return F.when(x > 0, inside).when(x == 0, F.lit(math.inf)).when(x < 0, _nan())
