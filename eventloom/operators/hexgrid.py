"""Hexagonal cameras in axial coordinates: rectangular images and back without loss, the pixel at a place in constant time."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.common import let, numbers


def unskew(x: Column, y: Column, rotation: float = 0.0, base: float = math.pi / 3) -> tuple[Column, Column]:
    """Places of a hexagonal grid turned by `rotation` and sheared along y, so that they stand on a right-angled one."""
    c, s = math.cos(rotation), math.sin(rotation)
    u = x * c - y * s
    return u, x * s + y * c - u / math.tan(base)


def reskew(x: Column, y: Column, rotation: float = 0.0, base: float = math.pi / 3) -> tuple[Column, Column]:
    """The inverse of unskew."""
    c, s = math.cos(rotation), math.sin(rotation)
    v = y + x / math.tan(base)
    return x * c + v * s, v * c - x * s


@dataclass(frozen=True)
class HexGrid:
    """Axial coordinates (q, r) of pixels, counted from 0, and the frame they come from: an origin and the two neighbour vectors."""

    q: tuple[int, ...]
    r: tuple[int, ...]
    origin: tuple[float, float]
    a: tuple[float, float]
    b: tuple[float, float]

    @staticmethod
    def from_places(x: Sequence[float], y: Sequence[float]) -> HexGrid:
        """Of a regular hexagonal grid in any rotation; an error if a pixel is over a tenth of the pitch away from it."""
        n = len(x)
        if n < 2:
            raise ValueError("a grid needs two pixels at least")
        pitch, j = min((math.hypot(x[i] - x[0], y[i] - y[0]), i) for i in range(1, n))
        # a pixel and its nearest neighbour, by all pixels in case the first one stands apart
        k = 0
        for i in range(n if n < 2000 else 0):
            d, m = min((math.hypot(x[i] - x[o], y[i] - y[o]), o) for o in range(n) if o != i)
            if d < pitch * (1 - 1e-9):
                pitch, j, k = d, m, i
        a = (x[j] - x[k], y[j] - y[k])
        turn = math.pi / 3
        b = (a[0] * math.cos(turn) - a[1] * math.sin(turn), a[0] * math.sin(turn) + a[1] * math.cos(turn))
        det = a[0] * b[1] - a[1] * b[0]
        axial = []
        for u, v in zip(x, y, strict=True):
            dx, dy = u - x[k], v - y[k]
            q, r = (dx * b[1] - dy * b[0]) / det, (dy * a[0] - dx * a[1]) / det
            i, o = round(q), round(r)
            if math.hypot((q - i) * a[0] + (r - o) * b[0], (q - i) * a[1] + (r - o) * b[1]) > pitch / 10:
                raise ValueError("the pixels do not stand on a hexagonal grid")
            axial.append((i, o))
        if len(set(axial)) < n:
            raise ValueError("two pixels stand at one place")
        lq, lr = min(q for q, _ in axial), min(r for _, r in axial)
        origin = (x[k] + lq * a[0] + lr * b[0], y[k] + lq * a[1] + lr * b[1])
        return HexGrid(tuple(q - lq for q, _ in axial), tuple(r - lr for _, r in axial), origin, a, b)

    @property
    def shape(self) -> tuple[int, int]:
        return max(self.q) + 1, max(self.r) + 1

    def neighbors(self) -> tuple[tuple[int, ...], ...]:
        """The up to six neighbours of every pixel, in ascending order."""
        at = {c: i for i, c in enumerate(zip(self.q, self.r, strict=True))}
        around = ((1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1))
        return tuple(tuple(sorted(at[q + i, r + j] for i, j in around if (q + i, r + j) in at)) for q, r in zip(self.q, self.r, strict=True))

    def _table(self) -> list[int]:
        """Pixel at each cell of the rectangle, row after row; -1 without one."""
        rows, columns = self.shape
        out = [-1] * (rows * columns)
        for i, (q, r) in enumerate(zip(self.q, self.r, strict=True)):
            out[q * columns + r] = i
        return out

    def to_rectangle(self, image: Column) -> Column:
        """Array of rows of an image; cells without a pixel are null. A null image stays null."""
        rows, columns = self.shape
        cells = numbers(self._table(), "int")
        flat = F.transform(cells, lambda p: F.when(p >= 0, image[p]))
        return let(flat, lambda f: F.when(image.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(f, i * columns + 1, columns))))

    def from_rectangle(self, rectangle: Column) -> Column:
        """The image of an array of rows: the inverse of to_rectangle."""
        place = F.transform(F.arrays_zip(numbers(self.q, "int").alias("q"), numbers(self.r, "int").alias("r")), lambda p: rectangle[p["q"]][p["r"]])
        return F.when(rectangle.isNotNull(), place)

    def pixel_at(self, x: Column, y: Column) -> Column:
        """The pixel whose hexagon holds a place; null outside of all, or for null or non-finite places.

        Axial coordinates are rounded as a cube's: the coordinate that rounding moves most follows from the other two. At an edge between
        two pixels one of them.
        """
        rows, columns = self.shape
        det = self.a[0] * self.b[1] - self.a[1] * self.b[0]
        dx, dy = x - self.origin[0], y - self.origin[1]
        q, r = (dx * self.b[1] - dy * self.b[0]) / det, (dy * self.a[0] - dx * self.a[1]) / det
        cells = numbers(self._table(), "int")

        def cell(c: Column) -> Column:
            i, j, k = F.rint(c["q"]), F.rint(c["r"]), F.rint(-c["q"] - c["r"])
            di, dj, dk = F.abs(i - c["q"]), F.abs(j - c["r"]), F.abs(k + c["q"] + c["r"])
            u = F.when((di > dj) & (di > dk), -j - k).otherwise(i)
            v = F.when(~((di > dj) & (di > dk)) & (dj > dk), -i - k).otherwise(j)
            inside = (u >= 0) & (u < rows) & (v >= 0) & (v < columns)
            return let(F.when(inside, cells[(u * columns + v).cast("int")]), lambda p: F.when(p >= 0, p))

        near = (F.abs(q) < 1e9) & (F.abs(r) < 1e9)
        return F.when(near, let(F.struct(q.alias("q"), r.alias("r")), cell))


def spiral(rings: int, pitch: float = 1.0, rotation: float = 0.0) -> tuple[list[float], list[float]]:
    """Places of a hexagonal camera of so many rings around one pixel, row after row."""
    x, y = [], []
    for q in range(-rings, rings + 1):
        for r in range(max(-rings, -q - rings), min(rings, -q + rings) + 1):
            u, v = pitch * (q + r / 2), pitch * r * math.sqrt(3) / 2
            x.append(u * math.cos(rotation) - v * math.sin(rotation))
            y.append(u * math.sin(rotation) + v * math.cos(rotation))
    return x, y
