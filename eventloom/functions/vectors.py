"""Small vector and spectrum formulas over columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.common import let, total


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """a with length 1; null elements for the zero vector."""
    return let(length(a), lambda n: F.transform(a, lambda x: F.try_divide(x, n)))


def angle(a: Column, b: Column) -> Column:
    """Angle between two vectors, in radians; null with a zero vector."""
    cosine = F.try_divide(dot(a, b), length(a) * length(b))
    return F.when(cosine.isNotNull(), F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))


def rotate(x: Column, y: Column, by: Column) -> tuple[Column, Column]:
    return x * F.cos(by) - y * F.sin(by), x * F.sin(by) + y * F.cos(by)


def along_and_across(x: Column, y: Column, x0: Column, y0: Column, psi: Column) -> tuple[Column, Column]:
    """(longitudinal, transverse) place relative to an axis through (x0, y0) at angle psi."""
    return rotate(x - x0, y - y0, -psi)


def rmse(truth: Column, prediction: Column) -> Column:
    """Aggregate: root of the mean squared difference."""
    return F.sqrt(F.avg((truth - prediction) ** 2))


def power_law(energy: Column, norm: float, index: float, reference: float = 1.0) -> Column:
    return norm * F.pow(energy / reference, F.lit(index))


def power_law_with_bump(energy: Column, norm: float, index: float, f: float, mu: float, sigma: float, reference: float = 1.0) -> Column:
    """A power law times 1 + f (exp(g) - 1), g a normal density of log10(energy)."""
    g = F.exp(-((F.log10(energy / reference) - mu) ** 2) / (2 * sigma**2)) / (sigma * math.sqrt(2 * math.pi))
    return power_law(energy, norm, index, reference) * (1 + f * (F.exp(g) - 1))


#: Fluxes by energy in TeV: gamma rays of the Crab nebula per TeV cm2 s, protons and electrons per TeV cm2 s sr. Fixed values.
SPECTRA = {
    "crab": lambda e: power_law(e, 2.83e-11, -2.62),
    "proton": lambda e: power_law(e, 9.8e-6, -2.62),
    "electron": lambda e: power_law_with_bump(e, 2.385e-9, -3.43, 1.950, -0.101, 0.741),
}
