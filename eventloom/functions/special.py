"""The error function to double precision, for columns and for numpy arrays."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.common import let

# W. J. Cody's rational approximations (Math. Comp. 23, 1969), numerator and denominator from the highest power.
NEAR = ((1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3), (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3))
MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
FAR = ((1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4), (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3))
#: Edges between the three, and where the complement is below the smallest number.
EDGES, LAST = (0.46875, 4.0), 26.0


def _ratio(parts, x):
    value = []
    for c in parts:
        v = c[0]
        for a in c[1:]:
            v = v * x + a
        value.append(v)
    return value[0] / value[1]


def _near(a: Column) -> Column:
    """erf from 0 to the first edge."""
    return let(F.greatest(a, F.lit(1e-300)), lambda x: let(x * x, lambda square: x * _ratio(NEAR, square)))


def _middle(a: Column) -> Column:
    """The complement between the edges."""
    return let(F.greatest(a, F.lit(1e-300)), lambda x: F.exp(-(x * x)) * _ratio(MIDDLE, x))


def _far(a: Column) -> Column:
    """The complement beyond them."""
    return let(
        F.greatest(F.least(a, F.lit(LAST)), F.lit(1.0)),
        lambda x: let(x * x, lambda square: F.exp(-square) / x * (1 / math.sqrt(math.pi) - let(1 / square, lambda inverse: _ratio(FAR, inverse)) / square)),
    )


def erf(x: Column) -> Column:
    def of(x: Column, a: Column) -> Column:
        value = F.when(a <= EDGES[0], _near(a)).when(a <= EDGES[1], 1 - _middle(a)).otherwise(1 - _far(a))
        return F.when(F.isnan(a), a).otherwise(F.signum(x) * value)

    return let(x.cast("double"), lambda x: let(F.abs(x), lambda a: of(x, a)))


def erfc(x: Column) -> Column:
    """1 - erf, without the loss of digits for large x."""

    def of(x: Column, a: Column) -> Column:
        value = let(F.when(a <= EDGES[0], 1 - _near(a)).when(a <= EDGES[1], _middle(a)).otherwise(_far(a)), lambda v: F.when(x < 0, 2 - v).otherwise(v))
        return F.when(F.isnan(a), a).otherwise(value)

    return let(x.cast("double"), lambda x: let(F.abs(x), lambda a: of(x, a)))


def normal_between(low: Column, high: Column, mean: Column, sigma: Column) -> Column:
    """Share of a normal distribution between two places; both in one tail are told apart to full precision."""

    def between(a: Column, b: Column) -> Column:
        return F.when(a > 0, erfc(a) - erfc(b)).when(b < 0, erfc(-b) - erfc(-a)).otherwise(erf(b) - erf(a)) / 2

    return let((low - mean) / (math.sqrt(2) * sigma), lambda a: let((high - mean) / (math.sqrt(2) * sigma), lambda b: between(a, b)))


def np_erfc(x: np.ndarray) -> np.ndarray:
    a = np.abs(x)
    near = a * _ratio(NEAR, np.minimum(a, 1) ** 2)
    m = np.clip(a, 0, 5)
    middle = np.exp(-m * m) * _ratio(MIDDLE, m)
    f = np.clip(a, 1, LAST)
    far = np.exp(-f * f) / f * (1 / math.sqrt(math.pi) - _ratio(FAR, 1 / (f * f)) / (f * f))
    value = np.where(a <= EDGES[0], 1 - near, np.where(a <= EDGES[1], middle, far))
    return np.where(x < 0, 2 - value, value)


def np_normal_between(low: np.ndarray, high: np.ndarray, mean: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    a, b = (low - mean) / (math.sqrt(2) * sigma), (high - mean) / (math.sqrt(2) * sigma)
    turn = b < 0
    a, b = np.where(turn, -b, a), np.where(turn, -a, b)
    return (np_erfc(a) - np_erfc(b)) / 2
