"""Likelihoods of a pixel's charge given its expectation, the width of a single photo-electron and the pedestal's width."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.common import let

_LEAST = 5.0e-324
_EPSILON = 2.0**-52


def gaussian(image: Column, prediction: Column, spe_width: Column, pedestal: Column) -> Column:
    """Negative log-likelihood in the Gaussian approximation, constants kept."""
    theta = pedestal**2 + prediction * (1 + spe_width**2)
    return F.ln(2 * math.pi * theta) / 2 + (image - prediction) ** 2 / (2 * theta)


def poisson_limit(mean: Column, confidence: float = 0.999) -> Column:
    """The least number whose Poisson distribution function reaches `confidence`; 0 for a mean of 0.

    Terms are summed by their logarithms, ten standard deviations and more beyond the mean, so no mean is too large.
    """

    def of(m: Column) -> Column:
        def step(s: Column, k: Column) -> Column:
            log = s["l"] + F.ln(m / k)
            more = s["c"] < confidence
            return F.struct(log.alias("l"), F.when(more, s["c"] + F.exp(log)).otherwise(s["c"]).alias("c"), F.when(more, k).otherwise(s["k"]).alias("k"))

        start = F.struct((-m).alias("l"), F.exp(-m).alias("c"), F.lit(0).alias("k"))
        last = F.ceil(m + 10 * F.sqrt(m) + 30).cast("int")
        return F.when(m > 0, F.aggregate(F.sequence(F.lit(1), last), start, step)["k"]).when(m == 0, F.lit(0))

    return let(mean.cast("double"), of)


def numeric(image: Column, prediction: Column, spe_width: Column, pedestal: Column, limit: Column) -> Column:
    """Negative log-likelihood summed over 0 to `limit` photo-electrons (see poisson_limit, of an image's largest expectation)."""

    def of(mu: Column) -> Column:
        def step(s: Column, n: Column) -> Column:
            theta = pedestal**2 + n * spe_width**2
            log = F.when(n == 0, -mu).otherwise(s["w"] + F.ln(mu / F.greatest(n, F.lit(1))))
            return F.struct(log.alias("w"), (s["l"] + F.exp(log) / F.sqrt(2 * math.pi * theta) * F.exp(-((image - n) ** 2) / (2 * theta))).alias("l"))

        return -F.ln(F.aggregate(F.sequence(F.lit(0), limit), F.struct(F.lit(0.0).alias("w"), F.lit(_EPSILON).alias("l")), step)["l"])

    return let(prediction + _EPSILON, of)


def combined(image: Column, prediction: Column, spe_width: Column, pedestal: Column, limit: Column, safety: float = 20.0) -> Column:
    """The Gaussian form above `safety` expected photo-electrons, the sum below."""
    return F.when(prediction > safety, gaussian(image, prediction, spe_width, pedestal)).otherwise(numeric(image, prediction, spe_width, pedestal, limit))


def mean_gaussian(prediction: Column, spe_width: Column, pedestal: Column) -> Column:
    """Expectation of twice the negative log-likelihood in the Gaussian approximation."""
    return 1 + math.log(2 * math.pi) + F.ln(pedestal**2 + prediction * (1 + spe_width**2) + _LEAST)


def chi_squared(image: Column, prediction: Column, pedestal: Column, error_factor: float = 2.9) -> Column:
    """Squared difference over pedestal and half of the difference, lowered by an error factor; null where that is 0."""
    return F.try_divide((image - prediction) ** 2, pedestal + 0.5 * (image - prediction)) / error_factor
