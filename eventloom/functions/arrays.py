"""Statistics and selections over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.common import let, ratio, total


def n_largest(a: Column, n: int) -> Column:
    """The n largest values, largest first."""
    return F.slice(F.sort_array(a, asc=False), 1, n)


def arg_n_largest(a: Column, n: int) -> Column:
    """Positions of the n largest values, largest first; of equal values the later position comes first."""
    return F.transform(F.slice(F.sort_array(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), asc=False), 1, n), lambda s: s["i"])


def argmax(a: Column) -> Column:
    """Position of the first largest value."""
    return F.array_position(a, F.array_max(a)).cast("int") - 1


def mean(a: Column) -> Column:
    return ratio(total(a), F.size(a))


def moment(a: Column, centre: Column, order: int) -> Column:
    """Mean of (x - centre)^order."""
    return ratio(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.pow(x.cast("double") - centre, F.lit(float(order)))), F.size(a))


def variance(a: Column) -> Column:
    """Population variance of the numbers of a; NaN left out."""
    return let(F.filter(a, lambda x: ~F.isnan(x)), lambda v: let(mean(v), lambda m: moment(v, m, 2)))


def describe(a: Column) -> Column:
    """struct(max, min, mean, std, skewness, kurtosis): population moments, excess kurtosis; null moments for a constant array."""

    def body(m: Column) -> Column:
        return let(
            moment(a, m, 2),
            lambda v: F.struct(
                F.array_max(a).cast("double").alias("max"),
                F.array_min(a).cast("double").alias("min"),
                m.alias("mean"),
                F.sqrt(v).alias("std"),
                ratio(moment(a, m, 3), F.pow(v, F.lit(1.5))).alias("skewness"),
                (ratio(moment(a, m, 4), v * v) - 3.0).alias("kurtosis"),
            ),
        )

    return let(mean(a), body)


def mask_to_ids(mask: Column, ids: Column) -> Column:
    """Ids at the true positions of a boolean array."""
    return F.filter(F.zip_with(ids, mask, lambda i, m: F.when(m, i)), lambda x: x.isNotNull())


def ids_to_mask(selected: Column, ids: Column) -> Column:
    return F.transform(ids, lambda i: F.array_contains(selected, i))


def multiplicity(mask: Column) -> Column:
    """How many positions of a boolean array are true."""
    return F.size(F.filter(mask, lambda x: x))


def closest_index(values: Column, target: Column) -> Column:
    """Position of the value nearest to target; of two equally near ones the larger value's."""
    near = F.transform(values, lambda v, i: F.struct(F.abs(v - target).alias("d"), (-v).alias("v"), i.alias("i")))
    return F.array_min(near)["i"]
