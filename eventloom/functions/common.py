"""Small Column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def total(a: Column) -> Column:
    """Sum of an array in double precision."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is zero, as ANSI mode would raise."""
    return F.try_divide(a, b)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def indices(n: int) -> Column:
    return F.array(*[F.lit(i) for i in range(n)]) if n <= 64 else F.sequence(F.lit(0), F.lit(n - 1))


def numbers(values, kind: str = "double") -> Column:
    return F.array(*[F.lit(v).cast(kind) for v in values])


def nested(values) -> Column:
    """A literal array of arrays of integers."""
    return F.array(*[F.array(*[F.lit(int(x)) for x in v]).cast("array<int>") for v in values])
