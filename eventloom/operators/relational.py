"""Key-preserving joins, merges and set checks over event tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.runtime import cut


class CannotMerge(ValueError):
    """Inputs that do not belong into one table."""


def join_allow_empty(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", order: list[str] | None = None) -> DataFrame:
    """Equi-join that keeps both schemas even where a side has no rows; `order` sorts the result."""
    out = left.join(right, on, how)
    return out.orderBy(*order) if order else out


def join_with_suffix(left: DataFrame, right: DataFrame, on: list[str], suffix: str = "_mono", how: str = "left") -> DataFrame:
    """Columns of both sides that clash get the suffix on the left one."""
    clash = {c: c + suffix for c in left.columns if c in right.columns and c not in on}
    return left.withColumnsRenamed(clash).join(right, on, how)


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> bool:
    """Whether both tables hold the same multiset of keys."""
    x, y = a.groupBy(*keys).agg(F.count("*").alias("n")), b.groupBy(*keys).agg(F.count("*").alias("m"))
    return x.join(y, keys, "full").where(~F.col("n").eqNullSafe(F.col("m"))).isEmpty()


def merge(tables: list[DataFrame], once: bool = False, drop: list[str] | None = None) -> DataFrame:
    """All rows of all tables, cast to the first one's types; with `once`, the first table only. Column sets must agree."""
    first = tables[0].drop(*(drop or []))
    if once:
        return first
    out = [first]
    for t in tables[1:]:
        t = t.drop(*(drop or []))
        if set(t.columns) != set(first.columns):
            raise CannotMerge(f"columns differ: {sorted(set(t.columns) ^ set(first.columns))}")
        out.append(t.select(*[F.col(f.name).cast(f.dataType) for f in first.schema]))
    return reduce(DataFrame.unionByName, out)


def check_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    """Raise where both tables have a key."""
    if not a.select(key).intersect(b.select(key)).isEmpty():
        raise CannotMerge(f"{key} occurs in both inputs")


def check_equal(a: DataFrame, b: DataFrame) -> None:
    """Raise where the rows of the tables differ."""
    if not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()):
        raise CannotMerge("the tables differ")


def with_row_index(df: DataFrame, order: list[str], name: str = "row_idx") -> DataFrame:
    """A dense index in the given order, without one task for all rows: ranks within ranges, plus the ranges' offsets."""
    # Written once: ranges must be the same ones for ranks and offsets.
    d = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    d = d.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = d.groupBy("__part").agg(F.count("*").alias("__n"))
    offsets = sizes.withColumn("__from", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return d.join(F.broadcast(offsets), "__part").withColumn(name, (F.col("__rank") + F.col("__from") - 1).cast("long")).drop("__part", "__rank", "__from")


def row_slice(df: DataFrame, start: int, stop: int, step: int = 1, index: str = "row_idx") -> DataFrame:
    """Rows start, start + step, ... before stop of an indexed table."""
    i = F.col(index)
    return df.where((i >= start) & (i < stop) & ((i - start) % step == 0))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in order; aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min(F.struct(*order, *[c for c in rest if c not in order]))
    return df.groupBy(*keys).agg(pick.alias("__x")).select(*keys, *[F.col(f"__x.{c}").alias(c) for c in rest])


def sample_rows(df: DataFrame, n: int, seed: int, key: list[str]) -> DataFrame:
    """n rows without replacement, chosen by a seeded hash of their key, so that a rerun gives the same ones."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)
