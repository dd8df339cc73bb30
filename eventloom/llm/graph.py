"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.runtime import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every vertex of a link and the smallest vertex it reaches; no row for vertices without links.

    Each round hooks a vertex to the neighbour that a hash ranks lowest, shortens the hooks once, and rewrites the
    links between what is left, so chains shrink geometrically and a star ends after one round. Links to null and of
    a vertex with itself are ignored, repeated links count once. Vertices may be of any orderable type.
    """
    e = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    e = cut(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while not e.isEmpty():
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        hook = both.groupBy("u").agg(F.min(rank("v")).alias("m")).select("u", F.least(F.col("m"), rank("u"))["v"].alias("v"))
        hook = cut(hook)
        up = hook.select(F.col("u").alias("v"), F.col("v").alias("w"))
        hook = cut(hook.join(up, "v").select("u", F.col("w").alias("v")))
        if found is None:
            found = hook
        else:
            up = hook.select(F.col("u").alias("v"), F.col("v").alias("w"))
            found = cut(found.join(up, "v", "left").select("u", F.coalesce("w", "v").alias("v")))
        ha, hb = hook.toDF("a", "p"), hook.toDF("b", "q")
        e = e.join(ha, "a").join(hb, "b").where("p <> q")
        e = cut(e.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
    if found is None:
        return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    least = found.groupBy("v").agg(F.min("u").alias("component"))
    return cut(found.join(least, "v").select(F.col("u").alias("id"), "component"))
