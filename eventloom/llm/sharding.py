"""Sharding by extendible hashing: a directory over prefixes of a 62-bit hash; only buckets over the byte limit split on
another bit.

Each round adds up the bytes of STEP further bits of the oversized buckets only (with partial sums before the shuffle),
and settles every bucket at the first bit where it fits. Rows that agree in the whole hash cannot be told apart by more
bits; where those alone are over the limit they go to numbered overflow pages of the same bucket, by rank.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.runtime import cut

BITS, STEP, SALTS = 62, 12, 64
#: Buckets up to which the directory is broadcast.
BUCKETS = 500_000


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(depth, prefix, bytes): the buckets over `__h` and `__n` (bytes of a row) of rows; disjoint, and covering all rows.

    Siblings below a bucket that fits are one bucket. A bucket of depth BITS may be over the limit: its rows share one hash.
    """
    leaves = []
    todo = rows.select("__h", "__n")
    depth = 0
    whole = rows.agg(F.sum("__n").alias("n")).first()[0] or 0
    if whole <= limit:
        return rows.sparkSession.createDataFrame([(0, 0, whole)], "depth int, prefix long, bytes long")
    while depth < BITS:
        deep = min(depth + STEP, BITS)
        fine = cut(todo.groupBy(F.shiftright("__h", BITS - deep).alias("p")).agg(F.sum("__n").alias("n")))
        # Sums of all shorter prefixes by doubling up: a bucket settles at the first depth where it fits.
        sums = fine.select("p", "n", F.lit(None).cast("int").alias("at"))
        for d in range(depth + 1, deep + 1):
            w = Window.partitionBy(F.shiftright("p", deep - d))
            sums = sums.withColumn("at", F.coalesce("at", F.when(F.sum("n").over(w) <= limit, F.lit(d))))
        sums = cut(sums)
        fit = sums.where("at is not null")
        leaves.append(fit.groupBy(F.col("at").alias("depth"), F.expr(f"shiftright(p, {deep} - at)").alias("prefix")).agg(F.sum("n").alias("bytes")))
        over = sums.where("at is null").select("p", "n")
        if deep == BITS:
            leaves.append(over.select(F.lit(BITS).alias("depth"), F.col("p").alias("prefix"), F.col("n").alias("bytes")))
        if over.isEmpty():
            break
        todo = cut(todo.withColumn("p", F.shiftright("__h", BITS - deep)).join(over.select("p"), "p", "left_semi").drop("p"))
        depth = deep
    return cut(reduce(DataFrame.unionByName, leaves))


def shard(docs: DataFrame, limit: int = 8 << 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with shard (bits of the bucket, then `/page` in case of overflow), shard_depth int and shard_bytes long added.

    A row counts the UTF-8 bytes of its text; null texts count none. The hash is of the key and the text, so rows
    without a key spread as well. No shard is over `limit`, but for single rows that are. Columns of docs with the
    added names are replaced; an empty table gives no rows.
    """
    d = docs.drop("shard", "shard_depth", "shard_bytes")
    h = F.shiftrightunsigned(F.xxhash64(F.col(key), F.col(text)), 2)
    d = d.withColumn("__h", h).withColumn("__n", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    where = directory(d, limit)
    depths = sorted(r[0] for r in where.select("depth").distinct().collect())  # at most BITS + 1 numbers
    if where.count() <= BUCKETS:
        # One look-up for each depth in use; the bucket is at one of them.
        found = []
        for x in depths:
            at = where.where(F.col("depth") == x).select(F.col("prefix").alias(f"__p{x}"), F.col("bytes").alias(f"__b{x}"))
            d = d.withColumn(f"__p{x}", F.shiftright("__h", BITS - x) if x else F.lit(0).cast("long")).join(F.broadcast(at), f"__p{x}", "left").drop(f"__p{x}")
            found.append(F.when(F.col(f"__b{x}").isNotNull(), F.struct(F.lit(x).alias("d"), F.col(f"__b{x}").alias("bytes"))))
        hit = F.coalesce(*found) if found else F.struct(F.lit(0).alias("d"), F.lit(0).cast("long").alias("bytes"))
        d = d.withColumn("__hit", hit).drop(*[f"__b{x}" for x in depths]).withColumns({"__d": F.col("__hit.d"), "__bytes": F.col("__hit.bytes")}).drop("__hit")
    else:
        # Hashes alone meet the directory at the depths in use, then the rows meet their hashes.
        h = d.select("__h").distinct().withColumn("__d", F.explode(F.array(*[F.lit(x) for x in depths])))
        h = h.withColumn("__p", F.expr(f"CASE WHEN __d = 0 THEN 0L ELSE shiftright(__h, {BITS} - __d) END"))
        h = h.join(where.withColumnsRenamed({"depth": "__d", "prefix": "__p", "bytes": "__bytes"}), ["__d", "__p"])
        d = d.join(h.select("__h", "__d", "__bytes"), "__h")
    d = d.withColumn("__p", F.expr(f"CASE WHEN __d = 0 THEN 0L ELSE shiftright(__h, {BITS} - __d) END"))
    bits = F.when(F.col("__d") == 0, F.lit("")).otherwise(F.expr("lpad(bin(__p), __d, '0')"))
    d = d.withColumn("shard", bits)
    over = d.where(F.col("__bytes") > limit)
    fits = d.where(F.col("__bytes") <= limit).withColumn("shard_bytes", F.col("__bytes"))
    if not over.limit(1).isEmpty():
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
        over = cut(over.withColumn("__s", salt))
        per = over.groupBy("__h", "__s").agg(F.count("*").alias("k"))
        per = per.withColumn("__from", F.sum("k").over(Window.partitionBy("__h").orderBy("__s")) - F.col("k")).drop("k")
        rank = F.row_number().over(Window.partitionBy("__h", "__s").orderBy(F.lit(0))) - 1 + F.col("__from")
        page = F.floor(rank / F.greatest(F.floor(F.lit(limit) / F.col("__n")), F.lit(1)))
        over = over.join(per, ["__h", "__s"]).withColumn("shard", F.concat("shard", F.lit("/"), page.cast("string")))
        pages = over.groupBy("shard").agg(F.sum("__n").alias("shard_bytes"))
        over = over.join(pages, "shard").drop("__s", "__from")
        fits = fits.unionByName(over)
    return fits.withColumn("shard_depth", F.col("__d").cast("int")).select(*[c for c in docs.columns if c not in ("shard", "shard_depth", "shard_bytes")], "shard", "shard_depth", "shard_bytes")
