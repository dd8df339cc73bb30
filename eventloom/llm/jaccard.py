"""N-gram Jaccard join: documents whose shingle sets have a Jaccard similarity of at least num/den, in the metric space of sets.

Sets are points; their distance is the size of the symmetric difference, and J(A,B) >= t exactly when
|A xor B| <= (1-t)/(1+t) (|A|+|B|). The pivots are the sets of a single shingle. A document is equally far from each
shingle that it has and farther from all others; the rarer shingle decides ties and so the Voronoi region. Let W be
the first w pivots of A. A document B without any of them has |A xor B| >= | |A xor W| - |B xor W| | = |B| + 2w - |A| by
the triangle inequality, which is more than a link allows once w > (1-t)|A|. So a copy of A in the regions of its first
floor((1-t)|A|)+1 pivots (its window) meets every partner in the region of a pivot that both windows hold, and the
place of the shared pivot in both windows bounds the distance once more.

A region is first compared with a few central members, which joins groups of near copies at linear cost; regions within
one component are done. A region that is still larger than REGION is dealt again, to the pairs of its pivot and the next ones
of windows longer by one (a link needs as many shared shingles in those), and so on for LEVELS levels. What is left is joined
within bands of like sizes. There the parities of hashed shingles give a lower bound of the distance (folding sets into
bits never increases a symmetric difference), and only what passes is compared as sets. The number of passes over the
texts is bounded, sizes and counts only decide where a pair is compared, and components are exact: every pair that could join
two components is compared, at whatever level. Copies of one set are folded and count as one point.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm import graph, text as tx
from eventloom.runtime import cut

#: Size of the table that shingle frequencies are counted in, and numbers of a slice of it; only ranks depend on it, so collisions cost no link.
BUCKETS, SLICE = 1 << 22, 1 << 16
#: Bits of the map that finds the documents to compare in the scan.
SPOTS = 1 << 22
#: Central members that a region is compared with, round by round.
CENTRES = (1, 8, 32)
#: Comparisons that the last join may make without another round, for each entry of a region.
REST = 16
#: Members of a region that is not dealt again, and levels of regions.
REGION, LEVELS = 2000, 3
#: Words (of 64 bits) of the parities that regions carry.
WORDS = 8


def _buckets(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64(BUCKETS - 1)).astype(np.int64)


def shingle_ranks(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """For each bucket a byte that grows with the number of documents that have a shingle in it, over all documents.

    Tasks count into a table of fixed size and pass it on in slices, which are added up 64 tasks at a time.
    """

    def count(batches):
        n = np.zeros(BUCKETS, np.int64)
        for b in filter(len, batches):
            for t in b["t"]:
                np.add.at(n, _buckets(tx.shingle_set(t, k)), 1)
        z = zstandard.ZstdCompressor(level=1)
        for i in range(0, BUCKETS, SLICE):
            if n[i : i + SLICE].any():
                yield pd.DataFrame({"slice": [i // SLICE], "n": [z.compress(n[i : i + SLICE].tobytes())]})

    def add(g: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(SLICE, np.int64)
        for x in g["n"]:
            n += np.frombuffer(zstandard.decompress(x), np.int64)
        return pd.DataFrame({"slice": g["slice"].iloc[:1], "task": g["task"].iloc[:1], "n": [zstandard.ZstdCompressor(level=1).compress(n.tobytes())]})

    schema = "slice int, task int, n binary"
    parts = docs.select(F.col(text).alias("t")).mapInPandas(count, "slice int, n binary").select("slice", F.spark_partition_id().alias("task"), "n")
    parts = cut(parts)
    while (parts.agg(F.max("task")).first()[0] or 0) > 0:
        parts = cut(parts.withColumn("task", F.expr("task div 64").cast("int")).groupBy("slice", "task").applyInPandas(add, schema))

    def ranks(batches):
        for b in filter(len, batches):
            yield pd.DataFrame({"slice": b["slice"], "n": [np.minimum(8 * np.log2(1 + np.frombuffer(zstandard.decompress(x), np.int64)), 255).astype(np.uint8).tobytes() for x in b["n"]]})

    out = np.zeros(BUCKETS, np.uint8)
    for r in parts.select("slice", "n").mapInPandas(ranks, "slice int, n binary").collect():  # BUCKETS bytes in all
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["n"], np.uint8)
    return out


def parity_bits(n: int) -> int:
    """Bits of a set's parities: a power of two of about its size."""
    return max(64 * WORDS, 1 << max(int(n) - 1, 1).bit_length())


def parities(s: np.ndarray) -> np.ndarray:
    """Bit i tells whether an odd number of members of s hash to i; words of 64 bits."""
    bits = parity_bits(len(s))
    n = np.bincount(((s >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((n & 1).astype(np.uint8)).view(np.uint64)


def _folded(p: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(p.reshape(-1, words), axis=0)


def _windows(docs: DataFrame, k: int, num: int, den: int, ranks) -> DataFrame:
    """row, doc, key, fp (of the whole set), n, parity, and window: the pivots, best first, with those that lower levels add."""

    def rows(batches):
        rank = ranks.value
        for whole in filter(len, batches):
            for at in range(0, len(whole), 500):
                b = whole.iloc[at : at + 500]
                fp, n, parity, window = [], [], [], []
                for t in b["t"]:
                    s = tx.shingle_set(t, k)
                    n.append(len(s))
                    fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    parity.append(parities(s).tobytes() if len(s) else None)
                    w = len(s) - -(-num * len(s) // den) + LEVELS if len(s) else 0
                    order = np.lexsort((s, rank[_buckets(s)]))
                    window.append(s[order[:w]].view(np.int64))
                yield pd.DataFrame({"doc": b["doc"].to_numpy(), "key": b["key"].to_numpy(), "fp": fp, "n": n, "parity": parity, "window": window}).astype({"doc": "Int64"})

    out = docs.mapInPandas(rows, "doc long, key long, fp binary, n int, parity binary, window array<long>")
    return out.withColumn("row", F.monotonically_increasing_id())


def _sets(docs: DataFrame, k: int, spots) -> DataFrame:
    """fp and set of the documents whose key may be among those asked for."""

    def rows(batches):
        asked = np.unpackbits(spots.value).astype(bool)
        for whole in filter(len, batches):
            some = whole["t"][asked[whole["key"].to_numpy() & (SPOTS - 1)]]
            for at in range(0, len(some), 200):
                s = [tx.shingle_set(t, k) for t in some.iloc[at : at + 200]]
                yield pd.DataFrame({"fp": [xxhash.xxh3_128_digest(x.tobytes()) for x in s], "s": [x.view(np.int64) for x in s]})

    return docs.select("key", "t").mapInPandas(rows, "fp binary, s array<long>")


def _may_link(num: int, den: int, level: int = 1) -> Column:
    """Whether the sizes and the places of the pivot shared at a level allow a link of x and y."""
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    left = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) + (level - 1)
    return (den * small >= num * large) & (left * (den + num) >= num * (F.col("x.n") + F.col("y.n")))


def _near(num: int, den: int) -> Column:
    """Whether the parities that x and y carry allow a link: their distance times (num + den) is at most (den - num) of both sizes."""
    differ = sum((F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(1, WORDS)), F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))))
    return differ * (den + num) <= (den - num) * (F.col("x.n") + F.col("y.n"))


class _Corpus:
    """The points of a join (one for each distinct set) and the comparison of pairs of them."""

    def __init__(self, docs: DataFrame, points: DataFrame, k: int, num: int, den: int):
        self.docs, self.points, self.k, self.num, self.den = docs, points, k, num, den
        self.sc = docs.sparkSession.sparkContext

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link: a bound by parities first, then the sets, made only of documents that are left.

        A bitmap of fixed size finds them in the scan, an exact join follows.
        """
        num, den, k = self.num, self.den, self.k

        def may(batches):
            for b in filter(len, batches):
                keep = np.zeros(len(b), bool)
                words = np.minimum(b["pa"].map(len), b["pb"].map(len)).to_numpy() // 8
                for i, (p, q, w, n) in enumerate(zip(b["pa"], b["pb"], words, b["n"], strict=True)):
                    x = _folded(np.frombuffer(p, np.uint64), w) ^ _folded(np.frombuffer(q, np.uint64), w)
                    keep[i] = int(np.bitwise_count(x).sum()) * (den + num) <= (den - num) * n
                yield b.loc[keep, ["a", "b"]]

        p = self.points.select("c", F.col("n").cast("long").alias("n"), "parity")
        both = pairs.join(p.toDF("a", "na", "pa"), "a").join(p.toDF("b", "nb", "pb"), "b").select("a", "b", "pa", "pb", (F.col("na") + F.col("nb")).alias("n"))
        pairs = cut(both.mapInPandas(may, "a long, b long"))
        asked = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
        wanted = cut(self.points.join(asked, "c", "left_semi").select("fp", "c", "key"))
        found = wanted.select(F.col("key").bitwiseAND(SPOTS - 1).alias("spot")).distinct().toPandas()["spot"].to_numpy(np.int64)
        spots = np.zeros(SPOTS, bool)
        spots[found] = True
        sets = _sets(self.docs, k, self.sc.broadcast(np.packbits(spots)))
        sets = cut(sets.join(wanted.select("fp", "c"), "fp").groupBy("c").agg(F.first("s").alias("s")))
        sa, sb = sets.toDF("a", "sa"), sets.toDF("b", "sb")

        def equal(batches):
            for b in filter(len, batches):
                keep = np.zeros(len(b), bool)
                for i, (x, y) in enumerate(zip(b["sa"], b["sb"], strict=True)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = common * (den + num) >= num * (len(x) + len(y))
                yield b.loc[keep, ["a", "b"]]

        return pairs.join(sa, "a").join(sb, "b").mapInPandas(equal, "a long, b long")


def _mixed(entries: DataFrame) -> DataFrame:
    """Entries of the regions that hold more than one component."""
    if "g" not in entries.columns:
        return entries
    some = entries.groupBy("pivot").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high").select("pivot")
    return entries.join(some, "pivot")


def _labelled(entries: DataFrame, comp: DataFrame) -> DataFrame:
    e = entries.drop("g").join(comp.toDF("c", "g"), "c", "left")
    return e.withColumn("g", F.coalesce("g", "c"))


def _pair(x: str = "x.c", y: str = "y.c") -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _central_pairs(entries: DataFrame, centres: int, may: Column) -> DataFrame:
    """Pairs of the members of a region with central ones of its largest component (of the region, before there are components)."""
    y = F.struct("pos", "n", "c").alias("y")
    if "g" not in entries.columns:
        least = entries.groupBy("pivot").agg(F.min(y).alias("x"))
        return entries.select("pivot", y).join(least, "pivot").where((F.col("x.c") != F.col("y.c")) & may).select(*_pair())
    share = entries.groupBy("pivot", "g").agg(F.count("*").alias("m"))
    main = share.groupBy("pivot").agg(F.max(F.struct("m", "g"))["g"].alias("main"))
    e = entries.join(main, "pivot")
    inner = e.where("g = main").groupBy("pivot", F.pmod(F.xxhash64("c", F.lit(centres)), F.lit(centres)).alias("lot")).agg(F.min(F.struct("pos", "n", "c")).alias("x"))
    return e.where("g <> main").select("pivot", y).join(inner.select("pivot", "x"), "pivot").where(may).select(*_pair())


def _banded_pairs(entries: DataFrame, level: int, num: int, den: int) -> DataFrame:
    """All pairs of a region in different components that sizes, places and parities let through; each pair meets in one band of sizes."""
    width = float(np.log(den / num)) if num < den else 1e-6
    band = lambda n: F.floor(F.log(n.cast("double")) / F.lit(width)).cast("int")
    y = F.struct("pos", "n", "c", "g", *[f"s{i}" for i in range(WORDS)])
    inner = entries.select("pivot", y.alias("y"), band(F.col("n")).alias("band"))
    low, high = F.ceil(F.col("n") * num / den), F.floor(F.col("n") * den / num)
    outer = entries.select("pivot", y.alias("x"), F.explode(F.sequence(band(low), band(high))).alias("band"))
    both = outer.join(inner, ["pivot", "band"])
    return both.where((F.col("x.c") < F.col("y.c")) & (F.col("x.g") != F.col("y.g")) & _may_link(num, den, level) & _near(num, den)).select(*_pair())


def _exhaustive_pairs(entries: DataFrame, points: DataFrame, windows: DataFrame, num: int, den: int) -> DataFrame:
    """Every pair in different components of a region that may link; regions over REGION are dealt to further pivots first."""

    def bits(batches):
        for b in filter(len, batches):
            s = np.stack([_folded(np.frombuffer(x, np.uint64), WORDS).view(np.int64) for x in b["parity"]])
            yield pd.DataFrame({"c": b["c"]} | {f"s{i}": s[:, i] for i in range(WORDS)})

    names = [f"s{i}" for i in range(WORDS)]
    carried = points.join(entries.select("c").distinct(), "c", "left_semi").select("c", "parity")
    carried = cut(carried.mapInPandas(bits, "c long, " + ", ".join(f"{s} long" for s in names)))
    found = []
    for level in range(1, LEVELS + 1):
        m = entries.groupBy("pivot").agg(F.count("*").alias("m"), F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high").select("pivot", "m")
        entries = cut(entries.join(m, "pivot"))
        large = entries.where(F.col("m") > REGION)
        if level == LEVELS or large.isEmpty():
            found.append(_banded_pairs(entries.join(carried, "c"), level, num, den))
            break
        # Sets too small to need level + 1 shared shingles are compared here, the rest in the regions of the next level.
        here = entries.where((F.col("m") <= REGION) | (F.col("n") * num < (level + 1) * den))
        found.append(_banded_pairs(here.join(carried, "c"), level, num, den))
        longer = windows.select(F.col("row").alias("c"), F.posexplode("window").alias("at", "next"))
        deeper = large.join(longer, "c").where((F.col("at") > F.col("pos")) & (F.col("at") < F.col("n") - F.ceil(F.col("n") * num / den) + level + 1))
        entries = deeper.select(F.xxhash64("pivot", "next").alias("pivot"), F.col("at").alias("pos"), "c", "n", "g")
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of docs: `doc`, n_shingles long, component_id (smallest `doc` reachable by links of J >= num/den).

    Null and empty texts, and texts without a word, have an empty set and link with nothing: their component is their
    own id. Fewer than k words count as one shingle. Rows with equal sets link, repeated rows and rows without an id
    included; a component without any id is null. Other columns of docs are ignored, whatever their names. Very long texts are
    handled whole; ties between equally rare pivots go to the smaller hash, which no result depends on.
    """
    sc = docs.sparkSession.sparkContext
    d = docs.select(F.col(doc).cast("long").alias("doc"), F.xxhash64(doc, text).alias("key"), F.col(text).alias("t"))
    ranks = sc.broadcast(shingle_ranks(d, "t", k))
    windows = cut(_windows(d, k, num, den, ranks))
    # Points: one for each distinct set, with the row to fetch its text from and a short key of its own.
    own = windows.where("fp is not null").groupBy("fp").agg(F.min("doc").alias("doc"), F.min(F.struct("row", "key")).alias("at"), F.first("n").alias("n"), F.first("parity").alias("parity"))
    points = cut(own.select("fp", F.col("at.row").alias("c"), "at.key", "n", "doc", "parity"))
    copies = windows.where("fp is not null").select("row", "fp").join(points.select("fp", "c"), "fp").where("row <> c").select("row", "c")

    pivots = F.slice("window", 1, F.col("n") - F.ceil(F.col("n") * num / den).cast("int") + 1)
    posts = windows.where("fp is not null").select("row", "n", F.posexplode(pivots).alias("pos", "pivot")).select("pivot", "row", (F.col("n").cast("long") * (1 << 32) + F.col("pos")).alias("np"))
    # Nearly every pivot is of one row only: counting first would shuffle as much again as the posts.
    shared = posts.withColumn("m", F.count("*").over(Window.partitionBy("pivot"))).where("m > 1")
    region = shared.join(copies, "row", "left").where("c is null")
    region = region.select("pivot", F.col("np").bitwiseAND((1 << 32) - 1).cast("int").alias("pos"), F.col("row").alias("c"), F.shiftright("np", 32).cast("int").alias("n"))
    region = cut(region, clean=True)  # by far the largest shuffle
    size = region.count()

    corpus = _Corpus(d, points, k, num, den)
    may = _may_link(num, den)
    links, entries, comp = None, region, None
    for centres in CENTRES:
        pairs = cut(_central_pairs(entries, centres, may).distinct())
        new = cut(corpus.links(pairs))
        links = new if links is None else links.union(new)
        comp = graph.components(links)
        entries = cut(_mixed(_labelled(entries, comp)).select("pivot", "pos", "c", "n", "g"))
        share = entries.groupBy("pivot", "g").agg(F.count("*").alias("m"))
        share = share.groupBy("pivot").agg(F.sum("m").alias("m"), F.max("m").alias("main"))
        todo = share.agg(F.sum((F.col("m") - F.col("main")) * F.col("m"))).first()[0] or 0
        if todo <= REST * size or new.isEmpty():
            break
    if todo:
        pairs = cut(_exhaustive_pairs(entries, points, windows, num, den).distinct())
        new = cut(corpus.links(pairs))
        if not new.isEmpty():
            comp = graph.components(links.union(new))
    least = points.join(comp.toDF("c", "g"), "c", "left").select("fp", F.coalesce("g", "c").alias("g"), "doc")
    least = least.join(least.groupBy("g").agg(F.min("doc").alias("component_id")), "g").select("fp", "component_id")
    out = windows.select("doc", "fp", "n").join(least, "fp", "left")
    out = out.select("doc", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("fp").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumnRenamed("doc", doc)
