from collections import defaultdict

from eventloom.llm import sharding
from eventloom.llm.queries import op5_extendible_sharding


def hold(rows, sizes, limit):
    """All rows once, byte sums right, no shard above the limit but for single rows, buckets prefix-free."""
    assert sorted((r.doc_id or -1) for r in rows) == sorted((i or -1) for i, _ in sizes)
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    size = dict(sizes)
    for rs in shards.values():
        total = sum(size[r.doc_id] for r in rs)
        assert {r.shard_bytes for r in rs} == {total}
        assert total <= limit or len(rs) == 1
    heads = sorted({s.split("/")[0] for s in shards})
    assert not any(b.startswith(a) for a, b in zip(heads, heads[1:], strict=False))
    return shards


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    sizes = [(r.doc_id, len((r.text or "").encode())) for r in docs]
    hold(op5_extendible_sharding(spark, small).collect(), sizes, 8 << 20)
    d = spark.read.parquet(f"{small}/documents.parquet")
    shards = hold(sharding.shard(d, limit=50_000).collect(), sizes, 50_000)
    assert len({len(s) for s in shards}) > 1  # only what is too large was split


def test_equal_rows_overflow(spark):
    rows = [(1, "x" * 100)] * 500 + [(2, None), (3, ""), (None, "y"), (4, "z" * 5000)]
    d = spark.createDataFrame([(*r, "s", 0) for r in rows], "doc_id long, text string, shard string, shard_depth int")
    shards = hold(sharding.shard(d, limit=1000).collect(), rows_sizes(rows), 1000)
    assert sum("/" in s for s in shards) >= 50


def rows_sizes(rows):
    return [(i, len(t or "")) for i, t in rows]


def test_empty(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_against_splitting_by_hand(spark, small, monkeypatch):
    """Only oversized buckets split, on one more bit at a time: the same buckets as a plain directory, by look-up and by join."""
    from pyspark.sql import functions as F

    d = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = d.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2).alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).collect()
    for limit in (20_000, 150_000, 1 << 30):
        want = {}

        def split(part, depth, limit=limit, want=want):
            if sum(r.n for r in part) <= limit or len(part) == 1 and depth == 62:
                want.update({r.doc_id: (format(r.h >> (62 - depth), f"0{depth}b") if depth else "", depth) for r in part})
                return
            for bit in (0, 1):
                some = [r for r in part if r.h >> (61 - depth) & 1 == bit]
                if some:
                    split(some, depth + 1)

        split([r for r in rows], 0)
        big = {r.doc_id for r in rows if r.n > limit}
        for buckets in (sharding.BUCKETS, 0):
            monkeypatch.setattr(sharding, "BUCKETS", buckets)
            got = {r.doc_id: (r.shard.split("/")[0], r.shard_depth) for r in sharding.shard(d, limit=limit).collect()}
            assert {k: v for k, v in got.items() if k not in big} == {k: v for k, v in want.items() if k not in big}
