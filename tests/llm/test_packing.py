import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventloom.llm import packing
from eventloom.llm.queries import op3_best_fit_packing, vocabulary


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def hold(rows, docs, limit):
    """Check pieces against the plain tokenizer, and the sequences; return how many there are."""
    want = []
    for (d, _), ids in zip(docs, plain_ids([t for _, t in docs]), strict=True):
        for k, at in enumerate(range(0, len(ids), limit)):
            x = np.array(ids[at : at + limit], "<u4")
            want.append((d, k, at, len(x), zlib.crc32(x.tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= limit
    return len(seqs)


def test_whole_table(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rows = op3_best_fit_packing(spark, small).collect()
    n = hold(rows, docs, 2048)
    least = -(-sum(r.length for r in rows) // 2048)
    assert n <= 1.03 * least + 1


def test_odd_texts(spark):
    docs = [(1, None), (2, ""), (3, " \n\t "), (4, "J̌ H̱ é É"), (5, "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b"), (6, "DON'T it's x y\x1cz \U0001f600\U0001f600"), (7, "x" * 30_000), (8, "́ ́a"), (8, "same"), (8, "same"), (None, "no id"), (9, "word " * 5_000)]
    d = spark.createDataFrame([(*r, "c", 5) for r in docs], "doc_id long, text string, salt string, length int")
    hold(packing.pack_documents(d, vocabulary("word_bpe_49k.json"), limit=64).collect(), docs, 64)


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(d, vocabulary("word_bpe_49k.json")).collect() == []


@pytest.mark.parametrize(("seed", "limit"), [(0, 2048), (1, 64), (2, 300), (3, 7)])
def test_plan_places_every_document_once(seed, limit):
    r = np.random.default_rng(seed)
    hist = np.bincount(np.minimum(r.geometric(min(0.9, 4 / limit), 3000), limit), minlength=limit + 1)
    runs, n = packing.plan(hist, limit)
    fill, seen = {}, {}
    for length, rank, k, s, o in runs.tolist():
        for i in range(k):
            fill.setdefault(s + i, []).append((o, length))
            seen.setdefault(length, []).append(rank + i)
    for x in range(limit + 1):
        assert sorted(seen.get(x, [])) == list(range(hist[x]))
    for s in fill.values():
        at = 0
        for o, x in sorted(s):
            assert o == at
            at += x
        assert at <= limit
    assert len(fill) == n <= 1.05 * (hist * np.arange(limit + 1)).sum() / limit + 2


def test_nnls():
    r = np.random.default_rng(5)
    a, x = np.abs(r.normal(size=(20, 8))), np.maximum(r.normal(size=8), 0)
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-5)


def test_plan_needs_little_memory():
    """The driver holds no table of all pairs of patterns."""
    import tracemalloc

    hist = np.random.default_rng(1).integers(0, 50, 2049)
    hist[0] = 0
    tracemalloc.start()
    packing.plan(hist, 2048)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6


def test_no_rows_from_python(spark, small, monkeypatch):
    """Lists of rows become a table by Python workers of another kind, which executors keep beside the others."""
    from eventloom.llm import mixing

    d = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source", "lang")
    make = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: make(self, data, *a, **b) if isinstance(data, pa.Table) else pytest.fail("rows from Python"))
    pieces = d.select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.length("text") % 2048 + 1).cast("long").alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    assert packing.pack(pieces, 2048).count() == d.count()
    assert 0 < mixing.mix(d).where("kept").count() < d.count()


def test_lots_of_one_length(spark, monkeypatch):
    """Most documents have the same length: they are ranked in several lots and get places of their own."""
    monkeypatch.setattr(packing, "LOT", 7)
    docs = [(i, "word " * r) for i, r in enumerate([5] * 90 + [63] * 20 + [64] * 3 + [200, 3, 9])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    hold(packing.pack_documents(d, vocabulary("word_bpe_49k.json"), limit=64).collect(), docs, 64)


def test_tokenizers_that_cross_white_space(spark):
    """One whose tokens hold spaces is given whole texts."""
    from tokenizers import Tokenizer

    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        assert packing.splits_at_space(f.read())
    path = vocabulary("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        assert not packing.splits_at_space(f.read())
    docs = [(1, "a  b\n c"), (2, None), (3, " the cat  sat "), (4, "x" * 300)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = packing.tokenize(d, path, 16, keep_ids=True).orderBy("doc_id", "piece").collect()
    t = Tokenizer.from_file(path)
    for i, x in docs:
        assert [k for r in rows if r.doc_id == i for k in r.ids] == t.encode(x or "", add_special_tokens=False).ids + [0]


def test_memo_starts_afresh(spark, monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 3)
    import pyarrow as pa

    texts = [" ".join(f"w{(i * j) % 17} Tail{i}" for j in range(6)) for i in range(40)]
    e = packing._Encoder(vocabulary("word_bpe_49k.json"))
    got = [e(pa.array(texts[i : i + 4])) for i in range(0, 40, 4)]
    ids = [x.tolist()[a:b] for x, ends in got for a, b in zip(ends, ends[1:], strict=False)]
    assert ids == [x[:-1] for x in plain_ids(texts)]
