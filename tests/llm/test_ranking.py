import zlib

import numpy as np

from eventloom.llm import ranking
from eventloom.llm.queries import op10_quality_ranking


def test_held_out_accuracy(spark, small):
    d = op10_quality_ranking(spark, small).toPandas()
    assert len(d) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert (d["held_out"] == d["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert d["score"].between(0, 1).all() and ((d["score"] >= 0.5).astype(int) == d["predicted"]).all()
    x = d[d["held_out"]].merge(spark.read.parquet(f"{small}/labels.parquet").toPandas(), on="doc_id")
    assert (x["quality"] == x["predicted"]).mean() >= 0.9


def test_pairs_give_the_weights_back():
    r = np.random.default_rng(0)
    f = r.normal(size=(2000, 4))
    w = np.array([2.0, -1.0, 0.0, 0.5])
    y = (f @ w + 0.3 * r.normal(size=2000) > 0.5).astype(int)
    m = ranking.fit(f, y)
    assert ((m.score(f) >= 0.5) == y).mean() > 0.93
    assert abs((m.score(f) >= 0.5).mean() - y.mean()) < 0.01  # the quantile accepts as many as carry label 1


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "x" * 500_000), (4, "a b"), (4, "a b"), (None, "c"), (5, "\U0001f600")]
    d = spark.createDataFrame([(*r, 0.5, "z") for r in docs], "doc_id long, text string, score double, predicted string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (3, 7), (None, 1), (99, 1)], "doc_id long, quality int")
    for lab in (labels, labels.limit(0)):
        got = ranking.score(d, ranking.train(d, lab)).collect()
        assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert ranking.score(d.limit(0), ranking.train(d, labels)).collect() == []
