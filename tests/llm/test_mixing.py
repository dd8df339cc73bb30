import itertools

import numpy as np
import pandas as pd

from eventloom.llm import mixing
from eventloom.llm.queries import op7_source_mixing


def test_raking_meets_all_marginals():
    r = np.random.default_rng(3)
    cells = pd.DataFrame(list(itertools.product("abcd", "xyz", "uv")), columns=list(mixing.DIMENSIONS))
    cells["tokens"] = r.integers(1, 1000, len(cells))
    targets = {k: mixing.tempered(cells.groupby(k)["tokens"].sum(), p) for k, p in zip(mixing.DIMENSIONS, (0.3, 0.5, 0.9), strict=True)}
    w = mixing.rake(cells, targets)
    for k, t in targets.items():
        assert np.allclose(pd.Series(w).groupby(cells[k]).sum(), t, atol=1e-7)
    p = mixing.probabilities(cells["tokens"].to_numpy(float), w, 0.4 * cells["tokens"].sum())
    assert p.max() <= 1 and abs((p * cells["tokens"]).sum() - 0.4 * cells["tokens"].sum()) < 1e-6


def test_joined_raking_is_the_same(spark):
    cells = pd.DataFrame([("a", "x", "u", 900), ("a", "y", "u", 50), ("b", "x", "v", 30), ("b", "y", "u", 20)], columns=[*mixing.DIMENSIONS, "tokens"])
    powers = {"source": 0.7, "lang": 0.8, "topic": 0.9}
    want = mixing.rake(cells, {k: mixing.tempered(cells.groupby(k)["tokens"].sum(), p) for k, p in powers.items()}, rounds=4)
    got = mixing.rake_joined(spark.createDataFrame(cells), powers, rounds=4).toPandas().sort_values(list(mixing.DIMENSIONS))
    assert np.allclose(got["weight"], want, rtol=1e-6)


def test_whole_table(spark, small):
    d = op7_source_mixing(spark, small).toPandas()
    assert len(d) == spark.read.parquet(f"{small}/documents.parquet").count()
    kept, all_ = d[d["kept"]]["n_tokens"].sum(), d["n_tokens"].sum()
    assert abs((d["probability"] * d["n_tokens"]).sum() / all_ - 0.7) < 1e-6
    sigma = np.sqrt((d["n_tokens"] ** 2 * d["probability"] * (1 - d["probability"])).sum())  # of a sum of independent draws
    assert abs(kept - 0.7 * all_) < 4 * sigma
    assert (d.groupby(["source", "lang", "topic"])["probability"].nunique() == 1).all()


def test_joined_mixing_is_the_same(spark, monkeypatch):
    rows = [(i, "w " * (40 + 97 * i % 300), "en" if i % 3 else "de", "abc"[i % 7 % 3], "uv"[i % 5 % 2]) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    for keep in (0.7, 1.0):
        monkeypatch.setattr(mixing, "CELLS", 100_000)
        want = mixing.mix(d, keep=keep).toPandas().set_index("doc_id").sort_index()
        monkeypatch.setattr(mixing, "CELLS", 0)
        got = mixing.mix(d, keep=keep).toPandas().set_index("doc_id").sort_index()
        assert np.allclose(got["probability"], want["probability"], atol=1e-7)


def test_odd_rows(spark):
    rows = [(1, None, "en", "s"), (2, "", None, "s"), (3, "a b c", None, None), (3, "a b c", None, None), (None, "x y", "en", "s"), (4, "w " * 90_000, "de", "t")]
    d = spark.createDataFrame([(*r, 1.5, "k") for r in rows], "doc_id long, text string, lang string, source string, probability double, kept string")
    got = mixing.mix(d, keep=1.0).collect()
    assert len(got) == len(rows) and all(r.kept for r in got) and all(r.probability == 1 for r in got)
    assert mixing.mix(d.limit(0)).collect() == []


def test_kept_rows_by_hand(spark, small):
    """Raking with plain dictionaries, probabilities by bisection of the scale, and the same draws: the same rows stay."""
    from pyspark.sql import functions as F

    from eventloom.llm import mixing

    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("doc_id", "source", "lang", mixing.topic().alias("topic"), mixing.tokens().alias("n"), (F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) / (1 << 30)).alias("draw")).collect()
    cells = {}
    for r in rows:
        k = (r.source, r.lang, r.topic)
        cells[k] = cells.get(k, 0) + r.n
    total = sum(cells.values())
    goals = []
    for i, power in enumerate((0.7, 0.8, 0.9)):
        sums = {}
        for k, n in cells.items():
            sums[k[i]] = sums.get(k[i], 0) + n
        raised = {v: n**power if n else 0.0 for v, n in sums.items()}
        goals.append({v: x / sum(raised.values()) for v, x in raised.items()})
    w = {k: n / total for k, n in cells.items()}
    for _ in range(500):
        for i, goal in enumerate(goals):
            have = {}
            for k, x in w.items():
                have[k[i]] = have.get(k[i], 0.0) + x
            w = {k: x * goal[k[i]] / have[k[i]] if have[k[i]] else 0.0 for k, x in w.items()}
    rate = {k: w[k] / n if n else 0.0 for k, n in cells.items()}
    low, high = 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        if sum(n * min(1.0, rate[k] * mid) for k, n in cells.items()) < 0.7 * total:
            low = mid
        else:
            high = mid
    want = {r.doc_id for r in rows if r.n == 0 or r.draw < min(1.0, rate[r.source, r.lang, r.topic] * high)}
    near = {r.doc_id for r in rows if abs(r.draw - rate[r.source, r.lang, r.topic] * high) < 1e-6}  # rounding may decide these
    got = {r.doc_id for r in mixing.mix(docs).where("kept").collect()}
    assert got - near == want - near and len(near) < 3
