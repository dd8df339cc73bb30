"""Each stage on its own input, against plain Python."""

import re

import corpus_pipeline as p
from eventloom.llm import quality


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_stages(spark, small, tmp_path, duck):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, at = docs.columns, {}
    for i, (name, stage) in enumerate(p.STAGES):
        before, out = docs, stage(spark, docs, small)
        if i + 1 < len(p.STAGES):
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        at[name] = (before.toPandas(), docs.toPandas())
    a, b = at["quality_rules"]
    want = {r[0] for r in duck.execute(f"select doc_id from ({quality.oracle_sql()}) where kept").fetchall()}
    assert set(b["doc_id"]) == want and len(b) == len(want)
    a, b = at["jaccard_join"]
    sets = {i: shingles(t) for i, t in zip(a["doc_id"], a["text"], strict=True)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert sorted(b["doc_id"]) == sorted({find(i) for i in ids})
    a, b = at["pii_sanitisation"]
    assert sorted(a["doc_id"]) == sorted(b["doc_id"]) and not b["text"].str.contains(r"[\w.]+@\w+\.\w").any()
    a, b = at["source_mixing"]
    assert set(b["doc_id"]) < set(a["doc_id"])
    assert 0.5 < b["text"].str.split().str.len().sum() / a["text"].str.split().str.len().sum() < 0.9
    a, b = at["best_fit_packing"]
    assert set(b["doc_id"]) == set(a["doc_id"]) and (b["offset"] + b["length"]).max() <= 2048


def test_run(spark, small):
    assert p.run(spark, small).count() > 0


def test_odd_documents(spark, tmp_path):
    text = " ".join(f"the word{i} of" for i in range(60))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, text, None, None, 5), (3, text, None, None, 5), (4, text + " end", "en", "s", 6), (None, text * 2, "en", "s", 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for _, stage in p.STAGES:
            docs = stage(spark, docs, "")
        docs.collect()
