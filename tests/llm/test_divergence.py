"""Divergence of sources against counting by hand and against SQL."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventloom.llm import divergence
from eventloom.llm.queries import op13_source_divergence

SCHEMA = "doc_id long, text string, lang string, source string, n int, part string, rank int"


def by_hand(rows, least, top=10):
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), lang or "", source or "") for t, lang, source in rows]
    out = set()
    for lang in {x[1] for x in docs}:
        own = [x for x in docs if x[1] == lang]
        spread = Counter(t for words, *_ in own for t in set(words))
        kept = {t for t, n in spread.items() if n >= least}
        count = {s: Counter(t for words, _, q in own if q == s for t in words if t in kept) for s in {x[2] for x in own}}
        p = lambda c, t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: B023, E731
        f = lambda a, b: (a - b) ** 2 // (a + b)
        every = sum(count.values(), Counter())
        for s, c in count.items():
            pair = [(-sum(f(p(c, t), p(d, t)) for t in kept), o.encode(), o) for o, d in count.items() if o != s]
            term = [(-f(p(c, t), p(every, t)), t.encode(), t) for t in kept if c[t] and p(c, t) > p(every, t)]
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pair))}
            out |= {(lang, s, "term", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(term)) if i < top}
    return out


@pytest.mark.parametrize("held", [7, 500_000])
def test_against_counting_by_hand(spark, held, monkeypatch):
    rng = random.Random(5)
    words = ["Alpha", "BETA", "gamma", "δ", "ÀB", "x1y", "a_b", "zz", "\x7f", "ﬀ", "梦"]
    rows = [(" ".join(rng.choices(words, weights=range(1, 12), k=rng.randint(0, 12))) or None, rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "é", None, "c\x00", "Z"])) for _ in range(250)]
    rows += [("hot hot word", "en", "a")] * 200 + [("", "xx", "lonely"), (None, "yy", "p"), ("none kept", "yy", "q")]
    d = spark.createDataFrame([(i, *r, 1, "p", 2) for i, r in enumerate(rows)], SCHEMA)
    for least in (3, 10):
        got = divergence.audit(d, least=least).collect()
        assert len(got) == len(set(got)) and set(map(tuple, got)) == by_hand(rows, least)


def test_terms_over_batches(monkeypatch):
    """Combinations are the same however rows of a term are cut into batches, and for counts too large to pack."""
    import pyarrow as pa

    rng = random.Random(2)
    rows = [("en", s, t, rng.choice([1, 2, 1 << 40])) for t in map(str, range(50)) for s in sorted(rng.sample("abcdefg", rng.randint(1, 7)))]
    table = pa.table({k: [r[i] for r in rows] for i, k in enumerate(("lang", "source", "term", "n"))})
    want = Counter((a, b, x, y) for _, a, t, x in rows for _, b, u, y in rows if t == u and a < b)
    for size, held in ((1, 3), (3, 20), (1000, 500_000)):
        monkeypatch.setattr(divergence, "PAIRS", held)
        got = Counter()
        for b in divergence._combinations(iter(table.to_batches(max_chunksize=size))):
            for r in b.to_pylist():
                got[r["a"], r["b"], r["na"], r["nb"]] += r["m"]
        assert got == want


def test_whole_table(spark, small, duck, same):
    same(op13_source_divergence(spark, small), duck, divergence.oracle_sql())


def test_exact_for_large_counts(spark):
    big = 3_000_000_000_000
    row = spark.range(1).select(divergence.smoothed(F.lit(big), F.lit(7 * big + 1), F.lit(1234567)).alias("p"), divergence.gap(F.lit(1_000_000_001), F.lit(2)).alias("g")).first()
    assert row.p == 1 + 1_000_000_000 * (big + 2) // (7 * big + 1 + 2 * 1234567) and row.g == 999_999_999**2 // 1_000_000_003


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
