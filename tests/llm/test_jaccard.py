import re

import pytest
from pyspark.sql import functions as F

from eventloom.llm import graph, jaccard
from eventloom.llm.queries import op4_jaccard_join


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def brute(rows, k, num, den=100):
    sets = [shingles(t, k) for _, t in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                at[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(s), low[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_whole_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert result(op4_jaccard_join(spark, small)) == brute(rows, 4, 85)


@pytest.mark.parametrize("num", [50, 80, 100])
def test_chains_and_groups(spark, num, monkeypatch):
    monkeypatch.setattr(jaccard, "REST", 1)  # so that regions go through several rounds
    import random

    r = random.Random(num)
    base = [[f"w{r.randrange(400)}" for _ in range(r.choice([6, 30, 90]))] for _ in range(12)]
    rows = []
    for b in base:
        t = list(b)
        for _ in range(14):  # each a small change of the one before
            rows.append((len(rows), " ".join(t)))
            if r.random() < 0.7:
                t[r.randrange(len(t))] = f"x{r.randrange(50)}"
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(jaccard.near_duplicates(d, k=3, num=num)) == brute(rows, 3, num)


def test_odd_rows(spark):
    long = " ".join(f"q{i}" for i in range(60_000))
    rows = [(1, None, 0, "a"), (2, "", 0, "b"), (3, " \t\n", 1, "c"), (4, "One two", 1, "d"), (5, "one TWO", 2, None), (6, "one two three four", 2, "e"), (7, "One  two three\nfour", 0, "f"), (7, "one two three four", 0, "g"), (8, long, 0, "h"), (9, long + " end", 0, "i"), (10, "Ä ä", 0, "j"), (11, "ä ä", 0, "k")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n int, fp string")
    got = result(jaccard.near_duplicates(d, k=4, num=85))
    n = 60_000 - 3
    assert got == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 6), (7, 1, 6), (8, n, 8), (9, n + 1, 8), (10, 1, 10), (11, 1, 11)]


def test_empty(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(200, 200), (None, 3), (300, 301), (301, 300)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 40)}, 300: 300, 301: 300}


@pytest.mark.parametrize("num", [60, 80])
def test_levels_of_regions(spark, num, monkeypatch):
    """Regions of more than three members are dealt again, down to the last level; very small sets among them."""
    monkeypatch.setattr(jaccard, "REGION", 3)
    monkeypatch.setattr(jaccard, "CENTRES", (1,))
    monkeypatch.setattr(jaccard, "REST", 0)
    import random

    r = random.Random(num)
    lines = [" ".join(f"l{i}w{j}" for j in range(3)) for i in range(5)]
    rows = [(i, " ".join(r.choices(lines, k=r.choice([1, 2, 3, 4])) + [f"w{r.randrange(9)}"] * r.randrange(3))) for i in range(300)]
    rows += [(300 + i, " ".join(r.choices("abc", k=r.choice([2, 3, 4])))) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(jaccard.near_duplicates(d, k=2, num=num)) == brute(rows, 2, num)


def test_template_texts(spark):
    """Texts of 5 of 12 lines: crowded regions without many links end in a bounded number of jobs."""
    import random

    r = random.Random(5)
    lines = [" ".join(f"l{i}w{j}" for j in range(6)) for i in range(12)]
    rows = [(i, " ".join(r.sample(lines, 5))) for i in range(2000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(jaccard.near_duplicates(d, k=5, num=80)) == brute(rows, 5, 80)


def test_posts_are_made_once(spark, small, monkeypatch):
    """The entries of all windows are by far the largest table; which of them share a pivot is found where they meet."""
    plans, cut = [], jaccard.cut
    monkeypatch.setattr(jaccard, "cut", lambda df, **how: (plans.append(df._jdf.queryExecution().sparkPlan().toString()), cut(df, **how))[1])
    result(op4_jaccard_join(spark, small))
    made = [p.count("Generate posexplode") for p in plans]
    assert 1 in made and max(made) == 1


def test_cut_leaves_no_shuffle_files(spark):
    """They would stay until the driver collects its garbage; a table that is cut can still be used itself, and the setting is as before."""
    import time

    from eventloom.runtime import CLEANUP, cut

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", files))

    before, was = shuffled(), spark.conf.get(CLEANUP)
    df = spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count()
    assert cut(df, clean=True).agg(F.sum("count")).first()[0] == 100_000 and cut(df, clean=True).count() == 1000
    end = time.time() + 10
    while (left := shuffled() - before) and time.time() < end:
        time.sleep(0.1)
    assert len(left) <= 8 + 8  # of the two queries over what was cut, a file for each task
    assert df.count() == 1000 and spark.conf.get(CLEANUP) == was
