"""The peak of the neighbours' sum is found once a pixel: not again in a filter under the explode, nor twice in the search of its place."""

import math

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from eventloom.functions import waveforms
from eventloom.functions.common import nested
from eventloom.plans import variant_queries

ROW = [[j for j in (i - 1, i + 1) if 0 <= j < 8] for i in range(8)]


def charges(v):
    """Three samples about the first largest sum of the neighbours, by counting."""
    w = [v[8 * i : 8 * i + 8] for i in range(8)]
    out = []
    for i, near in enumerate(ROW):
        sums = [sum(w[j][s] for j in near) for s in range(8)]
        top = sums.index(max(sums))
        out.append(sum(w[i][max(top - 1, 0) : top + 2]))
    return out


def test_peaks_are_computed_once(spark, tmp_path):
    rows = [[float((7 * p * (k + 2)) % 19) - 3 for p in range(64)] for k in range(4)] + [[0.0] * 64, None]
    ids = [1, 2, 3, 3, 4, 5]
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    d = variant_queries.waveform_neighbor_peak(spark, str(tmp_path))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan and plan.count("array_max") == 1
    want = [(i, p, None if v is None else c) for i, v in zip(ids, rows, strict=True) for p, c in enumerate([None] * 8 if v is None else charges(v))]
    key = lambda r: (r[0], r[1], math.inf if r[2] is None else r[2])
    got = sorted((tuple(r) for r in d.collect()), key=key)
    assert [r[:2] for r in got] == [r[:2] for r in sorted(want, key=key)]
    assert all(a[2] is b[2] is None or a[2] == pytest.approx(b[2], abs=1e-5) for a, b in zip(got, sorted(want, key=key), strict=True))


def test_odd_waveforms(spark):
    """Equal sums give the first sample; a null sample is no peak of its neighbours, one that is not a number is."""
    pulse, flat = [0.0, 1.0, 5.0, 1.0], [2.0] * 4
    rows = [(1, [pulse, flat, pulse]), (2, [[0.0, None, 5.0, 1.0], flat, pulse]), (3, [[0.0, 1.0, 5.0, math.nan], flat, pulse]), (4, [None, flat, pulse]), (5, [pulse, None, pulse]), (6, None)]
    d = spark.createDataFrame(rows, "k int, w array<array<double>>").coalesce(1)
    got = {r.k: r.p for r in d.select("k", waveforms.neighbor_peak_index(F.col("w"), nested([(1,), (0, 2), (1,)])).alias("p")).collect()}
    assert got == {1: [0, 2, 0], 2: [0, 2, 0], 3: [3, 3, 0], 4: [None] * 3, 5: [None, None, None], 6: None}
