"""Second pass over faulty chunks by slices of a list, Poisson limits and the sign of remainders."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions import likelihood
from eventloom.operators import chunks
from eventloom.operators.expressions import compile_expression


def by_slices(values, faulty, size, shift):
    out = []
    for f in sorted(set(faulty)):
        start = max(0, size * f if f - 1 in faulty else size * (f - 1)) + shift
        end = min(len(values) - 1, size * (f + 2)) - (shift - 1)
        part = values[start:end]
        if len(part) <= size:
            continue
        cuts = [(k * shift, k * shift + size) for k in range((len(part) - size) // shift + 1)]
        if cuts[-1][1] < len(part):
            cuts.append((len(part) - size, len(part)))
        out += [(f, k, size, np.mean(part[a:b]), np.median(part[a:b]), np.std(part[a:b])) for k, (a, b) in enumerate(cuts)]
    return out


@pytest.mark.parametrize(("size", "shift", "n", "faulty"), [(10, 5, 100, [1, 8]), (10, 5, 100, [3, 4, 5]), (10, 3, 57, [0, 2, 5, 5, 9]), (1000, 500, 5050, [1, 3]), (7, 6, 40, [0, 1, 2, 3, 4, 5])])
def test_against_slices(spark, size, shift, n, faulty):
    values = np.random.default_rng(n).normal(5, 2, n)
    d = spark.createDataFrame([(k, i, float(v), 0) for k in (1, 2) for i, v in enumerate(values)], "tel int, t int, v double, faulty int").drop("faulty")
    bad = spark.createDataFrame([(1, f) for f in faulty], "tel int, chunk int")
    got = sorted(tuple(r)[1:] for r in chunks.second_pass(d, ["tel"], ["t"], "v", bad, size, shift).collect())
    want = by_slices(values, set(faulty), size, shift)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3:] for g in got], [w[3:] for w in want])


def test_poisson_limit_of_large_means(spark):
    means = [0.0, 0.3, 5.0, 150.0, 400.0, 3000.0]
    d = spark.createDataFrame([(m,) for m in means], "m double").coalesce(1)
    got = [r.k for r in d.select(likelihood.poisson_limit(F.col("m")).alias("k")).collect()]
    for m, k in zip(means, got, strict=True):
        p = [math.exp(i * math.log(m) - m - math.lgamma(i + 1)) if m else float(i == 0) for i in range(k + 1)]
        assert sum(p) >= 0.999 - 1e-9 and (k == 0 or sum(p[:-1]) < 0.999)
    row = d.where("m = 3000").select(likelihood.numeric(F.lit(2990.0), F.col("m"), F.lit(0.5), F.lit(1.0), likelihood.poisson_limit(F.col("m"))).alias("n"), likelihood.gaussian(F.lit(2990.0), F.col("m"), F.lit(0.5), F.lit(1.0)).alias("g")).first()
    assert row.n == pytest.approx(row.g, rel=1e-2)


def test_remainders_have_the_sign_of_the_divisor(spark):
    d = spark.createDataFrame([(7.0, 3.0), (-7.0, 3.0), (7.0, -3.0), (-7.0, -3.0), (7.5, 2.5)], "a double, b double").coalesce(1)
    got = [r[0] for r in d.select(compile_expression("a % b", d.columns)).collect()]
    assert got == [a % b for a, b in ((7.0, 3.0), (-7.0, 3.0), (7.0, -3.0), (-7.0, -3.0), (7.5, 2.5))]
