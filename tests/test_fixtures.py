"""Small inputs with known results: selection, codecs, lookups, cuts, moments, timing."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from eventloom.functions import codecs, likelihood
from eventloom.functions.common import numbers
from eventloom.operators import images, lookup, response, selection, stereo

NAN, INF = math.nan, math.inf


def test_quality_mask(spark):
    d = spark.createDataFrame(list(zip([1.0, 0.2, -0.5, 0.6, 0.7], [0.0, 0.5, 1.0, 0.2, 0.1])), "x double, y double")
    q = selection.QualityQuery((("in circle", "(x**2 + y**2) < 1.0"), ("low x", "x < 0.5")))
    assert [r[0] for r in d.select(q.mask(d)).collect()] == [False, True, False, False, False]
    assert [tuple(r) for r in q.funnel(d).collect()] == [("TOTAL", 5, 5), ("in circle", 3, 3), ("low x", 2, 1)]
    assert q.select(d).count() == 1


@pytest.mark.parametrize(("text", "want"), [("x > 1", [False, True, False, False]), ("x >= 1", [False, True, False, True]), ("x < 1", [False] * 4), ("x == x", [False, True, False, True]), ("x != 1", [True, True, False, False]), ("~(x > 1)", [True, False, False, True]), ("1 < x", [False, True, False, False]), ("x > 1 or name == 'a'", [True, True, False, False])])
def test_nan_compares_as_in_python(spark, text, want):
    d = spark.createDataFrame([(NAN, "a"), (2.0, "b"), (None, "c"), (1.0, None)], "x double, name string").coalesce(1)
    q = selection.QualityQuery((("c", text),))
    assert [r[0] for r in d.select(q.mask(d)).collect()] == want
    assert q.select(d).count() == sum(want) == q.funnel(d).collect()[1]["counts"]


FIXED = [
    ("uint16", 10, 0, [(0, 0), (0.1, 1), (0.16, 2), (-INF, 65533), (NAN, 65534), (INF, 65535), (6553.3, 65535), (-1, 65533)]),
    ("uint16", 10, 400, [(-40, 0), (-30, 100), (0, 400), (0.1, 401), (0.16, 402), (6513.2, 65532), (6513.3, 65535), (-40.1, 65533)]),
    ("int16", 10, 0, [(-INF, -32768), (-3276.7, -32768), (-3276.6, -32766), (-50, -500), (0, 0), (50, 500), (3276.6, 32766), (3276.7, 32767), (INF, 32767), (NAN, -32767)]),
]


@pytest.mark.parametrize(("kind", "scale", "offset", "cases"), FIXED)
def test_fixed_point(spark, kind, scale, offset, cases):
    d = spark.createDataFrame([(float(x), c) for x, c in cases], "x double, want long")
    d = d.withColumn("code", codecs.encode_fixed(F.col("x"), scale, offset, kind)).withColumn("back", codecs.decode_fixed(F.col("code"), scale, offset, kind))
    minus, nan, plus, _, _ = codecs.fixed_codes(kind)
    for r in d.collect():
        assert r.code == r.want
        if r.code == nan:
            assert math.isnan(r.back)
        elif r.code in (minus, plus):
            assert r.back == (INF if r.code == plus else -INF)
        else:
            assert abs(r.back - r.x) <= 0.5 / scale + 1e-9


def test_high_resolution_time(spark):
    utc = datetime.timezone.utc
    rows = [("2016-12-31 23:59:59.999999", 1483228799 + 36, 3999996000), ("2017-01-01 00:00:00", 1483228800 + 37, 0), ("1972-01-01 00:00:00", 63072010, 0), ("2024-02-29 12:00:00.5", 1709208000 + 37, 2_000_000_000), ("1960-01-01 00:00:00", 0, None)]
    d = spark.createDataFrame([(datetime.datetime.fromisoformat(t).replace(tzinfo=utc), s, q) for t, s, q in rows], "t timestamp, s long, q long")
    d = d.withColumn("c", codecs.time_to_high_res(F.col("t"))).withColumn("back", codecs.high_res_to_micros(F.col("c.seconds"), F.col("c.quarter_nanoseconds")) - F.unix_micros("t"))
    for r in d.collect():
        assert r.c.seconds == r.s
        if r.q is not None:
            assert r.c.quarter_nanoseconds == r.q and r.back == 0


def test_truncated_text(spark):
    cases = [("hello", 4, "hell"), ("αβ", 4, "αβ"), ("αβγ", 4, "αβ"), ("αβγ", 3, "α"), ("foo \U0001f637", 8, "foo \U0001f637"), ("foo \U0001f637", 5, "foo "), ("ααα", 5, "αα"), ("", 3, ""), ("α", 1, "")]
    for text, most, want in cases:
        assert spark.createDataFrame([(text,)], "t string").select(codecs.truncate_utf8(F.col("t"), most)).first()[0] == want


def test_status_bits(spark):
    d = spark.createDataFrame([(v,) for v in (0b1101, 0b1000, 0b1110, 0b1101, 0)], "s int").coalesce(1)
    s = F.col("s")
    got = d.select(codecs.is_invalid(s), codecs.dvr_status(s), codecs.channel_info(s)).collect()
    assert [tuple(r) for r in got] == [(False, 1, 3), (False, 0, 2), (False, 2, 3), (False, 1, 3), (True, 0, 0)]


def test_stereo_means(spark):
    rows = [(1, 1, 1, 1.0, 1.0, True), (1, 1, 2, 2.0, 10.0, True), (1, 1, 3, 0.0, 4.0, True), (1, 2, 5, 1.0, 0.5, True), (1, 2, 7, 5.0, 0.7, False), (2, 1, 1, 9.0, 1.0, False)]
    d = spark.createDataFrame(rows, "obs_id int, event_id int, tel_id int, intensity double, energy double, ok boolean")
    for weight, want in ((None, [(5, 3.741657), (0.5, 0), (NAN, NAN)]), (F.col("intensity"), [(7, 4.242641), (0.5, 0), (NAN, NAN)])):
        out = stereo.combine_mean(d, ["obs_id", "event_id"], "energy", "tel_id", weight, valid=F.col("ok")).orderBy("obs_id", "event_id").collect()
        for r, (m, s) in zip(out, want, strict=True):
            assert r["mean"] == pytest.approx(m, nan_ok=True) and r["std"] == pytest.approx(s, abs=1e-6, nan_ok=True)
        assert [r.telescopes for r in out] == [[1, 2, 3], [5], []]
        assert [r.is_valid for r in out] == [True, True, False]


def test_spread_of_large_numbers(spark):
    d = spark.createDataFrame([(1, i, 1e9 + i, 1.0 + i) for i in range(3)], "event_id int, tel_id int, x double, w double")
    out = stereo.combine_mean(d, ["event_id"], "x", "tel_id").first()
    assert out["std"] == pytest.approx(math.sqrt(2 / 3), rel=1e-6)
    out = stereo.combine_mean(d, ["event_id"], "x", "tel_id", F.col("w")).first()  # weights 1, 2, 3: mean 4/3, variance 5/9
    assert out["mean"] - 1e9 == pytest.approx(4 / 3, rel=1e-6) and out["std"] == pytest.approx(math.sqrt(5 / 9), rel=1e-5)


def test_no_energy_above_zero(spark):
    d = spark.createDataFrame([(1, 1, -1.0), (1, 2, -2.0)], "event_id int, tel_id int, e double")
    r = stereo.combine_mean(d, ["event_id"], "e", "tel_id", log=True).first()
    assert (r.n_valid, r.telescopes, r.is_valid) == (0, [], False) and math.isnan(r["mean"])


def chunk_table(spark, second=2.0):
    rows = [(1, s, e, [v, w]) for s, e, v, w in ((0.0, 2.0, 1.0, 1.0), (1.0, 3.0, second, 2.0), (2.0, 4.0, 3.0, 3.0), (6.0, 8.0, 4.0, 4.0))]
    return spark.createDataFrame(rows, "tel_id int, time_start double, time_end double, mean array<double>")


def test_chunk_lookup(spark):
    rows = [(1, 1.2, "a"), (1, 1.7, None), (1, 2.2, "c"), (1, 2.2, "c"), (1, 5.0, "d"), (2, 1.0, "e"), (1, None, "f"), (None, 1.0, "g")]
    d = spark.createDataFrame(rows, "tel_id int, t double, note string")
    got = {(r.tel_id, r.t, r.note): r["mean"] for r in lookup.interval_lookup(d, chunk_table(spark), ["tel_id"], "t", "mean").collect()}
    assert got == {(1, 1.2, "a"): [2, 2], (1, 1.7, None): [2, 2], (1, 2.2, "c"): [3, 3], (1, 5.0, "d"): None, (2, 1.0, "e"): None, (1, None, "f"): None, (None, 1.0, "g"): None}
    assert lookup.interval_lookup(d, chunk_table(spark), ["tel_id"], "t", "mean").count() == len(rows)
    holes = lookup.interval_lookup(d.where("note = 'a'"), chunk_table(spark, NAN), ["tel_id"], "t", "mean").first()["mean"]
    assert holes == [1, 2]


def test_chunk_lookup_on_one_key(spark):
    """All rows belong to one telescope, whose chunks overlap and differ in length."""
    import random

    r = random.Random(2)
    chunks = [(1, s, s + r.choice([0.5, 3.0, 40.0]), [float(i)]) for i, s in enumerate(sorted(r.uniform(0, 300) for _ in range(80)))]
    rows = [(1, r.uniform(-5, 350)) for _ in range(500)]
    got = lookup.interval_lookup(spark.createDataFrame(rows, "tel_id int, t double"), spark.createDataFrame(chunks, "tel_id int, time_start double, time_end double, v array<double>"), ["tel_id"], "t", "v", 0.25).collect()
    assert len(got) == 500
    for x in got:
        inside = [c for c in chunks if c[1] - (0.25 if c is chunks[0] else 0) <= x.t <= c[2] + 0.25]
        assert x.v == (max(inside, key=lambda c: c[1])[3] if inside else None)


def test_percentile_cuts(spark):
    d = spark.createDataFrame(list(zip([0.1, 0.6, 0.45, 0.98, 0.32, 0.95, 0.25, 0.87], [0.1, 0.07, 0.21, 0.4, 0.03, 0.08, 0.11, 0.18], [0.17, 0.36, 0.47, 0.22, 1.2, 5.0, 4.2, 9.1])), "score double, theta double, energy double")
    for value, p, want in (("score", 25, [0.3625, 0.3025]), ("theta", 75, [0.2575, 0.1275])):
        cut = d.groupBy((F.col("energy") >= 1).alias("b")).agg(F.percentile(value, p / 100).alias("c")).orderBy("b").collect()
        assert [r.c for r in cut] == pytest.approx(want)
    assert response.__doc__


CAMERA = images.Camera.rectangular(6, 6)


def test_leakage_of_the_cleaned_image(spark):
    mask = [p in (0, 7, 14, 15) for p in range(36)]  # one pixel of the edge, one of the second ring, two inside
    d = spark.createDataFrame([([2.0] * 36, mask), ([2.0] * 36, [False] * 36)], "i array<double>, m array<boolean>").coalesce(1)
    a, b = [r[0] for r in d.select(images.leakage(F.col("i"), F.col("m"), CAMERA)).collect()]
    assert tuple(a) == (0.25, 0.5, 0.25, 0.5)
    assert tuple(b) == (None,) * 4


def test_concentration_leaves_out_pixels_a_diameter_away(spark):
    image = [0.0] * 36
    for p in (13, 14, 15, 8, 20):  # a cross around pixel 14, all arms exactly one pixel away
        image[p] = 1.0
    d = spark.createDataFrame([(image,)], "i array<double>").withColumn("h", images.hillas(F.col("i"), images.Camera.rectangular(6, 6, 0.0, 5.0)))
    c = d.select(images.concentration(F.col("i"), F.col("h"), images.Camera.rectangular(6, 6, 0.0, 5.0)).alias("c")).first().c
    assert (c.cog, c.pixel) == (pytest.approx(0.2), pytest.approx(0.2))


def test_one_pixel_has_no_axis(spark):
    d = spark.createDataFrame([([0.0] * 14 + [3.0] + [0.0] * 21,)], "i array<double>")
    h = d.select(images.hillas(F.col("i"), CAMERA).alias("h")).first().h
    assert (h.intensity, h.length, h.width) == (3.0, 0.0, 0.0)
    assert all(math.isnan(v) for v in (h.psi, h.skewness, h.kurtosis))


def test_timing_without_outliers(spark):
    """Two wild times do not move the line; the deviation is that of all pixels."""
    camera = images.Camera.rectangular(8, 8, 0.0, 7.0)
    times = [1.0 + 2.0 * x for x in camera.x]
    times[9] += 60.0
    times[50] -= 45.0
    h = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("psi"))
    d = spark.createDataFrame([(times, [True] * 64), ([NAN] * 64, [True] * 64), (times, [i == 3 for i in range(64)])], "t array<double>, m array<boolean>").coalesce(1)
    a, b, c = [r[0] for r in d.select(images.timing(numbers([1.0] * 64), F.col("t"), F.col("m"), h, camera)).collect()]
    assert (a.slope, a.intercept) == (pytest.approx(2.0), pytest.approx(1.0))
    assert a.deviation == pytest.approx(math.sqrt((60**2 + 45**2) / 64))
    assert all(math.isnan(v) for r in (b, c) for v in (r.slope, r.intercept, r.deviation))


def test_likelihood_by_numbers(spark):
    """The sum over photo-electrons against the plain formula; far above the switch the Gaussian form."""
    cases = [(5.0, 4.0), (0.0, 0.0), (60.0, 5.0), (40.0, 30.0), (18.0, 20.0)]
    top = max(m for _, m in cases)
    c, p, k = 0.0, math.exp(-top), 0
    while True:
        c += p
        if c >= 0.999:
            break
        k += 1
        p *= top / k

    def numeric(s, mu, w=0.5, ped=1.2):
        mu += 2.0**-52
        like = 2.0**-52
        for n in range(k + 1):
            theta = ped**2 + n * w**2
            like += mu**n * math.exp(-mu) / math.sqrt(2 * math.pi * theta) / math.factorial(n) * math.exp(-((s - n) ** 2) / (2 * theta))
        return -math.log(like)

    d = spark.createDataFrame(cases, "s double, mu double").coalesce(1)
    limit = likelihood.poisson_limit(F.lit(top))
    assert d.select(limit).first()[0] == k
    got = d.select(likelihood.numeric(F.col("s"), F.col("mu"), F.lit(0.5), F.lit(1.2), limit), likelihood.combined(F.col("s"), F.col("mu"), F.lit(0.5), F.lit(1.2), limit)).collect()
    for (s, mu), (a, b) in zip(cases, got, strict=True):
        assert a == pytest.approx(numeric(s, mu))
        theta = 1.2**2 + mu * 1.25
        assert b == pytest.approx(math.log(2 * math.pi * theta) / 2 + (s - mu) ** 2 / (2 * theta) if mu > 20 else a)


def test_time_constrained_cleaning(spark):
    """A late core pixel goes, a bright one may be twice as late; ring pixels need a core neighbour close in time."""
    image = [0.0] * 36
    times = [10.0] * 36
    for p in (14, 15, 20, 21):
        image[p] = 10.0
    image[16], times[16] = 10.0, 20.0  # core, late
    image[13], image[8] = 6.0, 6.0  # ring; the second one is late
    times[8] = 13.0
    d = spark.createDataFrame([(image, times), ([0.0] * 36, times)], "i array<double>, t array<double>").coalesce(1)
    got = images.time_constrained_cleaning(d, "i", "t", CAMERA, 7, 5, 4.5, 1.5).collect()
    assert [i for i, m in enumerate(got[0]["mask"]) if m] == [13, 14, 15, 20, 21]
    assert not any(got[1]["mask"])


def test_ring_containment(spark):
    cases = [(1.0, 0.0, 2.0, 1.0), (1.0, 5.0, 2.0, 0.0), (3.0, 0.5, 2.0, 1.0), (1.0, 2.0, 2.0, math.acos(0.25) / math.pi)]
    d = spark.createDataFrame(cases, "r double, x double, camera double, want double")
    for r in d.select("*", images.ring_containment(F.col("r"), F.col("x"), F.lit(0.0), 2.0).alias("got")).collect():
        assert r.got == pytest.approx(r.want)
