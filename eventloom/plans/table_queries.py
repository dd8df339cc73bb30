"""Queries of response tables by offset, of a tabulated atmosphere, of aberration, and of values valid a little early."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from eventloom.functions import atmosphere, muon, optics, waveforms
from eventloom.functions.common import nested
from eventloom.operators import images, instrument, lookup, response, response_fov
from eventloom.plans.catalogue import query
from eventloom.plans.event_queries import r6, s6
from eventloom.plans.series_queries import _EV, _REF, _sides, EDGES, scored
from eventloom.runtime import table

# -- response tables: lineitem rows are events, l_tax their offset --------------------------------------------------------

_RINGS = [0.0, 0.045, 0.1]
_FOV = f"{_EV}, f AS (SELECT *, CASE WHEN t < 0.045 THEN 0 ELSE 1 END AS ring FROM ev WHERE bin >= 0)"
_G = "g AS (SELECT * FROM (VALUES (0, 0.0, 0.045), (1, 0.045, 0.1)) v(ring, lo, hi))"
_CELL = "bin::INT AS bin, ring::INT AS ring"


@query("resolution_by_offset", f"WITH {_FOV} SELECT {_CELL}, count(*) AS n, {s6('avg(q)')} AS bias, {s6('(quantile_cont(q, 0.8413447460685429) - quantile_cont(q, 0.15865525393145707)) / 2')} AS resolution FROM f GROUP BY 1, 2")
def resolution_by_offset(spark, d):
    ev = scored(spark, d).withColumn("reco", F.col("e") * (1 + F.col("q")))
    out = response_fov.bias_resolution(ev, "e", "reco", "t", EDGES, _RINGS)
    return out.select("bin", "ring", "n", r6(F.col("bias")).alias("bias"), r6(F.col("resolution")).alias("resolution"))


@query("angular_by_offset", f"WITH {_FOV} SELECT {_CELL}, count(*) AS n, {', '.join(f'{s6(f"quantile_cont(s, {x / 100})")} AS q{x}' for x in (25, 50, 68, 95))} FROM f GROUP BY 1, 2")
def angular_by_offset(spark, d):
    out = response_fov.angular_resolution(scored(spark, d), "s", "e", "t", EDGES, _RINGS)
    return out.select("bin", "ring", "n", *[r6(F.col(c)).alias(c) for c in ("q25", "q50", "q68", "q95")])


@query("area_by_offset", f"WITH {_FOV} SELECT {_CELL}, count(*) FILTER (s >= 0.5) AS n_selected, count(*) AS n_simulated, {s6('count(*) FILTER (s >= 0.5) / count(*) * 1000000')} AS area FROM f GROUP BY 1, 2")
def area_by_offset(spark, d):
    ev = scored(spark, d)
    return response_fov.effective_area(ev.where("s >= 0.5"), ev, "e", "t", EDGES, _RINGS, 1e6).withColumn("area", r6(F.col("area")))


@query("dispersion_by_offset", f"""WITH {_FOV}, m AS (SELECT * FROM (VALUES (0, 0.525), (1, 0.03), (2, 0.945)) v(migration, width)), x AS (SELECT bin, ring, CASE WHEN q < 0.025 THEN 0 WHEN q < 0.055 THEN 1 ELSE 2 END AS migration, count(*) AS n FROM f GROUP BY 1, 2, 3), a AS (SELECT bin, ring, sum(n) AS total FROM x GROUP BY 1, 2)
SELECT {_CELL}, migration::INT AS migration, {s6('coalesce(n, 0) / total / width')} AS density FROM a CROSS JOIN m LEFT JOIN x USING (bin, ring, migration)""")
def dispersion_by_offset(spark, d):
    ev = scored(spark, d).withColumn("reco", F.col("e") * (1 + F.col("q")))
    out = response_fov.energy_dispersion(ev, "e", "reco", "t", EDGES, [0.5, 1.025, 1.055, 2.0], _RINGS)
    return out.select("bin", "ring", "migration", r6(F.col("density")).alias("density"))


_SOLID = "(2 * pi() * (cos(radians({})) - cos(radians({}))))"


@query("spread_by_offset", f"""WITH {_FOV}, h AS (SELECT * FROM (VALUES (0, 0.0, 0.025), (1, 0.025, 0.055), (2, 0.055, 0.2)) v(theta, low, high)), x AS (SELECT bin, ring, CASE WHEN q < 0.025 THEN 0 WHEN q < 0.055 THEN 1 ELSE 2 END AS theta, count(*) AS n FROM f GROUP BY 1, 2, 3), a AS (SELECT bin, ring, sum(n) AS total FROM x GROUP BY 1, 2)
SELECT {_CELL}, theta::INT AS theta, round(coalesce(n, 0) / total / {_SOLID.format('low', 'high')} + 3.7e-2, 0) AS density FROM a CROSS JOIN h LEFT JOIN x USING (bin, ring, theta)""")
def spread_by_offset(spark, d):
    out = response_fov.point_spread(scored(spark, d), "q", "e", "t", EDGES, [0.0, 0.025, 0.055, 0.2], _RINGS)
    return out.select("bin", "ring", "theta", F.round(F.col("density") + 3.7e-2, 0).alias("density"))


@query("sensitivity_by_offset", f"""WITH {_FOV}, {_G}, c AS (SELECT bin, quantile_cont(t, 0.68) AS cut FROM ev WHERE bin >= 0 GROUP BY 1),
x AS (SELECT bin, ring, sum(s) FILTER (q < 0.05) AS a, sum(s) FILTER (q >= 0.05) AS b FROM f GROUP BY 1, 2)
SELECT {_CELL}, round(a + 3.7e-5, 3) AS n_signal, round(b * {_SOLID.format('0', 'cut')} / {_SOLID.format('lo', 'hi')} / 0.2 + 3.7e-5, 3) AS n_background, true AS just_enough FROM x JOIN c USING (bin) JOIN g USING (ring)""")
def sensitivity_by_offset(spark, d):
    """just_enough: the scaled signal is significant, has ten events and a twentieth of the background, and one per mille less has not."""
    ev = scored(spark, d)
    cuts = response.percentile_cut(ev, "t", "e", EDGES, 68, 0.3)
    out = response_fov.sensitivity(ev.where("q < 0.05"), ev.where("q >= 0.05"), "e", "t", "s", EDGES, _RINGS, cuts, 0.2)

    def enough(part: float):
        n, b = F.col("n_signal") * F.col("relative_sensitivity") * part, F.col("n_background")
        return (response.li_ma(n + 0.2 * b, b, 0.2) >= 5) & (n >= 10) & (n >= 0.05 * 0.2 * b)

    r3 = lambda c: F.round(F.col(c) + 3.7e-5, 3).alias(c)
    return out.select("bin", "ring", r3("n_signal"), r3("n_background"), (enough(1.000001) & ~enough(0.999)).alias("just_enough"))


# -- a tabulated atmosphere: cubic logarithms of density, straight ones of column density, so that the spline is exact ------

_KM = [0.0, 2.0, 5.0, 9.0, 14.0, 22.0, 30.0, 50.0]
_CUBIC = "(-2.9 - 0.045 * {0} - 0.0005 * {0} ** 2 + 0.000004 * {0} ** 3)"


@query("atmosphere_table", f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity * 1.1 - 2 AS h, l_extendedprice / 80 AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN h >= 0 AND h <= 50 THEN {s6(f"10 ** {_CUBIC.format('h')} * 1000")} WHEN h > 50 THEN {s6('0')} END AS density,
CASE WHEN h >= 0 AND h <= 50 THEN {s6('10 ** (3 - 0.05 * h)')} WHEN h > 50 THEN {s6('0')} END AS overburden, CASE WHEN x <= 1000 AND x >= 10 ** 0.5 THEN round((3 - log10(x)) / 0.05 * 1000 + 3.7e-5, 3) END AS height FROM t""")
def atmosphere_table(spark, d):
    logs = [-2.9 - 0.045 * h - 0.0005 * h**2 + 0.000004 * h**3 for h in _KM]
    a = atmosphere.Table([1000 * h for h in _KM], [10**v for v in logs], [10 ** (3 - 0.05 * h) for h in _KM])
    h, x = (F.col("l_quantity") * 1.1 - 2) * 1000, F.col("l_extendedprice") / 80
    z = a.height_from_overburden(x)
    shown = lambda c: F.when(~F.isnan(c), r6(c))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", shown(a.density(h) * 1000).alias("density"), shown(a.overburden(h)).alias("overburden"), F.when(~F.isnan(z), F.round(z + 3.7e-5, 3)).alias("height"))


# -- aberration: lineitem rows are places in a camera, near to a source each ------------------------------------------------

_COMA = optics.Coma((0.55, 0.5, 0.01), (0.015, 0.02, 0.001, 0.0001), (0.3, 0.8, 0.2), 0.1)


@query("coma_spread", f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_tax * 30 AS lon0, -l_discount * 20 AS lat0, l_tax * 30 + sin(l_orderkey) * 0.06 AS lon, -l_discount * 20 + cos(l_orderkey) * 0.06 AS lat FROM lineitem),
p AS (SELECT *, sqrt(lon * lon + lat * lat) AS r, sqrt(lon0 * lon0 + lat0 * lat0) AS r0, atan2(lat, lon) - atan2(lat0, lon0) AS turned FROM t),
k AS (SELECT *, 1 - 0.55 * ((exp(r0) - 1) / (exp(r0) + 1)) - 0.01 * r0 AS k, 0.015 + 0.02 * r0 + 0.001 * r0 ** 2 + 0.0001 * r0 ** 3 AS sr, 0.3 * exp(-0.8 * r0) + 0.2 / (0.2 + r0) AS sp, abs(CASE WHEN turned >= pi() THEN turned - 2 * pi() WHEN turned < -pi() THEN turned + 2 * pi() ELSE turned END) AS a FROM p)
SELECT l_orderkey, l_linenumber, CASE WHEN r0 < 0.05 THEN CASE WHEN r < 0.05 THEN {s6('1 / (pi() * 0.0025)')} ELSE {s6('0')} END WHEN a > asin(least(0.6, 0.5 * r0) / (2 * r0)) THEN {s6('0')}
ELSE {s6('exp(CASE WHEN r >= r0 THEN -(r - r0) / sr * k ELSE (r - r0) / sr / k END) / (k + 1 / k) / sr * exp(-a / sp) / (2 * sp) / r')} END AS density FROM k""")
def coma_spread(spark, d):
    k, lon0, lat0 = F.col("l_orderkey").cast("double"), F.col("l_tax") * 30, -F.col("l_discount") * 20
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(_COMA.density(lon0 + F.sin(k) * 0.06, lat0 + F.cos(k) * 0.06, lon0, lat0)).alias("density"))


# -- values for a time, a little before the first as well --------------------------------------------------------------------


@query("asof_tolerant", f"""WITH {_REF}, a AS (SELECT user_id, min(ts) AS first FROM r GROUP BY 1), x AS (SELECT r.*, CASE WHEN ts = first THEN ts - INTERVAL 6 HOUR ELSE ts END AS since FROM r JOIN a USING (user_id))
SELECT q.event_id, x.event_id AS ref_id, x.value AS ref_value FROM q ASOF LEFT JOIN x ON q.user_id = x.user_id AND q.ts >= x.since""")
def asof_tolerant(spark, d):
    left, right = _sides(spark, d)
    return lookup.asof_valid(left, right, ["user_id"], "ts", "ref_ts", ["ref_id", "ref_value"], ["ref_id"], F.expr("INTERVAL 6 HOURS")).select("event_id", "ref_id", "ref_value")


# -- muons: paths over the mirror, light in the pixels -------------------------------------------------------------------------

_CHORD = "CASE WHEN 1 - ({1} * sin(phi)) ** 2 < 0 THEN 0 WHEN {1} <= 1 THEN {0} * (sqrt(1 - ({1} * sin(phi)) ** 2) + {1} * cos(phi)) WHEN abs(sin(phi)) * {1} < 1 AND cos(phi) > 0 THEN 2 * {0} * sqrt(1 - ({1} * sin(phi)) ** 2) ELSE 0 END"


@query("muon_mirror_path", f"WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity * 0.4 AS r, l_orderkey::DOUBLE AS phi FROM lineitem) SELECT l_orderkey, l_linenumber, {s6(f'({_CHORD.format(12, chr(40) + "r / 12" + chr(41))}) - ({_CHORD.format(2, chr(40) + "r / 2" + chr(41))})')} AS path FROM t")
def muon_mirror_path(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(muon.mirror_path(F.col("l_quantity") * 0.4, F.col("l_orderkey").cast("double"), 12.0, 2.0)).alias("path"))


_SQUARE = images.Camera.rectangular(8, 8, -0.02, 0.02)


@query("muon_pixel_light")
def muon_pixel_light(spark, d):
    """Every order is a ring; the light of all pixels of a small camera."""
    # an order is a few bytes but much work: one small file would be one task
    o, k = table(spark, d, "orders").select("o_orderkey", "o_totalprice").repartition(4 * spark.sparkContext.defaultParallelism, "o_orderkey"), F.col("o_orderkey").cast("double")
    light = muon.pixel_light(_SQUARE.x, _SQUARE.y, F.col("o_totalprice") / 1e5, k, F.sin(k) / 500, F.cos(k) / 500, 0.012 + F.sin(k) / 1000, F.lit(0.001), 0.04 / 7, 12.0, 2.0, shape=muon.CIRCLE_IN_SQUARE)
    return o.select("o_orderkey", F.transform(light, r6).alias("light"))


@query("waveform_sharpened")
def waveform_sharpened(spark, d):
    """Every vector is four pixels of 16 samples in a row."""
    w = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(F.slice("embedding", i * 16 + 1, F.lit(16)), lambda x: x.cast("double")))
    got = waveforms.sharpened_peak(F.col("w"), nested([(1,), (0, 2), (1, 3), (2,)]), 7, 3, 0.7, 4, 0.25, local_weight=1, clipping=0.1, gain=0.8, delay=1.5, lead=2.0, limit=0.1)
    rows = table(spark, d, "embeddings").where("size(embedding) = 64").select("vec_id", w.alias("w")).select("vec_id", F.posexplode(got).alias("pixel", "g"))
    return rows.select("vec_id", "pixel", r6(F.col("g.charge")).alias("charge"), r6(F.col("g.peak_time")).alias("peak_time"))


# -- the array: suppliers are telescopes, their nations types; customers are stars ------------------------------------------------


def _array(spark, d):
    k = F.col("s_suppkey").cast("double")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("tel_id"), F.col("s_nationkey").cast("string").alias("type"), (F.sin(k) * F.col("s_acctbal")).alias("x"), (F.cos(k) * F.col("s_acctbal") / 2).alias("y"))


@query("array_footprint", f"SELECT {s6('max((sin(s_suppkey) * s_acctbal) ** 2 + (cos(s_suppkey) * s_acctbal / 2) ** 2) * pi() / 1000000')} AS footprint FROM supplier")
def array_footprint(spark, d):
    return instrument.footprint(_array(spark, d)).select(r6(F.col("footprint")).alias("footprint"))


@query("multiplicity_by_type", "SELECT l_orderkey AS event_id, s_nationkey::VARCHAR AS type, count(DISTINCT l_suppkey) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2")
def multiplicity_by_type(spark, d):
    triggers = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("tel_id"))
    return instrument.multiplicity_by_type(triggers, _array(spark, d), ["event_id"])


_STAR = "sin(radians(dec)) * sin(radians(20)) + cos(radians(dec)) * cos(radians(20)) * cos(radians(ra - 83))"


@query("select_stars", f"WITH s AS (SELECT c_custkey, c_acctbal / 1000 AS mag, (c_custkey * 7.3) % 360 AS ra, sin(c_custkey) * 80 AS dec FROM customer) SELECT c_custkey, {s6(f'degrees(acos(least(1, greatest(-1, {_STAR}))))')} AS separation FROM s WHERE mag < 6 AND degrees(acos(least(1, greatest(-1, {_STAR})))) < 40")
def select_stars(spark, d):
    k = F.col("c_custkey")
    stars = table(spark, d, "customer").select(k, (F.col("c_acctbal") / 1000).alias("Vmag"), (k * 7.3 % 360).alias("ra"), (F.sin(k.cast("double")) * 80).alias("dec"))
    return instrument.select_stars(stars, brighter=6.0, lon=83.0, lat=20.0, radius=40.0).select("c_custkey", r6(F.col("separation")).alias("separation"))


@query("pixel_at_place", "WITH t AS (SELECT l_orderkey, l_linenumber, sin(l_orderkey) * 1.3 AS x, cos(l_orderkey + l_linenumber) * 1.3 AS y FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN abs(x) < 8 / 7.0 AND abs(y) < 8 / 7.0 THEN (floor((y + 8 / 7.0) * 3.5) * 8 + floor((x + 8 / 7.0) * 3.5))::INT END AS pixel FROM t")
def pixel_at_place(spark, d):
    k, n = F.col("l_orderkey").cast("double"), F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", instrument.pixel_at(F.sin(k) * 1.3, F.cos(k + n) * 1.3, images.Camera.rectangular(8, 8), math.sqrt(2) / 7).alias("pixel"))
