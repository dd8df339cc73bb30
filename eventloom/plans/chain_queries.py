"""Queries of whole processing chains: shower geometry, camera calibration, preparation for response tables, waveforms made sharp."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions import waveforms
from eventloom.functions.common import numbers
from eventloom.operators import calibration, geometry, images, preprocess, stereo
from eventloom.plans.catalogue import query
from eventloom.plans.event_queries import _TEL, r6, s6, tel_events
from eventloom.runtime import table

# -- shower geometry: lineitem rows are images, suppliers telescopes ---------------------------------------------------

_ALT, _AZ, _ALT0, _AZ0, _FAR = 1.2, 0.35, 1.21, 0.33, 0.1 * math.radians(4.0)


def _offset_sql(lon: str, lat: str) -> str:
    """SQL of struct(az, alt) of a place in the telescope's field of view."""
    x, y, z = f"cos({lat}) * cos({lon})", f"cos({lat}) * sin({lon})", f"sin({lat})"
    u, w = f"({x} * cos({_ALT}) - {z} * sin({_ALT}))", f"({x} * sin({_ALT}) + {z} * cos({_ALT}))"
    return f"{{'az': atan2({y}, {u}) + {_AZ}, 'alt': asin(least(greatest({w}, -1.0), 1.0))}}"


_UNIT = "[cos({0}.alt) * cos(-{0}.az), cos({0}.alt) * sin(-{0}.az), sin({0}.alt)]"
_NOMINAL = f"{{{{'lon': atan2(cos({{0}}.alt) * sin({{0}}.az - {_AZ0}), cos({{0}}.alt) * cos({{0}}.az - {_AZ0}) * cos({_ALT0}) + sin({{0}}.alt) * sin({_ALT0})), 'lat': asin(-cos({{0}}.alt) * cos({{0}}.az - {_AZ0}) * sin({_ALT0}) + sin({{0}}.alt) * cos({_ALT0}))}}}}"
_M3 = "m00 * (m11 * m22 - m12 * m12) - m01 * (m01 * m22 - m12 * m02) + m02 * (m01 * m12 - m11 * m02)"


def _cross_sql(a: str, b: str) -> str:
    return f"[{a}[2] * {b}[3] - {a}[3] * {b}[2], {a}[3] * {b}[1] - {a}[1] * {b}[3], {a}[1] * {b}[2] - {a}[2] * {b}[1]]"


def _core(sql: str) -> str:
    return f"CASE WHEN abs(cx) < 1e4 AND abs(cy) < 1e4 THEN round({sql} + 3.7e-5, 2) + 0.0 END"


def _psi(line: Column, discount: Column) -> Column:
    """line * 0.7 + discount * 15 to the last bit: SQL's 0.7 is a decimal, and 3 * 0.7 as doubles is not 2.1."""
    return line * 7 / 10 + discount * 15


@query("shower_geometry", f"""WITH {_TEL}, i AS (SELECT event_id, tel_id, line, energy AS intensity, (discount - 0.05) * 0.4 + energy * 1e-7 AS lon, (tax - 0.04) * 0.4 + energy * 3e-8 AS lat, line * 0.7 + discount * 15 AS psi, 0.2 + tax AS len, 0.05 + discount AS wid,
  s_acctbal / 20 AS x, 200 * sin(s_suppkey) AS y, 10 * cos(s_suppkey) AS z FROM tel JOIN supplier ON s_suppkey = tel_id),
a AS (SELECT *, {_offset_sql('lon', 'lat')} AS p1, {_offset_sql(f'(lon + {_FAR} * cos(psi))', f'(lat + {_FAR} * sin(psi))')} AS p2 FROM i),
b AS (SELECT *, {_UNIT.format('p1')} AS a, {_UNIT.format('p2')} AS b, {_NOMINAL.format('p1')} AS q1, {_NOMINAL.format('p2')} AS q2, intensity * len / wid AS w,
  sin({_ALT0}) * cos(-{_AZ0}) * x + sin({_ALT0}) * sin(-{_AZ0}) * y - cos({_ALT0}) * z AS tx, -sin(-{_AZ0}) * x + cos(-{_AZ0}) * y AS ty FROM a),
c AS (SELECT *, {_cross_sql('a', 'b')} AS n, atan((q1.lon - q2.lon) / (q1.lat - q2.lat)) AS axis, a[1] * x + a[2] * y + a[3] * z AS along, row_number() OVER () AS k FROM b),
v AS (SELECT l.event_id, {_cross_sql('l.n', 'r.n')} AS v, l.w * r.w AS w FROM c l JOIN c r ON l.event_id = r.event_id AND l.k < r.k),
u AS (SELECT event_id, sum(w * v[1] * s) AS vx, sum(w * v[2] * s) AS vy, sum(w * v[3] * s) AS vz, list([v[1] * s, v[2] * s, v[3] * s]) AS vs FROM (SELECT *, CASE WHEN v[3] < 0 THEN -1 ELSE 1 END AS s FROM v) GROUP BY 1),
g AS (SELECT event_id, count(*) AS n, avg(intensity) AS average_intensity, sum(sin(axis) ** 2) AS m1, sum(-sin(axis) * cos(axis)) AS m2, sum(cos(axis) ** 2) AS m3, sum(sin(axis) ** 2 * tx - sin(axis) * cos(axis) * ty) AS r1, sum(cos(axis) ** 2 * ty - sin(axis) * cos(axis) * tx) AS r2,
  sum(1 - a[1] * a[1]) AS m00, sum(-a[1] * a[2]) AS m01, sum(-a[1] * a[3]) AS m02, sum(1 - a[2] * a[2]) AS m11, sum(-a[2] * a[3]) AS m12, sum(1 - a[3] * a[3]) AS m22, sum(x - a[1] * along) AS h0, sum(y - a[2] * along) AS h1, sum(z - a[3] * along) AS h2 FROM c GROUP BY 1 HAVING count(*) > 1),
s AS (SELECT g.*, u.*, (m3 * r1 - m2 * r2) / (m1 * m3 - m2 * m2) AS cx, (m1 * r2 - m2 * r1) / (m1 * m3 - m2 * m2) AS cy, (m00 * (m11 * h2 - h1 * m12) - m01 * (m01 * h2 - h1 * m02) + h0 * (m01 * m12 - m11 * m02)) / ({_M3}) + 2000 AS h FROM g JOIN u USING (event_id))
SELECT event_id, n, round(asin(vz / sqrt(vx * vx + vy * vy + vz * vz)) + 3.7e-6, 4) AS alt, round((CASE WHEN -atan2(vy, vx) < 0 THEN 2 * pi() ELSE 0 END - atan2(vy, vx)) + 3.7e-6, 4) AS az, round(list_avg(list_transform(vs, lambda p: acos(least(1, greatest(-1, (p[1] * vx + p[2] * vy + p[3] * vz) / sqrt(vx * vx + vy * vy + vz * vz) / sqrt(p[1] * p[1] + p[2] * p[2] + p[3] * p[3])))))) + 3.7e-6, 3) AS direction_uncert,
{_core('cx')} AS core_tilted_x, {_core('cy')} AS core_tilted_y, {_core(f'sin({_ALT0}) * cos(-{_AZ0}) * cx - sin(-{_AZ0}) * cy + cos({_ALT0}) * cx / sin({_ALT0}) * cos({_ALT0}) * cos(-{_AZ0})')} AS core_x,
{_core(f'sin({_ALT0}) * sin(-{_AZ0}) * cx + cos(-{_AZ0}) * cy + cos({_ALT0}) * cx / sin({_ALT0}) * cos({_ALT0}) * sin(-{_AZ0})')} AS core_y, CASE WHEN abs(h) < 1e5 THEN round(h / 1000 + 3.7e-5, 2) + 0.0 END AS h_max_km, round(average_intensity + 3.7e-5, 2) AS average_intensity FROM s""")
def shower_geometry(spark, d):
    """Cores farther than 10 km and heights beyond 100 km are null: near-parallel lines, where the digits are noise."""
    place = table(spark, d, "supplier").select(F.col("s_suppkey").alias("tel_id"), (F.col("s_acctbal") / 20).alias("x"), (200 * F.sin(F.col("s_suppkey").cast("double"))).alias("y"), (10 * F.cos(F.col("s_suppkey").cast("double"))).alias("z"))
    e, x, t = F.col("energy"), F.col("discount"), F.col("tax")
    tel = tel_events(spark, d).join(place, "tel_id").select(
        "event_id", "tel_id", "x", "y", "z", e.alias("intensity"), ((x - 0.05) * 0.4 + e * 1e-7).alias("fov_lon"), ((t - 0.04) * 0.4 + e * 3e-8).alias("fov_lat"), _psi(F.col("line"), x).alias("psi"),
        (0.2 + t).alias("length"), (0.05 + x).alias("width"), F.lit(_ALT).alias("alt"), F.lit(_AZ).alias("az"), F.lit(_ALT0).alias("array_alt"), F.lit(_AZ0).alias("array_az"),
    )
    g = geometry.reconstruct(tel, ["event_id"], height=2000.0).where("size(telescopes) > 1")
    near = (F.abs("core_tilted_x") < 1e4) & (F.abs("core_tilted_y") < 1e4)
    two = lambda c: F.round(c + 3.7e-5, 2) + 0.0
    return g.select(
        "event_id", F.size("telescopes").alias("n"), F.round(F.col("alt") + 3.7e-6, 4).alias("alt"), F.round(F.col("az") + 3.7e-6, 4).alias("az"), F.round(F.col("direction_uncert") + 3.7e-6, 3).alias("direction_uncert"),
        *[F.when(near, two(F.col(c))).alias(c) for c in ("core_tilted_x", "core_tilted_y", "core_x", "core_y")], F.when(F.abs("h_max") < 1e5, two(F.col("h_max") / 1000)).alias("h_max_km"), two(F.col("average_intensity")).alias("average_intensity"),
    )


# -- camera calibration: embeddings as 8 pixels of 8 samples ------------------------------------------------------------

_CAM = images.Camera.rectangular(4, 2)
_PED, _FACTOR, _SHIFT = [0.01 * i for i in range(8)], [1 + 0.1 * i for i in range(8)], [0.3, 1.4, -1.2, 0.0, 2.3, -0.7, 0.6, -2.1]
_MEAN_SHIFT = sum(2 * x for x in _SHIFT) / 8
_MOVE = [round(2 * x - _MEAN_SHIFT) for x in _SHIFT]
_PX8 = "px AS (SELECT vec_id, (p - 1) // 8 AS px, (p - 1) % 8 AS s, embedding[p]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS p FROM embeddings))"


def _lit(a) -> str:
    return f"([{', '.join(map(str, a))}])[px + 1]"


@query("camera_calibration", f"""WITH {_PX8}, r AS (SELECT vec_id, px, max(v) > 0.05 AS signal, max(v) > 0.45 AS broken FROM px GROUP BY 1, 2),
w AS (SELECT px.vec_id, px.px, s, CASE WHEN signal THEN v ELSE 0 END - {_lit(_PED).replace('px', 'px.px')} AS v, broken FROM px JOIN r ON px.vec_id = r.vec_id AND px.px = r.px),
m AS (SELECT a.vec_id, a.px, a.s, b.v, a.broken FROM w a JOIN w b ON a.vec_id = b.vec_id AND a.px = b.px AND b.s = greatest(0, least(7, a.s + {_lit(_MOVE).replace('px', 'a.px')}))),
k AS (SELECT *, first_value(s) OVER (PARTITION BY vec_id, px ORDER BY v DESC, s) AS peak FROM m),
e AS (SELECT vec_id, px, any_value(broken) AS broken, sum(v) FILTER (s >= peak - 3 AND s < peak + 4) * {_lit(_FACTOR)} AS q,
  coalesce(sum(v * s) FILTER (v > 0 AND s >= peak - 3 AND s < peak + 4) / sum(v) FILTER (v > 0 AND s >= peak - 3 AND s < peak + 4), any_value(peak)) / 2 - ({_lit(_SHIFT)} * 2 - {_lit(_MOVE)}) / 2 AS t FROM k GROUP BY 1, 2),
n AS (SELECT e.vec_id, e.px, avg(o.q) AS q, avg(o.t) AS t FROM e JOIN e o ON o.vec_id = e.vec_id AND NOT o.broken AND ((o.px // 4 = e.px // 4 AND abs(o.px - e.px) = 1) OR abs(o.px - e.px) = 4) WHERE e.broken GROUP BY 1, 2)
SELECT e.vec_id, e.px AS pixel, CASE WHEN signal THEN 12 ELSE 0 END AS status, {s6('CASE WHEN e.broken THEN coalesce(n.q, 0) ELSE e.q END')} AS charge, {s6('CASE WHEN e.broken THEN coalesce(n.t, 0) ELSE e.t END')} AS peak_time FROM e JOIN r ON r.vec_id = e.vec_id AND r.px = e.px LEFT JOIN n ON n.vec_id = e.vec_id AND n.px = e.px""")
def camera_calibration(spark, d):
    w = table(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", i * 8 + 1, 8), lambda x: x.cast("double"))).alias("waveform"))
    over = lambda least: F.transform("waveform", lambda p: F.array_max(p) > least)
    w = w.withColumns({"pixel_status": F.array_repeat(F.lit(4), 8), "signal": over(0.05), "broken": over(0.45), "pedestal": numbers(_PED), "factor": numbers(_FACTOR), "time_shift": numbers(_SHIFT)})
    out = calibration.calibrate(calibration.reduce_volume(w, F.col("signal")), _CAM, rate=2.0)
    rows = out.select("vec_id", F.posexplode(F.arrays_zip("image", "peak_time", "pixel_status")).alias("pixel", "z"))
    return rows.select("vec_id", F.col("pixel").cast("long").alias("pixel"), F.col("z.pixel_status").alias("status"), r6(F.col("z.image")).alias("charge"), r6(F.col("z.peak_time")).alias("peak_time"))


def _smooth_sql(a: str, lo: int, hi: int) -> str:
    return f"list_transform(range(1, len({a}) + 1), lambda i: list_sum(list_transform(range({lo}, {hi} + 1), lambda k: {a}[greatest(1, least(len({a}), i + k))::INT])) / {hi - lo + 1})"


@query("waveform_deconvolved", f"""WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE - 0.02) AS a FROM embeddings), b AS (SELECT vec_id, list_transform(range(1, 65), lambda i: CASE WHEN i = 1 THEN 0 ELSE a[i] - 0.7 * a[i - 1] END) AS a FROM t),
c AS (SELECT vec_id, list_transform(range(0, 256), lambda i: a[(i // 4 + 1)::INT]) AS a FROM b), f AS (SELECT vec_id, {_smooth_sql('a', -1, 2)} AS a FROM c), g AS (SELECT vec_id, {_smooth_sql('a', -2, 1)} AS a FROM f)
SELECT vec_id, len(a) AS n, {s6('list_max(a)')} AS top, {s6('list_sum(a)')} AS charge, {s6('a[100]')} AS inside FROM g""")
def waveform_deconvolved(spark, d):
    w = table(spark, d, "embeddings").select("vec_id", waveforms.deconvolve(F.col("embedding"), F.lit(0.02), 0.7, 4).alias("a"))
    return w.select("vec_id", F.size("a").cast("long").alias("n"), r6(F.array_max("a")).alias("top"), r6(F.aggregate("a", F.lit(0.0), lambda s, x: s + x)).alias("charge"), r6(F.col("a")[99]).alias("inside"))


@query("waveform_centroid", f"""WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings), p AS (SELECT vec_id, a, list_position(a, list_max(a)) AS k, 0.3 * list_max(a) AS top FROM t), r AS (SELECT vec_id, k, unnest(range(1, 65)) AS i, unnest(a) AS v, top FROM p),
b AS (SELECT *, max(CASE WHEN i <= k AND NOT v > top THEN i END) OVER (PARTITION BY vec_id) AS low, min(CASE WHEN i > k AND NOT v > top THEN i END) OVER (PARTITION BY vec_id) AS high FROM r)
SELECT vec_id, {s6('coalesce(sum(v * (i - 1)) FILTER (i > coalesce(low, 0) AND i < coalesce(high, 65)) / sum(v) FILTER (i > coalesce(low, 0) AND i < coalesce(high, 65)), any_value(k) - 1)')} AS centroid FROM b GROUP BY 1""")
def waveform_centroid(spark, d):
    a = F.transform("embedding", lambda x: x.cast("double"))
    t = table(spark, d, "embeddings").select("vec_id", a.alias("a"))
    peak = F.array_position("a", F.array_max("a")).cast("int") - 1
    return t.select("vec_id", r6(waveforms.centroid(F.col("a"), peak, 0.3)).alias("centroid"))


@query("taubin_circle_fit", f"SELECT o_orderkey, {s6('0.2 * sin(o_orderkey)')} AS x, {s6('0.2 * cos(o_orderkey)')} AS y, {s6('0.4 + o_totalprice / 1e6')} AS radius FROM orders")
def taubin_circle_fit(spark, d):
    """Every order is a ring of known centre and radius; its pixels are those of a camera made of the ring's own points, moved and scaled."""
    o = table(spark, d, "orders").select("o_orderkey", F.sin(F.col("o_orderkey").cast("double")).alias("sx"), F.cos(F.col("o_orderkey").cast("double")).alias("sy"), (0.4 + F.col("o_totalprice") / 1e6).alias("r"))
    arc = images.Camera(*zip(*[(math.cos(0.3 * i), math.sin(0.3 * i)) for i in range(12)], strict=True), neighbors=((),) * 12)
    c = o.withColumn("c", images.taubin_circle_fit(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: 1.0 + i * F.abs(F.col("sx"))), arc))
    return c.select("o_orderkey", r6(F.col("c.x") * F.col("r") + 0.2 * F.col("sx")).alias("x"), r6(F.col("c.y") * F.col("r") + 0.2 * F.col("sy")).alias("y"), r6(F.col("c.radius") * F.col("r")).alias("radius"))


# -- events made ready for response tables -------------------------------------------------------------------------------

_RECO = preprocess.Reconstruction("Regressor", "Geometry", "Classifier")


def _apart_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"degrees(acos(least(1, greatest(-1, sin(radians({lat1})) * sin(radians({lat2})) + cos(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon1} - {lon2}))))))"


def _events(spark, d):
    """Orders as reconstructed events; the telescopes of the three reconstructions are those of the event's lines that pass a threshold each."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_discount", "l_tax"))).alias("l"))
    o = table(spark, d, "orders").join(rows, F.col("o_orderkey") == F.col("l_orderkey"))
    seen = lambda c, least: F.transform("l", lambda x: x[c] > least)
    return o.select(
        F.col("o_custkey").alias("obs_id"), k.alias("event_id"), (p / 1e4).alias("true_energy"), F.lit(180.0).alias("true_az"), F.lit(70.0).alias("true_alt"),
        (p / 9e3).alias("Regressor_energy"), (180 + 2 * F.sin(k.cast("double"))).alias("Geometry_az"), (70 + F.cos(k.cast("double"))).alias("Geometry_alt"), (p / 1e6).alias("Classifier_prediction"),
        F.lit(70.5).alias("subarray_pointing_lat"), F.lit(180.4).alias("subarray_pointing_lon"), F.lit(0).alias("subarray_pointing_frame"),
        seen("l_quantity", 10).alias("Regressor_telescopes"), seen("l_discount", 0.02).alias("Geometry_telescopes"), seen("l_tax", 0.01).alias("Classifier_telescopes"),
    )


@query("dl2_preprocessing", f"""WITH n AS (SELECT l_orderkey, least(count(*) FILTER (l_quantity > 10), count(*) FILTER (l_discount > 0.02), count(*) FILTER (l_tax > 0.01)) AS multiplicity FROM lineitem GROUP BY 1),
e AS (SELECT o_custkey AS obs_id, o_orderkey AS event_id, o_totalprice / 1e4 AS true_energy, o_totalprice / 9e3 AS reco_energy, o_totalprice / 1e6 AS gh_score, 180 + 2 * sin(o_orderkey) AS az, 70 + cos(o_orderkey) AS alt, multiplicity FROM orders JOIN n ON l_orderkey = o_orderkey),
f AS (SELECT *, radians(az - 180.4) AS l, radians(alt) AS b, radians(70.5) AS b0 FROM e)
SELECT obs_id, event_id, {s6('true_energy')} AS true_energy, {s6('reco_energy')} AS reco_energy, {s6('gh_score')} AS gh_score, {s6('az')} AS reco_az, {s6('alt')} AS reco_alt, multiplicity, 1.0::DOUBLE AS weight,
{s6(_apart_sql('az', 'alt', '180', '70'))} AS theta, {s6(_apart_sql('180', '70', '180.4', '70.5'))} AS true_source_fov_offset, {s6(_apart_sql('az', 'alt', '180.4', '70.5'))} AS reco_source_fov_offset,
{s6('-degrees(atan2(cos(b) * sin(l), cos(b) * cos(l) * cos(b0) + sin(b) * sin(b0)))')} AS reco_fov_lon, {s6('degrees(asin(sin(b) * cos(b0) - cos(b) * cos(l) * sin(b0)))')} AS reco_fov_lat FROM f""")
def dl2_preprocessing(spark, d):
    out = preprocess.derive(preprocess.normalise(_events(spark, d), _RECO), _RECO)
    numbers_ = ["true_energy", "reco_energy", "gh_score", "reco_az", "reco_alt", "theta", "true_source_fov_offset", "reco_source_fov_offset", "reco_fov_lon", "reco_fov_lat"]
    return out.select("obs_id", "event_id", F.col("multiplicity").cast("long").alias("multiplicity"), "weight", *[r6(F.col(c)).alias(c) for c in numbers_])


@query("simulated_sample", "SELECT sum(s_suppkey * 10)::BIGINT AS n_showers, -2.0::DOUBLE AS spectral_index, 0.003::DOUBLE AS energy_range_min, 330.0::DOUBLE AS energy_range_max, 1900.0::DOUBLE AS max_scatter_range, 10.0::DOUBLE AS max_viewcone_radius, 0.0::DOUBLE AS min_viewcone_radius FROM supplier")
def simulated_sample(spark, d):
    s = table(spark, d, "supplier")
    fixed = dict(zip(preprocess.SHARED, (-2.0, 0.003, 330.0, 1900.0, 10.0, 0.0), strict=True))
    runs = s.select(F.col("s_suppkey").alias("n_showers"), F.lit(10).alias("shower_reuse"), *[F.lit(v).alias(c) for c, v in fixed.items()])
    return preprocess.simulated_sample(runs, s.select((F.col("s_suppkey") * 10).alias("n_entries")))


@query("stereo_energy_unbiased", f"""WITH {_TEL}, w AS (SELECT event_id, intensity AS w, ln(energy) AS x FROM tel), m AS (SELECT event_id, sum(w * x) / sum(w) AS m, count(*) AS n, sum(w) AS sw, sum(w * w) AS qw FROM w GROUP BY 1),
v AS (SELECT event_id, m, n, CASE WHEN n > 1 THEN sqrt(sum(w * (x - m) ** 2) / any_value(sw - qw / sw)) END AS s FROM w JOIN m USING (event_id) GROUP BY event_id, m, n)
SELECT event_id, n AS n_valid, round(exp(m) + 3.7e-5, 3) AS energy, {s6('exp(s)')} AS uncert FROM v""")
def stereo_energy_unbiased(spark, d):
    m = stereo.combine_mean(tel_events(spark, d), ["event_id"], "energy", "tel_id", F.col("intensity"), log=True, unbiased=True)
    return m.select("event_id", "n_valid", F.round(F.col("mean") + 3.7e-5, 3).alias("energy"), F.when(~F.isnan("std"), r6(F.col("std"))).alias("uncert"))
