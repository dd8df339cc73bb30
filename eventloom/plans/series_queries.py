"""Queries over the monitoring series (events), camera images (embeddings as 8 x 8 pixels) and response tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import waveforms
from eventloom.operators import chunks, images, lookup, models, response
from eventloom.plans.catalogue import query
from eventloom.plans.event_queries import r6, s6
from eventloom.runtime import checkpoint_dir, table

CAMERA = images.Camera.rectangular(8, 8)


def series(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "ts", "value", "event_type")


def _pixels(name: str = "px") -> str:
    return f"{name} AS (SELECT vec_id, unnest(range(64)) AS p, unnest(embedding)::DOUBLE AS v FROM embeddings)"


_EDGES = "e AS (SELECT a.p AS p, b.p AS q FROM (SELECT unnest(range(64)) AS p) a, (SELECT unnest(range(64)) AS p) b WHERE abs(a.p // 8 - b.p // 8) + abs(a.p % 8 - b.p % 8) = 1)"
_PLACE = "xy AS (SELECT p, -1 + 2.0 * (p % 8) / 7 AS x, -1 + 2.0 * (p // 8) / 7 AS y FROM (SELECT unnest(range(64)) AS p))"


def image(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("image"))


def bits(mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda x: F.when(x, "1").otherwise("0")), "")


# -- chunks of the series ------------------------------------------------------------------------------------------

_RN = "n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
_STAT = f"count(*) AS n_events, {s6('avg(value)')} AS mean, {s6('median(value)')} AS median, {s6('stddev_pop(value)')} AS std"


def _plain(d: DataFrame) -> DataFrame:
    out = chunks.plain(d, ["user_id", "chunk"], "value")
    return out.select("user_id", "chunk", "n_events", *[r6(F.col(c)).alias(c) for c in ("mean", "median", "std")])


def _size_query(name: str, size: int, shift: int, last: str):
    step = shift or size
    k = f"(CASE WHEN n >= {size} THEN (n - {size}) // {step} + 1 ELSE 0 END)"
    end = f"(CASE WHEN {k} > 0 THEN ({k} - 1) * {step} + {size} ELSE 0 END)"
    extra = {"skip": "false", "truncate": f"n > {end} AND i >= {k} * {step}", "overlap": f"n > {end} AND i >= n - {size}"}[last]
    sql = f"""WITH {_RN}, c AS (SELECT user_id, value, unnest(range({k} + 1)) AS chunk, i, n FROM n),
    m AS (SELECT user_id, value, chunk FROM c WHERE (chunk < {k} AND i >= chunk * {step} AND i < chunk * {step} + {size}) OR (chunk = {k} AND {extra}))
    SELECT user_id, chunk, {_STAT} FROM m GROUP BY 1, 2"""

    @query(name, sql)
    def run(spark, d):
        return _plain(chunks.size_chunks(series(spark, d), ["user_id"], ["ts", "event_id"], size, shift, last))


_size_query("size_chunk_truncate", 20, 0, "truncate")
_size_query("size_chunk_skip", 20, 0, "skip")
_size_query("size_chunk_overlap", 20, 0, "overlap")
_size_query("size_chunk_shifted", 20, 5, "truncate")


def _time_query(name: str, hours: int, shift: int, last: str):
    dur, step = hours * 3600, (shift or hours) * 3600
    k = f"greatest(ceil((total - {dur}) / {step}), 0)"
    extra = {"skip": "false", "overlap": f"x >= greatest(total - {dur}, 0)", "truncate": f"x >= {k} * {step}"}[last]
    sql = f"""WITH t AS (SELECT user_id, value, epoch_us(ts) / 1e6 - min(epoch_us(ts)) OVER (PARTITION BY user_id) / 1e6 AS x FROM events), w AS (SELECT *, max(x) OVER (PARTITION BY user_id) AS total FROM t),
    c AS (SELECT *, unnest(range({k}::BIGINT + 1)) AS chunk FROM w), m AS (SELECT user_id, value, chunk FROM c WHERE (chunk < {k} AND x >= chunk * {step} AND x <= chunk * {step} + {dur}) OR (chunk = {k} AND {extra}))
    SELECT user_id, chunk, {_STAT} FROM m GROUP BY 1, 2"""

    @query(name, sql)
    def run(spark, d):
        return _plain(chunks.time_chunks(series(spark, d), ["user_id"], "ts", float(dur), float(shift * 3600), last))


_time_query("time_chunk_tumbling", 48, 0, "skip")
_time_query("time_chunk_sliding", 48, 24, "skip")
_time_query("time_chunk_overlap", 72, 0, "overlap")


@query("chunk_bounds", f"""WITH {_RN} SELECT user_id, i // 20 AS chunk, min(ts) AS time_start, max(ts) AS time_end, arg_min(event_id, (ts, event_id)) AS event_id_start, arg_max(event_id, (ts, event_id)) AS event_id_end, count(*) AS n_events FROM n GROUP BY 1, 2""")
def chunk_bounds(spark, d):
    c = chunks.size_chunks(series(spark, d), ["user_id"], ["ts", "event_id"], 20)
    return c.groupBy("user_id", "chunk").agg(*chunks.chunk_bounds("ts", "event_id"), F.count("*").alias("n_events"))


def _clip_sql(sigma: float, rounds: int) -> str:
    parts = ["c0 AS (SELECT user_id, event_type, value FROM events)"]
    for i in range(rounds):
        parts.append(f"c{i + 1} AS (SELECT user_id, event_type, value FROM (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM c{i} WINDOW w AS (PARTITION BY user_id)) WHERE abs(value - m) <= {sigma} * s)")
    return f"WITH {', '.join(parts)} SELECT user_id, count(*) AS n_events, round(avg(value) + 3.7e-5, 3) AS mean, round(stddev_pop(value) + 3.7e-5, 3) AS std FROM c{rounds} GROUP BY 1"


@query("sigma_clip", _clip_sql(2.0, 5))
def sigma_clip(spark, d):
    s = chunks.sigma_clip(series(spark, d), ["user_id"], "value", 2.0, 5)
    out = chunks.plain(s, ["user_id"], "value")
    return out.select("user_id", "n_events", F.round(F.col("mean") + 3.7e-5, 3).alias("mean"), F.round(F.col("std") + 3.7e-5, 3).alias("std"))


_H = "g AS (SELECT DISTINCT user_id FROM events)"


@query("histogram", f"WITH {_H}, b AS (SELECT user_id, floor(value / 50)::INT AS bin, count(*) AS n FROM events WHERE value >= 0 AND value < 400 GROUP BY 1, 2) SELECT g.user_id, k.bin::INT AS bin, coalesce(n, 0) AS count FROM g CROSS JOIN (SELECT unnest(range(8)) AS bin) k LEFT JOIN b ON b.user_id = g.user_id AND b.bin = k.bin")
def histogram(spark, d):
    return chunks.histogram(series(spark, d), ["user_id"], "value", [50.0 * i for i in range(9)])


@query("histogram_flow", f"WITH {_H}, b AS (SELECT user_id, CASE WHEN value < 50 THEN -1 WHEN value >= 250 THEN 4 ELSE floor((value - 50) / 50)::INT END AS bin, count(*) AS n FROM events GROUP BY 1, 2) SELECT g.user_id, k.bin::INT AS bin, coalesce(n, 0) AS count FROM g CROSS JOIN (SELECT unnest(range(-1, 5)) AS bin) k LEFT JOIN b ON b.user_id = g.user_id AND b.bin = k.bin")
def histogram_flow(spark, d):
    return chunks.histogram(series(spark, d), ["user_id"], "value", [50.0, 100.0, 150.0, 200.0, 250.0], flow=True)


@query("outlier_range", "SELECT event_id, value < 5 OR value > 300 AS outlier FROM events")
def outlier_range(spark, d):
    return series(spark, d).select("event_id", chunks.range_outlier(F.col("value"), 5, 300).alias("outlier"))


@query("outlier_median", "SELECT event_id, value - median(value) OVER w < -0.9 * median(value) OVER w OR value - median(value) OVER w > 4 * median(value) OVER w AS outlier FROM events WINDOW w AS (PARTITION BY user_id)")
def outlier_median(spark, d):
    return chunks.median_outlier(series(spark, d), ["user_id"], "value", -0.9, 4.0).select("event_id", "outlier")


@query("outlier_std", "SELECT event_id, value - median(value) OVER w < -1.5 * stddev_pop(value) OVER w OR value - median(value) OVER w > 2 * stddev_pop(value) OVER w AS outlier FROM events WINDOW w AS (PARTITION BY user_id)")
def outlier_std(spark, d):
    return chunks.std_outlier(series(spark, d), ["user_id"], "value", -1.5, 2.0).select("event_id", "outlier")


@query("valid_chunks", f"WITH {_RN} SELECT user_id, i // 20 AS chunk, {s6('avg((value > 150)::INT)')} AS faulty, avg((value > 150)::INT) < 0.1 AS is_valid FROM n GROUP BY 1, 2")
def valid_chunks(spark, d):
    c = chunks.size_chunks(series(spark, d), ["user_id"], ["ts", "event_id"], 20).withColumn("outlier", chunks.range_outlier(F.col("value"), 0, 150))
    return chunks.valid_chunks(c, ["user_id", "chunk"], "outlier").withColumn("faulty", r6(F.col("faulty")))


@query("second_pass", f"""WITH {_RN}, f AS (SELECT user_id, i // 10 AS f FROM n GROUP BY 1, 2 HAVING max(value) > 250), g AS (SELECT *, greatest(CASE WHEN lag(f) OVER (PARTITION BY user_id ORDER BY f) = f - 1 THEN f ELSE f - 1 END, 0) * 10 + 5 AS lo FROM f),
r AS (SELECT n.user_id, f AS faulty, value, i - lo AS j, least(n.n - 1, (f + 2) * 10) - 4 - lo AS m FROM n JOIN g ON g.user_id = n.user_id AND i >= lo AND i < least(n.n - 1, (f + 2) * 10) - 4),
c AS (SELECT *, unnest(range((m - 10) // 5 + 2)) AS chunk, (m - 10) // 5 + 1 AS k FROM r WHERE m > 10)
SELECT user_id, faulty, chunk, {_STAT} FROM c WHERE (chunk < k AND j >= chunk * 5 AND j < chunk * 5 + 10) OR (chunk = k AND m > (k - 1) * 5 + 10 AND j >= m - 10) GROUP BY 1, 2, 3""")
def second_pass(spark, d):
    s = series(spark, d)
    first = chunks.size_chunks(s, ["user_id"], ["ts", "event_id"], 10)
    faulty = first.groupBy("user_id", "chunk").agg(F.max("value").alias("top")).where("top > 250").select("user_id", "chunk")
    out = chunks.second_pass(s, ["user_id"], ["ts", "event_id"], "value", faulty, 10, 5)
    return out.select("user_id", "faulty", "chunk", "n_events", *[r6(F.col(c)).alias(c) for c in ("mean", "median", "std")])


@query("element_statistics", f"""WITH {_pixels()}, j AS (SELECT e.label AS label, px.* FROM px JOIN embeddings e USING (vec_id))
SELECT label, p AS pixel, count(*) AS n_events, {s6('avg(v)')} AS mean, {s6('median(v)')} AS median, {s6('stddev_pop(v)')} AS std FROM j GROUP BY 1, 2""")
def element_statistics(spark, d):
    e = table(spark, d, "embeddings").select("label", "embedding")
    s = chunks.elementwise(e, ["label"], "embedding")
    rows = s.select("label", F.posexplode(F.arrays_zip("n_events", "mean", "median", "std")).alias("pixel", "s"))
    return rows.select("label", F.col("pixel").cast("long").alias("pixel"), "s.n_events", *[r6(F.col(f"s.{c}")).alias(c) for c in ("mean", "median", "std")])


# -- values for a time ---------------------------------------------------------------------------------------------

_REF = "r AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase'), q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click')"


def _sides(spark, d):
    e = series(spark, d)
    return e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("ref_ts"), F.col("event_id").alias("ref_id"), F.col("value").alias("ref_value"))


@query("asof_preceding", f"WITH {_REF} SELECT q.event_id, r.event_id AS ref_id, r.value AS ref_value FROM q ASOF LEFT JOIN r ON q.user_id = r.user_id AND q.ts >= r.ts")
def asof_preceding(spark, d):
    left, right = _sides(spark, d)
    return lookup.asof(left, right, ["user_id"], "ts", "ref_ts", ["ref_id", "ref_value"], ["ref_id"]).select("event_id", "ref_id", "ref_value")


@query("asof_nearest", f"""WITH {_REF}, b AS (SELECT q.event_id, q.ts, r.ts AS bt, r.value AS bv FROM q ASOF LEFT JOIN r ON q.user_id = r.user_id AND q.ts >= r.ts), a AS (SELECT q.event_id, r.ts AS a_t, r.value AS av FROM q ASOF LEFT JOIN r ON q.user_id = r.user_id AND q.ts <= r.ts)
SELECT b.event_id, CASE WHEN a_t IS NULL OR epoch_us(ts) - epoch_us(bt) < epoch_us(a_t) - epoch_us(ts) THEN bv ELSE av END AS nearest_value FROM b JOIN a USING (event_id)""")
def asof_nearest(spark, d):
    left, right = _sides(spark, d)
    return lookup.nearest(left, right, ["user_id"], "ts", "ref_ts", "ref_value").select("event_id", "nearest_value")


@query("linear_interp", f"""WITH {_REF}, p AS (SELECT user_id, epoch_us(ts) / 1e6 AS t0, value AS y0, lead(epoch_us(ts) / 1e6) OVER w AS t1, lead(value) OVER w AS y1 FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT q.event_id, {s6('y0 + (epoch_us(q.ts) / 1e6 - t0) * (y1 - y0) / (t1 - t0)')} AS value FROM q ASOF JOIN p ON q.user_id = p.user_id AND epoch_us(q.ts) / 1e6 >= p.t0 WHERE t1 IS NOT NULL""")
def linear_interp(spark, d):
    left, right = _sides(spark, d)
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    left = left.select("event_id", "user_id", sec("ts").alias("t"))
    out = lookup.linear(left, right.select("user_id", sec("ref_ts").alias("t0"), "ref_value"), ["user_id"], "t", "t0", "ref_value", ["t0"])
    return out.where("not isnan(ref_value_at)").select("event_id", r6(F.col("ref_value_at")).alias("value"))


@query("interval_lookup", f"""WITH {_RN}, c AS (SELECT user_id, i // 10 AS chunk, min(epoch_us(ts)) / 1e6 AS s, max(epoch_us(ts)) / 1e6 AS e, max(value) AS top FROM n GROUP BY 1, 2), q AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'click'),
h AS (SELECT q.event_id, c.top, row_number() OVER (PARTITION BY q.event_id ORDER BY c.s DESC) AS k FROM q JOIN c ON q.user_id = c.user_id AND q.t >= c.s AND q.t <= c.e) SELECT event_id, top FROM h WHERE k = 1""")
def interval_lookup(spark, d):
    e = series(spark, d)
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    c = chunks.size_chunks(e, ["user_id"], ["ts", "event_id"], 10).groupBy("user_id", "chunk").agg(F.min(sec).alias("time_start"), F.max(sec).alias("time_end"), F.array(F.max("value")).alias("top"))
    q = e.where("event_type = 'click'").select("event_id", "user_id", sec.alias("t"))
    return lookup.interval_lookup(q, c, ["user_id"], "t", "top").where("top is not null").select("event_id", F.col("top")[0].alias("top"))


@query("unwrap", f"""WITH s AS (SELECT event_id, user_id, ts, value % 6 AS a, value % 6 - lag(value % 6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)
SELECT event_id, {s6("a + sum(CASE WHEN abs(coalesce(step, 0)) > 3 THEN -6 * round(coalesce(step, 0) / 6) ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")} AS unwrapped FROM s""")
def unwrap(spark, d):
    e = series(spark, d).withColumn("a", F.col("value") % 6)
    return lookup.unwrap(e, ["user_id"], ["ts", "event_id"], "a", 6.0).select("event_id", r6(F.col("a_unwrapped")).alias("unwrapped"))


# -- images --------------------------------------------------------------------------------------------------------

_CLEAN = f"""{_pixels()}, {_EDGES}, b AS (SELECT vec_id, e.p, bool_or(v >= 0.15) AS np, bool_or(v >= 0.08) AS nb FROM px JOIN e ON px.p = e.q GROUP BY 1, 2),
m AS (SELECT vec_id, p, v, (v >= 0.08 AND np) OR (v >= 0.15 AND nb) AS keep FROM px JOIN b USING (vec_id, p))"""


def cleaned(spark, d):
    i = image(spark, d)
    return i.withColumn("mask", images.tailcuts(F.col("image"), CAMERA, 0.15, 0.08))


def _mask_sql(expr: str) -> str:
    return f"string_agg(CASE WHEN {expr} THEN '1' ELSE '0' END, '' ORDER BY p)"


@query("image_tailcuts", f"WITH {_CLEAN} SELECT vec_id, {_mask_sql('keep')} AS mask FROM m GROUP BY 1")
def image_tailcuts(spark, d):
    return cleaned(spark, d).select("vec_id", bits(F.col("mask")).alias("mask"))


@query("image_dilate", f"WITH {_CLEAN}, g AS (SELECT m.vec_id, e.p, bool_or(keep) AS near FROM m JOIN e ON m.p = e.q GROUP BY 1, 2) SELECT vec_id, {_mask_sql('keep OR near')} AS mask FROM m JOIN g USING (vec_id, p) GROUP BY 1")
def image_dilate(spark, d):
    return cleaned(spark, d).select("vec_id", bits(images.dilate(F.col("mask"), CAMERA)).alias("mask"))


@query("image_mars", f"WITH {_CLEAN}, g AS (SELECT m.vec_id, e.p, bool_or(keep) AS near FROM m JOIN e ON m.p = e.q GROUP BY 1, 2) SELECT vec_id, {_mask_sql('keep OR (near AND v >= 0.08)')} AS mask FROM m JOIN g USING (vec_id, p) GROUP BY 1")
def image_mars(spark, d):
    return image(spark, d).select("vec_id", bits(images.mars_cleaning(F.col("image"), CAMERA, 0.15, 0.08)).alias("mask"))


@query("image_bright", f"WITH {_pixels()}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC) AS k FROM px), t AS (SELECT vec_id, sum(v) / 3 AS top FROM r WHERE k <= 3 GROUP BY 1) SELECT vec_id, {_mask_sql('top < 0.25 OR v >= 0.5 * top')} AS mask FROM px JOIN t USING (vec_id) GROUP BY 1")
def image_bright(spark, d):
    return image(spark, d).select("vec_id", bits(images.bright_cleaning(F.col("image"), 0.25, 0.5)).alias("mask"))


@query("image_time_cleaning", f"WITH {_CLEAN}, n AS (SELECT a.vec_id, a.p, count(*) FILTER (b.keep AND abs(b.v - a.v) < 0.12) AS k FROM m a JOIN e ON a.p = e.p JOIN m b ON b.vec_id = a.vec_id AND b.p = e.q GROUP BY 1, 2) SELECT vec_id, {_mask_sql('keep AND k >= 1')} AS mask FROM m JOIN n USING (vec_id, p) GROUP BY 1")
def image_time_cleaning(spark, d):
    return cleaned(spark, d).select("vec_id", bits(images.time_delta_cleaning(F.col("mask"), F.col("image"), CAMERA, 1, 0.12)).alias("mask"))


@query("image_islands", f"""WITH RECURSIVE {_CLEAN}, w(vec_id, p, root) AS (SELECT vec_id, p, p FROM m WHERE keep UNION SELECT w.vec_id, e.q, w.root FROM w JOIN e ON w.p = e.p JOIN m ON m.vec_id = w.vec_id AND m.p = e.q AND m.keep),
l AS (SELECT vec_id, p, min(root) AS root FROM w GROUP BY 1, 2) SELECT m.vec_id, count(DISTINCT root)::INT AS n_islands, count(l.p)::INT AS n_pixels FROM (SELECT DISTINCT vec_id FROM m) m LEFT JOIN l USING (vec_id) GROUP BY 1""")
def image_islands(spark, d):
    c = cleaned(spark, d).withColumn("labels", images.islands(F.col("mask"), CAMERA))
    return c.select("vec_id", images.island_sizes(F.col("labels"))["n"].alias("n_islands"), F.size(F.filter("mask", lambda x: x)).alias("n_pixels"))


@query("image_morphology", f"""WITH RECURSIVE {_CLEAN}, w(vec_id, p, root) AS (SELECT vec_id, p, p FROM m WHERE keep UNION SELECT w.vec_id, e.q, w.root FROM w JOIN e ON w.p = e.p JOIN m ON m.vec_id = w.vec_id AND m.p = e.q AND m.keep),
l AS (SELECT vec_id, p, min(root) AS root FROM w GROUP BY 1, 2), k AS (SELECT vec_id, root, count(*) AS n FROM l GROUP BY 1, 2)
SELECT i.vec_id, coalesce(sum(n), 0)::INT AS n_pixels, count(n)::INT AS n_islands, (count(n) FILTER (n <= 2))::INT AS n_small, (count(n) FILTER (n > 2 AND n <= 50))::INT AS n_medium, (count(n) FILTER (n > 50))::INT AS n_large FROM embeddings i LEFT JOIN k USING (vec_id) GROUP BY 1""")
def image_morphology(spark, d):
    m = cleaned(spark, d).withColumn("labels", images.islands(F.col("mask"), CAMERA))
    m = m.select("vec_id", images.morphology(F.col("mask"), F.col("labels")).alias("k"))
    return m.select("vec_id", "k.n_pixels", "k.n_islands", F.col("k.n_small_islands").alias("n_small"), F.col("k.n_medium_islands").alias("n_medium"), F.col("k.n_large_islands").alias("n_large"))


@query("image_leakage", f"""WITH {_CLEAN}, k AS (SELECT *, p // 8 IN (0, 7) OR p % 8 IN (0, 7) AS b1, p // 8 IN (0, 1, 6, 7) OR p % 8 IN (0, 1, 6, 7) AS b2 FROM m)
SELECT vec_id, {s6('count(*) FILTER (keep AND b1) / nullif(count(*) FILTER (keep), 0)')} AS pixels_1, {s6('count(*) FILTER (keep AND b2) / nullif(count(*) FILTER (keep), 0)')} AS pixels_2,
{s6('CASE WHEN sum(v) FILTER (keep) <> 0 THEN coalesce(sum(v) FILTER (keep AND b1), 0) / sum(v) FILTER (keep) END')} AS intensity_1 FROM k GROUP BY 1""")
def image_leakage(spark, d):
    c = cleaned(spark, d).withColumn("l", images.leakage(F.col("image"), F.col("mask"), CAMERA))
    return c.select("vec_id", r6(F.col("l.pixels_width_1")).alias("pixels_1"), r6(F.col("l.pixels_width_2")).alias("pixels_2"), r6(F.col("l.intensity_width_1")).alias("intensity_1"))


_HILLAS = f"""{_CLEAN}, {_PLACE}, q AS (SELECT vec_id, p, v, x, y FROM m JOIN xy USING (p) WHERE keep), c AS (SELECT vec_id, sum(v) AS s, sum(v * x) / sum(v) AS cx, sum(v * y) / sum(v) AS cy FROM q GROUP BY 1),
k AS (SELECT vec_id, s, cx, cy, sum(v * (x - cx) * (x - cx)) / s AS xx, sum(v * (x - cx) * (y - cy)) / s AS xy, sum(v * (y - cy) * (y - cy)) / s AS yy FROM q JOIN c USING (vec_id) GROUP BY 1, 2, 3, 4)"""


@query("image_hillas", f"""WITH {_HILLAS} SELECT vec_id, {s6('s')} AS intensity, {s6('cx')} AS x, {s6('cy')} AS y, {s6('sqrt(cx * cx + cy * cy)')} AS r,
{s6('sqrt(greatest((xx + yy) / 2 + sqrt(((xx - yy) / 2) ** 2 + xy * xy), 0))')} AS length FROM k""")
def image_hillas(spark, d):
    c = cleaned(spark, d)
    h = c.select("vec_id", images.hillas(images.masked(F.col("image"), F.col("mask")), CAMERA).alias("h")).where("h is not null")
    return h.select("vec_id", *[r6(F.col(f"h.{c}")).alias(c) for c in ("intensity", "x", "y", "r", "length")])


@query("image_hillas_uncertainty", f"""WITH {_HILLAS}, l AS (SELECT *, sqrt(greatest((xx + yy) / 2 + sqrt(((xx - yy) / 2) ** 2 + xy * xy), 0)) AS length, sqrt(greatest((xx + yy) / 2 - sqrt(((xx - yy) / 2) ** 2 + xy * xy), 0)) AS width,
CASE WHEN xy = 0 AND xx >= yy THEN 0 WHEN xy = 0 THEN pi() / 2 ELSE atan((sqrt(((xx - yy) / 2) ** 2 + xy * xy) - (xx - yy) / 2) / xy) END AS psi FROM k),
f AS (SELECT vec_id, s, length, width, sum(v * ((x - cx) * cos(psi) + (y - cy) * sin(psi)) ** 4) / s AS m4 FROM q JOIN l USING (vec_id) WHERE length > 0.05 GROUP BY vec_id, s, length, width)
SELECT vec_id, {s6('sqrt(greatest(m4 - length ** 4, 0) / s) / (2 * length)')} AS length_error, {s6('sqrt(4.0 / 49 / s) / length')} AS axis_error, {s6('sqrt(4.0 / 49 / s)')} AS cog_error FROM f""")
def image_hillas_uncertainty(spark, d):
    c = cleaned(spark, d).withColumn("c", images.masked(F.col("image"), F.col("mask")))
    c = c.withColumn("h", images.hillas(F.col("c"), CAMERA)).where("h.length > 0.05")
    u = c.select("vec_id", "h", images.hillas_uncertainty(F.col("c"), F.col("h"), CAMERA).alias("u"))
    bend = 1 + F.tan(F.col("h.width") / F.col("h.length") * 1.5707963267948966) ** 2
    return u.select("vec_id", r6(F.col("u.length")).alias("length_error"), r6(F.col("u.psi") / bend).alias("axis_error"), r6(F.col("u.transverse_cog")).alias("cog_error"))


@query("image_concentration", f"""WITH {_HILLAS} SELECT vec_id, {s6('coalesce(sum(v) FILTER ((x - cx) ** 2 + (y - cy) ** 2 < 4.0 / 49 ), 0) / s')} AS cog, {s6('max(v) / s')} AS pixel FROM q JOIN k USING (vec_id) GROUP BY vec_id, s""")
def image_concentration(spark, d):
    c = cleaned(spark, d).withColumn("c", images.masked(F.col("image"), F.col("mask")))
    c = c.withColumn("h", images.hillas(F.col("c"), CAMERA)).where("h is not null")
    out = c.select("vec_id", images.concentration(F.col("c"), F.col("h"), CAMERA).alias("k"))
    return out.select("vec_id", r6(F.col("k.cog")).alias("cog"), r6(F.col("k.pixel")).alias("pixel"))


@query("invalid_pixel_average", f"""WITH {_pixels()}, {_EDGES}, n AS (SELECT px.vec_id, e.p, coalesce(avg(v) FILTER (e.q % 5 <> 0), 0) AS a FROM px JOIN e ON px.p = e.q GROUP BY 1, 2)
SELECT vec_id, p, {s6('CASE WHEN p % 5 = 0 THEN a ELSE v END')} AS value FROM px JOIN n USING (vec_id, p)""")
def invalid_pixel_average(spark, d):
    broken = F.array(*[F.lit(p % 5 == 0) for p in range(64)])
    out = image(spark, d).select("vec_id", F.posexplode(images.neighbor_average(F.col("image"), broken, CAMERA)).alias("p", "v"))
    return out.select("vec_id", F.col("p").cast("long").alias("p"), r6(F.col("v")).alias("value"))


@query("circle_fit", f"""WITH {_pixels()}, {_PLACE}, w AS (SELECT vec_id, abs(v) AS w, x, y, x * x + y * y AS r FROM px JOIN xy USING (p)),
t AS (SELECT vec_id, sum(w) AS w, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * y * y) AS yy, sum(w * x * y) AS xy, sum(w * x * r) AS xr, sum(w * y * r) AS yr, sum(w * r) AS r FROM w GROUP BY 1),
u AS (SELECT *, xx - x / w * x AS a1, xy - x / w * y AS b1, (xr - r / w * x) / 2 AS c1, xy - y / w * x AS a2, yy - y / w * y AS b2, (yr - r / w * y) / 2 AS c2 FROM t),
v AS (SELECT *, (c1 * b2 - c2 * b1) / (a1 * b2 - a2 * b1) AS fx, (a1 * c2 - a2 * c1) / (a1 * b2 - a2 * b1) AS fy FROM u)
SELECT vec_id, {s6('fx')} AS x, {s6('fy')} AS y, {s6('sqrt(r / w - 2 * fx * x / w - 2 * fy * y / w + fx * fx + fy * fy)')} AS radius FROM v""")
def circle_fit(spark, d):
    i = image(spark, d).select("vec_id", images.circle_fit(F.transform("image", lambda v: F.abs(v)), CAMERA).alias("c"))
    return i.select("vec_id", r6(F.col("c.x")).alias("x"), r6(F.col("c.y")).alias("y"), r6(F.col("c.radius")).alias("radius"))


@query("ring_features", f"""WITH {_pixels()}, {_PLACE}, w AS (SELECT vec_id, abs(v) AS w, sqrt((x - 0.1) ** 2 + (y + 0.2) ** 2) AS d FROM px JOIN xy USING (p))
SELECT vec_id, {s6('sum(w * (d - 0.5) ** 2) / sum(w)')} AS error, {s6('coalesce(sum(w) FILTER (d >= 0.5 - 0.5 * 0.33 AND d <= 0.5 + 0.5 * 0.33), 0) / sum(w)')} AS inside FROM w GROUP BY 1""")
def ring_features(spark, d):
    w = image(spark, d).withColumn("w", F.transform("image", lambda v: F.abs(v)))
    r, x, y = F.lit(0.5), F.lit(0.1), F.lit(-0.2)
    return w.select("vec_id", r6(images.ring_error(F.col("w"), r, x, y, CAMERA)).alias("error"), r6(images.ring_ratio(F.col("w"), r, x, y, CAMERA, 0.33)).alias("inside"))


# -- waveforms -----------------------------------------------------------------------------------------------------


@query("waveform_local_peak", f"""WITH {_pixels()}, k AS (SELECT vec_id, arg_min(p, (-v, p)) AS peak FROM px GROUP BY 1), s AS (SELECT * FROM px JOIN k USING (vec_id) WHERE p >= peak - 2 AND p < peak + 5)
SELECT vec_id, {s6('sum(v)')} AS charge, {s6('sum(v * p) FILTER (v > 0) / sum(v) FILTER (v > 0)')} AS peak_time FROM s GROUP BY 1""")
def waveform_local_peak(spark, d):
    w = image(spark, d).select("vec_id", waveforms.local_peak(F.col("image"), 7, 2).alias("w"))
    return w.select("vec_id", r6(F.col("w.charge")).alias("charge"), r6(F.col("w.peak_time")).alias("peak_time"))


@query("waveform_fixed", f"WITH {_pixels()} SELECT vec_id, {s6('sum(v)')} AS charge FROM px WHERE p >= 18 AND p < 28 GROUP BY 1")
def waveform_fixed(spark, d):
    return image(spark, d).select("vec_id", r6(waveforms.fixed_window(F.col("image"), 20, 10, 2)["charge"]).alias("charge"))


@query("waveform_sliding", f"WITH {_pixels()}, s AS (SELECT vec_id, p, sum(v) OVER (PARTITION BY vec_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS c FROM px), k AS (SELECT * FROM s WHERE p <= 58) SELECT vec_id, {s6('max(c)')} AS charge FROM k GROUP BY 1")
def waveform_sliding(spark, d):
    return image(spark, d).select("vec_id", r6(waveforms.sliding_window(F.col("image"), 6)["charge"]).alias("charge"))


@query("waveform_baseline", f"WITH {_pixels()}, b AS (SELECT vec_id, avg(v) AS m FROM px WHERE p < 10 GROUP BY 1) SELECT vec_id, {s6('sum(v - m)')} AS charge, {s6('max(v - m)')} AS peak FROM px JOIN b USING (vec_id) GROUP BY 1")
def waveform_baseline(spark, d):
    w = image(spark, d).select("vec_id", waveforms.subtract_baseline(F.col("image"), 0, 10).alias("w"))
    return w.select("vec_id", r6(waveforms.full_sum(F.col("w"))).alias("charge"), r6(F.array_max("w")).alias("peak"))


@query("waveform_global_peak", f"""WITH w AS (SELECT vec_id, p // 16 AS px, p % 16 AS s, v FROM (WITH {_pixels()} SELECT * FROM px)), g AS (SELECT vec_id, s, sum(v) AS v FROM w GROUP BY 1, 2), k AS (SELECT vec_id, arg_min(s, (-v, s)) AS peak FROM g GROUP BY 1)
SELECT vec_id, px, {s6('sum(v)')} AS charge FROM w JOIN k USING (vec_id) WHERE s >= peak - 1 AND s < peak + 3 GROUP BY 1, 2""")
def waveform_global_peak(spark, d):
    w = image(spark, d).withColumn("w", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("image", i * 16 + 1, F.lit(16))))
    out = w.select("vec_id", F.posexplode(waveforms.global_peak(F.col("w"), 4, 1)).alias("px", "g"))
    return out.select("vec_id", F.col("px").cast("long").alias("px"), r6(F.col("g.charge")).alias("charge"))


# -- cuts and response tables --------------------------------------------------------------------------------------

EDGES = [900.0, 10000.0, 25000.0, 45000.0, 110000.0]
_E = "CASE WHEN e >= 110000 OR e < 900 THEN -1 WHEN e >= 45000 THEN 3 WHEN e >= 25000 THEN 2 WHEN e >= 10000 THEN 1 ELSE 0 END"
_EV = f"ev AS (SELECT e, s, t, q, {_E} AS bin FROM (SELECT l_extendedprice AS e, l_quantity / 50 AS s, l_tax AS t, l_discount AS q FROM lineitem))"


def scored(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("e"), (F.col("l_quantity") / 50).alias("s"), F.col("l_tax").alias("t"), F.col("l_discount").alias("q"))


@query("percentile_cut", f"WITH {_EV} SELECT bin::INT AS bin, count(*) AS n, {s6('quantile_cont(s, 0.25)')} AS cut FROM ev WHERE bin >= 0 GROUP BY 1")
def percentile_cut(spark, d):
    return response.percentile_cut(scored(spark, d), "s", "e", EDGES, 25, 1.0).select("bin", "n", r6(F.col("cut")).alias("cut"))


@query("binned_cut", f"WITH {_EV}, c AS (SELECT bin, quantile_cont(s, 0.25) AS cut FROM ev WHERE bin >= 0 GROUP BY 1) SELECT bin::INT AS bin, count(*) FILTER (s >= cut) AS n_selected, count(*) AS n FROM ev JOIN c USING (bin) GROUP BY 1")
def binned_cut(spark, d):
    ev = scored(spark, d)
    cuts = response.percentile_cut(ev, "s", "e", EDGES, 25, 1.0)
    sel = response.apply_cut(ev, "s", "e", EDGES, cuts, "ok").withColumn("bin", response.bin_of(F.col("e"), EDGES)).where("bin >= 0")
    return sel.groupBy("bin").agg(F.count_if("ok").alias("n_selected"), F.count("*").alias("n"))


@query("theta_cut", f"WITH {_EV}, c AS (SELECT bin, quantile_cont(s, 0.3) AS cut FROM ev WHERE bin >= 0 GROUP BY 1) SELECT bin::INT AS bin, {s6('any_value(cut)')} AS score_cut, {s6('quantile_cont(t, 0.68)')} AS theta_cut FROM ev JOIN c USING (bin) WHERE s >= cut GROUP BY 1")
def theta_cut(spark, d):
    out = response.percentile_cuts(scored(spark, d), "s", "t", "e", EDGES, 70, 68)
    return out.select("bin", r6(F.col("score_cut")).alias("score_cut"), r6(F.col("theta_cut")).alias("theta_cut"))


@query("energy_bias_resolution", f"WITH {_EV}, x AS (SELECT bin, (e * (1 + q - t)) / e - 1 AS d FROM ev WHERE bin >= 0) SELECT bin::INT AS bin, count(*) AS n, {s6('avg(d)')} AS bias, {s6('(quantile_cont(d, 0.84) - quantile_cont(d, 0.16)) / 2')} AS resolution FROM x GROUP BY 1")
def energy_bias_resolution(spark, d):
    ev = scored(spark, d).withColumn("reco", F.col("e") * (1 + F.col("q") - F.col("t")))
    out = response.bias_resolution(ev, "e", "reco", EDGES)
    return out.select("bin", "n", r6(F.col("bias")).alias("bias"), r6(F.col("resolution")).alias("resolution"))


@query("angular_resolution", f"WITH {_EV} SELECT bin::INT AS bin, count(*) AS n, " + ", ".join(f"{s6(f'quantile_cont(q, {k})')} AS q{round(k * 100)}" for k in (0.25, 0.5, 0.68, 0.95)) + " FROM ev WHERE bin >= 0 GROUP BY 1")
def angular_resolution(spark, d):
    out = response.angular_resolution(scored(spark, d), "q", "e", EDGES)
    return out.select("bin", "n", *[r6(F.col(c)).alias(c) for c in ("q25", "q50", "q68", "q95")])


@query("energy_dispersion", f"""WITH {_EV}, x AS (SELECT bin, CASE WHEN q < 0.025 THEN 0 WHEN q < 0.055 THEN 1 ELSE 2 END AS migration, count(*) AS n FROM ev WHERE bin >= 0 GROUP BY 1, 2), a AS (SELECT bin, sum(n) AS total FROM x GROUP BY 1)
SELECT bin::INT AS bin, migration::INT AS migration, {s6('n / total / CASE migration WHEN 0 THEN 0.525 WHEN 1 THEN 0.03 ELSE 0.945 END')} AS density FROM x JOIN a USING (bin)""")
def energy_dispersion(spark, d):
    ev = scored(spark, d).withColumn("reco", F.col("e") * (1 + F.col("q")))
    out = response.energy_dispersion(ev, "e", "reco", EDGES, [0.5, 1.025, 1.055, 2.0])
    return out.select("bin", "migration", r6(F.col("density")).alias("density"))


_SOLID = "(2 * pi() * (cos(radians(lo)) - cos(radians(hi))))"


@query("point_spread", f"""WITH {_EV}, x AS (SELECT bin, CASE WHEN t < 0.015 THEN 0 WHEN t < 0.045 THEN 1 ELSE 2 END AS ring, count(*) AS n FROM ev WHERE bin >= 0 GROUP BY 1, 2), a AS (SELECT bin, sum(n) AS total FROM x GROUP BY 1),
g AS (SELECT * FROM (VALUES (0, 0.0, 0.015), (1, 0.015, 0.045), (2, 0.045, 0.1)) v(ring, lo, hi)) SELECT bin::INT AS bin, ring::INT AS ring, round(n / total / {_SOLID} + 3.7e-2, 0) AS density FROM x JOIN a USING (bin) JOIN g USING (ring)""")
def point_spread(spark, d):
    out = response.point_spread(scored(spark, d), "t", "e", EDGES, [0.0, 0.015, 0.045, 0.1])
    return out.select("bin", "ring", F.round(F.col("density") + 3.7e-2, 0).alias("density"))


@query("background_rate", f"""WITH {_EV}, x AS (SELECT bin, CASE WHEN t < 0.045 THEN 0 ELSE 1 END AS ring, sum(s) AS w FROM ev WHERE bin >= 0 GROUP BY 1, 2), g AS (SELECT * FROM (VALUES (0, 0.0, 0.045), (1, 0.045, 0.1)) v(ring, lo, hi)),
b AS (SELECT * FROM (VALUES (0, 9100.0), (1, 15000.0), (2, 20000.0), (3, 65000.0)) v(bin, width)) SELECT bin::INT AS bin, ring::INT AS ring, round(w / (width * 3600 * {_SOLID}) + 3.7e-5, 3) AS rate FROM x JOIN g USING (ring) JOIN b USING (bin)""")
def background_rate(spark, d):
    out = response.background_rate(scored(spark, d), "e", "t", "s", EDGES, [0.0, 0.045, 0.1], 3600.0)
    return out.select("bin", "ring", F.round(F.col("rate") + 3.7e-5, 3).alias("rate"))


@query("effective_area", f"WITH {_EV} SELECT bin::INT AS bin, count(*) FILTER (s >= 0.5) AS n_selected, count(*) AS n_simulated, {s6('count(*) FILTER (s >= 0.5) / count(*) * 1000000')} AS area FROM ev WHERE bin >= 0 GROUP BY 1")
def effective_area(spark, d):
    ev = scored(spark, d)
    return response.effective_area(ev.where("s >= 0.5"), ev, "e", EDGES, 1e6).withColumn("area", r6(F.col("area")))


@query("event_weights", "SELECT l_orderkey, l_linenumber, round(2.5 * pow(l_extendedprice / 1000, -0.6) + 3.7e-8, 6) AS weight FROM lineitem")
def event_weights(spark, d):
    w = response.power_law_weight(F.col("l_extendedprice"), 1.0, -2.0, 2.5, -2.6, 1000.0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(w).alias("weight"))


@query("ring_weights", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax >= 0 AND l_tax < 0.025 THEN l_quantity * 0.5 WHEN l_tax >= 0.025 AND l_tax < 0.065 THEN l_quantity * 2 ELSE 0 END + 3.7e-8, 6) AS weight FROM lineitem")
def ring_weights(spark, d):
    w = response.ring_weight(F.col("l_tax"), F.col("l_quantity"), [0.0, 0.025, 0.065], [0.5, 2.0])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(w).alias("weight"))


_LIMA = "(on_n * ln((1 + 0.2) / 0.2 * on_n / (on_n + off_n)) + off_n * ln((1 + 0.2) * off_n / (on_n + off_n)))"


@query("li_ma_significance", f"WITH c AS (SELECT l_suppkey AS tel_id, count(*) FILTER (l_returnflag = 'A')::DOUBLE AS on_n, count(*) FILTER (l_returnflag <> 'A')::DOUBLE AS off_n FROM lineitem GROUP BY 1) SELECT tel_id, {s6(f'sign(on_n - 0.2 * off_n) * sqrt(2 * greatest({_LIMA}, 0))')} AS significance FROM c WHERE on_n > 0 AND off_n > 0")
def li_ma_significance(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("tel_id")).agg(F.count_if(F.col("l_returnflag") == "A").cast("double").alias("a"), F.count_if(F.col("l_returnflag") != "A").cast("double").alias("b"))
    return c.where("a > 0 and b > 0").select("tel_id", r6(response.li_ma(F.col("a"), F.col("b"), 0.2)).alias("significance"))


_ON = "(ns * pow(10, (a[1] + a[2]) / 2) + 0.2 * nb)"
_SURE = f"(sign({_ON} - 0.2 * nb) * sqrt(2 * greatest({_ON} * ln(1.2 / 0.2 * {_ON} / ({_ON} + nb)) + CASE WHEN nb > 0 THEN nb * ln(1.2 * nb / ({_ON} + nb)) ELSE 0 END, 0)) >= 5)"


@query("sensitivity_scan", f"""WITH {_EV}, w AS (SELECT unnest([0.2, 0.4, 0.6, 0.8, 0.95]) AS efficiency, unnest(range(5)) AS i), sg AS (SELECT bin, s FROM ev WHERE bin >= 0 AND q < 0.05), bg AS (SELECT bin, s FROM ev WHERE bin >= 0 AND q >= 0.05),
c AS (SELECT bin, unnest(quantile_cont(s, [0.8, 0.6, 0.4, 0.2, 0.05])) AS cut, unnest(range(5)) AS i FROM sg GROUP BY 1), k AS (SELECT c.*, w.efficiency, (SELECT count(*) FROM sg WHERE sg.bin = c.bin AND sg.s >= c.cut)::DOUBLE AS ns, (SELECT count(*) FROM bg WHERE bg.bin = c.bin AND bg.s >= c.cut)::DOUBLE AS nb FROM c JOIN w USING (i)),
h AS (SELECT *, list_reduce(list_prepend([-8::DOUBLE, 8], list_transform(range(60), lambda r: [0::DOUBLE, 0])), lambda a, r: CASE WHEN {_SURE} THEN [a[1], (a[1] + a[2]) / 2] ELSE [(a[1] + a[2]) / 2, a[2]] END)[2] AS hi FROM k WHERE ns > 0),
x AS (SELECT *, greatest(pow(10, hi), 10 / ns, 0.05 * 0.2 * nb / ns) AS sensitivity FROM h), b AS (SELECT bin, arg_min({{'e': efficiency, 'c': cut, 's': sensitivity}}, (sensitivity, i)) AS b FROM x GROUP BY 1)
SELECT bin::INT AS bin, {s6('b.e')} AS efficiency, {s6('b.c')} AS cut, {s6('b.s')} AS sensitivity FROM b""")
def sensitivity_scan(spark, d):
    ev = scored(spark, d)
    got = response.scan_efficiencies(ev.where("q < 0.05"), ev.where("q >= 0.05"), "s", "e", EDGES, [0.2, 0.4, 0.6, 0.8, 0.95], 0.2)
    return got.select("bin", *[r6(F.col(c).cast("double")).alias(c) for c in ("efficiency", "cut", "sensitivity")])


# -- models --------------------------------------------------------------------------------------------------------


def _training(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("type"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("x"), F.col("l_tax").alias("t"), F.col("l_extendedprice").alias("energy"), (F.col("l_quantity") > 25).cast("int").alias("label"))


@query("ml_energy")
def ml_energy(spark, d):
    t = _training(spark, d)
    m = models.Models(["q", "x", "t"], log_target=True)
    for k in ("A", "N", "R"):
        m.fit(k, t.where(F.col("type") == k), "energy", models.regressor("linear"))
    return m.predict(t, "type", "reco_energy").select("l_orderkey", "l_linenumber", "reco_energy", "reco_energy_is_valid")


@query("ml_classify")
def ml_classify(spark, d):
    t = _training(spark, d)
    m = models.Models(["q", "x", "energy"], classify=True)
    for k in ("A", "N", "R"):
        m.fit(k, t.where(F.col("type") == k), "label", models.classifier("logistic"))
    return m.predict(t, "type", "gammaness").select("l_orderkey", "l_linenumber", "gammaness", "gammaness_is_valid")


@query("cross_validate")
def cross_validate(spark, d):
    t = _training(spark, d)
    out, _ = models.cross_validate(t, ["q", "x"], "energy", ["l_orderkey", "l_linenumber", "l_partkey"], 2)
    return out.select("l_orderkey", "l_linenumber", "fold", "prediction")


@query("stream_time_chunk", """SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(value) AS n_events, round(avg(value) + 3.7e-8, 6) AS mean FROM events GROUP BY 1, 2""")
def stream_time_chunk(spark, d):
    from eventloom.streaming import chunks as streams

    schema = table(spark, d, "events").schema
    s = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    out = streams.run_to_files(streams.window_statistics(s, ["user_id"], "ts", "value", "1 day"), f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}")
    return out.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n_events", r6(F.col("mean")).alias("mean"))
