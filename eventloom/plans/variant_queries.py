"""Queries of further cleanings, extractors and frames, over vectors as images or waveforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import coords, waveforms
from eventloom.functions.common import nested
from eventloom.operators import images
from eventloom.plans.catalogue import query
from eventloom.plans.event_queries import r6, s6
from eventloom.plans.series_queries import _CLEAN, _EDGES, CAMERA, _mask_sql, _pixels, bits, cleaned, image
from eventloom.runtime import table



def _step(name: str, of: str, near: str, keep: str) -> str:
    """A CTE (vec_id, p, v, keep) from the one before: k counts the neighbours for which `near` holds."""
    return f"{name}n AS (SELECT a.vec_id, a.p, count(*) FILTER ({near}) AS k FROM {of} a JOIN e ON e.p = a.p JOIN {of} b ON b.vec_id = a.vec_id AND b.p = e.q GROUP BY 1, 2), {name} AS (SELECT {of}.vec_id, {of}.p, v, {keep} AS keep FROM {of} JOIN {name}n USING (vec_id, p))"


_TIMED = "b.keep AND abs(b.v - a.v) < 0.12"


@query("image_core_cleaning", f"""WITH {_pixels()}, {_EDGES}, f0 AS (SELECT *, v >= 0.15 AS keep FROM px), {_step("f1", "f0", "b.keep", "keep AND k >= 1")}, {_step("f2", "f1", "b.keep", "keep OR (k > 0 AND v >= 0.08)")},
{_step("f3", "f2", _TIMED, "keep AND k >= 1")}, {_step("f4", "f3", "b.keep", "keep AND k >= 1")}, {_step("f5", "f4", _TIMED, "keep AND k >= 1")} SELECT vec_id, {_mask_sql('keep')} AS mask FROM f5 GROUP BY 1""")
def image_core_cleaning(spark, d):
    """Core pixels, their ring, and twice the pixels whose neighbours are close in time (here the value itself)."""
    return image(spark, d).select("vec_id", bits(images.fact_cleaning(F.col("image"), F.col("image"), CAMERA, 0.15, 0.08, 1, 0.12)).alias("mask"))


@query("image_largest_island", f"""WITH RECURSIVE {_CLEAN}, w(vec_id, p, root) AS (SELECT vec_id, p, p FROM m WHERE keep UNION SELECT w.vec_id, e.q, w.root FROM w JOIN e ON w.p = e.p JOIN m ON m.vec_id = w.vec_id AND m.p = e.q AND m.keep),
l AS (SELECT vec_id, p, min(root) AS root FROM w GROUP BY 1, 2), s AS (SELECT vec_id, arg_min(root, (-n, root)) AS root FROM (SELECT vec_id, root, count(*) AS n FROM l GROUP BY 1, 2) GROUP BY 1)
SELECT m.vec_id, string_agg(CASE WHEN l.root IS NOT NULL AND l.root = s.root THEN '1' ELSE '0' END, '' ORDER BY m.p) AS mask, count(*) FILTER (keep)::INT AS n_pixels FROM m LEFT JOIN l USING (vec_id, p) LEFT JOIN s ON s.vec_id = m.vec_id GROUP BY 1""")
def image_largest_island(spark, d):
    """The first of the islands with most pixels."""
    c = cleaned(spark, d).withColumn("labels", images.islands(F.col("mask"), CAMERA))
    return c.select("vec_id", bits(images.largest_island(F.col("labels"))).alias("mask"), F.size(F.filter("mask", lambda x: x)).alias("n_pixels"))


def _rows_of_eight(spark, d):
    return image(spark, d).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("image", i * 8 + 1, 8)).alias("w"))


@query("waveform_gain_selected", f"WITH {_pixels()}, g AS (SELECT vec_id, p // 8 AS pixel, v, max(v) OVER (PARTITION BY vec_id, p // 8) > 0.25 AS bright FROM px) SELECT vec_id, pixel, {s6('sum(CASE WHEN bright THEN v / 10 ELSE v END)')} AS charge FROM g GROUP BY 1, 2")
def waveform_gain_selected(spark, d):
    """The low gain, a tenth of the high one, where a sample of the high one is above a threshold."""
    w = _rows_of_eight(spark, d).select("vec_id", waveforms.select_gain(F.col("w"), F.transform("w", lambda p: F.transform(p, lambda x: x / 10)), 0.25).alias("w"))
    return w.select("vec_id", F.posexplode(F.transform("w", waveforms.full_sum)).alias("pixel", "charge")).withColumn("charge", r6(F.col("charge")))


@query("waveform_neighbor_peak", f"""WITH {_pixels()}, w AS (SELECT vec_id, p // 8 AS pixel, p % 8 AS s, v FROM px), n AS (SELECT a.vec_id, a.pixel, b.s, sum(b.v) AS v FROM (SELECT DISTINCT vec_id, pixel FROM w) a JOIN w b ON b.vec_id = a.vec_id AND abs(b.pixel - a.pixel) = 1 GROUP BY 1, 2, 3),
k AS (SELECT vec_id, pixel, arg_min(s, (-v, s)) AS peak FROM n GROUP BY 1, 2) SELECT vec_id, pixel, {s6('sum(v) FILTER (s >= peak - 1 AND s < peak + 2)')} AS charge FROM w JOIN k USING (vec_id, pixel) GROUP BY 1, 2""")
def waveform_neighbor_peak(spark, d):
    """Three samples about the peak of the neighbours' sum, pixels in a row."""
    row = nested([[j for j in (i - 1, i + 1) if 0 <= j < 8] for i in range(8)])
    e = waveforms.neighbor_peak(F.col("w"), row, 3, 1)
    # exploded where it is computed: of a column that is exploded Spark tests the size first, in a filter below that computes it all again
    return _rows_of_eight(spark, d).select("vec_id", F.posexplode(e).alias("pixel", "e")).select("vec_id", "pixel", r6(F.col("e.charge")).alias("charge"))


@query("camera_places", f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS x, l_discount * 5 AS y FROM lineitem), s AS (SELECT *, (x * sin(0.3) + y * cos(0.3)) / 28 AS lon, (x * cos(0.3) - y * sin(0.3)) / 28 AS lat FROM t)
SELECT l_orderkey, l_linenumber, {s6('lon')} AS lon, {s6('lat')} AS lat, {s6('x')} AS x, {s6('y')} AS y FROM s""")
def camera_places(spark, d):
    """Places in a turned camera as directions, and back."""
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("x"), (F.col("l_discount") * 5).alias("y"))
    lon, lat = coords.camera_to_telescope(F.col("x"), F.col("y"), F.lit(28.0), 0.3)
    t = t.select("l_orderkey", "l_linenumber", lon.alias("lon"), lat.alias("lat"))
    x, y = coords.telescope_to_camera(F.col("lon"), F.col("lat"), F.lit(28.0), 0.3)
    return t.select("l_orderkey", "l_linenumber", r6(F.col("lon")).alias("lon"), r6(F.col("lat")).alias("lat"), r6(x).alias("x"), r6(y).alias("y"))


@query("tilted_places", f"""WITH t AS (SELECT s_suppkey, s_nationkey * 10.0 AS x, s_suppkey % 50 * 5.0 AS y, s_suppkey % 9 * 2.0 AS z, 1.1 + s_suppkey % 30 / 100.0 AS alt, s_suppkey % 628 / 100.0 AS az FROM supplier),
u AS (SELECT *, sin(alt) * cos(az) * x - sin(alt) * sin(az) * y - cos(alt) * z AS a, sin(az) * x + cos(az) * y AS b FROM t)
SELECT s_suppkey, {s6('a')} AS tilted_x, {s6('b')} AS tilted_y, {s6('x - z * cos(alt) * cos(az) / sin(alt)')} AS ground_x, {s6('y + z * cos(alt) * sin(az) / sin(alt)')} AS ground_y FROM u""")
def tilted_places(spark, d):
    """Places in the plane across a direction, taken back and projected to the ground along it: where the line through the place meets it."""
    n = F.col
    t = table(spark, d, "supplier").select("s_suppkey", (n("s_nationkey") * 10.0).alias("x"), (n("s_suppkey") % 50 * 5.0).alias("y"), (n("s_suppkey") % 9 * 2.0).alias("z"), (1.1 + n("s_suppkey") % 30 / 100.0).alias("alt"), (n("s_suppkey") % 628 / 100.0).alias("az"))
    a, b = coords.ground_to_tilted(n("x"), n("y"), n("z"), n("alt"), n("az"))
    t = t.withColumns({"a": a, "b": b})
    gx, gy = coords.project_to_ground(*coords.tilted_to_ground(n("a"), n("b"), n("alt"), n("az")), n("alt"), n("az"))
    return t.select("s_suppkey", r6(n("a")).alias("tilted_x"), r6(n("b")).alias("tilted_y"), r6(gx).alias("ground_x"), r6(gy).alias("ground_y"))
