"""Queries of monitoring values, cuts, hexagonal cameras and places on the earth."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from eventloom.functions import coords, geodesy
from eventloom.operators import hexgrid, optimise
from eventloom.operators.monitoring import Series, pointing, values_at
from eventloom.plans.catalogue import query
from eventloom.plans.event_queries import r6, s6
from eventloom.plans.series_queries import image, series
from eventloom.runtime import table

# -- monitoring: clicks are events; purchases, views and errors are series of their user -----------------------------------------

_NEAR = 43_200.0
_AROUND = "q.event_id, q.t, s.t AS u, s.v FROM q ASOF LEFT JOIN (SELECT * FROM s WHERE event_type = '{0}') s ON q.user_id = s.user_id AND q.t {1} s.t"
_LOOKUPS = f"""s AS (SELECT user_id, event_type, epoch_us(ts) / 1e6 AS t, max(value) AS v FROM events GROUP BY 1, 2, 3), q AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'click'),
p AS (SELECT {_AROUND.format("purchase", ">=")}), vb AS (SELECT {_AROUND.format("view", ">=")}), va AS (SELECT {_AROUND.format("view", "<")}), eb AS (SELECT {_AROUND.format("error", ">=")}), ea AS (SELECT {_AROUND.format("error", "<")}),
j AS (SELECT q.event_id, q.user_id, q.t, p.v AS pv, vb.u AS b, vb.v AS bv, va.u AS a, va.v AS av, eb.u AS c, eb.v AS cv, ea.u AS d, ea.v AS dv FROM q JOIN p USING (event_id) JOIN vb USING (event_id) JOIN va USING (event_id) JOIN eb USING (event_id) JOIN ea USING (event_id))"""
_LINE = "CASE WHEN b = t THEN bv WHEN b IS NOT NULL AND a IS NOT NULL THEN bv + (t - b) / (a - b) * (av - bv) END"
_TURN = "((dv - cv + 50) - 100 * floor((dv - cv + 50) / 100) - 50)"
_RAW = f"CASE WHEN c = t THEN cv WHEN c IS NOT NULL AND d IS NOT NULL THEN cv + (t - c) / (d - c) * {_TURN} END"
_ANGLE = f"({_RAW}) - 100 * floor(({_RAW}) / 100)"
_CLOSE = f"CASE WHEN c IS NOT NULL AND (d IS NULL OR t - c <= d - t) THEN CASE WHEN t - c <= {_NEAR} THEN cv END WHEN d - t <= {_NEAR} THEN dv END"


def _series(spark, d):
    e = series(spark, d)
    own = lambda kind, **how: Series(e.where(F.col("event_type") == kind), "value", "ts", **how)
    return e.where("event_type = 'click'").select("event_id", "user_id", "ts"), own


@query("monitoring_values", f"WITH {_LOOKUPS} SELECT event_id, {s6('pv')} AS last_purchase, {s6(_LINE)} AS views, {s6(_CLOSE)} AS near_error, {s6(_ANGLE)} AS angle FROM j")
def monitoring_values(spark, d):
    """For each click the last purchase, views in a line, an error within half a day, and errors as angles of a circle of 100."""
    clicks, own = _series(spark, d)
    looked = {"last_purchase": own("purchase", mode="previous"), "views": own("view"), "near_error": own("error", mode="nearest", tolerance=_NEAR), "angle": own("error", mode="angle", period=100.0)}
    got = values_at(clicks, ["user_id"], "ts", looked, bucket=7 * 86_400.0)
    return got.select("event_id", *[r6(F.col(c)).alias(c) for c in looked])


@query("event_pointing", f"""WITH {_LOOKUPS}, k AS (SELECT c_custkey AS user_id, min((c_acctbal, c_nationkey::DOUBLE)) AS k FROM customer WHERE c_nationkey < 20 GROUP BY 1),
f AS (SELECT event_id, {_LINE} AS alt, {_ANGLE} AS az, k.k FROM j LEFT JOIN k USING (user_id))
SELECT event_id, CASE WHEN alt IS NOT NULL AND az IS NOT NULL THEN 'monitoring' WHEN k IS NOT NULL THEN 'constant' END AS pointing_source,
{s6('CASE WHEN alt IS NOT NULL AND az IS NOT NULL THEN alt ELSE k[1] END')} AS altitude, {s6('CASE WHEN alt IS NOT NULL AND az IS NOT NULL THEN az ELSE k[2] END')} AS azimuth FROM f""")
def event_pointing(spark, d):
    """Views as altitudes and errors as azimuths; where one is missing, the customer of the user's number."""
    clicks, own = _series(spark, d)
    fixed = table(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("altitude"), F.col("c_nationkey").cast("double").alias("azimuth"))
    got = pointing(clicks, ["user_id"], "ts", own("view"), own("error", mode="angle", period=100.0), fixed, ["user_id"], bucket=7 * 86_400.0)
    return got.select("event_id", "pointing_source", r6(F.col("altitude")).alias("altitude"), r6(F.col("azimuth")).alias("azimuth"))


# -- cuts ------------------------------------------------------------------------------------------------------------------------


@query("cut_optimisation")
def cut_optimisation(spark, d):
    """Lines with little discount are signal, the others background; line numbers are multiplicities, taxes angles, quantities scores."""
    rows = table(spark, d, "lineitem").select("l_discount", (F.col("l_extendedprice") / 1e4).alias("energy"), F.col("l_linenumber").alias("mult"), (F.col("l_tax") * 5).alias("theta"), (F.col("l_quantity") / 50).alias("score"), F.lit(1.0).alias("w"), (F.col("l_discount") * 10).alias("off"))
    grid = [0.02 * i for i in range(51)]
    return optimise.optimise(rows.where("l_discount < 0.05"), rows.where("l_discount >= 0.05"), "energy", "mult", "theta", "score", "w", "off", [0.0, 1.0, 2.0, 4.0, 8.0, 16.0], [1, 2, 3, 4], grid[1:], grid[:-1], [0.2, 0.4, 0.6, 0.8], [0.1 * i for i in range(1, 10)])


# -- hexagonal cameras -----------------------------------------------------------------------------------------------------------

_HEX = hexgrid.HexGrid.from_places(*hexgrid.spiral(4))
_SMALL, _WIDE = hexgrid.spiral(2), hexgrid.spiral(6)
_ROWS = lambda rows: ", ".join(f"({', '.join(map(str, r))})" for r in rows)


@query("hex_rectangle", f"""WITH c(p, r, k) AS (VALUES {_ROWS(zip(range(61), _HEX.q, _HEX.r, strict=True))})
SELECT vec_id, r AS row, k AS col, {s6('embedding[p + 1]::DOUBLE')} AS value, true AS back FROM embeddings, c""")
def hex_rectangle(spark, d):
    """The first 61 components as a hexagonal camera, its rectangle cell by cell, and whether the way back gives the image."""
    i = image(spark, d).select("vec_id", F.slice("image", 1, 61).alias("i"))
    i = i.withColumn("rect", _HEX.to_rectangle(F.col("i")))
    i = i.select("vec_id", (_HEX.from_rectangle(F.col("rect")) == F.col("i")).alias("back"), F.posexplode("rect").alias("row", "cells"))
    return i.select("vec_id", "back", "row", F.posexplode("cells").alias("col", "value")).where("value is not null").withColumn("value", r6(F.col("value")))


@query("hex_pixel_at", f"""WITH c(x, y, p) AS (VALUES {_ROWS((x, y, next((i for i, (a, b) in enumerate(zip(*_SMALL, strict=True)) if math.hypot(x - a, y - b) < 0.1), 'NULL')) for x, y in zip(*_WIDE, strict=True))}),
l AS (SELECT DISTINCT l_quantity, l_discount, l_quantity / 12 - 2.0137 AS x, l_discount * 40 - 2.0071 AS y FROM lineitem),
n AS (SELECT l_quantity, l_discount, arg_min({{'p': p}}, (l.x - c.x) ** 2 + (l.y - c.y) ** 2).p AS p FROM l, c GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, p::INT AS pixel FROM lineitem JOIN n USING (l_quantity, l_discount)""")
def hex_pixel_at(spark, d):
    """The pixel of a small hexagonal camera at a place made of quantity and discount."""
    g = hexgrid.HexGrid.from_places(*_SMALL)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", g.pixel_at(F.col("l_quantity") / 12 - 2.0137, F.col("l_discount") * 40 - 2.0071).alias("pixel"))


# -- places on the earth ---------------------------------------------------------------------------------------------------------

_LAT, _LON, _HEIGHT = math.radians(28.7622), math.radians(-17.8925), 2147.0
_N = f"({geodesy.AXIS} / sqrt(1 - {geodesy._E2!r} * sin({{0}}) ** 2))"


@query("earth_places", f"""WITH g AS (SELECT s_suppkey, s_acctbal * 3 AS x, s_suppkey * 10.0 AS y, s_nationkey * 1.0 AS z FROM supplier),
o AS (SELECT *, z * cos({_LAT}) - x * sin({_LAT}) AS o FROM g), e AS (SELECT s_suppkey, ({_N.format(_LAT)} + {_HEIGHT}) * cos({_LAT}) * cos({_LON}) + o * cos({_LON}) + y * sin({_LON}) AS ex,
({_N.format(_LAT)} + {_HEIGHT}) * cos({_LAT}) * sin({_LON}) + o * sin({_LON}) - y * cos({_LON}) AS ey, ({_N.format(_LAT)} * (1 - {geodesy._E2!r}) + {_HEIGHT}) * sin({_LAT}) + x * cos({_LAT}) + z * sin({_LAT}) AS ez FROM o),
t AS (SELECT *, sqrt(ex * ex + ey * ey) AS p, list_reduce(list_prepend(atan2(ez, sqrt(ex * ex + ey * ey)), range(30)::DOUBLE[]), lambda a, k: atan2(ez + {geodesy._E2!r} * {_N.format('a')} * sin(a), sqrt(ex * ex + ey * ey))) AS lat FROM e)
SELECT s_suppkey, {s6('degrees(lat)')} AS lat, {s6('degrees(atan2(ey, ex))')} AS lon, {s6('p / cos(lat) - ' + _N.format('lat'))} AS height FROM t""")
def earth_places(spark, d):
    """Suppliers about a reference location, as geodetic coordinates."""
    c = [F.lit(v) for v in (_LAT, _LON, _HEIGHT)]
    s = table(spark, d, "supplier").select("s_suppkey", F.array(*geodesy.ground_to_earth(F.col("s_acctbal") * 3, F.col("s_suppkey") * 10.0, F.col("s_nationkey") * 1.0, *c)).alias("e"))
    lat, lon, height = geodesy.geodetic(*[F.col("e")[i] for i in range(3)])
    return s.select("s_suppkey", r6(F.degrees(lat)).alias("lat"), r6(F.degrees(lon)).alias("lon"), r6(height).alias("height"))


@query("impact_by_telescope", f"""WITH t AS (SELECT s_suppkey, s_nationkey * 20.0 - 240 AS x, s_suppkey % 40 * 12.0 - 240 AS y, s_suppkey % 7 * 3.0 AS z FROM supplier), o AS (SELECT o_orderkey, o_orderkey % 100 - 50.0 AS cx, o_totalprice % 100 - 50 AS cy, 0.9 + o_orderkey % 60 / 100.0 AS alt, o_orderkey % 628 / 100.0 AS az FROM orders),
d AS (SELECT l_orderkey, l_linenumber, x - cx AS px, y - cy AS py, z AS pz, cos(alt) * cos(az) AS dx, -cos(alt) * sin(az) AS dy, sin(alt) AS dz FROM lineitem JOIN t ON s_suppkey = l_suppkey JOIN o ON o_orderkey = l_orderkey)
SELECT l_orderkey, l_linenumber, {s6('sqrt((py * dz - pz * dy) ** 2 + (pz * dx - px * dz) ** 2 + (px * dy - py * dx) ** 2)')} AS impact FROM d""")
def impact_by_telescope(spark, d):
    """Distance of every telescope (supplier) of an event (order) from its axis, in the plane across it."""
    n = F.col
    t = table(spark, d, "supplier").select(n("s_suppkey").alias("l_suppkey"), (n("s_nationkey") * 20.0 - 240).alias("x"), (n("s_suppkey") % 40 * 12.0 - 240).alias("y"), (n("s_suppkey") % 7 * 3.0).alias("z"))
    o = table(spark, d, "orders").select(n("o_orderkey").alias("l_orderkey"), (n("o_orderkey") % 100 - 50.0).alias("cx"), (n("o_totalprice") % 100 - 50).alias("cy"), (0.9 + n("o_orderkey") % 60 / 100.0).alias("alt"), (n("o_orderkey") % 628 / 100.0).alias("az"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(o, "l_orderkey").join(t, "l_suppkey")
    return rows.select("l_orderkey", "l_linenumber", r6(coords.impact_in_tilted(n("cx"), n("cy"), n("alt"), n("az"), n("x"), n("y"), n("z"))).alias("impact"))
