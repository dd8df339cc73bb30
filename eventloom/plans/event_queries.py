"""Queries of the event engine over the driver's tables: orders are array events, lineitem rows telescope events,
suppliers telescopes, customers observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import arrays, atmosphere, codecs, coords, likelihood, vectors
from eventloom.operators import relational, selection, stereo
from eventloom.plans.catalogue import query
from eventloom.runtime import table

#: Added before rounding, so that sums that differ in the last bit do not round apart at a tie.
_TIE = 3.7e-8


def r6(c: Column) -> Column:
    return F.round(c + _TIE, 6)


def s6(sql: str) -> str:
    return f"round({sql} + {_TIE}, 6)"


def tel_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("tel_id"), F.col("l_quantity").alias("intensity"), F.col("l_extendedprice").alias("energy"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("line"),
    )


_TEL = """tel AS (SELECT l_orderkey AS event_id, l_suppkey AS tel_id, l_quantity AS intensity, l_extendedprice AS energy, l_discount AS discount,
  l_tax AS tax, l_returnflag AS kind, l_linenumber AS line FROM lineitem)"""

QUALITY = selection.QualityQuery((("enough charge", "intensity > 5"), ("low discount", "discount <= 0.08"), ("energetic", "log10(energy) > 3.2")))
_Q = "intensity > 5 AND discount <= 0.08 AND log10(energy) > 3.2"


@query("quality_mask", f"WITH {_TEL} SELECT event_id, tel_id, line, intensity, energy FROM tel WHERE {_Q}")
def quality_mask(spark, d):
    return QUALITY.select(tel_events(spark, d)).select("event_id", "tel_id", "line", "intensity", "energy")


@query("quality_funnel", f"""WITH {_TEL} SELECT 'TOTAL' AS criteria, count(*) AS counts, count(*) AS cumulative_counts FROM tel
UNION ALL SELECT 'enough charge', count(*) FILTER (intensity > 5), count(*) FILTER (intensity > 5) FROM tel
UNION ALL SELECT 'low discount', count(*) FILTER (discount <= 0.08), count(*) FILTER (intensity > 5 AND discount <= 0.08) FROM tel
UNION ALL SELECT 'energetic', count(*) FILTER (log10(energy) > 3.2), count(*) FILTER ({_Q}) FROM tel""")
def quality_funnel(spark, d):
    return QUALITY.funnel(tel_events(spark, d))


@query("quality_vector", f"WITH {_TEL} SELECT [intensity > 5, discount <= 0.08, log10(energy) > 3.2]::VARCHAR AS passed, count(*) AS n FROM tel GROUP BY 1")
def quality_vector(spark, d):
    t = tel_events(spark, d)
    text = F.concat(F.lit("["), F.array_join(F.transform(QUALITY.vector(t), lambda x: x.cast("string")), ", "), F.lit("]"))
    return t.select(text.alias("passed")).groupBy("passed").agg(F.count("*").alias("n"))


@query("funnel_merge", f"""WITH {_TEL} SELECT 'TOTAL' AS criteria, count(*)::BIGINT AS counts, count(*)::BIGINT AS cumulative_counts FROM tel
UNION ALL SELECT 'enough charge', count(*) FILTER (intensity > 5), count(*) FILTER (intensity > 5) FROM tel
UNION ALL SELECT 'low discount', count(*) FILTER (discount <= 0.08), count(*) FILTER (intensity > 5 AND discount <= 0.08) FROM tel
UNION ALL SELECT 'energetic', count(*) FILTER (log10(energy) > 3.2), count(*) FILTER ({_Q}) FROM tel""")
def funnel_merge(spark, d):
    t = tel_events(spark, d)
    return selection.add_statistics(QUALITY.funnel(t.where("kind = 'A'")).unionByName(QUALITY.funnel(t.where("kind <> 'A'"))))


@query("feature_generation", f"WITH {_TEL} SELECT event_id, line, {s6('energy / intensity')} AS unit, {s6('sqrt(energy / intensity) * (1 - discount)')} AS root, energy / intensity > 1500 AND NOT tax > 0.05 AS bright FROM tel")
def feature_generation(spark, d):
    t = selection.generate_features(tel_events(spark, d), [("unit", "energy / intensity"), ("root", "np.sqrt(unit) * (1 - discount)"), ("bright", "(unit > 1500) & ~(tax > 0.05)")])
    return t.select("event_id", "line", r6(F.col("unit")).alias("unit"), r6(F.col("root")).alias("root"), "bright")


selection.register("spectra", selection.EventPreprocessor(
    {"energy": "reco_energy"}, (("theta", "arctan2(discount, 1 + tax)"), ("log_energy", "log10(reco_energy)")),
    selection.QualityQuery((("near", "theta < 0.08"), ("charge", "intensity >= 10"))), ("event_id", "line", "theta", "log_energy"),
))


@query("event_preprocessor", f"WITH {_TEL} SELECT event_id, line, {s6('atan2(discount, 1 + tax)')} AS theta, {s6('log10(energy)')} AS log_energy FROM tel WHERE atan2(discount, 1 + tax) < 0.08 AND intensity >= 10")
def event_preprocessor(spark, d):
    t = selection.FEATURE_SETS["spectra"](tel_events(spark, d))
    return t.withColumns({"theta": r6(F.col("theta")), "log_energy": r6(F.col("log_energy"))})


@query("trigger_multiplicity", f"""WITH {_TEL}, k AS (SELECT *, count(*) OVER (PARTITION BY event_id, kind) AS n FROM tel WHERE kind IN ('A', 'N')),
g AS (SELECT * FROM k WHERE n >= CASE kind WHEN 'A' THEN 2 ELSE 0 END), a AS (SELECT *, count(*) OVER (PARTITION BY event_id) AS m FROM g)
SELECT event_id, tel_id, kind, line, energy FROM a WHERE m >= 2""")
def trigger_multiplicity(spark, d):
    return selection.software_trigger(tel_events(spark, d), ["event_id"], "kind", {"A": 2}, 2, ["A", "N"]).select("event_id", "tel_id", "kind", "line", "energy")


@query("event_type_filter", "SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ('click', 'view')")
def event_type_filter(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("click", "view")).select("event_id", "user_id", "event_type", "value")


@query("read_subarray_events", """SELECT o_orderkey AS event_id, o_custkey AS obs_id, o_totalprice AS energy, c_mktsegment AS segment, c_nationkey AS site, n_name AS site_name
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def read_subarray_events(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("obs_id"), F.col("o_totalprice").alias("energy"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("obs_id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("site"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("site"), F.col("n_name").alias("site_name"))
    out = relational.join_allow_empty(relational.join_allow_empty(o, c, ["obs_id"]), n, ["site"])
    return out.select("event_id", "obs_id", "energy", "segment", "site", "site_name")


@query("read_telescope_events", f"""WITH {_TEL} SELECT tel.event_id, tel_id, line, tel.energy AS energy_mono, o_totalprice AS energy, s_name AS tel_name
FROM tel LEFT JOIN orders ON tel.event_id = o_orderkey LEFT JOIN supplier ON tel_id = s_suppkey""")
def read_telescope_events(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("energy"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("tel_id"), F.col("s_name").alias("tel_name"))
    out = relational.join_with_suffix(tel_events(spark, d).select("event_id", "tel_id", "line", "energy"), o, ["event_id"]).join(s, "tel_id", "left")
    return out.select("event_id", "tel_id", "line", "energy_mono", "energy", "tel_name")


@query("events_by_type", f"""WITH {_TEL} SELECT r_name AS type, count(*) AS n_events, count(DISTINCT tel_id) AS n_tels, {s6('max(energy)')} AS max_energy
FROM tel JOIN supplier ON tel_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def events_by_type(spark, d):
    tels = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    t = tel_events(spark, d).join(tels.select(F.col("s_suppkey").alias("tel_id"), F.col("r_name").alias("type")), "tel_id")
    return t.groupBy("type").agg(F.count("*").alias("n_events"), F.countDistinct("tel_id").alias("n_tels"), r6(F.max("energy")).alias("max_energy"))


@query("join_left_empty_events", f"WITH {_TEL} SELECT o_orderkey AS event_id, count(line) AS multiplicity FROM orders LEFT JOIN tel ON o_orderkey = event_id GROUP BY 1")
def join_left_empty_events(spark, d):
    n = tel_events(spark, d).groupBy("event_id").agg(F.count("line").alias("multiplicity"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"))
    return relational.join_allow_empty(o, n, ["event_id"]).select("event_id", F.coalesce("multiplicity", F.lit(0)).alias("multiplicity"))


@query("semi_triggered", "SELECT o_orderkey AS event_id, o_totalprice AS energy FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30)")
def semi_triggered(spark, d):
    t = tel_events(spark, d).where("intensity > 30")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("energy")).join(t, "event_id", "left_semi")


@query("anti_triggered", "SELECT o_orderkey AS event_id, o_totalprice AS energy FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_triggered(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("energy")).join(tel_events(spark, d), "event_id", "left_anti")


@query("outer_join_keys", """SELECT coalesce(a.k, b.k) AS obs_id, a.n AS n_events, b.n AS n_tels FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a
FULL JOIN (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1) b ON a.k = b.k""")
def outer_join_keys(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("obs_id")).agg(F.count("*").alias("n_events"))
    b = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("obs_id")).agg(F.count("*").alias("n_tels"))
    return relational.join_allow_empty(a, b, ["obs_id"], "full")


@query("merge_union", """SELECT o_orderkey AS event_id, o_totalprice AS energy FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F'""")
def merge_union(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("energy"))
    return relational.merge([o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'")], drop=["o_orderstatus"])


@query("merge_obs_intersect", "SELECT o_custkey AS obs_id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def merge_obs_intersect(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", F.col("o_custkey").alias("obs_id"))
    return o.where("o_orderstatus = 'F'").select("obs_id").intersect(o.where("o_orderstatus = 'O'").select("obs_id"))


@query("merge_obs_except", "SELECT o_custkey AS obs_id FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def merge_obs_except(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", F.col("o_custkey").alias("obs_id"))
    return o.where("o_orderstatus = 'F'").select("obs_id").exceptAll(o.where("o_orderstatus = 'O'").select("obs_id"))


@query("row_slice", "SELECT event_id, row_idx FROM (SELECT o_orderkey AS event_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders) WHERE row_idx >= 100 AND row_idx < 5000 AND (row_idx - 100) % 7 = 0")
def row_slice(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"))
    return relational.row_slice(relational.with_row_index(o, ["event_id"]), 100, 5000, 7).select("event_id", "row_idx")


@query("dedup_first_pointing", "SELECT user_id, event_type, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def dedup_first_pointing(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return relational.first_per_key(e, ["user_id", "event_type"], ["ts", "event_id"])


def _stereo(spark, d, kind):
    w = stereo.weight_of("none") if kind == "none" else F.col("intensity") if kind == "intensity" else F.col("intensity") * (1 + F.col("tax"))
    out = stereo.combine_mean(tel_events(spark, d), ["event_id"], "energy", "tel_id", w)
    return out.select("event_id", r6(F.col("mean")).alias("mean"), F.col("std").alias("std"), "n_valid", "telescopes")


def _stereo_query(kind: str, w: str):
    m = f"sum({w} * energy) / sum({w})"
    sql = f"WITH {_TEL} SELECT event_id, {s6(m)} AS mean, count(*) AS n_valid, array_to_string(list_sort(list(DISTINCT tel_id)), ',') AS telescopes FROM tel GROUP BY event_id"

    @query(f"stereo_mean_{kind}", sql)
    def run(spark, d):
        return _stereo(spark, d, kind).select("event_id", "mean", "n_valid", F.array_join(F.transform("telescopes", lambda x: x.cast("string")), ",").alias("telescopes"))

    return run


_stereo_query("none", "1.0")
_stereo_query("intensity", "intensity")
_stereo_query("aspect", "(intensity * (1 + tax))")


@query("stereo_std", f"""WITH {_TEL}, m AS (SELECT event_id, sum(intensity * energy) / sum(intensity) AS m FROM tel GROUP BY 1)
SELECT event_id, round(sqrt(sum(intensity * (energy - m) * (energy - m)) / sum(intensity)) + 0.00037, 3) AS std FROM tel JOIN m USING (event_id) GROUP BY event_id""")
def stereo_std(spark, d):
    return _stereo(spark, d, "intensity").select("event_id", F.round(F.col("std") + 0.00037, 3).alias("std"))


@query("stereo_log_energy", f"WITH {_TEL} SELECT event_id, {s6('exp(sum(intensity * ln(energy)) / sum(intensity)) / 1000')} AS mean_k, count(*) AS n_valid FROM tel GROUP BY event_id")
def stereo_log_energy(spark, d):
    out = stereo.combine_mean(tel_events(spark, d), ["event_id"], "energy", "tel_id", F.col("intensity"), log=True)
    return out.select("event_id", r6(F.col("mean") / 1000).alias("mean_k"), "n_valid")


_DIR = "WITH t AS (SELECT l_orderkey AS event_id, l_discount * 3 AS az, 1.2 - l_tax AS alt, l_quantity AS w FROM lineitem), s AS (SELECT event_id, sum(w * cos(alt) * cos(az)) / sum(w) AS x, sum(w * cos(alt) * sin(az)) / sum(w) AS y, sum(w * sin(alt)) / sum(w) AS z FROM t GROUP BY 1)"


@query("stereo_direction_mean", f"{_DIR} SELECT event_id, {s6('atan2(y, x)')} AS az, {s6('asin(least(z / sqrt(x * x + y * y + z * z), 1))')} AS alt FROM s")
def stereo_direction_mean(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), (F.col("l_discount") * 3).alias("az"), (1.2 - F.col("l_tax")).alias("alt"), F.col("l_quantity").alias("w"))
    out = stereo.combine_direction(t, ["event_id"], "az", "alt", F.col("w"))
    return out.select("event_id", r6(F.col("az")).alias("az"), r6(F.col("alt")).alias("alt"))


@query("telescope_mask", f"""WITH {_TEL}, p AS (SELECT event_id, list_sort(list(DISTINCT s_nationkey)) AS l FROM tel JOIN supplier ON tel_id = s_suppkey GROUP BY 1)
SELECT event_id, array_to_string(list_transform((SELECT list(n_nationkey ORDER BY n_nationkey) FROM nation), lambda i: CASE WHEN list_contains(l, i) THEN '1' ELSE '0' END), '') AS mask, len(l)::INT AS multiplicity FROM p""")
def telescope_mask(spark, d):
    """Which stations (nations of the telescopes) saw an event; a mask over all 25 of them."""
    stations = table(spark, d, "nation").agg(F.sort_array(F.collect_list("n_nationkey")).alias("ids"))
    tel = tel_events(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("tel_id"), "s_nationkey"), "tel_id")
    t = tel.groupBy("event_id").agg(F.collect_set("s_nationkey").alias("l")).crossJoin(F.broadcast(stations))  # one row of 25 numbers
    t = t.select("event_id", arrays.ids_to_mask(F.col("l"), F.col("ids")).alias("m"))
    return t.select("event_id", F.array_join(F.transform("m", lambda x: F.when(x, "1").otherwise("0")), "").alias("mask"), arrays.multiplicity(F.col("m")).alias("multiplicity"))


@query("descriptive_stats", """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT vec_id, avg(x) AS mu FROM v GROUP BY 1),
c AS (SELECT vec_id, max(x) AS mx, min(x) AS mn, avg(x) AS mean, avg((x - mu) ** 2) AS v2, avg((x - mu) ** 3) AS v3, avg((x - mu) ** 4) AS v4 FROM v JOIN m USING (vec_id) GROUP BY 1)
SELECT vec_id, """ + ", ".join(f"{s6(e)} AS {n}" for n, e in (("max", "mx"), ("min", "mn"), ("mean", "mean"), ("std", "sqrt(v2)"), ("skewness", "v3 / v2 ** 1.5"), ("kurtosis", "v4 / v2 ** 2 - 3"))) + " FROM c")
def descriptive_stats(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    s = e.select("vec_id", arrays.describe(F.col("a")).alias("s"))
    return s.select("vec_id", *[r6(F.col(f"s.{c}")).alias(c) for c in ("max", "min", "mean", "std", "skewness", "kurtosis")])


@query("top_k_pixels", """WITH v AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i DESC) AS k FROM v)
SELECT vec_id, k::INT AS k, i::INT AS pixel, """ + s6("x") + " AS value FROM r WHERE k <= 3")
def top_k_pixels(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    e = e.select("vec_id", "a", F.posexplode(arrays.arg_n_largest(F.col("a"), 3)).alias("k", "pixel"))
    return e.select("vec_id", (F.col("k") + 1).alias("k"), "pixel", r6(F.get("a", F.col("pixel"))).alias("value"))


@query("fixed_point_codec", """WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 6 AND l_returnflag = 'A' THEN 'nan'::DOUBLE WHEN l_linenumber = 7 AND l_returnflag = 'A' THEN '-inf'::DOUBLE
WHEN l_linenumber = 7 THEN 'inf'::DOUBLE ELSE l_extendedprice - 20000 END AS x FROM lineitem),
c AS (SELECT *, CASE WHEN isnan(x) THEN 65534 WHEN isinf(x) AND x < 0 THEN 65533 WHEN isinf(x) THEN 65535 WHEN round_even(x * 1.5, 0) + 1000 < 0 THEN 65533 WHEN round_even(x * 1.5, 0) + 1000 > 65532 THEN 65535
ELSE round_even(x * 1.5, 0) + 1000 END::INT AS code FROM t)
SELECT l_orderkey, l_linenumber, code, CASE WHEN code < 65533 THEN round((code - 1000) / 1.5 + 3.7e-8, 6) END AS back, CASE WHEN code = 65534 THEN 'nan' WHEN code = 65533 THEN 'low' WHEN code = 65535 THEN 'high' END AS special FROM c""")
def fixed_point_codec(spark, d):
    flag, line = F.col("l_returnflag") == "A", F.col("l_linenumber")
    x = F.when((line == 6) & flag, float("nan")).when((line == 7) & flag, float("-inf")).when(line == 7, float("inf")).otherwise(F.col("l_extendedprice") - 20000)
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", codecs.encode_fixed(x, 1.5, 1000.0).alias("code"))
    back = codecs.decode_fixed(F.col("code"), 1.5, 1000.0)
    special = F.when(F.isnan(back), "nan").when(back == float("-inf"), "low").when(back == float("inf"), "high")
    return t.select("*", F.when(special.isNull(), r6(back)).alias("back"), special.alias("special"))


_KINDS = {"A": 1, "N": 2, "R": 3}


@query("enum_codec", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 END AS code, l_returnflag AS name FROM lineitem")
def enum_codec(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", codecs.encode_enum(F.col("l_returnflag"), _KINDS).alias("code"))
    return t.withColumn("name", codecs.decode_enum(F.col("code"), _KINDS))


@query("time_codec", """SELECT event_id, epoch_us(ts) // 1000000 + CASE WHEN ts >= TIMESTAMP '2017-01-01' THEN 37 WHEN ts >= TIMESTAMP '2015-07-01' THEN 36 WHEN ts >= TIMESTAMP '2012-07-01' THEN 35 END AS seconds,
(epoch_us(ts) % 1000000) * 4000 AS quarter_nanoseconds FROM events""")
def time_codec(spark, d):
    t = table(spark, d, "events").select("event_id", codecs.time_to_high_res(F.col("ts")).alias("t"))
    return t.select("event_id", "t.seconds", "t.quarter_nanoseconds")


@query("pixel_status_bits", "SELECT event_id, (user_id & 3)::INT AS dvr, ((user_id & 12) >> 2)::INT AS channel, ((user_id & 12) >> 2) = 0 AS invalid FROM events")
def pixel_status_bits(spark, d):
    s = F.col("user_id").cast("int")
    return table(spark, d, "events").select("event_id", codecs.dvr_status(s).alias("dvr"), codecs.channel_info(s).alias("channel"), codecs.is_invalid(s).alias("invalid"))


@query("truncate_text", "SELECT doc_id, left(lang || source, 5) AS short FROM documents")
def truncate_text(spark, d):
    return table(spark, d, "documents").select("doc_id", codecs.truncate_utf8(F.concat("lang", "source"), 5).alias("short"))


_ANG = "FROM (SELECT l_orderkey, l_linenumber, l_discount * 3 AS az, 1.2 - l_tax AS alt, 0.1 AS az0, 1.1 AS alt0 FROM lineitem)"


@query("coords_nominal", f"""SELECT l_orderkey, l_linenumber, {s6('atan2(cos(alt) * sin(az - az0), cos(alt) * cos(az - az0) * cos(alt0) + sin(alt) * sin(alt0))')} AS lon,
{s6('asin(-cos(alt) * cos(az - az0) * sin(alt0) + sin(alt) * cos(alt0))')} AS lat {_ANG}""")
def coords_nominal(spark, d):
    lon, lat = coords.to_offset(F.col("l_discount") * 3, 1.2 - F.col("l_tax"), F.lit(0.1), F.lit(1.1))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(lon).alias("lon"), r6(lat).alias("lat"))


@query("coords_round_trip", f"SELECT l_orderkey, l_linenumber, {s6('l_discount * 3')} AS az, {s6('1.2 - l_tax')} AS alt FROM lineitem")
def coords_round_trip(spark, d):
    lon, lat = coords.to_offset(F.col("l_discount") * 3, 1.2 - F.col("l_tax"), F.lit(0.1), F.lit(1.1))
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", lon.alias("lon"), lat.alias("lat"))
    az, alt = coords.from_offset(F.col("lon"), F.col("lat"), F.lit(0.1), F.lit(1.1))
    az = F.when(az > 6.2831, az - 2 * 3.141592653589793).otherwise(az)
    return t.select("l_orderkey", "l_linenumber", r6(az).alias("az"), r6(alt).alias("alt"))


@query("ang_separation", f"SELECT l_orderkey, l_linenumber, {s6('acos(least(greatest(sin(alt) * sin(alt0) + cos(alt) * cos(alt0) * cos(az - az0), -1), 1))')} AS theta {_ANG}")
def ang_separation(spark, d):
    theta = coords.separation(F.col("l_discount") * 3, 1.2 - F.col("l_tax"), F.lit(0.1), F.lit(1.1))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(theta).alias("theta"))


@query("coords_tilted", f"""SELECT l_orderkey, l_linenumber, {s6('sin(1.1) * cos(-0.3) * l_quantity + sin(1.1) * sin(-0.3) * l_tax * 100 - cos(1.1) * l_linenumber')} AS x,
{s6('-sin(-0.3) * l_quantity + cos(-0.3) * l_tax * 100')} AS y FROM lineitem""")
def coords_tilted(spark, d):
    x, y = coords.ground_to_tilted(F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_linenumber").cast("double"), F.lit(1.1), F.lit(0.3))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(x).alias("x"), r6(y).alias("y"))


@query("impact_distance", f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity - 20 AS x, l_tax * 100 - 5 AS y, l_linenumber AS z, cos(1.1) * cos(-0.3) AS dx, cos(1.1) * sin(-0.3) AS dy, sin(1.1) AS dz FROM lineitem)
SELECT l_orderkey, l_linenumber, {s6('sqrt((y * dz - z * dy) ** 2 + (z * dx - x * dz) ** 2 + (x * dy - y * dx) ** 2)')} AS impact FROM t""")
def impact_distance(spark, d):
    i = coords.impact_distance(F.lit(20.0), F.lit(5.0), F.lit(1.1), F.lit(0.3), F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_linenumber").cast("double"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(i).alias("impact"))


@query("pair_intersection", f"""WITH t AS (SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY tel_id, line, energy, intensity, discount, tax) AS i, intensity / 50 AS x, tax * 10 AS y, discount * 15 + line AS psi, energy FROM (WITH {_TEL} SELECT * FROM tel)),
p AS (SELECT a.event_id, a.x * sin(a.psi) - a.y * cos(a.psi) AS k1, b.x * sin(b.psi) - b.y * cos(b.psi) AS k2, sin(a.psi) * cos(b.psi) - cos(a.psi) * sin(b.psi) AS det, sin(a.psi) AS s1, cos(a.psi) AS c1, sin(b.psi) AS s2, cos(b.psi) AS c2,
  a.energy * b.energy / (a.energy + b.energy) * abs(sin(a.psi - b.psi)) AS w FROM t a JOIN t b ON a.event_id = b.event_id AND a.i < b.i),
c AS (SELECT event_id, (c2 * k1 - c1 * k2) / det AS cx, w FROM p WHERE abs(det) > 1e-3)
SELECT event_id, round(sum(w * cx) / sum(w) + 3.7e-6, 4) AS x, count(*) AS n_pairs FROM c GROUP BY 1""")
def pair_intersection(spark, d):
    t = tel_events(spark, d).withColumns({"x": F.col("intensity") / 50, "y": F.col("tax") * 10, "psi": F.col("discount") * 15 + F.col("line")})
    p = stereo.pairs_of_event(t, ["event_id"], ["x", "y", "psi", "energy"], ["tel_id", "line", "energy", "intensity", "discount", "tax"])
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    cx, _ = stereo.intersect_lines(a("x"), a("y"), a("psi"), b("x"), b("y"), b("psi"))
    w = a("energy") * b("energy") / (a("energy") + b("energy")) * F.abs(F.sin(a("psi") - b("psi")))
    p = p.where(F.abs(F.sin(a("psi")) * F.cos(b("psi")) - F.cos(a("psi")) * F.sin(b("psi"))) > 1e-3).select("event_id", cx.alias("cx"), w.alias("w"))
    return p.groupBy("event_id").agg(F.round(F.sum(F.col("w") * F.col("cx")) / F.sum("w") + 3.7e-6, 4).alias("x"), F.count("*").alias("n_pairs"))


@query("true_disp", f"""SELECT l_orderkey, l_linenumber, {s6('abs(cos(l_linenumber) * (0.1 - l_discount) + sin(l_linenumber) * (0.05 - l_tax))')} AS disp,
CASE WHEN cos(l_linenumber) * (0.1 - l_discount) + sin(l_linenumber) * (0.05 - l_tax) < 0 THEN -1.0 ELSE 1.0 END::DOUBLE AS sign FROM lineitem""")
def true_disp(spark, d):
    disp, sign = stereo.true_disp(F.lit(0.1), F.lit(0.05), F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber").cast("double"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(disp).alias("disp"), sign.alias("sign"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Quality mask on telescope events, weighted stereo mean per array event, joined to the array events."""
    good = QUALITY.select(tel_events(spark, d))
    mean = stereo.combine_mean(good, ["event_id"], "energy", "tel_id", F.col("intensity"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("time"), F.col("o_totalprice").alias("true_energy"))
    return relational.join_allow_empty(o, mean, ["event_id"]).select("event_id", "time", "true_energy", r6(F.col("mean")).alias("energy"), "n_valid")


@query("flagship", f"""WITH {_TEL}, m AS (SELECT event_id, {s6('sum(intensity * energy) / sum(intensity)')} AS energy, count(*) AS n_valid FROM tel WHERE {_Q} GROUP BY 1)
SELECT o_orderkey AS event_id, o_orderdate AS time, o_totalprice AS true_energy, energy, n_valid FROM orders LEFT JOIN m ON o_orderkey = event_id""")
def flagship_query(spark, d):
    return flagship(spark, d)


# -- formulas ------------------------------------------------------------------------------------------------------


@query("atmosphere_exponential", f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity * 300 - 600 AS h, l_tax * 5 AS zen FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN h >= 0 THEN {s6('1000 * exp(-h / 8000)')} END AS depth, CASE WHEN h >= 0 THEN {s6('1000 * exp(-h / 8000) / cos(zen)')} END AS slant, CASE WHEN h >= 0 THEN {s6('1e6 * 0.00125 * exp(-h / 8000)')} END AS density,
CASE WHEN h > 0 THEN round(h, 3) END AS back FROM t""")
def atmosphere_exponential(spark, d):
    a = atmosphere.Exponential()
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 300 - 600).alias("h"), (F.col("l_tax") * 5).alias("zen"))
    slant = a.slant_depth(F.col("h"), F.col("zen"))
    some = lambda c: F.when(~F.isnan(c), c)
    return t.select("l_orderkey", "l_linenumber", some(r6(a.overburden(F.col("h")))).alias("depth"), some(r6(slant)).alias("slant"), some(r6(a.density(F.col("h")) * 1e6)).alias("density"), F.when(F.col("h") > 0, F.round(a.height_from_slant_depth(slant, F.col("zen")), 3)).alias("back"))


_LAYERS = ((0.0, -140.508, 1178.05, 9942.0), (7000.0, -18.4377, 1265.08, 8780.0), (11400.0, 0.217565, 1349.22, 6361.0), (37000.0, -0.000201796, 703.745, 7720.0), (100000.0, 0.000763128, 1.0, 1e8))


@query("atmosphere_layers", f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity * 2500 - 5000 AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, {s6("CASE WHEN h >= 100000 THEN greatest(0.000763128 - h / 1e8, 0) WHEN h >= 37000 THEN -0.000201796 + 703.745 * exp(-h / 7720) WHEN h >= 11400 THEN 0.217565 + 1349.22 * exp(-h / 6361) WHEN h >= 7000 THEN -18.4377 + 1265.08 * exp(-h / 8780) WHEN h >= 0 THEN -140.508 + 1178.05 * exp(-h / 9942) END")} AS depth,
{s6("1e4 * CASE WHEN h >= 100000 THEN 1 / 1e8 WHEN h >= 37000 THEN 703.745 / 7720 * exp(-h / 7720) WHEN h >= 11400 THEN 1349.22 / 6361 * exp(-h / 6361) WHEN h >= 7000 THEN 1265.08 / 8780 * exp(-h / 8780) WHEN h >= 0 THEN 1178.05 / 9942 * exp(-h / 9942) END")} AS density,
CASE WHEN h >= 0 AND h < 35000 AND h NOT IN (0, 7000, 11400) THEN round(h, 2) END AS back FROM t""")
def atmosphere_layers(spark, d):
    a = atmosphere.FiveLayers(_LAYERS)
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2500 - 5000).alias("h"))
    some = lambda c: F.when(~F.isnan(c), c)
    depth = a.overburden(F.col("h"))
    back = F.when((F.col("h") >= 0) & (F.col("h") < 35000) & ~F.col("h").isin(0.0, 7000.0, 11400.0), F.round(a.height_from_overburden(depth), 2))
    return t.select("l_orderkey", "l_linenumber", some(r6(depth)).alias("depth"), some(r6(a.density(F.col("h")) * 1e6)).alias("density"), back.alias("back"))


@query("pixel_likelihood", f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity AS s, l_quantity * (0.5 + 10 * l_discount) AS mu, 0.4 + l_tax AS w, 1.2 AS ped FROM lineitem)
SELECT l_orderkey, l_linenumber, {s6('ln(2 * pi() * (ped ** 2 + mu * (1 + w ** 2))) / 2 + (s - mu) ** 2 / (2 * (ped ** 2 + mu * (1 + w ** 2)))')} AS approx, {s6('1 + ln(2 * pi()) + ln(ped ** 2 + mu * (1 + w ** 2))')} AS expected,
{s6('(s - mu) ** 2 / (40 + 0.5 * (s - mu)) / 2.9')} AS chi2 FROM t""")
def pixel_likelihood(spark, d):
    q = F.col("l_quantity")
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", q.alias("s"), (q * (0.5 + 10 * F.col("l_discount"))).alias("mu"), (0.4 + F.col("l_tax")).alias("w"))
    args = (F.col("mu"), F.col("w"), F.lit(1.2))
    return t.select("l_orderkey", "l_linenumber", r6(likelihood.gaussian(F.col("s"), *args)).alias("approx"), r6(likelihood.mean_gaussian(*args)).alias("expected"), r6(likelihood.chi_squared(F.col("s"), F.col("mu"), F.lit(40.0))).alias("chi2"))


@query("vector_angle", f"""WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings) SELECT vec_id, {s6('sqrt(list_sum(list_transform(a, lambda x: x * x)))')} AS length, {s6('acos(a[1] / sqrt(list_sum(list_transform(a, lambda x: x * x))))')} AS angle FROM t""")
def vector_angle(spark, d):
    t = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    axis = F.transform("a", lambda x, i: F.when(i == 0, 1.0).otherwise(0.0))
    return t.select("vec_id", r6(vectors.length(F.col("a"))).alias("length"), r6(vectors.angle(F.col("a"), axis)).alias("angle"))


@query("flux_spectra", f"""SELECT l_orderkey, l_linenumber, {s6('1e11 * 2.83e-11 * (l_quantity / 10) ** -2.62')} AS crab, {s6('1e6 * 9.8e-6 * (l_quantity / 10) ** -2.62')} AS proton,
{s6('1e9 * 2.385e-9 * (l_quantity / 10) ** -3.43 * (1 + 1.95 * (exp(exp(-1 * (log10(l_quantity / 10) + 0.101) ** 2 / (2 * 0.741 ** 2)) / (0.741 * sqrt(2 * pi()))) - 1))')} AS electron FROM lineitem""")
def flux_spectra(spark, d):
    e = F.col("l_quantity") / 10
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[r6(f(e) * s).alias(k) for (k, f), s in zip(vectors.SPECTRA.items(), (1e11, 1e6, 1e9), strict=True)])
