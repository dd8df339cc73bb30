"""Shower geometry of an array event from the image axes of its telescopes.

Everything a telescope contributes is a sum or one entry of a list as long as the array, so one grouping by event gives it all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import coords
from eventloom.functions.common import finite
from eventloom.functions.vectors import angle


def nearest_point_2d(x: Column, y: Column, psi: Column) -> tuple[Column, Column]:
    """Aggregates: the place with the least summed squared distance to lines through (x, y) at angle psi; null if all are parallel."""
    s, c = F.sin(psi), F.cos(psi)
    a, b, d = F.sum(s * s), F.sum(-s * c), F.sum(c * c)
    u, v = F.sum(s * s * x - s * c * y), F.sum(c * c * y - s * c * x)
    det = a * d - b * b
    det = F.when(F.abs(det) > 1e-15, det)
    return (d * u - b * v) / det, (a * v - b * u) / det


def nearest_point_3d(n: tuple[Column, Column, Column], p: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """Aggregates: the place with the least summed squared distance to lines through p along the unit vectors n; null if all are parallel."""
    m = [[F.sum((1.0 if i == j else 0.0) - n[i] * n[j]) for j in range(3)] for i in range(3)]
    along = n[0] * p[0] + n[1] * p[1] + n[2] * p[2]
    r = [F.sum(p[i] - n[i] * along) for i in range(3)]
    minor = lambda a, i, j, k, l: a[i][k] * a[j][l] - a[i][l] * a[j][k]
    det3 = lambda a: a[0][0] * minor(a, 1, 2, 1, 2) - a[0][1] * minor(a, 1, 2, 0, 2) + a[0][2] * minor(a, 1, 2, 0, 1)
    det = det3(m)
    det = F.when(F.abs(det) > 1e-15, det)
    return tuple(det3([[r[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]) / det for k in range(3))


def crossings(planes: Column) -> Column:
    """Of structs (n: unit normal, w: weight) of planes: struct(v, w) for each pair, v the direction in which the two meet, turned upwards."""

    def pair(a: Column, b: Column) -> Column:
        p, q = a["n"], b["n"]
        v = (p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0])
        up = F.when(v[2] < 0, -1.0).otherwise(1.0)
        return F.struct(F.array(*[c * up for c in v]).alias("v"), (a["w"] * b["w"]).alias("w"))

    return F.flatten(F.transform(planes, lambda a, i: F.transform(F.slice(planes, i + 2, F.size(planes)), lambda b: pair(a, b))))


def reconstruct(tel: DataFrame, event: list[str], tel_id: str = "tel_id", height: float = 0.0, camera_radius: float = math.radians(4.0)) -> DataFrame:
    """Direction, core and height of the shower maximum from pairs of image planes and from the nearest points of lines.

    tel: one row per event and telescope with fov_lon, fov_lat, psi, length, width, intensity (the image, angles in radians), alt, az
    (the telescope's pointing), array_alt, array_az, and x, y, z (its place). Rows with a null or non-finite value, or without
    intensity, are left out, as is a telescope whose width is not above zero, as no axis can be told.

    Per event: alt, az, direction_uncert, core_x, core_y, core_tilted_x, core_tilted_y, h_max (above sea level; height is the
    observatory's), average_intensity, telescopes, is_valid. With fewer than two telescopes, or parallel planes, is_valid is false and
    the numbers are null. Repeated rows count as telescopes of their own.
    """
    needed = ["fov_lon", "fov_lat", "psi", "length", "width", "intensity", "alt", "az", "array_alt", "array_az", "x", "y", "z"]
    ok = F.lit(True)
    for c in needed:
        ok = ok & F.coalesce(finite(F.col(c).cast("double")), F.lit(False))
    t = tel.withColumn("__ok", ok & F.coalesce(F.col("width") > 0, F.lit(False)) & F.coalesce(F.col("intensity") > 0, F.lit(False)))
    col = {c: F.when(F.col("__ok"), F.col(c).cast("double")) for c in needed}
    far = 0.1 * camera_radius
    az1, alt1 = coords.from_offset(col["fov_lon"], col["fov_lat"], col["az"], col["alt"])
    az2, alt2 = coords.from_offset(col["fov_lon"] + far * F.cos(col["psi"]), col["fov_lat"] + far * F.sin(col["psi"]), col["az"], col["alt"])
    t = t.select(*event, F.col(tel_id).alias("__id"), "__ok", *[col[c].alias(f"__{c}") for c in needed], az1.alias("__az1"), alt1.alias("__alt1"), az2.alias("__az2"), alt2.alias("__alt2"))
    c = lambda n: F.col(f"__{n}")
    a, b = coords.righthanded(c("alt1"), c("az1")), coords.righthanded(c("alt2"), c("az2"))
    cross = (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    lon1, lat1 = coords.to_offset(c("az1"), c("alt1"), c("array_az"), c("array_alt"))
    lon2, lat2 = coords.to_offset(c("az2"), c("alt2"), c("array_az"), c("array_alt"))
    tx, ty = coords.ground_to_tilted(c("x"), c("y"), c("z"), c("array_alt"), c("array_az"))
    t = t.withColumns({
        "__nx": a[0], "__ny": a[1], "__nz": a[2], "__normal": F.array(*cross), "__w": c("intensity") * c("length") / c("width"),
        "__axis": F.atan(F.try_divide(lon1 - lon2, lat1 - lat2)), "__tx": tx, "__ty": ty,
    })
    # an axis across the camera's x has no slope there; its angle is a right one
    t = t.withColumn("__axis", F.when(c("ok"), F.coalesce(c("axis"), F.lit(math.pi / 2))))
    cx, cy = nearest_point_2d(c("tx"), c("ty"), c("axis"))
    top = nearest_point_3d((c("nx"), c("ny"), c("nz")), (c("x"), c("y"), c("z")))[2]
    g = t.groupBy(*event).agg(
        F.count_if("__ok").alias("__n"), cx.alias("core_tilted_x"), cy.alias("core_tilted_y"), (top + height).alias("h_max"), F.avg(c("intensity")).alias("average_intensity"),
        F.min(c("array_alt")).alias("__array_alt"), F.min(c("array_az")).alias("__array_az"),
        F.array_sort(F.collect_list(F.when(c("ok"), c("id")))).alias("telescopes"),
        F.sort_array(F.collect_list(F.when(c("ok"), F.struct(c("id").alias("i"), c("normal").alias("n"), c("w").alias("w"))))).alias("__planes"),
    )
    g = g.withColumn("__c", crossings(F.col("__planes")))
    summed = lambda i: F.aggregate("__c", F.lit(0.0), lambda s, p: s + p["v"][i] * p["w"])
    g = g.withColumns({f"__v{k}": summed(i) for i, k in enumerate("xyz")})
    n = F.sqrt(F.col("__vx") ** 2 + F.col("__vy") ** 2 + F.col("__vz") ** 2)
    v = F.array(*[F.try_divide(F.col(f"__v{k}"), n) for k in "xyz"])
    g = g.withColumn("__v", F.when(n > 0, v))
    off = F.transform("__c", lambda p: angle(F.col("__v"), p["v"]))
    mean_off = F.aggregate(F.filter(off, lambda x: x.isNotNull()), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda s, x: F.struct((s["s"] + x).alias("s"), (s["n"] + 1).alias("n")), lambda s: F.try_divide(s["s"], s["n"]))
    g = g.withColumns({
        "alt": F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("__v")[2]))),
        "az": F.pmod(-F.atan2(F.col("__v")[1], F.col("__v")[0]), F.lit(2 * math.pi)), "direction_uncert": mean_off,
    })
    ground = coords.tilted_to_ground(F.col("core_tilted_x"), F.col("core_tilted_y"), F.col("__array_alt"), F.col("__array_az"))
    gx, gy = coords.project_to_ground(*ground, F.col("__array_alt"), F.col("__array_az"))
    g = g.withColumns({"core_x": gx, "core_y": gy})
    g = g.withColumn("is_valid", (F.col("__n") >= 2) & F.coalesce(finite(F.col("alt")) & finite(F.col("core_x")), F.lit(False)))
    names = ["alt", "az", "direction_uncert", "core_x", "core_y", "core_tilted_x", "core_tilted_y", "h_max", "average_intensity"]
    return g.select(*event, *[F.when(F.col("is_valid"), F.col(k)).alias(k) for k in names], "telescopes", "is_valid")
