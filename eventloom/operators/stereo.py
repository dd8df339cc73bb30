"""From telescope rows to array events: weighted means, directions, scores, and pairs of image axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import coords
from eventloom.functions.common import finite


def weight_of(kind: str, intensity: str | None = None, length: str | None = None, width: str | None = None) -> Column:
    """none: 1; intensity: the charge; aspect: charge * length / width."""
    if kind == "none":
        return F.lit(1.0)
    if kind == "intensity":
        return F.col(intensity).cast("double")
    if kind == "aspect":
        return F.try_divide(F.col(intensity) * F.col(length), F.col(width))
    raise ValueError(f"no such weight: {kind}")


def mean_and_std(value: Column, weight: Column, valid: Column) -> tuple[Column, Column]:
    """Aggregates: weighted mean and population standard deviation over valid rows, NaN without weight.

    One pass, without a difference of large squares: the spread is taken about the plain mean by the built-in covariances,
    which update running means, and moved to the weighted mean.
    """
    ok = valid & value.isNotNull() & weight.isNotNull()
    x, w = F.when(ok, value.cast("double")), F.when(ok, weight.cast("double"))
    each, shift = F.avg(w), F.try_divide(F.covar_pop(w, x), F.avg(w))
    v = F.try_divide(F.covar_pop(w * x, x) - F.avg(x) * F.covar_pop(w, x), each) - shift * shift
    nan = F.lit(float("nan"))
    return F.coalesce(F.try_divide(F.sum(w * x), F.sum(w)), nan), F.coalesce(F.sqrt(F.when(v.isNotNull(), F.greatest(v, F.lit(0.0)))), nan)


def combine_mean(tel: DataFrame, event: list[str], value: str, tel_id: str, weight: Column | None = None, log: bool = False, valid: Column | None = None, unbiased: bool = False) -> DataFrame:
    """event, mean, std, n_valid, telescopes, is_valid. With `log`, mean and std are those of the logarithm, as factors.

    With `unbiased`, the variance is divided by W - sum(w^2) / W instead of W = sum(w), and std is NaN for a single row. Rows count if they are valid (by default: finite) and, with `log`, above zero; is_valid tells whether the mean is a finite number.
    """
    ok = finite(F.col(value).cast("double")) if valid is None else F.coalesce(valid, F.lit(False))
    if log:
        ok = ok & F.coalesce(F.col(value) > 0, F.lit(False))
    x = F.ln(F.when(F.col(value) > 0, F.col(value).cast("double"))) if log else F.col(value)
    w = F.lit(1.0) if weight is None else weight
    m, s = mean_and_std(x, w, ok)
    if unbiased:
        used = F.when(ok & x.isNotNull(), w.cast("double"))
        share = F.try_divide(F.sum(used * used), F.sum(used) ** 2)
        s = F.when((F.count(used) > 1) & (share < 1), s / F.sqrt(1 - share)).otherwise(F.lit(float("nan")))
    out = tel.groupBy(*event).agg(m.alias("mean"), s.alias("std"), F.count_if(ok).alias("n_valid"), F.array_sort(F.collect_set(F.when(ok, F.col(tel_id)))).alias("telescopes"))
    if log:
        out = out.withColumns({"mean": F.exp("mean"), "std": F.exp("std")})
    return out.withColumn("is_valid", finite(F.col("mean")))


def combine_direction(tel: DataFrame, event: list[str], az: str, alt: str, weight: Column | None = None) -> DataFrame:
    """event, az, alt, ang_dev: direction of the mean unit vector."""
    lon, lat, dev = coords.unit_mean(F.col(az), F.col(alt), weight)
    return tel.groupBy(*event).agg(F.pmod(lon, F.lit(2 * 3.141592653589793)).alias("az"), lat.alias("alt"), dev.alias("ang_dev"))


def combine_impact(tel: DataFrame, event: list[str], x: str, y: str, weight: Column) -> DataFrame:
    n = F.sum(weight)
    return tel.groupBy(*event).agg(F.try_divide(F.sum(weight * F.col(x)), n).alias("core_x"), F.try_divide(F.sum(weight * F.col(y)), n).alias("core_y"))


def pairs_of_event(tel: DataFrame, event: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """Every pair of rows of an event, as structs a and b.

    An event has as many rows as telescopes saw it, at most the size of the array, so pairs are made inside one list per event.
    """
    rows = tel.groupBy(*event).agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias("r"))
    pair = F.flatten(F.transform("r", lambda a, i: F.transform(F.slice("r", i + 2, F.size("r")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return rows.select(*event, F.explode(pair).alias("p")).select(*event, "p.a", "p.b")


def intersect_lines(x1: Column, y1: Column, phi1: Column, x2: Column, y2: Column, phi2: Column) -> tuple[Column, Column]:
    """Where two lines through (x, y) at angle phi cross; null for parallel ones."""
    s1, c1, s2, c2 = F.sin(phi1), F.cos(phi1), F.sin(phi2), F.cos(phi2)
    det = s1 * c2 - c1 * s2
    k1, k2 = x1 * s1 - y1 * c1, x2 * s2 - y2 * c2
    det = F.when(F.abs(det) > 1e-12, det)
    return (c2 * k1 - c1 * k2) / det, (s2 * k1 - s1 * k2) / det


def crossing_mean(tel: DataFrame, event: list[str], x: str, y: str, psi: str, intensity: str, order: list[str]) -> DataFrame:
    """Weighted mean and spread of the crossings of all pairs of image axes: I1 I2 / (I1 + I2) * |sin(psi1 - psi2)|."""
    p = pairs_of_event(tel, event, [x, y, psi, intensity], order)
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    cx, cy = intersect_lines(a(x), a(y), a(psi), b(x), b(y), b(psi))
    w = F.try_divide(a(intensity) * b(intensity), a(intensity) + b(intensity)) * F.abs(F.sin(a(psi) - b(psi)))
    p = p.select(*event, cx.alias("cx"), cy.alias("cy"), w.alias("w")).where("cx is not null")
    mx, sx = mean_and_std(F.col("cx"), F.col("w"), F.lit(True))
    my, sy = mean_and_std(F.col("cy"), F.col("w"), F.lit(True))
    return p.groupBy(*event).agg(mx.alias("x"), my.alias("y"), sx.alias("x_std"), sy.alias("y_std"), F.count("*").alias("n_pairs"))


def plane_crossing(tel: DataFrame, event: list[str], normal: tuple[str, str, str], weight: str, order: list[str]) -> DataFrame:
    """Direction in which the image planes of an event meet: the weighted mean of the pairwise cross products, turned upwards."""
    nx, ny, nz = normal
    p = pairs_of_event(tel, event, [nx, ny, nz, weight], order)
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    cx, cy, cz = a(ny) * b(nz) - a(nz) * b(ny), a(nz) * b(nx) - a(nx) * b(nz), a(nx) * b(ny) - a(ny) * b(nx)
    up = F.when(cz < 0, -1.0).otherwise(1.0) * a(weight) * b(weight)
    p = p.select(*event, (cx * up).alias("vx"), (cy * up).alias("vy"), (cz * up).alias("vz"))
    out = p.groupBy(*event).agg(*[F.sum(c).alias(c) for c in ("vx", "vy", "vz")])
    n = F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2)
    return out.select(*event, *[F.try_divide(F.col(c), n).alias(c) for c in ("vx", "vy", "vz")])


def shower_height(source_x: Column, source_y: Column, cog_x: Column, cog_y: Column, core_x: Column, core_y: Column, tel_x: Column, tel_y: Column) -> Column:
    """Impact distance over the angle between image centre and source."""
    disp = F.sqrt((source_x - cog_x) ** 2 + (source_y - cog_y) ** 2)
    return F.try_divide(F.sqrt((core_x - tel_x) ** 2 + (core_y - tel_y) ** 2), disp)


def true_disp(source_lon: Column, source_lat: Column, cog_lon: Column, cog_lat: Column, psi: Column, project: bool = True) -> tuple[Column, Column]:
    """(length, sign) from the image centre to the source along the axis; without `project`, the full distance."""
    dx, dy = source_lon - cog_lon, source_lat - cog_lat
    along = F.cos(psi) * dx + F.sin(psi) * dy
    size = F.abs(along) if project else F.sqrt(dx * dx + dy * dy)
    return size, F.when(along < 0, -1.0).otherwise(1.0)
