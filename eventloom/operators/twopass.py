"""Charge and time of waveforms in two passes: windows about each pixel's own pulse, then where the shower's time gradient predicts it.

Every step adds a column to one row per image, so an image is extracted where it is scanned; only the islands' labels leave the JVM, in Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import waveforms as wf
from eventloom.functions.arrays import argmax
from eventloom.functions.common import let, numbers
from eventloom.operators import images
from eventloom.operators.images import Camera

#: (width, shift) of the window in samples: about a peak, at the start and at the end of the readout. Fixed values.
WINDOW, AT_START, AT_END = (5, 2), (5, 0), (6, 4)


def corrections(pulse: list[float], pulse_step: float, sample_step: float) -> tuple[float, float, float]:
    """1 / share of a reference pulse inside each of the three windows."""
    return tuple(wf.integration_correction(pulse, pulse_step, sample_step, *w) for w in (WINDOW, AT_START, AT_END))


def _first_peak(w: Column) -> Column:
    """Where three samples have the largest sum, at least two samples from both ends."""
    sums = F.transform(F.sequence(F.lit(2), F.size(w) - 3), lambda i: w[i - 1].cast("double") + w[i] + w[i + 1])
    return argmax(sums) + 2


def extract(d: DataFrame, camera: Camera, threshold: float, rate: float = 1.0, correction: tuple[float, float, float] = (1.0, 1.0, 1.0), waveform: str = "waveform", broken: str | None = None, second_pass: bool = True, starts: int = 5) -> DataFrame:
    """d with image, peak_time (arrays over pixels) and is_valid.

    First pass: five samples about the best three; broken pixels then get the mean of their sound neighbours. Pixels over `threshold` with a
    neighbour over it, and those over half of it beside them, are the core; its brightest island gives an axis, and a trimmed line of time
    over the place along the axis predicts every pixel's pulse. Second pass: pixels outside of the island, or under the threshold, are integrated again in five samples
    there; a window that leaves the readout takes its first or last five samples. With fewer than three pixels in the island, or no line, the first pass stands and is_valid
    is false. `correction`: factors for a window about a peak, at the start, at the end (see corrections). rate: samples per unit of time.

    A null waveform, or one of under five samples, gives nulls and is_valid false; ties go to the first sample and the first island. Columns of
    these three names are replaced, those that start with `__` are taken.
    """
    long = F.col(waveform).isNotNull() & (F.size(waveform) == camera.n) & F.forall(waveform, lambda w: w.isNotNull() & (F.size(w) >= 5))
    d = d.withColumn("__w", F.when(long, F.transform(waveform, lambda w: F.transform(w, lambda x: x.cast("double")))))
    first = F.transform("__w", lambda w: let(_first_peak(w), lambda p: wf.around(w, p, *WINDOW, rate)))
    d = d.withColumn("__1", first)
    d = d.withColumns({"__q": F.transform("__1", lambda e: e["charge"] * correction[0]), "__t": F.transform("__1", lambda e: e["peak_time"])})
    if not second_pass:
        return d.withColumns({"image": F.col("__q"), "peak_time": F.col("__t"), "is_valid": F.col("__w").isNotNull()}).drop("__w", "__1", "__q", "__t")
    if broken is not None:
        d = d.withColumn("__b", F.coalesce(F.col(broken), F.transform("__q", lambda _: F.lit(False))))
        d = d.withColumns({c: images.neighbor_average(F.col(c), F.col("__b"), camera) for c in ("__q", "__t")})
    d = d.withColumn("__m", images.tailcuts(F.col("__q"), camera, threshold, threshold / 2, least=1))
    d = d.withColumn("__l", images.islands(F.col("__m"), camera))
    found = F.array_max("__l") > 0
    d = d.withColumn("__i", F.when(found, images.brightest_island(F.col("__l"), F.col("__q"))).otherwise(F.col("__m")))
    d = d.withColumn("__n", F.size(F.filter("__i", lambda m: m)))
    d = d.withColumn("__h", F.when(F.col("__n") >= 3, images.hillas(images.masked(F.col("__q"), F.col("__i")), camera)))
    # every image has the same number of starts; those without an axis are left out before
    d = d.withColumn("__g", F.when(F.col("__h").isNotNull(), images.timing(F.col("__q"), F.col("__t"), F.col("__i"), F.col("__h"), camera, starts=starts)))
    valid = F.col("__g").isNotNull() & ~F.isnan("__g.slope")

    x, y = numbers(camera.x), numbers(camera.y)
    h, g, n = F.col("__h"), F.col("__g"), F.size(F.col("__w")[0])
    along = F.zip_with(x, y, lambda a, b: (a - h["x"]) * F.cos(h["psi"]) + (b - h["y"]) * F.sin(h["psi"]))
    # far beyond the readout all places are alike; an integer must hold them
    at = F.transform(along, lambda a: F.rint(F.greatest(F.lit(-1e6), F.least(F.lit(1e6), (g["slope"] * a + g["intercept"]) * rate))).cast("int"))

    def again(w: Column, p: Column) -> Column:
        start, end, size = p < WINDOW[1], p - WINDOW[1] + WINDOW[0] > F.size(w) - 1, F.size(w)
        about = wf.around(w, p, *WINDOW, rate)
        early = wf.around(w, F.lit(0), *AT_START, rate)
        late = wf.around(w, F.when(p > size - 3, size - 1).otherwise(p), *AT_END, rate)
        scaled = lambda e, f: F.struct((e["charge"] * f).alias("charge"), e["peak_time"].alias("peak_time"))
        return F.when(end, scaled(late, correction[2])).when(start, scaled(early, correction[1])).otherwise(scaled(about, correction[0]))

    d = d.withColumn("__p", F.when(valid, at))
    parts = F.arrays_zip(F.col("__w").alias("w"), F.col("__q").alias("q"), F.col("__t").alias("t"), F.col("__i").alias("i"), F.col("__p").alias("p"))
    second = F.transform(parts, lambda z: F.when(z["i"] & (z["q"] >= threshold), F.struct(z["q"].alias("charge"), z["t"].alias("peak_time"))).otherwise(again(z["w"], z["p"])))
    d = d.withColumn("__2", F.when(valid, second))
    image = F.when(valid, F.transform("__2", lambda e: e["charge"])).otherwise(F.col("__q"))
    time = F.when(valid, F.transform("__2", lambda e: e["peak_time"])).otherwise(F.col("__t"))
    d = d.withColumns({"image": image, "peak_time": time, "is_valid": valid})
    return d.drop(*[c for c in d.columns if c.startswith("__")])
