"""From calibrated samples to images: data reduction, pedestal, time shifts, charge and time, flat field, broken pixels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import waveforms as wf
from eventloom.functions.common import let, total
from eventloom.operators.images import Camera, neighbor_average

#: Two bits of a pixel's status tell whether it is stored; both set: stored, and part of the signal. Fixed value.
STORED = 0b1100


def reduce_volume(d: DataFrame, signal: Column, waveform: str = "waveform", status: str = "pixel_status") -> DataFrame:
    """Pixels outside `signal` (a boolean array) get samples of zero and lose the status bits that tell they are stored."""
    zero = F.transform(F.arrays_zip(F.col(waveform).alias("w"), signal.alias("s")), lambda z: F.when(z["s"], z["w"]).otherwise(F.transform(z["w"], lambda x: x * 0)))
    bits = F.transform(F.arrays_zip(F.col(status).alias("b"), signal.alias("s")), lambda z: F.when(z["s"], z["b"].bitwiseOR(F.lit(STORED))).otherwise(z["b"].bitwiseAND(F.lit(0xFF & ~STORED))))
    return d.withColumns({waveform: zero, status: bits})


def of_channel(values: Column, channel: Column) -> Column:
    """values[channel[pixel]][pixel] for every pixel: coefficients by gain channel, of the channel that was read."""
    return F.transform(channel, lambda c, i: values[c][i])


def shifts(time_shift: Column, rate: float) -> Column:
    """struct(whole, rest) for every pixel: samples by which a waveform moves, relative to the camera's mean, and the time that remains.

    Halves go to the even number.
    """
    samples = F.transform(time_shift, lambda x: x.cast("double") * rate)
    return let(samples, lambda s: let(total(s) / F.size(s), lambda m: F.transform(s, lambda x: F.struct(F.bround(x - m).cast("int").alias("whole"), ((x - F.bround(x - m)) / rate).alias("rest")))))


def calibrate(
    d: DataFrame, camera: Camera, rate: float, extract: Callable[[Column], Column] | None = None, waveform: str = "waveform", pedestal: str | None = "pedestal", factor: str | None = "factor",
    time_shift: str | None = "time_shift", broken: str | None = "broken", channel: str | None = None, move_samples: bool = True, move_peak: bool = True,
) -> DataFrame:
    """Adds image and peak_time, arrays over the pixels.

    extract gives struct(charge, peak_time) of one waveform (by default seven samples about its own peak, times in units of 1 / rate).
    Coefficients are arrays over pixels in columns of d, or arrays of those by gain channel if `channel` names the chosen channels; a
    column name of None, or a null coefficient, leaves its step out. Of single-sample waveforms the sample is the charge and the time
    is 0. Broken pixels get the mean of the neighbours that are not. A null waveform gives null images.
    """
    extract = extract or (lambda w: let(wf.argmax(w), lambda p: wf.around(w, p, 7, 3, rate)))
    pick = lambda name: None if name is None else (F.col(name) if channel is None else of_channel(F.col(name), F.col(channel)))
    w = F.transform(waveform, lambda p: F.transform(p, lambda x: x.cast("double")))
    if pedestal is not None:
        w = F.coalesce(F.zip_with(w, pick(pedestal), lambda p, b: F.transform(p, lambda x: x - b)), w)
    out = d.withColumn("__w", w)
    rest = None
    if time_shift is not None:
        s = shifts(pick(time_shift), rate)
        if move_samples:
            out = out.withColumn("__s", s)
            out = out.withColumn("__w", F.coalesce(F.zip_with("__w", "__s", lambda p, t: wf.shift_waveform(p, t["whole"])), F.col("__w")))
            rest = F.transform("__s", lambda t: t["rest"])
        else:
            rest = pick(time_shift)
    single = F.transform("__w", lambda p: F.struct(p[0].alias("charge"), F.lit(0.0).alias("peak_time")))
    many = F.transform("__w", lambda p: let(extract(p), lambda e: F.struct(e["charge"].cast("double").alias("charge"), e["peak_time"].cast("double").alias("peak_time"))))
    out = out.withColumn("__e", F.when(F.size(F.col("__w")[0]) == 1, single).otherwise(many))
    charge, time = F.transform("__e", lambda e: e["charge"]), F.transform("__e", lambda e: e["peak_time"])
    if rest is not None and move_peak:
        moved = F.zip_with(time, rest, lambda t, r: t - r)
        time = F.when(F.size(F.col("__w")[0]) == 1, time).otherwise(F.coalesce(moved, time))
    if factor is not None:
        charge = F.coalesce(F.zip_with(charge, pick(factor), lambda q, f: q * f), charge)
    out = out.withColumns({"image": charge, "peak_time": time})
    if broken is not None:
        mask = F.coalesce(F.col(broken), F.transform("image", lambda _: F.lit(False)))
        out = out.withColumn("__b", mask).withColumns({c: neighbor_average(F.col(c), F.col("__b"), camera) for c in ("image", "peak_time")})
    return out.drop(*[c for c in ("__w", "__s", "__e", "__b") if c in out.columns])
