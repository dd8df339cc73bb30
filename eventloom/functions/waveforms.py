"""Charge and time of waveforms: arrays of samples, one array per pixel."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.arrays import argmax, mean
from eventloom.functions.common import let, ratio, total


def subtract_baseline(w: Column, start: int, end: int) -> Column:
    """w less the mean of its samples [start, end)."""
    return let(mean(F.slice(w, start + 1, end - start)), lambda m: F.transform(w, lambda x: x.cast("double") - m))


def around(w: Column, peak: Column, width: int, shift: int, rate: float = 1.0) -> Column:
    """struct(charge, peak_time) over samples [peak - shift, peak - shift + width) that exist; the time is the charge-weighted
    position of the positive samples, or the peak without any, over the sampling rate."""
    lo = F.greatest(peak - shift, F.lit(0))
    hi = F.least(peak - shift + width, F.size(w))
    part = F.slice(w, lo + 1, F.greatest(hi - lo, F.lit(0)))

    def body(p: Column) -> Column:
        num = F.aggregate(F.transform(p, lambda x, i: F.when(x > 0, x.cast("double") * (i + lo)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
        den = F.aggregate(p, F.lit(0.0), lambda s, x: s + F.when(x > 0, x.cast("double")).otherwise(0.0))
        return F.struct(total(p).alias("charge"), (F.coalesce(ratio(num, den), peak.cast("double")) / rate).alias("peak_time"))

    return let(part, body)


def full_sum(w: Column) -> Column:
    return total(w)


def fixed_window(w: Column, peak: int, width: int, shift: int) -> Column:
    return around(w, F.lit(peak), width, shift)


def local_peak(w: Column, width: int, shift: int) -> Column:
    return let(argmax(w), lambda p: around(w, p, width, shift))


def global_peak(waveforms: Column, width: int, shift: int) -> Column:
    """One struct per pixel, around the peak of the mean waveform of all pixels."""
    n = F.size(waveforms[0])
    mean_wave = F.transform(F.sequence(F.lit(0), n - 1), lambda s: F.aggregate(waveforms, F.lit(0.0), lambda acc, w: acc + w[s].cast("double")))
    return let(argmax(mean_wave), lambda p: F.transform(waveforms, lambda w: around(w, p, width, shift)))


def neighbor_peak_index(waveforms: Column, neighbors: Column, local_weight: int = 0) -> Column:
    """Per pixel the peak of its neighbours' summed waveform (its own counted local_weight times)."""
    n = F.size(waveforms[0])

    def one(w: Column, i: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), n - 1), lambda s: w[s].cast("double") * local_weight + F.aggregate(neighbors[i], F.lit(0.0), lambda acc, j: acc + waveforms[j][s].cast("double")))
        return let(sums, argmax)

    return F.transform(waveforms, one)


def neighbor_peak(waveforms: Column, neighbors: Column, width: int, shift: int, local_weight: int = 0) -> Column:
    """One struct per pixel, around the peak of its neighbours' summed waveform."""
    return let(neighbor_peak_index(waveforms, neighbors, local_weight), lambda p: F.transform(waveforms, lambda w, i: around(w, p[i], width, shift)))


def sliding_window(w: Column, width: int) -> Column:
    """struct(charge, start): the first window of `width` samples with the largest sum."""
    sums = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: total(F.slice(w, i + 1, width)))
    return let(sums, lambda s: F.struct(F.array_max(s).alias("charge"), argmax(s).alias("start")))


def shift_waveform(w: Column, samples: Column) -> Column:
    """w moved by whole samples; beyond its ends the edge sample repeats."""
    return F.transform(w, lambda _, i: w[F.greatest(F.lit(0), F.least(F.size(w) - 1, i + samples))])


def select_gain(high: Column, low: Column, threshold: float) -> Column:
    """Per pixel the low-gain waveform where any high-gain sample exceeds the threshold."""
    return F.zip_with(high, low, lambda h, l: F.when(F.exists(h, lambda x: x > threshold), l).otherwise(h))


def calibrate(raw: Column, pedestal: Column, factor: Column) -> Column:
    """(raw - pedestal) * factor for each pixel."""
    return F.transform(F.arrays_zip(raw.alias("r"), pedestal.alias("p"), factor.alias("f")), lambda z: (z["r"].cast("double") - z["p"]) * z["f"])


def integration_correction(pulse: list[float], pulse_step: float, sample_step: float, width: int, shift: int) -> float:
    """1 / share of a reference pulse inside the window around its largest sample, as the pulse is sampled."""
    total_charge = sum(pulse)
    bins: dict[int, float] = {}
    for i, v in enumerate(pulse):
        k = int(i * pulse_step / sample_step)
        bins[k] = bins.get(k, 0.0) + v
    peak = max(bins, key=lambda k: (bins[k], -k))
    inside = sum(bins.get(k, 0.0) for k in range(peak - shift, peak - shift + width))
    return total_charge / inside if inside else float("nan")


def smooth(w: Column, width: int) -> Column:
    """Mean over `width` samples, forward and then backward, so that pulses stay in place; beyond the ends the edge sample repeats."""
    before = width // 2

    def pass_over(a: Column, sign: int) -> Column:
        at = lambda i: a[F.greatest(F.lit(0), F.least(F.size(a) - 1, i))]
        return F.transform(a, lambda _, i: sum((at(i + sign * (k - before)) for k in range(1, width)), at(i - sign * before)).cast("double") / width)

    return let(pass_over(w, -1), lambda a: pass_over(a, 1)) if width > 1 else w


def deconvolve(w: Column, baseline: Column, pole_zero: float, upsampling: int = 1) -> Column:
    """w less its baseline and less pole_zero times the sample before, each sample then repeated `upsampling` times and smoothed."""
    flat = F.transform(w, lambda x: x.cast("double") - baseline)
    sharp = let(flat, lambda a: F.transform(a, lambda x, i: F.when(i == 0, 0.0).otherwise(x - pole_zero * F.try_element_at(a, F.greatest(i, F.lit(1))))))
    if upsampling == 1:
        return sharp
    return let(F.flatten(F.transform(sharp, lambda x: F.array_repeat(x, upsampling))), lambda a: smooth(a, upsampling))


def centroid(w: Column, peak: Column, limit: float) -> Column:
    """Charge-weighted position of the samples about the peak that stay above limit * peak; the peak itself if that is negative."""

    def within(t: Column) -> Column:
        a, at = t["a"], t["at"]
        low = F.array_max(F.transform(a, lambda x, i: F.when((i <= at) & ~(x > t["least"]), i)))
        high = F.array_min(F.transform(a, lambda x, i: F.when((i > at) & ~(x > t["least"]), i)))

        def over_run(b: Column) -> Column:
            run = F.filter(F.transform(a, lambda x, i: F.struct(x.cast("double").alias("x"), i.alias("i"))), lambda p: (p["i"] > b["low"]) & (p["i"] < b["high"]))
            sums = F.aggregate(run, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("m")), lambda s, p: F.struct((s["s"] + p["x"]).alias("s"), (s["m"] + p["x"] * p["i"]).alias("m")), lambda s: ratio(s["m"], s["s"]))
            return F.coalesce(sums, at.cast("double"))

        # a peak of 0 is not above its own limit and starts no run; what follows it may still be
        bounds = F.struct(F.coalesce(low, F.lit(-1)).alias("low"), F.coalesce(high, F.size(a)).alias("high"))
        return F.when(a[at] < 0, at.cast("double")).otherwise(let(bounds, over_run))

    return let(F.struct(w.alias("a"), peak.alias("at")), lambda q: let(F.struct(q["a"].alias("a"), q["at"].alias("at"), (limit * q["a"][q["at"]]).alias("least")), within))


def sharpened_peak(waveforms: Column, neighbors: Column, width: int, shift: int, pole_zero: float, upsampling: int, rate: float, local_weight: int = 0, clipping: float = 0.0, gain: float = 0.0, delay: float = 0.0, lead: float = 0.0, limit: float | None = None) -> Column:
    """struct(charge, peak_time) per pixel around the peak of its neighbours' deconvolved waveforms.

    A finite clipping c > 0 turns what the neighbours add from x into (x / c) / (1 + |x / c|), and 0 where that is negative. With a limit
    the time is the centroid of the rising edge (the waveform deconvolved with 1) near the peak less `lead` samples. A gain or
    delay of 0 is none. rate: samples per nanosecond before upsampling.
    """

    def sharp(by: float) -> Column:
        return F.transform(waveforms, lambda w: deconvolve(w, F.lit(0.0), by, upsampling))

    def soft(x: Column) -> Column:
        return F.greatest(x / clipping / (1 + F.abs(x / clipping)), F.lit(0.0))

    def over(q: Column) -> Column:
        seen = q["a"] if clipping == 0 or math.isinf(clipping) else F.transform(q["a"], lambda w: F.transform(w, soft))

        def one(w: Column, i: Column, peaks: Column) -> Column:
            got = around(w, peaks[i], width, shift, rate * upsampling)
            time = got["peak_time"]
            if limit is not None:
                at = F.least(F.greatest(F.rint(peaks[i] - lead).cast("int"), F.lit(0)), F.size(w) - 1)
                time = centroid(q["edge"][i], at, limit) / (rate * upsampling)
            return F.struct((got["charge"] / gain if gain else got["charge"]).alias("charge"), (time - delay).alias("peak_time"))

        return let(seen, lambda v: let(neighbor_peak_index(v, neighbors, local_weight), lambda p: F.transform(q["a"], lambda w, i: one(w, i, p))))

    parts = [sharp(pole_zero).alias("a")] + ([sharp(1.0).alias("edge")] if limit is not None else [])
    return let(F.struct(*parts), over)


@dataclass(frozen=True)
class Deconvolution:
    """What sharpened_peak needs of a camera, from its reference pulse: the names are those of its arguments."""

    pole_zero: float
    gain: float
    delay: float
    lead: float


def _sharp(x: np.ndarray, pole_zero: float, upsampling: int) -> np.ndarray:
    """deconvolve with no baseline, for one numpy waveform."""
    y = np.concatenate([[0.0], x[1:] - pole_zero * x[:-1]])
    if upsampling == 1:
        return y
    y = np.repeat(y, upsampling)
    box, before = np.ones(upsampling) / upsampling, upsampling // 2
    after = upsampling - 1 - before
    for _ in range(2):  # forward, then on what is turned round
        y = np.convolve(np.pad(y, (after, before), mode="edge"), box, "valid")[::-1]
    return y


def _centre(d: np.ndarray, peak: int, limit: float) -> float:
    if d[peak] < 0:
        return float(peak)
    above = d > limit * d[peak]
    low, high = peak, peak
    while low > 0 and above[low - 1]:
        low -= 1
    while high + 1 < len(d) and above[high + 1]:
        high += 1
    part = d[low : high + 1]
    return float((part * np.arange(low, high + 1)).sum() / part.sum()) if part.sum() else float(peak)


def deconvolution(pulse: Sequence[float], pulse_step: float, sample_step: float, upsampling: int, width: int, shift: int, limit: float | None = None, profile: float = 0.0) -> Deconvolution:
    """Pole-zero factor, gain, delay and lead of the edge for a reference pulse sampled every pulse_step ns in a camera that samples every sample_step ns.

    All are means over the phases in which the camera can meet the pulse. The factor is the decay from the sample after the steepest fall to the next one. The gain is the
    share of the pulse's charge in the window about its sharpened peak, for light spread in time by a Gaussian of `profile` ns (0: none). With a limit the delay is that of the rising edge's
    centroid, else of the peak; lead: samples from the edge's peak to the sharpened one. Phases whose window leaves the pulse do not count; an error if none is left.
    """
    if upsampling < 1 or width < 1:
        raise ValueError("upsampling and width must be at least 1")
    if sample_step < pulse_step:
        raise ValueError("the reference pulse must be sampled at least as finely as the camera samples")
    pulse = np.asarray(pulse, float)
    step = round(sample_step / pulse_step)
    decays = []
    for phase in range(step):
        x = pulse[phase::step]
        i = int(np.argmin(np.diff(x))) + 1
        if i + 1 < len(x):
            decays.append(x[i + 1] / x[i])
    if not decays:
        raise ValueError("no decay in the reference pulse")
    pole_zero = float(np.mean(decays))
    seen = pulse
    if profile:
        t = (np.arange(len(pulse)) - len(pulse) / 2) * pulse_step
        seen = np.convolve(pulse, np.exp(-((t / profile) ** 2) / 2) / (profile * math.sqrt(2 * math.pi)), "same")
    charge = seen.sum() * pulse_step / sample_step
    gains, delays, leads = [], [], []
    for phase in range(step):
        x = seen[phase::step]
        y = _sharp(x, pole_zero, upsampling)
        peak = int(y.argmax())
        if peak - shift < 0 or peak - shift + width > len(y):
            continue
        at = float(peak)
        if limit is not None:
            edge = _sharp(x, 1.0, upsampling)
            leads.append(peak - int(edge.argmax()))
            at = _centre(edge, int(edge.argmax()), limit)
        delays.append((at / upsampling * step - int(seen.argmax())) * pulse_step)
        gains.append(y[peak - shift : peak - shift + width].sum() / charge)
    if not gains:
        raise ValueError("the peak of the reference pulse is not contained")
    return Deconvolution(pole_zero, float(np.mean(gains)), float(np.mean(delays)), float(np.mean(leads)) if leads else 0.0)
