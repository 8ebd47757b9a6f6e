"""Array functions over sampled pulses, as Catalyst higher-order functions on array<double> columns.

Samples are on a uniform grid: sample i lies at start + i * step. Times are null where there is no valid crossing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: inside a lambda, Spark computes an expression anew for each element and each mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def first_index(a: Column, test) -> Column:
    """0-based index of the first element that passes, or null."""
    return F.get(F.filter(F.transform(a, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull()), F.lit(0))


def peak_index(a: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def basic_features(mv: Column, baseline: int, threshold: float, polarity: int = 1) -> dict[str, Column]:
    """Baseline and noise of the first samples, amplitude, peak and trigger index; the baseline isn't subtracted."""
    head = F.slice(mv, 1, baseline)
    base = mean(head)
    noise = F.sqrt(F.aggregate(head, F.lit(0.0), lambda s, x: s + (x - base) * (x - base)) / F.size(head))
    signal = F.transform(mv, lambda x: x * polarity)
    return {
        "baseline_mv": base, "noise_mv": noise, "amplitude_mv": F.array_max(signal), "peak_index": peak_index(signal),
        "trigger_index": F.coalesce(first_index(signal, lambda x: x > threshold), F.lit(-1)),
    }


def crossings(y: Column, level: Column | float) -> Column:
    """Rising crossings of a level as positions in samples, ascending.

    Between k and k+1 with y[k] < level <= y[k+1], interpolated; a sample at the level that is followed by a
    greater one, and not reached from below, counts where no such pair exists.
    """
    level = F.lit(level) if not isinstance(level, Column) else level
    return let(y, lambda v: let(level, lambda t: _crossings(v, t)))


def _crossings(y: Column, level: Column) -> Column:
    pair = F.transform(F.sequence(F.lit(0), F.size(y) - 2), lambda k: F.struct(k.alias("k"), F.get(y, k).alias("a"), F.get(y, k + 1).alias("b")))
    rising = lambda d: F.filter(d, lambda p: (p["a"] < level) & (p["b"] >= level))
    touching = lambda d: F.filter(d, lambda p: (p["a"] == level) & (p["b"] > level))
    found = let(pair, lambda d: let(rising(d), lambda r: F.when(F.size(r) > 0, r).otherwise(touching(d))))
    place = lambda p: p["k"] + (level - p["a"]) / (p["b"] - p["a"])
    return F.when(F.size(y) >= 2, F.transform(found, place)).otherwise(F.array().cast("array<double>"))


def first_crossing(y: Column, level: Column | float) -> Column:
    return F.get(crossings(y, level), F.lit(0))


def last_crossing_before_peak(y: Column, level: Column | float) -> Column:
    """Last rising crossing among the samples up to the first maximum."""
    return let(y, lambda v: F.try_element_at(crossings(F.slice(v, 1, peak_index(v) + 1), level), F.lit(-1)))


def leading_edge(y: Column, threshold: Column | float) -> Column:
    """First sample at or above a positive threshold, interpolated from the one before it; null if that is sample 0 or flat."""
    t = F.lit(threshold) if not isinstance(threshold, Column) else threshold

    def at(v: Column, k: Column) -> Column:
        a, b = F.get(v, k - 1), F.get(v, k)
        return F.when((t > 0) & (k > 0) & (a != b), (k - 1) + (t - a) / (b - a))

    return let(y, lambda v: let(first_index(v, lambda x: x >= t), lambda k: at(v, k)))


def femtoseconds(position: Column, step_s: float, start_s: float) -> Column:
    """Position in samples to whole femtoseconds, half to even."""
    return F.rint((start_s + position * step_s) * 1e15).cast("long")


def led_grid(y: Column, thresholds: list[float]) -> Column:
    return let(y, lambda v: F.transform(F.array(*map(F.lit, thresholds)), lambda t: leading_edge(v, t)))


def cfd_grid(y: Column, fractions: list[float]) -> Column:
    return let(y, lambda v: F.transform(F.array(*map(F.lit, fractions)), lambda f: last_crossing_before_peak(v, f * F.array_max(v))))


def crop(y: Column, center: Column, before: int, after: int) -> Column:
    """Samples from center - before to center + after and one more on each side, within the trace; null under two samples."""
    lo = F.greatest(F.lit(0), center - before - 1)
    hi = F.least(F.size(y) - 1, center + after + 1)
    return F.when((center >= 0) & (hi - lo >= 1), F.slice(y, lo + 1, hi - lo + 1))


def anchored_window(y: Column, anchor: Column, before: int, after: int) -> Column:
    """Samples anchor - before to anchor + after as float; null if that leaves the trace."""
    lo, n = anchor - before, before + after + 1
    return F.when((lo >= 0) & (lo + n <= F.size(y)), F.slice(y, lo + 1, n).cast("array<float>"))


def realigned(y: Column, shift: Column) -> Column:
    """y moved by whole samples; null where a sample comes from outside."""
    return F.transform(y, lambda x, i: F.when((i + shift >= 0) & (i + shift < F.size(y)), F.get(y, (i + shift).cast("int"))))


def subsample(y: Column, k: int) -> Column:
    return F.filter(y, lambda x, i: i % k == 0)


def threshold_differences(y1: Column, y2: Column, thresholds: list[float], step_ps: float) -> Column:
    """Per threshold the difference of the two last crossings before the peak, in ps; null where either is missing."""
    return F.transform(F.array(*map(F.lit, thresholds)), lambda t: (last_crossing_before_peak(y1, t) - last_crossing_before_peak(y2, t)) * step_ps)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def centred(a: Column) -> Column:
    m = mean(a)
    return F.transform(a, lambda x: x - m)


def cosine(a: Column, b: Column) -> Column:
    """Null where either row is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


#: Features that lie on the time axis: they have a difference, but no asymmetry.
TIME_FEATURES = ("time_max", "time_min", "centroid", "slope")


def shape_features(y: Column, times: Column, early: int, late: int) -> dict[str, Column]:
    """Fourteen features of a pulse: extremes, mean, sample deviation, areas, times, slope, early and late means."""
    n, m, mt = F.size(y), mean(y), mean(times)
    step = F.get(times, F.lit(1)) - F.get(times, F.lit(0))
    trapezoid = lambda a: step * (F.aggregate(a, F.lit(0.0), lambda s, x: s + x) - (F.get(a, F.lit(0)) + F.try_element_at(a, F.lit(-1))) / 2)
    low = F.array_min(y)
    lifted = F.transform(y, lambda x: x - low)
    total = F.aggregate(lifted, F.lit(0.0), lambda s, x: s + x)
    ct = F.transform(times, lambda t: t - mt)
    first, last = mean(F.slice(y, 1, early)), mean(F.slice(y, n - late + 1, late))
    return {
        "maximum": F.array_max(y), "minimum": low, "peak_to_peak": F.array_max(y) - low, "average": m,
        "deviation": F.sqrt(F.aggregate(y, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / (n - 1)),
        "area": trapezoid(y), "area_abs": trapezoid(F.transform(y, F.abs)),
        "time_max": F.get(times, peak_index(y)), "time_min": F.get(times, (F.array_position(y, low) - 1).cast("int")),
        "centroid": F.when(total > 0, dot(lifted, times) / total), "slope": dot(centred(y), ct) / dot(ct, ct),
        "early": first, "late": last, "early_late": first - last,
    }


def asymmetry(a: Column, b: Column) -> Column:
    s = F.abs(a) + F.abs(b)
    return F.when(s > 1e-12, (a - b) / s)


def butterworth_sections(cutoff: float, order: int) -> list[tuple[float, float, float, float, float]]:
    """Low-pass sections (b0, b1, b2, a1, a2) by the bilinear transform; cutoff as a fraction of the Nyquist frequency."""
    if not 0 < cutoff < 1:
        raise ValueError("the cutoff must lie below the Nyquist frequency")
    w = np.tan(np.pi * cutoff / 2)
    out = []
    for k in range(order // 2):
        q = 2 * np.sin(np.pi * (2 * k + 1) / (2 * order))
        d = 1 + q * w + w * w
        out.append((w * w / d, 2 * w * w / d, w * w / d, 2 * (w * w - 1) / d, (1 - q * w + w * w) / d))
    if order % 2:
        out.append((w / (1 + w), w / (1 + w), 0.0, (w - 1) / (1 + w), 0.0))
    return out


def _cascade(x: np.ndarray, sections: list) -> np.ndarray:
    """Run the sections along the last axis, each from the steady state of its first sample."""
    for b0, b1, b2, a1, a2 in sections:
        x0 = x[:, 0]
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        z1, z2 = x0 * (gain - b0), x0 * (b2 - a2 * gain)
        y = np.empty_like(x)
        for t in range(x.shape[1]):
            v = x[:, t]
            y[:, t] = b0 * v + z1
            z1, z2 = b1 * v - a1 * y[:, t] + z2, b2 * v - a2 * y[:, t]
        x = y
    return x


def zero_phase(x: np.ndarray, sections: list, pad: int) -> np.ndarray:
    """Forward and backward filtering with odd extension at both ends."""
    pad = min(pad, x.shape[1] - 1)
    left, right = 2 * x[:, :1] - x[:, pad:0:-1], 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]
    y = _cascade(np.concatenate([left, x, right], axis=1), sections)
    y = _cascade(y[:, ::-1], sections)[:, ::-1]
    return y[:, pad : y.shape[1] - pad]


def low_pass(cutoff: float, order: int):
    """A column function that denoises array<double>; traces of one length are filtered together, nulls stay null."""
    sections = butterworth_sections(cutoff, order)
    pad = 3 * (2 * len(sections) + 1 - sum(s[2] == 0 for s in sections))

    @F.pandas_udf("array<double>")
    def run(col: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(col), index=col.index, dtype=object)
        sizes = col.map(lambda v: -1 if v is None else len(v))
        for n in sizes.unique():
            at = np.flatnonzero(sizes.to_numpy() == n)
            if n < 0:
                continue
            rows = np.stack([np.asarray(col.iloc[i], dtype=float) for i in at]) if n else np.zeros((len(at), 0))
            done = zero_phase(rows, sections, pad) if n > 1 else rows
            for i, r in zip(at, done, strict=True):
                out.iloc[i] = r
        return out

    return run
