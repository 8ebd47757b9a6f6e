"""Channel and event extraction: features, reference times and anchored windows of pulses, as struct columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import waveform as W


@dataclass(frozen=True)
class ChannelSettings:
    """How a channel is read. Samples lie on a grid of step_s from start_s; windows are in samples about the anchor."""

    step_s: float
    start_s: float
    baseline: int = 500
    trigger_mv: float = 50.0
    polarity: int = 1
    led_mv: float | None = 10.0
    cfd_fraction: float | None = 0.045
    crop_before: int = 1000
    crop_after: int = 1000
    window_before: int = 2000
    window_after: int = 24000


_D, _I, _L, _W = T.DoubleType(), T.IntegerType(), T.LongType(), T.ArrayType(T.FloatType())
CHANNEL = {
    "valid": T.BooleanType(), "baseline_mv": _D, "noise_mv": _D, "amplitude_mv": _D, "peak_index": _I, "trigger_index": _I,
    "led_fs": _L, "cfd_fs": _L, "anchor_fs": _L, "window": _W, "aligned_window": _W,
}
SCHEMA = T.StructType([T.StructField(k, v) for k, v in CHANNEL.items()])


def _rising(y: np.ndarray, level: float, first: bool) -> float | None:
    """First or last rising crossing in samples; a touched sample counts where nothing crosses."""
    k = np.flatnonzero((y[:-1] < level) & (y[1:] >= level))
    if not len(k):
        k = np.flatnonzero((y[:-1] == level) & (y[1:] > level))
    if not len(k):
        return None
    i = int(k[0] if first else k[-1])
    return i + (level - y[i]) / (y[i + 1] - y[i])


def read_channel(y: np.ndarray, s: ChannelSettings, align_fs: float | None) -> tuple:
    """The fields of CHANNEL for one trace in mV."""
    head = y[: s.baseline]
    base = float(head.mean()) if len(head) else None
    noise = float(np.sqrt(((head - base) ** 2).mean())) if len(head) else None
    signal = y * s.polarity
    peak = int(signal.argmax())
    over = np.flatnonzero(signal > s.trigger_mv)
    trigger = int(over[0]) if len(over) else -1
    features = (base, noise, float(signal.max()), peak, trigger)
    fs = lambda p: None if p is None else int(np.rint((s.start_s + p * s.step_s) * 1e15))
    lo, hi = max(0, trigger - s.crop_before - 1), min(len(signal) - 1, trigger + s.crop_after + 1)
    cut = signal[lo : hi + 1]
    if trigger < 0 or len(cut) < 2 or not np.isfinite(cut).all() or cut.max() <= 0:
        return (False, *features, None, None, None, None, None)
    shifted = lambda p: None if p is None else lo + p
    led = fs(shifted(_rising(cut, s.led_mv, True))) if s.led_mv is not None else None
    cfd = fs(shifted(_rising(cut[: cut.argmax() + 1], s.cfd_fraction * cut.max(), False))) if s.cfd_fraction is not None else None
    own = led if s.led_mv is not None else cfd

    def window(at: float | None) -> tuple:
        if at is None:
            return None, None
        k = int(np.rint((at / 1e15 - s.start_s) / s.step_s))
        a, b = k - s.window_before, k + s.window_after + 1
        return k, signal[a:b].astype(np.float32) if a >= 0 and b <= len(signal) else None

    k, w = window(own)
    ok = w is not None and (s.led_mv is None or led is not None) and (s.cfd_fraction is None or cfd is not None)
    aligned = None
    if align_fs is not None:
        aligned = window(None if np.isnan(align_fs) else align_fs)[1]
        ok = ok and aligned is not None
    return (ok, *features, led, cfd, None if k is None else fs(float(k)), w if ok else None, aligned if ok else None)


def channel(mv: Column, s: ChannelSettings, align_fs: Column | None = None) -> Column:
    """A struct of CHANNEL's fields; aligned_window lies about align_fs, if that is given.

    The reference times come from the crop about the trigger. The channel is invalid without a trigger, with a
    missing reference time, with a sample that isn't finite, or where a window leaves the trace; an invalid channel
    has null windows, and a null or empty trace null features. Traces go to numpy in Arrow batches: as one
    expression, crop, crossings and windows would repeat each other many times over.
    """
    asked = align_fs is not None

    @F.pandas_udf(SCHEMA)
    def run(trace: pd.Series, align: pd.Series) -> pd.DataFrame:
        none = (False, None, None, None, None, -1, None, None, None, None, None)
        rows = [none if y is None or not len(y) else read_channel(np.asarray(y, float), s, float(a) if asked and a is not None else (np.nan if asked else None)) for y, a in zip(trace, align, strict=True)]
        out = pd.DataFrame(rows, columns=list(CHANNEL))
        for c in ("led_fs", "cfd_fs", "anchor_fs"):
            out[c] = out[c].astype("Int64")
        for c in ("peak_index", "trigger_index"):
            out[c] = out[c].astype("Int32")
        return out

    return run(mv, (align_fs if asked else F.lit(None)).cast("double"))


def event(df: DataFrame, energy: tuple[str, str], energy_settings: ChannelSettings, timing: tuple[str, str] | None = None, timing_settings: ChannelSettings | None = None) -> DataFrame:
    """df with energy1, energy2 and, where there are timing channels, timing1 and timing2, standard times and valid.

    Standard leading-edge and constant-fraction times come from the timing channels where there are any, else from
    the energy channels; each energy channel then also has a window about its timing channel's leading edge.
    """
    out = df
    if timing:
        s = timing_settings or energy_settings
        for k, c in enumerate(timing, 1):
            out = out.withColumn(f"timing{k}", channel(F.col(c), s))
    for k, c in enumerate(energy, 1):
        out = out.withColumn(f"energy{k}", channel(F.col(c), energy_settings, F.col(f"timing{k}.led_fs") if timing else None))
    names = ["energy1", "energy2", *(["timing1", "timing2"] if timing else [])]
    valid = F.lit(True)
    for n in names:
        valid &= F.col(f"{n}.valid")
    kind = "timing" if timing else "energy"
    times = {f"{t}{k}_fs": F.col(f"{kind}{k}.{t}_fs") for t in ("led", "cfd") for k in (1, 2)}
    return out.withColumns({**times, "valid": valid})


#: Channel modes: the input windows' family and the target times' family.
MODES = {"energy_to_energy": ("energy", "energy"), "energy_to_timing": ("energy", "timing"), "timing_to_timing": ("timing", "timing")}
ALIASES = {"energy": "energy_to_energy", "e2e": "energy_to_energy", "e2t": "energy_to_timing", "timing": "timing_to_timing", "t2t": "timing_to_timing"}


def mode_view(events: DataFrame, mode: str) -> DataFrame:
    """event_index, mode, window1, window2, led1_fs ... anchor2_fs of a channel mode; a family that is missing is an error."""
    name = ALIASES.get(mode, mode)
    if name not in MODES:
        raise ValueError(f"unknown channel mode {mode}")
    source, target = MODES[name]
    for family in {source, target}:
        if f"{family}1" not in events.columns:
            raise ValueError(f"the events have no {family} channels")
    window = "aligned_window" if source != target else "window"
    anchor = target if source != target else source
    return events.where("valid").select(
        "event_index", F.lit(name).alias("mode"), *(F.col(f"{source}{k}.{window}").alias(f"window{k}") for k in (1, 2)),
        *(F.col(f"{target}{k}.{t}_fs").alias(f"{t}{k}_fs") for t in ("led", "cfd") for k in (1, 2)), *(F.col(f"{anchor}{k}.anchor_fs").alias(f"anchor{k}_fs") for k in (1, 2)),
    )


def same_edge_times(y: Column, levels: list[float], reference: Column, reference_level: float, tolerance: float = 1.5) -> Column:
    """Times of several levels on the edge that holds a reference crossing, as positions in samples.

    A level below the reference takes its last rising crossing at or before the reference, one above it the first
    crossing after it and before the next peak; the reference level itself is the reference. Crossings may lie past
    the reference by the tolerance.
    """

    def one(level: Column) -> Column:
        found = W.crossings(y, level)
        before = F.try_element_at(F.filter(found, lambda p: p <= reference + tolerance), F.lit(-1))
        top = reference.cast("int") + W.peak_index(F.slice(y, reference.cast("int") + 1, F.size(y)))
        after = F.get(F.filter(found, lambda p: (p >= reference - tolerance) & (p <= top)), F.lit(0))
        return F.when(level == reference_level, reference).when(level < reference_level, before).otherwise(after)

    return F.transform(F.array(*map(F.lit, levels)), one)


def apply_selection(view: DataFrame, led_fs: tuple[Column, Column], step_fs: float) -> DataFrame:
    """The view with new leading-edge times, its windows moved by whole samples to them, and the anchors moved along."""
    out = view
    for k, new in zip((1, 2), led_fs, strict=True):
        shift = F.rint((new - F.col(f"anchor{k}_fs")) / step_fs).cast("int")
        out = out.withColumn(f"_shift{k}", shift).withColumn(f"led{k}_fs", new)
    for k in (1, 2):
        moved = W.realigned(F.col(f"window{k}"), F.col(f"_shift{k}"))
        out = out.withColumn(f"window{k}", moved).withColumn(f"anchor{k}_fs", (F.col(f"anchor{k}_fs") + F.col(f"_shift{k}") * step_fs).cast("long"))
    return out.drop("_shift1", "_shift2")


def shift_support(view: DataFrame, led_fs: tuple[Column, Column], step_fs: float, spare: tuple[int, int]) -> DataFrame:
    """least and greatest shift, and ok: whether every shifted window stays inside `spare` samples on either side."""
    s = F.array(*(F.rint((new - F.col(f"anchor{k}_fs")) / step_fs).cast("int") for k, new in zip((1, 2), led_fs, strict=True)))
    d = view.select(F.explode(s).alias("s")).agg(F.min("s").alias("least"), F.max("s").alias("greatest"))
    return d.withColumn("ok", (F.col("least") >= -spare[0]) & (F.col("greatest") <= spare[1]))
