"""Scalar timing expressions: unit conversions, time differences, code tables. All are plain Catalyst columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of the two sides and of the matching states; 255 stands for any other text.
SIDES = {"a": 0, "b": 1}
STATUSES = (
    "accepted", "no_candidate", "no_overlap", "deviation_too_large", "missing_pulse", "write_failed", "other_side_missing", "other_side_deviation",
)
UNKNOWN = 255
#: Width of a Gaussian at half its height, in standard deviations: 2 sqrt(2 ln 2).
FWHM = 2.3548200450309493


def window_lsb(ns: Column, toa_lsb_ps: Column) -> Column:
    """A window in whole LSB, rounded up, at least 1."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(ns * 1000 / toa_lsb_ps))


def duration_limits_lsb(low_ns: Column, high_ns: Column, toa_lsb_ps: Column) -> tuple[Column, Column]:
    """Least (rounded up, at least 1) and greatest (rounded down, at least the least) duration in LSB."""
    low = window_lsb(low_ns, toa_lsb_ps)
    return low, F.greatest(low, F.floor(high_ns * 1000 / toa_lsb_ps))


def tot_tolerance_lsb(tolerance_ns: Column, toa_lsb_ps: Column, tot_lsb_ps: Column) -> Column:
    """Tolerance of a recorded duration: the configured one or one duration bin, whichever is wider, rounded up."""
    return F.greatest(F.ceil(tolerance_ns * 1000 / toa_lsb_ps), window_lsb(tot_lsb_ps / 1000, toa_lsb_ps))


def millivolt(samples: Column, gain: Column, offset: Column) -> Column:
    """(raw * gain - offset) * 1000 for each sample."""
    return F.transform(samples, lambda x: (x.cast("double") * gain - offset) * 1000)


def time_axis_ns(samples: Column, interval_s: Column, start_s: Column) -> Column:
    return F.transform(samples, lambda x, i: (i * interval_s + start_s) * 1e9)


def delta_ps(first_fs: Column, second_fs: Column) -> Column:
    """Difference of two femtosecond times in ps; null where either is missing."""
    return (first_fs - second_fs) / 1000


def anchor_shift_ps(led1: Column, anchor1: Column, led2: Column, anchor2: Column) -> Column:
    """How far the two windows were moved against each other; 0 where an anchor is missing."""
    return F.coalesce(((led1 - anchor1) - (led2 - anchor2)) / 1000, F.lit(0.0))


def correction_target_ps(led_delta: Column, shift: Column, true_tof: Column) -> Column:
    return led_delta - shift - true_tof


def side_code(side: Column) -> Column:
    """0 or 1; anything else fails the query."""
    return F.when(side == "a", 0).when(side == "b", 1).otherwise(F.raise_error(F.concat(F.lit("not a side: "), F.coalesce(side, F.lit("null")))).cast("int"))


def status_code(status: Column) -> Column:
    out = F.when(status == STATUSES[0], 0)
    for k, name in enumerate(STATUSES[1:], 1):
        out = out.when(status == name, k)
    return out.otherwise(UNKNOWN)


def status_name(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, STATUSES)), code.cast("int")), F.lit("unknown"))


def voltage_from_name(name: Column, pattern: str = r"(\d+(?:\.\d+)?)\s*V") -> Column:
    """First group of a pattern as a number; null where it doesn't match."""
    return F.regexp_extract(name, pattern, 1).try_cast("double")


def centred(led: Column, final: Column, led_center: Column, correction_center: Column) -> dict[str, Column]:
    """Centred components of a correction, and by how much it brings an event nearer to zero."""
    led_c, corr_c = led - led_center, (final - led) - correction_center
    return {"led_c": led_c, "corr_c": corr_c, "final_c": led_c + corr_c, "gain": F.abs(led_c) - F.abs(led_c + corr_c)}
