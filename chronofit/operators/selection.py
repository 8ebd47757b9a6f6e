"""Event selection: single-pulse measurements, peak windows, alignment filters, cut flows, cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fits import photopeak
from .lineage import cut
from .stats import robust_scale


def single_pulses(hits: DataFrame, energy: tuple[int, int] = (1, 5), timing: tuple[int, int] | None = (3, 7)) -> DataFrame:
    """Events with exactly one lead and one later trail on both energy channels and, if asked, one lead on both timing channels.

    run_id, event_index, duration_a, duration_b and, with timing channels, alignment_a, alignment_b, timing.
    """
    lead = lambda c: (F.col("channel") == c) & (F.col("edge") == 1)
    trail = lambda c: (F.col("channel") == c) & (F.col("edge") == 0)
    aggs, keep = [], F.lit(True)
    for s, e in zip("ab", energy, strict=True):
        aggs += [F.count_if(lead(e)).alias(f"nl{s}"), F.count_if(trail(e)).alias(f"nt{s}"), F.min(F.when(lead(e), F.col("toa_lsb"))).alias(f"l{s}"), F.min(F.when(trail(e), F.col("toa_lsb"))).alias(f"t{s}")]
        keep &= (F.col(f"nl{s}") == 1) & (F.col(f"nt{s}") == 1) & (F.col(f"t{s}") > F.col(f"l{s}"))
    out = [(F.col(f"t{s}") - F.col(f"l{s}")).alias(f"duration_{s}") for s in "ab"]
    if timing:
        for s, t in zip("ab", timing, strict=True):
            aggs += [F.count_if(lead(t)).alias(f"nc{s}"), F.min(F.when(lead(t), F.col("toa_lsb"))).alias(f"c{s}")]
            keep &= F.col(f"nc{s}") == 1
        out += [(F.col(f"c{s}") - F.col(f"l{s}")).alias(f"alignment_{s}") for s in "ab"] + [(F.col("cb") - F.col("ca")).alias("timing")]
    return hits.groupBy("run_id", "event_index").agg(*aggs).where(keep).select("run_id", "event_index", *out)


def in_windows(events: DataFrame, windows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Events whose values all lie in their inclusive windows; windows: keys, value_low and value_high for each value."""
    test = F.lit(True)
    for v in values:
        test &= F.col(v).between(F.col(f"{v}_low"), F.col(f"{v}_high"))
    return events.join(windows, list(keys)).where(test).select(*events.columns)


def alignment_filter(events: DataFrame, keys: Sequence[str], values: Sequence[str], z: float = 5.0, floor: float = 2.0, minimum: int = 20, robust: bool = True) -> DataFrame:
    """Events within z scales of the centre of every value; groups of fewer than `minimum` events pass whole.

    Robust centres are median and 1.4826 MAD, others mean and sample deviation; the scale is at least the floor.
    """
    keys, scales = list(keys), None
    test = F.lit(True)
    for v in values:
        if robust:
            s = robust_scale(events, keys, v, floor)
        else:
            s = events.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("center"), F.greatest(F.coalesce(F.stddev_samp(v), F.lit(0.0)), F.lit(floor)).alias("scale"))
        s = s.select(*keys, F.col("n").alias(f"_n_{v}"), F.col("center").alias(f"_c_{v}"), F.col("scale").alias(f"_s_{v}"))
        scales = s if scales is None else scales.join(s, keys)
        test &= (F.col(f"_n_{v}") < minimum) | (F.abs(F.col(v) - F.col(f"_c_{v}")) <= z * F.col(f"_s_{v}"))
    if scales is None:
        return events
    # a table of a row for each group, whose size is known: where groups are few, events aren't shuffled into as few tasks
    return events.join(cut(scales), keys).where(test).select(*events.columns)


def cut_flow(events: DataFrame, keys: Sequence[str], cuts: dict[str, Column]) -> DataFrame:
    """keys, total, the count after each cut in order, selected, rejected; a null test counts as failed."""
    aggs, test = [F.count("*").alias("total")], F.lit(True)
    for name, cut in cuts.items():
        test = test & F.coalesce(cut, F.lit(False))
        aggs.append(F.count_if(test).alias(name))
    return events.groupBy(*keys).agg(*aggs, F.count_if(test).alias("selected"), F.count_if(~test).alias("rejected"))


def upper_noise_limit(events: DataFrame, keys: Sequence[str], noise: str, z: float = 5.0) -> DataFrame:
    """keys, limit: median and z robust scales; the median alone where the scale is 0."""
    return robust_scale(events, keys, noise).select(*keys, (F.col("center") + z * F.col("scale")).alias("limit"))


def photopeak_cohort(events: DataFrame, keys: Sequence[str], amplitudes: Sequence[str], noises: Sequence[str], trigger: str, inside: tuple[int, int], z: float = 5.0, **fit) -> DataFrame:
    """Events with finite amplitudes in every channel's photopeak, noise under its limit, and the trigger strictly inside a range.

    Photopeaks are fitted on one population, the noise limits on what passes them.
    """
    keys, pool = list(keys), events
    for a in amplitudes:
        pool = pool.where(F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double")))
    out = pool
    for a in amplitudes:
        w = photopeak(pool, keys, a, **fit).where("success").select(*keys, F.col("low").alias("_lo"), F.col("high").alias("_hi"))
        out = out.join(w, keys).where(F.col(a).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    peak = out
    for n in noises:
        out = out.join(upper_noise_limit(peak, keys, n, z), keys).where(F.col(n) <= F.col("limit")).drop("limit")
    return out.where((F.col(trigger) > inside[0]) & (F.col(trigger) < inside[1]))


def mismatch_filter(events: DataFrame, keys: Sequence[str], deltas: Sequence[str], z: float = 4.0, most_ps: float | None = None, minimum: int = 3) -> DataFrame:
    """Family by family, events whose time difference lies near the median of those still left.

    The reach is z robust scales (a scale of 0 counts as 1), or fixed. Groups with fewer than `minimum` pairs are dropped.
    """
    keys, out = list(keys), events
    for d in deltas:
        s = robust_scale(out.where(F.col(d).isNotNull()), keys, d).where(F.col("n") >= minimum)
        reach = F.lit(most_ps) if most_ps is not None else z * F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)
        out = out.join(s.select(*keys, "center", "scale"), keys).where(F.abs(F.col(d) - F.col("center")) <= reach).drop("center", "scale")
    return out


def relative_quality(results: DataFrame, keys: Sequence[str], model: str, score: str, baseline: str, limit: float = 2.0) -> DataFrame:
    """Add ratio, the score over the baseline model's best of the same key, and included: finite and within the limit, or the baseline."""
    keys = list(keys)
    base = results.where(F.col(model) == baseline).groupBy(*keys).agg(F.min(score).alias("_base"))
    ratio = F.col(score) / F.col("_base")
    out = results.join(base, keys, "left").withColumn("ratio", ratio)
    ok = F.col("ratio").isNotNull() & ~F.isnan("ratio") & (F.col("ratio") <= limit)
    return out.withColumn("included", (F.col(model) == baseline) | F.coalesce(ok, F.lit(False))).drop("_base")


def included_runs(df: DataFrame, run: str, names: Sequence[str]) -> DataFrame:
    """Rows of the named runs, whatever the case and leading zeros of the names; all rows if no name is given."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"^(run)?0*", "")
    wanted = [n.lower().removeprefix("run").lstrip("0") for n in names]
    return df.where(plain(F.col(run)).isin(wanted)) if wanted else df


def energy_preselection(events: DataFrame, keys: Sequence[str], amplitudes: Sequence[str], noises: Sequence[str], triggers: Sequence[str], inside: tuple[int, int], most_noise: float | Sequence[float], minimum: int = 1, **fit) -> DataFrame:
    """Events with finite amplitude and noise, triggers inside a range, noise under its limit, and every amplitude in its photopeak.

    All tests are on one population; keys with fewer than `minimum` events left are dropped.
    """
    keys = list(keys)
    limits = list(most_noise) if isinstance(most_noise, Sequence) else [most_noise] * len(noises)
    test = F.lit(True)
    for c in (*amplitudes, *noises):
        test &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    for t in triggers:
        test &= (F.col(t) >= 0) & (F.col(t) > inside[0]) & (F.col(t) < inside[1])
    for n, most in zip(noises, limits, strict=True):
        test &= F.col(n) < most
    pool = events.where(test)
    out = pool
    for a in amplitudes:
        w = photopeak(pool, keys, a, **fit).where("success").select(*keys, F.col("low").alias("_lo"), F.col("high").alias("_hi"))
        out = out.join(w, keys).where(F.col(a).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    enough = out.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= minimum).drop("_n")
    return out.join(enough, keys, "left_semi")
