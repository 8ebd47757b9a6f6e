"""Grouped statistics: robust location and scale, residual metrics, correlations, profiles, bootstrap."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofit.functions.timing import FWHM

from .lineage import cut
from .quantiles import counted, finite, quantiles


def _spread(values: DataFrame, q: DataFrame, middle: int) -> DataFrame:
    """_group, n, q, mad, sq (sum of squares about the mean): the spread of counted values about q[middle]."""
    off = F.col("v") - F.col("q")[middle]
    away = values.join(q, "_group").groupBy("_group", "n", "q", F.abs(off).alias("v")).agg(F.sum("w").alias("w"), F.sum(F.col("w") * off).alias("_s"), F.sum(F.col("w") * off * off).alias("_q"))
    away = cut(away)
    mad = quantiles(away.select("_group", "v", "w"), [0.5]).select("_group", F.col("q")[0].alias("mad"))
    moments = away.groupBy("_group", "n", "q").agg(F.sum("_s").alias("_s"), F.sum("_q").alias("_q"))
    return moments.join(mad, "_group").withColumn("sq", F.greatest(F.lit(0.0), F.col("_q") - F.col("_s") * F.col("_s") / F.col("n"))).drop("_s", "_q")


def robust_counts(values: DataFrame, floor: float = 0.0) -> DataFrame:
    """_group, n, center, scale of counted values."""
    s = _spread(values, quantiles(values, [0.5]), 0)
    deviation = F.when(F.col("n") > 1, F.sqrt(F.col("sq") / (F.col("n") - 1))).otherwise(0.0)
    scale = F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).otherwise(deviation)
    return s.select("_group", "n", F.col("q")[0].alias("center"), F.greatest(scale, F.lit(float(floor))).alias("scale"))


def _keys(keys: Sequence[str]) -> list[Column]:
    return [F.col(f"_group.{k}") for k in keys]


def robust_scale(df: DataFrame, keys: Sequence[str], value: str, floor: float = 0.0) -> DataFrame:
    """keys, n, center, scale: the median, and 1.4826 MAD or, where that is 0, the sample deviation, at least `floor`.

    Only finite values count; a group without any has no row.
    """
    return robust_counts(cut(counted(df, keys, F.col(value))), floor).select(*_keys(keys), "n", "center", "scale")


def span_scale(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, center, scale for fits: the median and half the 15.87 to 84.13 % span, else MAD, else the population deviation, else 1."""
    values = cut(counted(df, keys, F.col(value)))
    s = _spread(values, quantiles(values, [0.1587, 0.5, 0.8413]), 1)
    span, deviation = (F.col("q")[2] - F.col("q")[0]) / 2, F.sqrt(F.col("sq") / F.col("n"))
    scale = F.when(span > 0, span).when(F.col("mad") > 0, 1.4826 * F.col("mad")).when(deviation > 0, deviation).otherwise(1.0)
    return s.select(*_keys(keys), F.col("q")[1].alias("center"), scale.alias("scale"))


def clipped_delay(df: DataFrame, keys: Sequence[str], value: str, z: float = 3.5, rounds: int = 8, floor: float = 2.0, minimum: int = 20) -> DataFrame:
    """Sigma-clipped average: keys, mean, deviation, center, scale, n_input, n_kept, rounds; groups under `minimum` have a null mean.

    Each round takes the robust centre and scale of what is kept and keeps, of all values, those within z scales; a
    group stops when nothing changes or too few would stay. The rounds run on the counted values, and carry two numbers
    for each group. Only finite values count.
    """
    values = cut(counted(df, keys, F.col(value)))
    everything = df.select(F.struct(F.lit(0).alias("_"), *keys).alias("_group"), finite(F.col(value)).alias("v")).groupBy("_group").agg(F.count("v").alias("n_input"))
    everything = cut(everything)
    inf = float("inf")
    limits = everything.select("_group", F.lit(-inf).alias("low"), F.lit(inf).alias("high"), F.lit(0).alias("rounds"), (F.col("n_input") >= minimum).alias("live"))
    v = F.col("v")
    within = lambda low, high: v.between(F.col(low), F.col(high))
    for _ in range(rounds):
        kept = values.join(limits.where("live"), "_group").where(within("low", "high")).select("_group", "v", "w")
        new = robust_counts(kept, floor).select("_group", (F.col("center") - z * F.col("scale")).alias("low2"), (F.col("center") + z * F.col("scale")).alias("high2"))
        both = limits.join(new, "_group")
        counts = values.join(both, "_group").groupBy("_group", "low2", "high2").agg(
            F.sum(F.when(within("low2", "high2"), F.col("w")).otherwise(0)).alias("_k"), F.count_if(within("low2", "high2") != within("low", "high")).alias("_moved")
        )
        go = F.coalesce(F.col("live") & (F.col("_k") >= minimum) & (F.col("_moved") > 0), F.lit(False))
        limits = cut(limits.join(counts, "_group", "left").select(
            "_group", F.when(go, F.col("low2")).otherwise(F.col("low")).alias("low"), F.when(go, F.col("high2")).otherwise(F.col("high")).alias("high"), (F.col("rounds") + go.cast("int")).alias("rounds"), go.alias("live"),
        ))
        if limits.where("live").isEmpty():
            break
    kept = values.join(limits, "_group").where(within("low", "high")).select("_group", "v", "w")
    mean = F.sum(v * F.col("w")) / F.sum("w")
    means = kept.groupBy("_group").agg(mean.alias("mean"), F.sum("w").alias("n_kept"))
    off = v - F.col("mean")
    spread = kept.join(means, "_group").groupBy("_group").agg(F.sqrt(F.sum(F.col("w") * off * off) / F.nullif(F.sum("w") - 1, F.lit(0))).alias("deviation"))
    out = everything.join(means, "_group", "left").join(spread, "_group", "left").join(robust_counts(kept, floor).drop("n"), "_group", "left").join(limits.select("_group", "rounds"), "_group")
    enough = F.col("n_input") >= minimum
    return out.select(*_keys(keys), *(F.when(enough, F.col(c)).alias(c) for c in ("mean", "deviation", "center", "scale")), "n_input", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), "rounds")


def residual_metrics(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, n, mean_ps, std_ps, ctr_ps (2.3548 sample deviations), rmse_ps, variance_ps2 (population) over finite values."""
    v = finite(F.col(value))
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean_ps"), F.stddev_samp(v).alias("std_ps"), (F.stddev_samp(v) * FWHM).alias("ctr_ps"),
        F.sqrt(F.avg(v * v)).alias("rmse_ps"), F.var_pop(v).alias("variance_ps2"),
    )


def bias_objective(variance: Column, bias: Column, weight: float) -> Column:
    return variance + weight * bias * bias


def average_rank(value: str, keys: Sequence[str] = ()) -> Column:
    """Rank from 1 within the keys, ties at their average."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(w.partitionBy(*keys, value)) - 1) / 2


def correlations(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """keys, n, pearson, spearman, slope, intercept, r2 over rows where both are finite; fewer than 3 rows give nulls.

    Ranks are taken over the distinct values of a group and weighted by their counts, so what a task sorts is as
    long as the group has different values.
    """
    keys = list(keys)
    d = df.select(*keys, finite(F.col(x)).alias("x"), finite(F.col(y)).alias("y")).where("x is not null and y is not null")
    for c in ("x", "y"):
        counts = d.groupBy(*keys, c).agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        d = d.join(counts.select(*keys, c, (before + (F.col("_n") + 1) / 2).alias(f"r{c}")), [*keys, c])
    enough = F.count("*") >= 3
    return d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.when(enough, F.corr("x", "y")).alias("pearson"), F.when(enough, F.corr("rx", "ry")).alias("spearman"),
        F.when(enough, F.regr_slope("y", "x")).alias("slope"), F.when(enough, F.regr_intercept("y", "x")).alias("intercept"), F.when(enough, F.regr_r2("y", "x")).alias("r2"),
    )


def plane(df: DataFrame, keys: Sequence[str], x1: str, x2: str, y: str) -> DataFrame:
    """keys, b1, b2, b0 of the least-squares plane y = b0 + b1 x1 + b2 x2, from covariances; null where they are singular."""
    c = lambda a, b: F.covar_pop(a, b)
    s = df.groupBy(*keys).agg(
        c(x1, x1).alias("s11"), c(x2, x2).alias("s22"), c(x1, x2).alias("s12"), c(x1, y).alias("s1y"), c(x2, y).alias("s2y"),
        F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.avg(y).alias("my"),
    )
    det = F.expr("s11 * s22 - s12 * s12")
    b1, b2 = F.when(det != 0, F.expr("s1y * s22 - s2y * s12") / det), F.when(det != 0, F.expr("s2y * s11 - s1y * s12") / det)
    return s.select(*keys, b1.alias("b1"), b2.alias("b2"), (F.col("my") - b1 * F.col("m1") - b2 * F.col("m2")).alias("b0"))


def binned_profile(df: DataFrame, keys: Sequence[str], x: str, y: str, most: int = 40, least: int = 20) -> DataFrame:
    """keys, bin, n, x_median, y_median, y_std in equal-width bins, the last one closed; bins of few rows are left out."""
    keys = list(keys)
    r = df.groupBy(*keys).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.least(F.lit(most), F.greatest(F.lit(10), F.floor(F.sqrt(F.count(x))))).cast("int").alias("k"))
    b = F.least(F.floor((F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("k")), F.col("k") - 1).cast("int")
    d = df.join(r, keys).where(F.col("hi") > F.col("lo")).withColumn("bin", b)
    out = d.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.percentile(x, 0.5).alias("x_median"), F.percentile(y, 0.5).alias("y_median"), F.stddev_samp(y).alias("y_std"))
    return out.where(F.col("n") >= least)


#: Groups whose replicate sums a task holds before it passes them on.
HELD_GROUPS = 256
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def poisson_weights(hashes: np.ndarray, replicates: int) -> np.ndarray:
    """Poisson(1) weights, rows x replicates, that follow from each row's hash and the replicate alone."""
    step = (np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    x = hashes.astype(np.int64).view(np.uint64)[:, None] + step
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(_POISSON, (x ^ (x >> np.uint64(31))) / 2.0**64, side="right").astype(np.int64)


def replicate_sums(df: DataFrame, keys: Sequence[str], hashed: Column, value: Column, replicates: int, cells: Sequence[Column] = ()) -> DataFrame:
    """keys, cell, rep, n, s, q: in every replicate, the sums of weights, weighted values and weighted squares of each cell of each group.

    A row counts once for each of `cells` (whole numbers; without any, for cell 0), with the same Poisson(1) weight in all of them.
    For large groups that has the distribution of fixed-size resampling. A task adds up its rows in one table of cells by
    replicates and passes on only that, so the shuffle doesn't grow with the rows.
    """
    keys, parts = list(keys), list(cells) or [F.lit(0).cast("long")]
    d = df.select(*keys, hashed.alias("_h"), value.cast("double").alias("_v"), *(c.cast("long").alias(f"_c{i}") for i, c in enumerate(parts))).where("_v is not null")
    names = [f"_c{i}" for i in range(len(parts))]

    def run(frames):
        held: dict[tuple, dict[int, np.ndarray]] = {}

        def passed_on():
            for key, table in held.items():
                for cell, sums in table.items():
                    yield pd.DataFrame({**{k: pd.Series([x], dtype=object) for k, x in zip(keys, key, strict=True)}, "cell": [cell], **{c: [row] for c, row in zip("nsq", sums, strict=True)}})
            held.clear()

        for pdf in frames:
            for key, part in pdf.groupby(keys, dropna=False) if keys else [((), pdf)]:
                v = part["_v"].to_numpy(float)
                for lo in range(0, len(part), 4096):
                    x = v[lo : lo + 4096, None]
                    w = poisson_weights(part["_h"].to_numpy()[lo : lo + 4096], replicates)
                    table = held.setdefault(tuple(None if y != y else y for y in key), {})
                    for name in names:
                        cell = part[name].to_numpy()[lo : lo + 4096]
                        order = np.argsort(cell, kind="stable")
                        found, first = np.unique(cell[order], return_index=True)
                        sums = [np.add.reduceat(y[order], first, axis=0) for y in (w.astype(float), w * x, w * x * x)]
                        for i, c in enumerate(found.tolist()):
                            table[c] = table.get(c, 0) + np.stack([y[i] for y in sums])
            if len(held) > HELD_GROUPS:
                yield from passed_on()
        yield from passed_on()

    kinds = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    made = d.mapInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "cell long, n array<double>, s array<double>, q array<double>"]))
    rows = made.select(*keys, "cell", F.posexplode(F.arrays_zip("n", "s", "q")).alias("rep", "x"))
    return rows.groupBy(*keys, "cell", "rep").agg(*(F.sum(f"x.{c}").alias(c) for c in "nsq"))


def bootstrap_ctr(df: DataFrame, keys: Sequence[str], row_id: str, value: str, replicates: int = 200, seed: int = 1) -> DataFrame:
    """keys, n, ctr_uncertainty_ps: deviation of CTR over replicates with Poisson(1) weights; null under 3 rows."""
    keys = list(keys)
    group = F.struct(F.lit(0).alias("_"), *keys).alias("_group")
    d = df.select(group, F.col(row_id).alias("_id"), finite(F.col(value)).alias("v"))
    whole = d.groupBy("_group").agg(F.count("v").alias("n"), F.avg("v").alias("_mean"))
    # about the group's mean, so that squares don't lose the spread
    near = d.join(whole.select("_group", "_mean"), "_group").select(*(F.col(f"_group.{k}") for k in keys), "_id", (F.col("v") - F.col("_mean")).alias("v"))
    reps = replicate_sums(near, keys, F.xxhash64(F.lit(seed), "_id"), F.col("v"), replicates)
    ctr = F.when(F.col("n") > 1, FWHM * F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1))))
    out = reps.withColumn("ctr", ctr).groupBy(group).agg(F.stddev_samp("ctr").alias("u"))
    return whole.join(out, "_group", "left").select(*(F.col(f"_group.{k}") for k in keys), "n", F.when(F.col("n") >= 3, F.col("u")).alias("ctr_uncertainty_ps"))


def student_two_sided(t: float, dof: float) -> float:
    """P(|T| >= |t|) by the continued fraction of the incomplete beta function."""
    if not math.isfinite(t):
        return 0.0 if abs(t) == math.inf else math.nan
    x = dof / (dof + t * t)
    a, b = dof / 2, 0.5

    def fraction(x: float, a: float, b: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + num / c
                c = c if abs(c) > tiny else tiny
                h *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return h

    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation r over n rows by Student's t with n - 2 degrees of freedom."""
    out = []
    for a, k in zip(r, n, strict=True):
        if a is None or not np.isfinite(a) or k < 3:
            out.append(math.nan)
        else:
            out.append(student_two_sided(a * math.sqrt((k - 2) / (1 - a * a)) if abs(a) < 1 else math.inf, k - 2))
    return pd.Series(out)


def false_discovery(df: DataFrame, keys: Sequence[str], p: str, q: str) -> DataFrame:
    """Add Benjamini-Hochberg q: least p * m / rank over this and greater ranks, at most 1; null and NaN p are left out."""
    ok = finite(F.col(p))
    w = Window.partitionBy(*keys, ok.isNull())
    raw = ok * F.count(ok).over(w) / F.row_number().over(w.orderBy(ok))
    d = df.withColumn("_raw", raw)
    return d.withColumn(q, F.least(F.lit(1.0), F.min("_raw").over(w.orderBy(ok.desc()).rowsBetween(Window.unboundedPreceding, 0)))).drop("_raw")


def correlation_table(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str) -> DataFrame:
    """keys, feature, n, Pearson and Spearman with p and q, line and r2 of every feature against the target."""
    keys = list(keys)
    rows = df.unpivot([*keys, target], [F.col(f).cast("double").alias(f) for f in features], "feature", "x")
    out = correlations(rows, [*keys, "feature"], "x", target)
    out = out.withColumn("pearson_p", correlation_p("pearson", "n")).withColumn("spearman_p", correlation_p("spearman", "n"))
    return false_discovery(false_discovery(out, keys, "pearson_p", "pearson_q"), keys, "spearman_p", "spearman_q")


def quantile_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, n, mean, std, median, q1, q3, p1, p99 of the finite values."""
    v = finite(F.col(value))
    group = F.struct(F.lit(0).alias("_"), *keys).alias("_group")
    out = df.select(group, v.alias("v")).groupBy("_group").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    q = quantiles(cut(counted(df, keys, F.col(value))), (0.5, 0.25, 0.75, 0.01, 0.99)).select("_group", "q")
    return out.join(q, "_group", "left").select(*_keys(keys), "n", "mean", "std", *(F.col("q")[i].alias(c) for i, c in enumerate(("median", "q1", "q3", "p1", "p99"))))


def integer_histogram(df: DataFrame, keys: Sequence[str], value: str, width: int) -> DataFrame:
    """keys, edge, n: counts in bins [edge, edge + width) of whole multiples of the width."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, (F.floor(F.col(value) / width) * width).alias("edge")).agg(F.count("*").alias("n"))


def density_histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 80, reach: float = 7.0) -> DataFrame:
    """keys, bin, n, density within median +- reach robust scales, in equal bins, the last one closed."""
    keys = list(keys)
    s = robust_scale(df, keys, value).where("scale > 0").select(*keys, (F.col("center") - reach * F.col("scale")).alias("lo"), (2 * reach * F.col("scale") / bins).alias("w"))
    b = F.least(F.floor((F.col(value) - F.col("lo")) / F.col("w")), F.lit(bins - 1)).cast("int")
    d = df.join(s, keys).where(F.col(value).between(F.col("lo"), F.col("lo") + bins * F.col("w"))).groupBy(*keys, "w", b.alias("bin")).agg(F.count("*").alias("n"))
    total = d.groupBy(*keys).agg(F.sum("n").alias("t"))
    return d.join(total, keys).select(*keys, "bin", "n", (F.col("n") / F.col("t") / F.col("w")).alias("density"))
