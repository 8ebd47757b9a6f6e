"""Histogram fits: events become counts in Spark, and only the counts of one group reach a Python task."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofit.functions.timing import FWHM

from .lineage import cut
from .quantiles import counted, quantiles
from .stats import replicate_sums, robust_counts, span_scale

_erf = np.vectorize(math.erf, otypes=[float])
FIT_SCHEMA = "success boolean, n long, mean_ps double, sigma_ps double, ctr_ps double, mean_error_ps double, ctr_error_ps double, deviance double, ndof int, phase int, bin_width_ps double, ctr_spread_ps double, message string"


def _cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _erf(x / math.sqrt(2)))


def _pdf(x: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def binned_gaussian(edges: np.ndarray, counts: np.ndarray, mean: float, sigma: float, bounds: tuple[float, float], means: tuple[float, float] = (-math.inf, math.inf), rounds: int = 60):
    """Maximum likelihood of a Gaussian integrated over bins and normalised to the histogram's range.

    Fisher scoring with step halving, within bounds of sigma and of the mean; returns mean, sigma, their covariance and the Poisson deviance, or None.
    """
    total = counts.sum()

    def model(m: float, s: float):
        z = (edges - m) / s
        c, d = _cdf(z), _pdf(z)
        p, norm = np.diff(c), c[-1] - c[0]
        dm, ds = -np.diff(d) / s, -np.diff(z * d) / s
        dn = np.array([-(d[-1] - d[0]) / s, -(z[-1] * d[-1] - z[0] * d[0]) / s])
        p = np.maximum(p / norm, 1e-300)
        return p, (dm / norm - p * dn[0] / norm), (ds / norm - p * dn[1] / norm)

    def value(m: float, s: float) -> float:
        return float((counts * np.log(model(m, s)[0])).sum())

    best = value(mean, sigma)
    for _ in range(rounds):
        p, dm, ds = model(mean, sigma)
        g = np.array([(counts * dm / p).sum(), (counts * ds / p).sum()])
        info = total * np.array([[(dm * dm / p).sum(), (dm * ds / p).sum()], [(dm * ds / p).sum(), (ds * ds / p).sum()]])
        try:
            step = np.linalg.solve(info, g)
        except np.linalg.LinAlgError:
            return None
        scale = 1.0
        while scale > 1e-6:
            m, s = min(max(mean + scale * step[0], means[0]), means[1]), min(max(sigma + scale * step[1], bounds[0]), bounds[1])
            new = value(m, s)
            if np.isfinite(new) and new >= best - 1e-12:
                break
            scale /= 2
        moved = abs(m - mean) + abs(s - sigma)
        mean, sigma, best = m, s, new
        if moved < 1e-9 * max(1.0, sigma):
            break
    p, dm, ds = model(mean, sigma)
    info = total * np.array([[(dm * dm / p).sum(), (dm * ds / p).sum()], [(dm * ds / p).sum(), (ds * ds / p).sum()]])
    try:
        cov = np.linalg.inv(info)
    except np.linalg.LinAlgError:
        return None
    e = total * p
    deviance = 2 * float((np.where(counts > 0, counts * np.log(np.maximum(counts, 1) / e), 0.0) - (counts - e)).sum())
    return (mean, sigma, cov, deviance) if np.isfinite([mean, sigma, deviance]).all() else None


def gaussian_ctr(df: DataFrame, keys: Sequence[str], value: str, bins_per_fwhm: float = 10, least_ps: float = 1.0, most_ps: float = 25.0, phases: int = 8, min_events: int = 100) -> DataFrame:
    """A Gaussian width fit for each key over histograms at several bin phases: keys and the fields of FIT_SCHEMA.

    value is in whole femtoseconds. The bin width is a part of the first guess of the full width, within limits;
    every phase's histogram holds all values and an empty bin beyond them on either side (five bins at least). The
    mean stays within a bin of the values, sigma between a fifth of a bin and the greatest of twice the values'
    range, ten times the first guess and two bins. The phase of the least deviance per degree of freedom is taken. A
    group with too few values, or without any successful phase, has a failure row. Errors are those of the Fisher
    information.
    """
    keys = list(keys)
    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("long").alias("v"))
    plan = _bin_plan(d, keys, bins_per_fwhm, least_ps, most_ps).withColumn("phase", F.explode(F.sequence(F.lit(0), F.lit(phases - 1))))
    bins = d.join(plan, keys).groupBy(*keys, "phase", "center", "scale", "w", _bin(F.col("phase"), phases).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    return _fit_bins(bins, keys, phases, min_events)


def _bin_plan(d: DataFrame, keys: Sequence[str], bins_per_fwhm: float, least_ps: float, most_ps: float) -> DataFrame:
    """keys, center, scale and w, the bin width in whole femtoseconds."""
    width = F.greatest(F.lit(1), F.rint(F.least(F.lit(most_ps), F.greatest(F.lit(least_ps), F.lit(FWHM) * F.col("scale") / 1000 / bins_per_fwhm)) * 1000)).cast("long")
    return span_scale(d, keys, "v").select(*keys, "center", "scale", width.alias("w"))


def _bin(phase: Column, phases: int) -> Column:
    return F.floor((F.col("v") + F.floor(F.col("w") * phase / phases)) / F.col("w"))


def _fit_bins(bins: DataFrame, keys: Sequence[str], phases: int, min_events: int) -> DataFrame:
    """A fit of each key's histograms: keys, phase, center, scale, w, bin, n, least, most."""
    keys = list(keys)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        n = int(pdf.loc[pdf.phase == r.phase, "n"].sum())
        fail = lambda why: pd.DataFrame([[*r[keys], False, n, *[np.nan] * 6, 0, -1, r.w / 1000, np.nan, why]], columns=columns)
        if n < min_events:
            return fail("too few events")
        found = []
        for phase, part in pdf.groupby("phase"):
            shift, least, most = int(r.w * phase // phases), int(part.least.min()), int(part.most.max())
            # an empty bin on either side; none after a greatest value that begins its bin; five bins at least
            lo, hi = int(part.bin.min()) - 1, int(part.bin.max()) + ((most + shift) % int(r.w) != 0)
            hi = max(hi, lo + 4)
            counts = np.zeros(hi - lo + 1)
            counts[(part.bin - lo).to_numpy()] = part.n
            edges = (np.arange(lo, hi + 2) * r.w - shift - r.center) / 1000
            width, start = r.w / 1000, max(r.scale / 1000, 1e-3)
            narrow = max(0.2 * width, 1e-3)
            wide = max(2 * (most - least) / 1000, 10 * start, 10 * narrow)
            means = ((least - r.center) / 1000 - width, (most - r.center) / 1000 + width)
            got = binned_gaussian(edges, counts, 0.0, max(start, narrow), (narrow, wide), means)
            if got:
                found.append((got[3] / max(1, len(counts) - 2), got[3], int(phase), len(counts) - 2, got))
        if not found:
            return fail("every phase failed")
        _, deviance, phase, ndof, (m, sigma, cov, _) = min(found, key=lambda x: x[:3])
        spread = float(np.std([FWHM * x[4][1] for x in found]))
        return pd.DataFrame([[*r[keys], True, n, m + r.center / 1000, sigma, FWHM * sigma, math.sqrt(max(cov[0, 0], 0)), FWHM * math.sqrt(max(cov[1, 1], 0)), deviance, ndof, phase, r.w / 1000, spread, ""]], columns=columns)

    columns = [*keys, *(x.split()[0] for x in FIT_SCHEMA.split(", "))]
    kinds = {f.name: f.dataType.simpleString() for f in bins.schema.fields}
    return bins.groupBy(*keys).applyInPandas(fit, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + (", " if keys else "") + FIT_SCHEMA)


def bootstrap_gaussian(
    df: DataFrame, keys: Sequence[str], row_id: str, value: str, replicates: int = 200, seed: int = 1, bins_per_fwhm: float = 10, least_ps: float = 1.0, most_ps: float = 25.0, phases: int = 8, min_events: int = 100
) -> DataFrame:
    """keys, fits, ctr_uncertainty_ps: deviation of the fitted CTR over refits of Poisson(1) replicates.

    value is in whole femtoseconds. Every replicate is fitted over the bins of the group itself, at all phases, so what is shuffled
    are counts of replicates by bins. Fewer successful refits than ten, or than four in five, give null; a group without
    values has no row.
    """
    keys = list(keys)
    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(row_id).alias("_id"), F.col(value).cast("long").alias("v"))
    plan = cut(_bin_plan(d, keys, bins_per_fwhm, least_ps, most_ps))
    wide = 1 << 40  # bins of a phase
    cells = [F.lit(phase * wide) + _bin(F.lit(phase), phases) + wide // 2 for phase in range(phases)]
    reps = replicate_sums(d.join(plan.select(*keys, "w"), keys), keys, F.xxhash64(F.lit(seed), "_id"), F.lit(1.0), replicates, cells)
    ends = d.groupBy(*keys).agg(F.min("v").alias("least"), F.max("v").alias("most"))
    bins = reps.where("n > 0").join(plan.join(ends, keys), keys).select(*keys, "rep", F.floor(F.col("cell") / wide).alias("phase"), "center", "scale", "w", (F.col("cell") % wide - wide // 2).alias("bin"), "n", "least", "most")
    f = _fit_bins(bins, [*keys, "rep"], phases, min_events)
    ok = F.col("success")
    out = f.groupBy(*keys).agg(F.count_if(ok).alias("fits"), F.stddev_samp(F.when(ok, F.col("ctr_ps"))).alias("u"))
    return out.select(*keys, "fits", F.when(F.col("fits") >= max(10, math.ceil(0.8 * replicates)), F.col("u")).alias("ctr_uncertainty_ps"))


def grid_scan(df: DataFrame, keys: Sequence[str], first: str, second: str, **fit) -> DataFrame:
    """A fit for each parameter of two equally long arrays of times: keys, parameter, efficiency and the fit's fields."""
    keys = list(keys)
    total = df.groupBy(*keys).agg(F.count("*").alias("selected"))
    each = df.select(*keys, F.posexplode(F.zip_with(first, second, lambda a, b: a - b)).alias("parameter", "delta"))
    out = gaussian_ctr(each, [*keys, "parameter"], "delta", **fit)
    return out.join(total, keys).withColumn("efficiency", F.col("n") / F.col("selected")).drop("selected")


def best_of(scan: DataFrame, keys: Sequence[str], score: str = "ctr_ps", order: str = "parameter") -> DataFrame:
    """The successful row of the least finite score for each key; ties by the lower parameter."""
    rest = [c for c in scan.columns if c not in keys]
    ok = scan.where(F.col("success") & F.col(score).isNotNull() & ~F.isnan(score))
    best = ok.groupBy(*keys).agg(F.min(F.struct(F.col(score).alias("_s"), F.col(order).alias("_o"), F.struct(*rest).alias("_r"))).alias("b"))
    return best.select(*keys, "b._r.*")


def density_on_grid(values: DataFrame, plan: DataFrame, grid: int) -> DataFrame:
    """_group, i, y: at each of `grid` points from x0 to x1 the sum of Gaussian kernels of width h over counted values.

    values: _group, v, w; plan: _group, x0, x1, h. A task adds its values up on one grid a group and passes on only that.
    """

    def run(frames):
        held: dict[str, tuple] = {}
        for pdf in frames:
            for key, part in pdf.groupby("_name"):
                r = part.iloc[0]
                x = np.linspace(r.x0, r.x1, grid)
                y = held[key][1] if key in held else np.zeros(grid)
                v, w = part.v.to_numpy(), part.w.to_numpy(float)
                for k in range(0, len(v), 256):
                    y += (w[k : k + 256, None] * np.exp(-0.5 * ((x[None, :] - v[k : k + 256, None]) / r.h) ** 2)).sum(axis=0)
                held[key] = (key, y)
            if len(held) > 64:
                yield pd.DataFrame(list(held.values()), columns=["_name", "y"])
                held.clear()
        if held:
            yield pd.DataFrame(list(held.values()), columns=["_name", "y"])

    named = F.to_json("_group", {"ignoreNullFields": "false"}).alias("_name")
    made = values.join(plan.select("_group", "x0", "x1", "h"), "_group").select(named, "v", "w", "x0", "x1", "h").mapInPandas(run, "_name string, y array<double>")
    sums = made.select("_name", F.posexplode("y").alias("i", "y")).groupBy("_name", "i").agg(F.sum("y").alias("y"))
    return sums.join(plan.select("_group", named), "_name").select("_group", "i", "y")


def local_maxima(y: np.ndarray) -> np.ndarray:
    """Places of what is higher than its neighbours on both sides; of a flat top, its middle."""
    edge = np.flatnonzero(np.concatenate([[True], np.diff(y) != 0]))  # where runs of equal values begin
    last = np.concatenate([edge[1:] - 1, [len(y) - 1]])
    level = y[edge]
    k = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    return (edge[k] + last[k]) // 2


def peak_window(df: DataFrame, keys: Sequence[str], value: str, minimum: int = 50, grid: int = 4096, factor: float = 0.35, height: float = 0.12, low_scale: float = 2.0, high_scale: float = 4.0, inside: int = 5, rightmost: bool = True) -> DataFrame:
    """Energy peak window by a kernel density over whole values: keys, low, high, peak, center, scale, n, message.

    Of the density's local maxima of enough height the rightmost or the highest is taken, without any its greatest point. The
    values between the points at which it has fallen to half, or all values where fewer than two are there, give median and
    MAD (or else the sample deviation, or else the half-height width over 2.355, at least 1), and these the window; an empty
    window becomes the values' range. Values that are all equal are a window of their own, of scale 1. A group with too few
    values, or too few in its window, has a message and no window. The density is summed up over partitions.
    """
    keys = list(keys)
    values = cut(counted(df, keys, F.col(value)))
    v, w = F.col("v"), F.col("w")
    plan = values.groupBy("_group").agg(F.sum("w").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), (F.sum(v * w) / F.sum("w")).alias("_mean"))
    sq = values.join(plan.select("_group", "_mean"), "_group").groupBy("_group").agg(F.sum(w * (v - F.col("_mean")) * (v - F.col("_mean"))).alias("_sq"))
    pad = F.greatest(F.lit(1.0), 0.03 * (F.col("most") - F.col("least")))
    width = F.pow(F.col("n"), F.lit(-0.2)) * factor * F.sqrt(F.col("_sq") / F.greatest(F.lit(1), F.col("n") - 1))
    plan = cut(plan.join(sq, "_group").select("_group", "n", "least", "most", (F.col("least") - pad).alias("x0"), (F.col("most") + pad).alias("x1"), width.alias("h")))
    full = plan.where((F.col("n") >= minimum) & (F.col("least") < F.col("most")))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        y, x = pdf.sort_values("i").y.to_numpy(), np.linspace(r.x0, r.x1, grid)
        top = local_maxima(y)
        top = top[y[top] >= height * y.max()]
        k = int(y.argmax()) if not len(top) else int(top[-1]) if rightmost else int(top[y[top].argmax()])
        low = np.flatnonzero(y[:k] <= y[k] / 2)
        high = np.flatnonzero(y[k + 1 :] <= y[k] / 2)
        return pd.DataFrame({"_name": [r["_name"]], "peak": [x[k]], "from": [x[low[-1]] if len(low) else x[0]], "to": [x[k + 1 + high[0]] if len(high) else x[-1]]})

    named = F.to_json("_group", {"ignoreNullFields": "false"}).alias("_name")
    density = density_on_grid(values.join(full.select("_group"), "_group"), full, grid)
    peaks = cut(density.join(full.select("_group", named, "x0", "x1"), "_group").drop("_group").groupBy("_name").applyInPandas(find, "_name string, peak double, `from` double, `to` double"))
    peaks = full.select("_group", named).join(peaks, "_name").drop("_name")
    near = values.join(peaks, "_group").withColumn("_in", v.between(F.floor("from"), F.ceil("to"))).withColumn("_few", F.sum(F.when(F.col("_in"), w).otherwise(0)).over(Window.partitionBy("_group")) < 2)
    core = cut(near.where(F.col("_in") | F.col("_few")).select("_group", "v", "w"))
    fwhm = F.greatest(F.lit(1.0), (F.col("to") - F.col("from")) / 2.355)
    found = robust_counts(core).join(peaks, "_group").withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(fwhm)).select("_group", "peak", "center", "scale")
    both = plan.select("_group", "n", "least", "most").join(found, "_group", "left")
    low, high = F.floor(F.col("center") - low_scale * F.col("scale")).cast("double"), F.ceil(F.col("center") + high_scale * F.col("scale")).cast("double")
    own = F.col("least") == F.col("most")
    one = lambda c, alone: F.when(own & (F.col("n") >= minimum), alone).otherwise(c)
    both = both.withColumn("low", one(F.when(low < high, low).otherwise(F.col("least")), F.col("least"))).withColumn("high", one(F.when(low < high, high).otherwise(F.col("most")), F.col("most")))
    both = both.withColumns({c: one(F.col(c), x) for c, x in (("peak", F.col("least")), ("center", F.col("least")), ("scale", F.lit(1.0)))})
    both = both.withColumns({c: F.when(F.col("scale").isNotNull(), F.col(c)) for c in ("low", "high")})
    counts = values.join(both.select("_group", "low", "high"), "_group").where(v.between(F.col("low"), F.col("high"))).groupBy("_group").agg(F.sum("w").alias("_inside"))
    message = F.when(F.col("n") < minimum, "too few events").when(~own & (F.coalesce("_inside", F.lit(0)) < inside), "too few events in the peak").otherwise("")
    out = both.join(counts, "_group", "left").withColumn("message", message)
    shown = lambda c: F.when(F.col("message") == "", F.col(c)).alias(c)
    return out.select(*(F.col(f"_group.{k}") for k in keys), *(shown(c) for c in ("low", "high", "peak", "center", "scale")), "n", "message")


def bounded_gaussian(x: np.ndarray, y: np.ndarray, start: Sequence[float], low: Sequence[float], high: Sequence[float], rounds: int = 200) -> tuple[np.ndarray, np.ndarray] | None:
    """Least squares of amplitude, mean and sigma with weights of the counts' root, held within bounds: parameters and covariance.

    Damped Gauss-Newton steps; a parameter at a bound that the slope pushes against stays out of a step. Errors are taken
    as known, so the covariance is the inverse of the weighted normal matrix.
    """
    weight, low, high = 1 / np.sqrt(np.maximum(y, 1)), np.asarray(low, float), np.asarray(high, float)
    p = np.clip(np.asarray(start, float), low, high)
    shape = lambda p: np.exp(-0.5 * ((x - p[1]) / p[2]) ** 2)
    cost = lambda p: float(((p[0] * shape(p) - y) ** 2 * weight**2).sum())

    def slopes(p):
        e, z = shape(p), (x - p[1]) / p[2]
        return np.stack([e, p[0] * e * z / p[2], p[0] * e * z * z / p[2]], axis=1) * weight[:, None]

    best, damp = cost(p), 1e-3
    for _ in range(rounds):
        j = slopes(p)
        a, g = j.T @ j, j.T @ ((p[0] * shape(p) - y) * weight)
        free = ~(((p <= low) & (g > 0)) | ((p >= high) & (g < 0)))
        if not free.any():
            break
        step = np.zeros(3)
        m = a[np.ix_(free, free)]
        step[free] = np.linalg.lstsq(m + damp * np.diag(np.diag(m) + 1e-12), -g[free], rcond=None)[0]
        new = np.clip(p + step, low, high)
        value = cost(new)
        if value < best:
            done = best - value <= 1e-12 * max(1.0, best) and np.abs(new - p).max() <= 1e-9 * max(1.0, np.abs(p).max())
            p, best, damp = new, value, damp / 5
            if done:
                break
        else:
            damp *= 5
            if damp > 1e12:
                break
    if not np.isfinite(p).all():
        return None
    j = slopes(p)
    return p, np.linalg.pinv(j.T @ j)


PEAK_SCHEMA = "success boolean, mean double, sigma double, mean_error double, sigma_error double, low double, high double, fit_low double, fit_high double, chi2 double, ndof int, iterations int, n long, message string"


def photopeak(df: DataFrame, keys: Sequence[str], value: str, bin_mv: float = 1.0, quantile: float = 0.55, smooth: float = 2.0, half_width: float = 15.0, reach: float = 2.5, rounds: int = 6, tolerance: float = 0.01, low: float = 2.0, high: float = 4.0) -> DataFrame:
    """Photopeak of an amplitude histogram: keys and the fields of PEAK_SCHEMA.

    Counts in bins come from Spark. The highest smoothed bin at or above a quantile of the values starts a fit of a Gaussian
    within `half_width`, with the mean inside that interval and sigma from a tenth of a bin to the values' range; it is
    repeated within `reach` sigmas until mean and sigma each move by no more than `tolerance`, or `rounds` times. A round
    that can't be fitted ends this; if it is the first, the row fails, as it does under 20 finite values. A last fit over the
    last interval gives parameters, errors and chi-square (variance: the fitted counts, at least 1). The window reaches from
    `low` sigmas below to `high` above.
    """
    keys = list(keys)
    values = cut(counted(df, keys, F.col(value)))
    q = quantiles(values, [quantile]).select("_group", F.col("q")[0].alias("q"))
    ends = values.groupBy("_group").agg(F.min("v").alias("least"), F.max("v").alias("most"))
    counts = values.groupBy("_group", F.floor(F.col("v") / bin_mv).alias("b")).agg(F.sum("w").alias("n")).join(q, "_group").join(ends, "_group").select(*(F.col(f"_group.{k}") for k in keys), "b", "n", "q", "least", "most")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        n = int(pdf.n.sum())
        fail = lambda why, k=0: pd.DataFrame([[*r[keys], False, *[np.nan] * 9, 0, k, n, why]], columns=columns)
        if n < 20:
            return fail("too few values")
        first, end = math.floor(r.least / bin_mv), math.ceil(r.most / bin_mv)
        end = max(end, first + 1)
        y = np.zeros(end - first + 1)  # the bin beyond the greatest value too
        y[(pdf.b - first).to_numpy(np.int64)] = pdf.n
        x = (np.arange(first, end + 1) + 0.5) * bin_mv
        radius = max(1, int(4 * smooth + 0.5))
        kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / smooth) ** 2)
        flat = np.convolve(np.pad(y, radius, mode="edge"), kernel / kernel.sum(), mode="valid")
        allowed = x >= r.q if (x >= r.q).any() else np.ones(len(x), bool)
        mean, sigma = float(x[np.argmax(np.where(allowed, flat, -1.0))]), max(bin_mv, half_width / 3)
        a, b, widest = mean - half_width, mean + half_width, max((end - first) * bin_mv, bin_mv)
        top, done = 0.0, 0
        why = "the fit failed"

        def fitted(a, b, start):
            part = (x >= a) & (x <= b)
            got = bounded_gaussian(x[part], y[part], start, (0.0, a, 0.1 * bin_mv), (np.inf, b, widest)) if part.any() else None
            return part, got

        for _ in range(rounds):
            part = (x >= a) & (x <= b)
            if part.sum() < 7 or (y[part] > 0).sum() < 4:
                why = "too few populated bins"
                break
            part, got = fitted(a, b, (max(y[part].max(), 1.0), mean, max(sigma, 0.5 * bin_mv)))
            if got is None:
                break
            (amplitude, m, s), cov = got
            top, done = float((amplitude * np.exp(-0.5 * ((x[part] - m) / s) ** 2)).max()), done + 1
            still = abs(m - mean) <= tolerance and abs(s - sigma) <= tolerance
            mean, sigma = float(m), float(s)
            a, b = mean - reach * sigma, mean + reach * sigma
            if still:
                break
        if not done:
            return fail(why)
        part, got = fitted(a, b, (top, mean, sigma))
        amplitude = top
        if got is not None:
            (amplitude, mean, sigma), cov = got
        expected = amplitude * np.exp(-0.5 * ((x[part] - mean) / sigma) ** 2)
        chi2 = float(((y[part] - expected) ** 2 / np.maximum(expected, 1.0)).sum())
        error = np.sqrt(np.maximum(np.diag(cov), 0))
        return pd.DataFrame([[*r[keys], True, mean, sigma, error[1], error[2], mean - low * sigma, mean + high * sigma, a, b, chi2, max(0, int(part.sum()) - 3), done, n, ""]], columns=columns)

    columns = [*keys, *(c.split()[0] for c in PEAK_SCHEMA.split(", "))]
    kinds = {f.name: f.dataType.simpleString() for f in counts.schema.fields}
    return counts.groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + (", " if keys else "") + PEAK_SCHEMA)
