"""Parameter search and calibrated estimators: candidates, scores, linear pair regression solved by aggregation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofit.functions import waveform as W
from chronofit.functions.timing import FWHM

from . import splits
from .lineage import cut
from .stats import residual_metrics


def product(axes: Sequence[DataFrame]) -> DataFrame:
    """Every combination of the rows of small parameter tables, one axis each."""
    out = axes[0]
    for a in axes[1:]:
        out = out.join(a)
    return out


def random_draws(df: DataFrame, n: int, seed: int | str) -> DataFrame:
    """n rows of a candidate table by hash order: unique draws without replacement, the same wherever they are made."""
    key = F.sha2(F.concat(F.lit(f"{seed}|"), F.to_json(F.struct(*df.columns))), 256)
    return df.distinct().withColumn("_k", key).orderBy("_k").limit(n).drop("_k")


def subsets(values: DataFrame, column: str, least: int, most: int) -> DataFrame:
    """All ascending subsets of a small value table, of `least` to `most` members, as an array column."""
    grown = values.select(F.array(column).alias("subset"))
    out = grown if least <= 1 else None
    for k in range(2, most + 1):
        grown = grown.join(values.select(F.col(column).alias("_v")), F.col("_v") > F.element_at("subset", -1)).select(F.concat("subset", F.array("_v")).alias("subset"))
        if k >= least:
            out = grown if out is None else out.unionByName(grown)
    return out


def candidate_scores(results: DataFrame, keys: Sequence[str], candidate: str, fold: str, value: str) -> DataFrame:
    """keys, candidate, score_ps (mean of the folds' CTR), fold_std_ps, folds, n, mean_ps, rmse_ps (pooled)."""
    keys = list(keys)
    f = residual_metrics(results, [*keys, candidate, fold], value)
    s = f.groupBy(*keys, candidate).agg(F.avg("ctr_ps").alias("score_ps"), F.stddev_samp("ctr_ps").alias("fold_std_ps"), F.count("ctr_ps").alias("folds"))
    pooled = residual_metrics(results, [*keys, candidate], value).select(*keys, candidate, "n", "mean_ps", "rmse_ps")
    return s.join(pooled, [*keys, candidate])


def choose(scores: DataFrame, keys: Sequence[str], candidate: str, score: str = "score_ps") -> DataFrame:
    """Add selected: the strictly least finite score of each key, the first candidate at ties."""
    keys = list(keys)
    ok = scores.where(F.col(score).isNotNull() & ~F.isnan(score))
    best = ok.groupBy(*keys).agg(F.min(F.struct(F.col(score).alias("s"), F.col(candidate).alias("c")))["c"].alias("_best"))
    return scores.join(best, keys, "left").withColumn("selected", F.coalesce(F.col(candidate) == F.col("_best"), F.lit(False))).drop("_best")


def nested_evaluation(results: DataFrame, keys: Sequence[str], candidate: str, fold: str, value: str) -> DataFrame:
    """Per outer fold the candidate chosen on the other folds, scored on the outer one: keys, outer_fold, candidate, ctr_ps, then averaged.

    Returns keys, folds, mean_ctr_ps, std_ctr_ps. The inner score of a candidate is the mean CTR of its other folds.
    """
    keys = list(keys)
    f = residual_metrics(results, [*keys, candidate, fold], value).select(*keys, candidate, fold, "ctr_ps")
    total = f.groupBy(*keys, candidate).agg(F.sum("ctr_ps").alias("s"), F.count("ctr_ps").alias("k"))
    inner = f.join(total, [*keys, candidate]).withColumn("inner", F.when(F.col("k") > 1, (F.col("s") - F.col("ctr_ps")) / (F.col("k") - 1))).where("inner is not null")
    best = inner.groupBy(*keys, fold).agg(F.min(F.struct("inner", F.col(candidate).alias("c"), "ctr_ps")).alias("b"))
    return best.groupBy(*keys).agg(F.count("*").alias("folds"), F.avg("b.ctr_ps").alias("mean_ctr_ps"), F.stddev_samp("b.ctr_ps").alias("std_ctr_ps"))


def threshold_scan(pairs: DataFrame, keys: Sequence[str], first: str, second: str, thresholds: Sequence[float], step_ps: float, kind: str = "led") -> DataFrame:
    """keys, parameter, valid, and residual metrics of the time difference at every leading-edge threshold or constant fraction."""
    grid = (lambda y: W.led_grid(y, list(thresholds))) if kind == "led" else (lambda y: W.cfd_grid(y, list(thresholds)))
    d = pairs.select(*keys, grid(F.col(first)).alias("_a"), grid(F.col(second)).alias("_b"))
    each = d.select(*keys, F.posexplode(F.zip_with("_a", "_b", lambda a, b: (a - b) * step_ps)).alias("parameter", "delta"))
    return residual_metrics(each, [*keys, "parameter"], "delta")


def led_times(traces: pa.ListArray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """functions.waveform.leading_edge() of whole traces at ascending levels: times in samples, and whether there is one; a row each."""
    sizes = np.diff(traces.offsets.to_numpy())
    times, found = np.zeros((len(traces), len(levels))), np.zeros((len(traces), len(levels)), bool)
    flat, start = traces.flatten(), np.concatenate([[0], np.cumsum(sizes)])
    known, samples = flat.is_valid().to_numpy(zero_copy_only=False), flat.to_numpy(zero_copy_only=False).astype(float)
    for size in np.unique(sizes[sizes > 1]):
        rows = np.flatnonzero(sizes == size)
        at = start[rows][:, None] + np.arange(size)
        y, ok = samples[at], known[at]
        # how many levels each trace has reached by each sample; a number that is none lies above all, a missing one below
        top = np.maximum.accumulate(np.where(ok, np.where(np.isnan(y), np.inf, y), -np.inf), axis=1)
        reached = np.searchsorted(levels, top, side="right") + np.arange(len(rows))[:, None] * (len(levels) + 1)
        before = np.bincount(reached.ravel(), minlength=len(rows) * (len(levels) + 1)).reshape(len(rows), -1).cumsum(axis=1)[:, :-1]
        line, k = np.arange(len(rows))[:, None], np.clip(before, 1, size - 1)
        a, b = y[line, k - 1], y[line, k]
        found[rows] = (before > 0) & (before < size) & (levels > 0) & ok[line, k - 1] & (a != b)
        with np.errstate(all="ignore"):
            times[rows] = (k - 1) + (levels - a) / (b - a)
    return times, found


def _led_spreads(d: DataFrame, first: str, second: str, levels: np.ndarray, step_ps: float) -> DataFrame:
    """k, _fold, sd, missing, n of the time difference at each of the ascending levels.

    A task hands on a count, mean and sum of squares about it for each level and fold, so nothing grows with events times levels.
    """
    where = pa.schema([("k", pa.int32()), ("_fold", pa.int32()), ("n", pa.int64()), ("c", pa.int64()), ("m", pa.float64()), ("q", pa.float64())])

    def run(batches):
        held: dict[int, tuple] = {}
        for b in batches:
            (ta, fa), (tb, fb) = (led_times(x, levels) for x in b.columns[1:])
            folds, have = b.column(0).to_numpy(), fa & fb
            with np.errstate(all="ignore"):
                delta = np.where(have, (ta - tb) * step_ps, 0.0)
                for fold in np.unique(folds):
                    x, ok = delta[folds == fold], have[folds == fold]
                    c = ok.sum(axis=0)
                    m = x.sum(axis=0) / np.maximum(c, 1)
                    q = np.where(ok, (x - m) ** 2, 0.0).sum(axis=0)
                    n0, c0, m0, q0 = held.get(fold, (0, 0, 0.0, 0.0))
                    both = np.maximum(c0 + c, 1)
                    held[fold] = n0 + len(x), c0 + c, m0 + (m - m0) * c / both, q0 + q + (m - m0) ** 2 * c0 * c / both
        for fold, (n, c, m, q) in held.items():
            k = np.arange(len(levels), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full_like(k, fold)), pa.array(np.full(len(k), n)), pa.array(c), pa.array(m), pa.array(q)], schema=where)

    whole = d.where(F.col(first).isNotNull() & F.col(second).isNotNull()).select("_fold", first, second)
    parts = whole.mapInArrow(run, "k int, _fold int, n long, c long, m double, q double")
    w = Window.partitionBy("k", "_fold")
    mean = F.sum(F.col("c") * F.col("m")).over(w) / F.sum("c").over(w)
    parts = parts.withColumn("off", F.when(F.col("c") > 0, F.col("m") - mean).otherwise(0.0))
    total = F.sum(F.col("q") + F.col("c") * F.col("off") * F.col("off"))
    return parts.groupBy("k", "_fold").agg(F.when(F.sum("c") > 1, F.sqrt(total / (F.sum("c") - 1))).alias("sd"), (F.sum("n") - F.sum("c")).alias("missing"), F.sum("n").alias("n"))


def adaptive_threshold(pairs: DataFrame, first: str, second: str, row_id: str, folds: int, low: float, high: float, step_ps: float, coarse: int = 121, fine: int = 41, kind: str = "led", seed: int = 1) -> tuple[float, DataFrame]:
    """Coarse-to-fine search of one threshold: the value, and the table of both passes (pass, value, score_ps, valid).

    The range ends at the least window maximum of any event and detector. A value at which any event lacks a
    crossing, or a fold has fewer than two events, is excluded; the score is the mean over near-equal folds of CTR. The
    driver sees one row for each value.
    """
    top = pairs.agg(F.min(F.least(F.array_max(first), F.array_max(second)))).first()[0] if kind == "led" else high
    lo, hi = max(low, 1e-6), min(high, top - 1e-6)
    if not lo < hi:
        raise ValueError("no threshold is reached by every event")
    d = cut(splits.folds(pairs.select(row_id, first, second), [], row_id, folds, seed).select(F.col("fold").alias("_fold"), first, second))
    tables = []

    def score(values: np.ndarray, number: int) -> pd.DataFrame:
        if kind == "led":
            per = _led_spreads(d, first, second, values, step_ps)
        else:
            grid = lambda y: W.cfd_grid(y, values.tolist())
            each = d.select("_fold", F.posexplode(F.zip_with(grid(F.col(first)), grid(F.col(second)), lambda a, b: (a - b) * step_ps)).alias("k", "delta"))
            per = each.groupBy("k", "_fold").agg(F.stddev_samp("delta").alias("sd"), F.count_if(F.col("delta").isNull()).alias("missing"), F.count("*").alias("n"))
        whole = (F.sum("missing") == 0) & (F.min("n") >= 2) & (F.count("*") == folds)
        out = per.groupBy("k").agg((F.avg("sd") * FWHM).alias("score_ps"), whole.alias("valid")).toPandas()
        out["value"], out["number"] = values[out.k.to_numpy()], number
        tables.append(out)
        return out[out.valid & out.score_ps.notna()].sort_values(["score_ps", "value"])

    values = np.linspace(lo, hi, coarse)
    best = score(values, 1)
    if best.empty:
        raise ValueError("every value lacks a crossing somewhere, or a fold has fewer than two events")
    k = int(best.k.iloc[0])
    best2 = score(np.linspace(values[max(0, k - 1)], values[min(coarse - 1, k + 1)], fine), 2)
    both = pd.concat([best.head(1), best2.head(1)]).sort_values(["score_ps", "value"])
    table = pairs.sparkSession.createDataFrame(pd.concat(tables)[["number", "value", "score_ps", "valid"]])
    return float(both.value.iloc[0]), table


def normalisation(df: DataFrame, arrays: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, i, mean, std of each sample pooled over several array columns; a deviation of 1e-6 or less counts as 1."""
    each = None
    for a in arrays:
        e = df.select(*keys, F.posexplode(a).alias("i", "x"))
        each = e if each is None else each.unionByName(e)
    sd = F.stddev_pop("x")
    return each.groupBy(*keys, "i").agg(F.avg("x").alias("mean"), F.when(sd > 1e-6, sd).otherwise(1.0).alias("std"))


def antisymmetric(first: Column, second: Column) -> Column:
    """The feature of a pair: the difference of its two windows, which changes sign when they are swapped."""
    return F.zip_with(first, second, lambda a, b: a - b)


_SUMS = pa.schema([("_key", pa.string()), ("g", pa.list_(pa.float64())), ("h", pa.list_(pa.float64())), ("loss", pa.float64()), ("n", pa.int64())])


def _blocks(batches):
    """Batches of _key, x, y and _e as one row for each key, whose numbers are packed doubles; a missing number is NaN."""
    numbers = lambda c: c.to_numpy(zero_copy_only=False).astype(np.float64)
    for b in batches:
        if not b.num_rows:
            continue
        key, x, y, e = b.columns
        sizes = np.diff(x.offsets.to_numpy())
        if (sizes != sizes[0]).any():
            raise ValueError("features differ in length")
        x, y, e = numbers(x.flatten()).reshape(b.num_rows, -1) if sizes[0] else np.zeros((b.num_rows, 0)), numbers(y), numbers(e)
        names, of = np.unique(np.array(key.to_pylist(), dtype=object), return_inverse=True)
        order = np.argsort(of, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(of[order])) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.string()), *(pa.array([v[i].tobytes() for i in parts], pa.binary()) for v in (y, e, x))], names=["_key", "y", "e", "x"])


def insensitive_fit(df: DataFrame, keys: Sequence[str], features: str, target: str, c: float, epsilon: float | str, rounds: int = 60, intercept: bool = False) -> DataFrame:
    """Linear epsilon-insensitive regression for each key, solved by distributed passes: keys, weights, bias, objective, n.

    Minimises |w|^2 / 2 + C sum max(0, |y - xw| - epsilon) by iteratively reweighted least squares on a smoothed
    loss; epsilon is a number or the name of a column. Each pass sums weighted normal equations in Spark, one small matrix for each key; the weights, as long as a
    window, stay on the driver.
    """
    keys = list(keys)
    d = df.where(F.col(features).isNotNull() & F.col(target).isNotNull()).select(F.to_json(F.struct(*keys)).alias("_key") if keys else F.lit("{}").alias("_key"), *keys, F.col(features).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y"), (F.col(epsilon) if isinstance(epsilon, str) else F.lit(epsilon)).cast("double").alias("_e"))
    spark = df.sparkSession
    # rows of one key and batch lie in one block of numbers, so a pass costs no Python object for each row
    d = d.select("_key", "x", "y", "_e").mapInArrow(_blocks, "_key string, y binary, e binary, x binary").persist()
    state: dict[str, np.ndarray] = {}

    def sums(current: dict[str, np.ndarray], smooth: float):
        shared = spark.sparkContext.broadcast(current)

        def run(batches):
            acc: dict[str, list] = {}
            for b in batches:
                for key, *numbers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    y, wide, x = (np.frombuffer(v) for v in numbers)
                    x = x.reshape(len(y), -1)
                    if intercept:
                        x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
                    w = shared.value.get(key)
                    r = y - (x @ w if w is not None else 0.0)
                    over = np.abs(r) - wide
                    a = np.where(over > 0, 1 / np.maximum(np.abs(r), smooth), 0.0) if w is not None else np.full(len(y), 1.0)
                    aim = np.where(over > 0, y - np.sign(r) * wide, 0.0) if w is not None else y
                    got = (x.T @ (a[:, None] * x), x.T @ (a * aim), float(np.maximum(over, 0).sum()), len(y))
                    old = acc.get(key)
                    acc[key] = got if old is None else tuple(p + q for p, q in zip(old, got, strict=True))
            rows = [(k, g.ravel().tolist(), h.tolist(), e, n) for k, (g, h, e, n) in acc.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, _SUMS.types, strict=True)], schema=_SUMS)

        parts = d.mapInArrow(run, "_key string, g array<double>, h array<double>, loss double, n long")
        flat = parts.select("_key", "loss", "n", F.posexplode(F.concat("g", "h")).alias("i", "v"))
        total = flat.groupBy("_key", "i").agg(F.sum("v").alias("v"), F.sum("loss").alias("loss"), F.sum("n").alias("n"))
        out: dict[str, tuple] = {}
        for key, part in total.toPandas().groupby("_key"):
            v = part.sort_values("i").v.to_numpy()
            p = int(round((-1 + np.sqrt(1 + 4 * len(v))) / 2))
            out[key] = (v[: p * p].reshape(p, p), v[p * p :], float(part.loss.iloc[0]), int(part.n.iloc[0]))
        return out

    best: dict[str, tuple[float, np.ndarray, int]] = {}
    smooth = 1.0
    for k in range(rounds):
        got = sums(state, smooth)
        moved = 0.0
        for key, (g, h, loss, n) in got.items():
            p = len(h)
            w = state.get(key)
            if w is not None:
                ridge = w[:-1] if intercept else w
                objective = 0.5 * float(ridge @ ridge) + c * loss
                if key not in best or objective < best[key][0]:
                    best[key] = (objective, w.copy(), n)
            penalty = np.eye(p)
            if intercept:
                penalty[-1, -1] = 1e-9
            new = np.linalg.solve(penalty + c * g, c * h)
            moved = max(moved, 1.0 if w is None else float(np.abs(new - w).max() / (1e-9 + np.abs(new).max())))
            state[key] = new
        smooth = max(1e-6, smooth * 0.5)
        if moved < 1e-6 and smooth <= 1e-6:
            break
    d.unpersist()
    rows = [[key, (w[:-1] if intercept else w).tolist(), float(w[-1]) if intercept else 0.0, o, n] for key, (o, w, n) in best.items()]
    found = spark.createDataFrame(rows, "_key string, weights array<double>, bias double, objective double, n long")
    if not keys:
        return found.drop("_key")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    return found.select(F.from_json("_key", kinds).alias("k"), "weights", "bias", "objective", "n").select("k.*", "weights", "bias", "objective", "n")


def predicted(features: Column, weights: Column, bias: Column) -> Column:
    return W.dot(features, weights) + bias


def final_evaluation(df: DataFrame, features: str, target: str, fold: str, folds: int, development: Column, c: float, epsilons: Sequence[float], rounds: int = 60) -> DataFrame:
    """The rows of df with epsilon, split (development or blind), prediction and residual: chosen on folds, refitted, evaluated once.

    Each epsilon is fitted on the development rows outside each fold, all in one pass, and scored by the mean CTR of
    the folds' own residuals. The best one (the lesser at ties) is fitted again on all development rows; blind rows take
    part in neither. Rows without features or target are left out, and a null `development` counts as blind. Without
    development rows, or where no epsilon has a score, nothing is returned.
    """
    own = [x for x in df.columns if x not in ("epsilon", "split", "prediction", "residual")]
    whole = cut(df.select(*own).where(F.col(features).isNotNull() & F.col(target).isNotNull()).withColumn("split", F.when(development, "development").otherwise("blind")))
    each = whole.where("split = 'development'").select(features, target, fold, F.explode(F.array(*map(F.lit, map(float, epsilons)))).alias("epsilon"))
    train = each.withColumn("_out", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where(F.col("_out") != F.col(fold))
    fit = insensitive_fit(train, ["epsilon", "_out"], features, target, c, "epsilon", rounds)
    tried = each.join(fit.select("epsilon", F.col("_out").alias(fold), "weights", "bias"), ["epsilon", fold])
    tried = tried.withColumn("_r", F.col(target) - predicted(F.col(features), F.col("weights"), F.col("bias"))).withColumn("_k", F.lit(1))
    best = choose(candidate_scores(tried, ["_k"], "epsilon", fold, "_r"), ["_k"], "epsilon").where("selected").select("epsilon").first()
    whole = whole.withColumn("epsilon", F.lit(best["epsilon"] if best else None).cast("double"))
    again = insensitive_fit(whole.where("split = 'development' and epsilon is not null"), ["epsilon"], features, target, c, "epsilon", rounds)
    out = whole.join(again.select("epsilon", "weights", "bias"), "epsilon")
    return out.withColumn("prediction", predicted(F.col(features), F.col("weights"), F.col("bias"))).withColumn("residual", F.col(target) - F.col("prediction")).drop("weights", "bias")


def attribution(df: DataFrame, keys: Sequence[str], arrays: Sequence[str], weights: str) -> DataFrame:
    """keys, i, importance: mean |x w| of each sample over events and detectors, the greatest scaled to 1."""
    keys, each = list(keys), None
    for a in arrays:
        e = df.select(*keys, F.posexplode(F.zip_with(a, weights, lambda x, w: F.abs(x * w))).alias("i", "v"))
        each = e if each is None else each.unionByName(e)
    m = each.groupBy(*keys, "i").agg(F.avg("v").alias("m"))
    top = m.groupBy(*keys).agg(F.max("m").alias("top"))
    out = m.join(top, keys) if keys else m.join(top)
    return out.select(*keys, "i", F.when(F.col("top") > 0, F.col("m") / F.col("top")).otherwise(0.0).alias("importance"))


def threshold_study(events: DataFrame, keys: Sequence[str], row_id: str, first: str, second: str, blind: float, validation: float, seed: int | str, step_ps: float) -> DataFrame:
    """One row for each key: the best parameter on validation (or blind, as the oracle) and its CTR on blind.

    first and second are equally long arrays of times in samples, one for each parameter of the grid.
    """
    from .splits import three_way

    keys = list(keys)
    d = three_way(events, keys, row_id, blind, validation, seed).select(*keys, "split", F.posexplode(F.zip_with(first, second, lambda a, b: (a - b) * step_ps)).alias("parameter", "delta"))
    s = residual_metrics(d, [*keys, "split", "parameter"], "delta").select(*keys, "split", "parameter", "n", "ctr_ps").where("ctr_ps is not null and not isnan(ctr_ps)")
    best = lambda split, name: s.where(F.col("split") == split).groupBy(*keys).agg(F.min(F.struct("ctr_ps", "parameter")).alias(name))
    chosen = best("validation", "v").join(best("blind", "o"), keys, "left")
    at = s.where("split = 'blind'").select(*keys, F.col("parameter").alias("p"), F.col("ctr_ps").alias("blind_ctr_ps"), F.col("n").alias("blind_n"))
    out = chosen.withColumn("p", F.col("v.parameter")).join(at, [*keys, "p"], "left")
    return out.select(*keys, F.col("p").alias("parameter"), F.col("v.ctr_ps").alias("validation_ctr_ps"), "blind_ctr_ps", "blind_n", F.col("o.parameter").alias("oracle_parameter"), F.col("o.ctr_ps").alias("oracle_ctr_ps"))


def standardised(df: DataFrame, keys: Sequence[str], features: str, training: Column) -> DataFrame:
    """df with the feature array scaled by the mean and deviation of the training rows of its key; a deviation of 0 counts as 1."""
    keys = list(keys)
    each = df.where(training).select(*keys, F.posexplode(features).alias("i", "x"))
    s = each.groupBy(*keys, "i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    s = s.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s")))).alias("_s"))
    out = df.join(s, keys) if keys else df.join(s)
    return out.withColumn(features, F.zip_with(features, "_s", lambda x, p: (x - p["m"]) / p["s"])).drop("_s")


def threshold_regression(df: DataFrame, keys: Sequence[str], features: str, target: str, training: Column, c: float, epsilon: float, rounds: int = 40) -> DataFrame:
    """Linear epsilon-insensitive regression with intercept on standardised threshold differences: df with prediction and residual.

    Fitted on the training rows of each key; rows with a missing feature have no prediction.
    """
    keys = list(keys)
    # read three times: for the scales, the fit and the residuals
    whole = cut(df.withColumn("_train", training).where(F.size(F.filter(features, lambda x: x.isNull() | F.isnan(x))) == 0))
    d = standardised(whole, keys, features, F.col("_train"))
    fit = insensitive_fit(d.where("_train"), keys, features, target, c, epsilon, rounds, intercept=True)
    out = d.join(fit.select(*keys, "weights", "bias"), keys) if keys else d.join(fit.select("weights", "bias"))
    return out.withColumn("prediction", predicted(F.col(features), F.col("weights"), F.col("bias"))).withColumn("residual", F.col(target) - F.col("prediction")).drop("weights", "bias", "_train")
