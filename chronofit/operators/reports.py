"""Report tables: grouped runs, summaries, joins of results, top lists, counts and series."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .stats import finite, quantile_summary

#: What makes runs compatible.
GROUP = ("voltage", "acquisition_mode", "energy_threshold_mv", "timing_threshold_mv")


def compatible_groups(runs: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """One row for each group of runs: keys, group_id, run_ids in order of run number, n_runs."""
    keys = list(keys)
    g = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("run_number", "run_id"))).alias("m"))
    label = F.concat_ws("_", F.format_string("%sV", F.col(keys[0]).cast("string")), *(F.col(k).cast("string") for k in keys[1:]))
    return g.select(*keys, label.alias("group_id"), F.array_join(F.transform("m", lambda x: x["run_id"]), ",").alias("run_ids"), F.size("m").alias("n_runs"))


def event_offsets(runs: DataFrame, count: str, keys: Sequence[str] = GROUP, order: str = "run_number") -> DataFrame:
    """Add event_offset: the number of events in the group's earlier runs."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("event_offset", F.coalesce(F.sum(count).over(w), F.lit(0)))


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """One row for each key: that of the greatest version; where versions tie, the one from `new`."""
    keys = list(keys)
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max(F.struct(F.col(version).alias("_v"), "_new", F.struct(*rest).alias("_r"))).alias("b"))
    return best.select(*keys, "b._r.*").select(*old.columns)


def on_voltage(left: DataFrame, right: DataFrame, score: str, order: str) -> DataFrame:
    """Two instruments' rows at equal voltage: of the right, the last row for each voltage; with their difference."""
    r = right.where(finite(F.col(score)).isNotNull()).groupBy("voltage").agg(F.max_by(score, order).alias("right_ps"))
    return left.where(finite(F.col(score)).isNotNull()).select("voltage", "run_id", F.col(score).alias("left_ps")).join(r, "voltage").withColumn("difference_ps", F.col("left_ps") - F.col("right_ps"))


def separation(a: Column, ea: Column, b: Column, eb: Column) -> Column:
    """Distance of two values in units of their joint error."""
    return F.abs(a - b) / F.sqrt(ea * ea + eb * eb)


def selection_against_blind(selected: DataFrame, blind: DataFrame, keys: Sequence[str] = ("file_id", "mode", "model")) -> tuple[DataFrame, DataFrame]:
    """Selected rows beside their blind rows, and per mode n and Pearson r of the two (null under 3 rows)."""
    joined = selected.join(blind, list(keys))
    r = F.when(F.count("*") >= 3, F.corr("selection_ps", "blind_ps"))
    return joined, joined.groupBy("mode").agg(F.count("*").alias("n"), r.alias("pearson"))


def ctr_by_voltage(df: DataFrame, score: str, error: str) -> DataFrame:
    return df.groupBy("voltage").agg(F.avg(score).alias("ctr_ps"), F.sqrt(F.sum(F.col(error) * F.col(error))).alias("error_ps"), F.count("*").alias("n"))


def best_by_count(rows: DataFrame, keys: Sequence[str], count: str, score: str, baseline: DataFrame) -> DataFrame:
    """keys, count, best and its improvement over the baseline of the same keys in percent; keys without a baseline are left out."""
    keys = list(keys)
    best = rows.groupBy(*keys, count).agg(F.min(score).alias("best_ps"))
    return best.join(baseline, keys).withColumn("improvement_pct", 100 * (F.col("baseline_ps") - F.col("best_ps")) / F.col("baseline_ps"))


def correction_matrix(rows: DataFrame, models: Sequence[str], event: str = "event_index", model: str = "model", value: str = "value") -> DataFrame:
    """model_a, model_b, n, pearson over events that all models have with finite values; fewer than 3 give null."""
    wide = rows.groupBy(event).pivot(model, list(models)).agg(F.max(finite(F.col(value)))).dropna()
    names = [(a, b) for a in models for b in models]
    s = wide.agg(F.count("*").alias("n"), *(F.corr(f"`{a}`", f"`{b}`").alias(f"r{i}") for i, (a, b) in enumerate(names)))
    each = F.array(*(F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.when(F.col("n") >= 3, F.col(f"r{i}")).alias("pearson")) for i, (a, b) in enumerate(names)))
    return s.select("n", F.explode(each).alias("x")).select("x.model_a", "x.model_b", "n", "x.pearson")


def extremes(df: DataFrame, keys: Sequence[str], score: str, order: str, k: int = 3, best: bool = True) -> DataFrame:
    """The k rows of greatest (or least) finite score for each key, with their place; ties by the order column."""
    s = finite(F.col(score))
    w = Window.partitionBy(*keys).orderBy(s.desc() if best else s.asc(), F.col(order))
    return df.where(s.isNotNull()).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def representative(df: DataFrame, keys: Sequence[str], amplitude: str, order: str) -> DataFrame:
    """The row of each key whose amplitude is nearest to the median; ties by the order column."""
    keys = list(keys)
    m = df.groupBy(*keys).agg(F.percentile(amplitude, 0.5).alias("_m"))
    d = df.join(m, keys)
    return d.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(F.abs(F.col(amplitude) - F.col("_m")), F.col(order))).alias("r")).select(*keys, "r.*")


def regional_importance(profile: DataFrame, keys: Sequence[str], time: str, importance: str, start: float, stop: float, width: float) -> DataFrame:
    """keys, bin, importance: mean of |importance| over its maximum in fixed time bins, the last closed; an empty bin takes the nearest sample."""
    keys, n = list(keys), int(round((stop - start) / width))
    top = profile.groupBy(*keys).agg(F.max(F.abs(importance)).alias("_t"))
    d = profile.join(top, keys).select(*keys, F.col(time).alias("t"), (F.abs(importance) / F.when(F.col("_t") > 0, F.col("_t")).otherwise(1.0)).alias("v"))
    bins = d.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    inside = d.where(F.col("t").between(start, stop)).groupBy(*keys, F.least(F.floor((F.col("t") - start) / width), F.lit(n - 1)).cast("int").alias("bin")).agg(F.avg("v").alias("importance"))
    center = start + (F.col("bin") + 0.5) * width
    empty = bins.join(inside, [*keys, "bin"], "left_anti")
    near = empty.join(d, keys).groupBy(*keys, "bin").agg(F.min_by("v", F.struct(F.abs(F.col("t") - center), F.col("t"))).alias("importance"))
    return inside.unionByName(near)


def nearest_row(rows: DataFrame, keys: Sequence[str], column: str, wanted: float, score: str) -> DataFrame:
    """The row of each key whose column is nearest to a value; ties by the score."""
    keys = list(keys)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.abs(F.col(column) - wanted), F.col(score))).alias("r")).select(*keys, "r.*")


def error_populations(df: DataFrame, keys: Sequence[str], residual: str, groups: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows with z, the centred residual in sample deviations, and the population it falls in; rows of none are left out."""
    keys = list(keys)
    s = df.groupBy(*keys).agg(F.avg(residual).alias("_m"), F.stddev_samp(residual).alias("_s"))
    d = df.join(s, keys).where("_s > 0").withColumn("z", (F.col(residual) - F.col("_m")) / F.col("_s"))
    name = F.lit(None).cast("string")
    for k, (center, half) in groups.items():
        name = F.coalesce(name, F.when(F.abs(F.col("z") - center) <= half, k))
    return d.withColumn("population", name).where("population is not null").drop("_m", "_s")


def mean_difference(df: DataFrame, keys: Sequence[str], first: str, second: str) -> DataFrame:
    """keys, i, n, mean of first - second at each sample over finite values."""
    each = df.select(*keys, F.posexplode(F.zip_with(first, second, lambda a, b: a - b)).alias("i", "x")).withColumn("x", finite(F.col("x")))
    return each.groupBy(*keys, "i").agg(F.count("x").alias("n"), F.avg("x").alias("mean"))


def drawn_shifts(n: int, draws: int, seed: int) -> list[int]:
    """0 and `draws` different cyclic shifts of n events (all n - 1 where there are no more), drawn by sha256(seed|k) for k = 0, 1, ..."""
    out = {0: None}
    k = 0
    while len(out) <= min(draws, n - 1):
        out[1 + int(hashlib.sha256(f"{seed}|{k}".encode()).hexdigest()[:8], 16) % (n - 1)] = None
        k += 1
    return list(out)


#: Swaps of a bijection, in each direction.
SWAPS = 16


def partner(i: Column, draw: Column, n: int, seed: int) -> Column:
    """Another event of 0..n-1 for event i: for each draw a bijection without fixed points, computed from i alone; n > 1.

    A chain of swaps scatters the events, the place after the next one is taken, and the chain is undone. In a swap, x and
    its mirror (k - x) mod n change places or not, as a hash of the greater of them says.
    """

    def number(*parts: Column) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts))), 1, 7), 16, 10).cast("long")

    def swapped(x: Column, r: Column) -> Column:
        # an array of one binds the mirror: an expression that stands in three places would be hashed in each
        bound = F.transform(F.array(F.pmod(number(draw, r) - x, F.lit(n))), lambda mirror: F.when(number(draw, r, F.greatest(x, mirror)) % 2 == 0, mirror).otherwise(x))
        return F.element_at(bound, 1)

    there = F.aggregate(F.sequence(F.lit(0), F.lit(SWAPS - 1)), i.cast("long"), swapped)
    return F.aggregate(F.sequence(F.lit(SWAPS - 1), F.lit(0), F.lit(-1)), F.pmod(there + 1, F.lit(n)).cast("long"), swapped)


def random_pairs(events: DataFrame, index: str, n: int, draws: int, seed: int) -> DataFrame:
    """draw, i, j: every event with its partner of each draw; none where n < 2."""
    d = events.select(F.col(index).cast("long").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    return d.where(F.lit(n > 1)).select("draw", "i", partner(F.col("i"), F.col("draw"), max(n, 2), seed).alias("j"))


#: Events of a block when pairs of waveforms are compared.
PAIR_BLOCK = 2048


def pair_similarity(df: DataFrame, index: str, first: str, second: str, pairs: DataFrame) -> DataFrame:
    """draw, i, j, similarity: cosine of event i's first row with event j's second, for pairs (draw, i, j); zero rows have none.

    A waveform goes once to each block of partners that it has, however many draws pair it there, and a task holds two
    blocks of waveforms and the pairs between them.
    """
    from chronofit.functions.waveform import dot

    block = lambda c: F.floor(F.col(c) / PAIR_BLOCK)
    narrow = pairs.select("draw", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).withColumn("bi", block("i")).withColumn("bj", block("j"))

    def side(column: str, own: str) -> DataFrame:
        unit = F.transform(F.col(column), lambda x: x / F.sqrt(dot(F.col(column), F.col(column))))
        rows = df.where(dot(F.col(column), F.col(column)) > 0).select(F.col(index).cast("long").alias(own), unit.alias("x"))
        return rows.join(narrow.select(own, "bi", "bj").distinct(), own)

    none = F.lit(None).cast("long")
    a = side(first, "i").select("bi", "bj", F.lit(None).cast("int").alias("draw"), "i", none.alias("j"), "x")
    b = side(second, "j").select("bi", "bj", F.lit(None).cast("int").alias("draw"), none.alias("i"), "j", "x")
    rows = a.unionByName(b).unionByName(narrow.select("bi", "bj", F.col("draw").cast("int").alias("draw"), "i", "j", F.lit(None).cast("array<double>").alias("x")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wanted, have = pdf[pdf.draw.notna()], pdf[pdf.draw.isna()]
        a, b = have[have.i.notna()].sort_values("i"), have[have.j.notna()].sort_values("j")
        ids = [a.i.to_numpy(np.int64), b.j.to_numpy(np.int64)]
        draw, ends = wanted.draw.to_numpy(np.int64), [wanted.i.to_numpy(np.int64), wanted.j.to_numpy(np.int64)]
        if not (len(a) and len(b)):
            draw, ends = draw[:0], [e[:0] for e in ends]
        at = [np.searchsorted(x, e) for x, e in zip(ids, ends, strict=True)]
        ok = np.logical_and.reduce([x[np.minimum(p, len(x) - 1)] == e for x, p, e in zip(ids, at, ends, strict=True)]) if len(draw) else np.zeros(0, bool)
        x, y = (np.stack(s.x.to_list()) if len(s) else np.zeros((0, 1)) for s in (a, b))
        p, q = at[0][ok], at[1][ok]
        found = [np.einsum("ij,ij->i", x[p[k : k + 8192]], y[q[k : k + 8192]]) for k in range(0, len(p), 8192)]
        return pd.DataFrame({"draw": draw[ok], "i": ends[0][ok], "j": ends[1][ok], "similarity": np.concatenate(found) if found else np.zeros(0)})

    return rows.groupBy("bi", "bj").applyInPandas(run, "draw int, i long, j long, similarity double")


def shift_test(df: DataFrame, index: str, first: str, second: str, n: int, shifts: Sequence[int]) -> DataFrame:
    """shift, n, similarity: mean cosine of event i's first row with event (i + shift) mod n's second; shift 0 is the matched mean."""
    pairs = df.select(F.col(index).alias("i"), F.explode(F.array(*map(F.lit, shifts))).alias("draw")).withColumn("j", (F.col("i") + F.col("draw")) % n)
    return pair_similarity(df, index, first, second, pairs).groupBy(F.col("draw").alias("shift")).agg(F.count("*").alias("n"), F.avg("similarity").alias("similarity"))


def similarity_distribution(df: DataFrame, index: str, first: str, second: str, n: int, draws: int = 20, seed: int = 1) -> DataFrame:
    """kind (matched or random), n, mean, std, median, q1, q3, p1, p99 of the cosines of events with themselves and with drawn partners."""
    own = df.select(F.lit(0).alias("draw"), F.col(index).alias("i"), F.col(index).alias("j"))
    pairs = cut(own.unionByName(random_pairs(df, index, n, draws, seed)))  # read three times, and partners are long chains of hashes
    both = pair_similarity(df, index, first, second, pairs)
    return quantile_summary(cut(both).withColumn("kind", F.when(F.col("draw") == 0, "matched").otherwise("random")), ["kind"], "similarity")


def permutation_p(table: DataFrame) -> DataFrame:
    """matched, null_mean, gain, p of a shift_test() table: p = (1 + nulls at or above the matched mean) / (1 + nulls)."""
    m = F.max(F.when(F.col("shift") == 0, F.col("similarity")))
    nulls = F.collect_list(F.when(F.col("shift") != 0, F.col("similarity")))
    t = table.agg(m.alias("matched"), nulls.alias("_n"))
    above = F.size(F.filter("_n", lambda x: x >= F.col("matched")))
    mean = F.aggregate("_n", F.lit(0.0), lambda s, x: s + x) / F.size("_n")
    return t.select("matched", mean.alias("null_mean"), (F.col("matched") - mean).alias("gain"), ((1 + above) / (1 + F.size("_n"))).alias("p"))
