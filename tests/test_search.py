import numpy as np
import pyarrow as pa
import pytest
from chronofit.functions import waveform as W
from chronofit.operators import search, splits
from chronofit.plans import wave_queries
from pyspark.sql import functions as F

from conftest import SMALL

STEP, FWHM = 100.0, 2.3548200450309493


def ramps(spark, n, seed=3):
    """Pairs of straight ramps: a threshold v is crossed at sample v / slope."""
    g = np.random.default_rng(seed)
    slopes = g.uniform(8, 12, (n, 2))
    rows = [(i, *([float(s * k) for k in range(20)] for s in pair)) for i, pair in enumerate(slopes)]
    return slopes, spark.createDataFrame(rows, "event_index long, mv1 array<double>, mv2 array<double>")


def test_threshold_search_scores_near_equal_folds(spark):
    slopes, pairs = ramps(spark, 40)
    best, table = search.adaptive_threshold(pairs, "mv1", "mv2", "event_index", 3, 20.0, 500.0, STEP, coarse=5, fine=3)
    fold = {r.event_index: r.fold for r in splits.folds(pairs, [], "event_index", 3, 1).collect()}
    groups = [[i for i in fold if fold[i] == k] for k in range(3)]
    assert sorted(map(len, groups)) == [13, 13, 14]
    spread = np.mean([np.std([1 / slopes[i][0] - 1 / slopes[i][1] for i in g], ddof=1) for g in groups]) * STEP * FWHM
    rows = table.collect()
    assert len(rows) == 8 and all(r.valid and r.score_ps == pytest.approx(r.value * spread) for r in rows)
    assert best == 20.0 and max(r.value for r in rows) == pytest.approx(slopes.min() * 19)


def test_threshold_search_excludes_folds_of_one_event(spark):
    pairs = ramps(spark, 3)[1]
    with pytest.raises(ValueError, match="fewer than two"):
        search.adaptive_threshold(pairs, "mv1", "mv2", "event_index", 2, 20.0, 100.0, STEP, coarse=3, fine=3)
    with pytest.raises(ValueError, match="no threshold"):
        search.adaptive_threshold(pairs, "mv1", "mv2", "event_index", 2, 9000.0, 9999.0, STEP, coarse=3, fine=3)


def test_threshold_query_takes_all_events(spark):
    rows = wave_queries.h3_adaptive_threshold(spark, SMALL).collect()
    assert len(rows) == 121 + 41 and all(r.valid for r in rows)


def test_times_of_all_levels_are_those_of_leading_edge(spark):
    g, nan, inf = np.random.default_rng(4), float("nan"), float("inf")
    odd = [[], [5.0], [0.0, 3.0, 3.0], [4.0, 1.0, 5.0], [None, 4.0, 5.0], [0.0, None, 4.0], [0.0, nan, 1.0], [-inf, 2.0], [0.0, inf], [0.0, 2.0, 2.0, 4.0]]
    rows = odd + [g.integers(-3, 9, g.integers(1, 30)).astype(float).tolist() for _ in range(60)] + [g.normal(0, 4, 40).tolist() for _ in range(60)]
    levels = np.linspace(0.0, 7.0, 29)
    times, found = search.led_times(pa.array(rows, pa.list_(pa.float64())), levels)
    d = spark.createDataFrame(list(enumerate(rows)), "i int, y array<double>")
    want = [r.t for r in d.select("i", W.led_grid(F.col("y"), levels.tolist()).alias("t")).orderBy("i").collect()]
    assert [[x is not None for x in r] for r in want] == found.tolist()
    assert all(x is None or x == y or x != x and y != y for r, s in zip(want, times.tolist(), strict=True) for x, y in zip(r, s, strict=True))


def test_spreads_come_without_a_row_for_each_level_and_event(spark):
    pairs = ramps(spark, 40)[1].withColumn("_fold", (F.col("event_index") % 3).cast("int"))
    levels = np.array([20.0, 100.0, 170.0])
    got = search._led_spreads(pairs.repartition(5), "mv1", "mv2", levels, STEP)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    grid = lambda c: W.led_grid(F.col(c), levels.tolist())
    each = pairs.select("_fold", F.posexplode(F.zip_with(grid("mv1"), grid("mv2"), lambda a, b: (a - b) * STEP)).alias("k", "x"))
    want = {(r.k, r._fold): r for r in each.groupBy("k", "_fold").agg(F.stddev_samp("x").alias("sd"), F.count_if(F.col("x").isNull()).alias("missing"), F.count("*").alias("n")).collect()}
    rows = got.collect()
    assert len(rows) == len(want) == 9
    for r in rows:
        w = want[r.k, r._fold]
        assert (r.n, r.missing) == (w.n, w.missing) and r.sd == pytest.approx(w.sd)
