"""Statistics, fits, filters, splits and search against numpy and known answers."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronofit.functions import timing as T
from chronofit.functions import waveform as W
from chronofit.operators import fits, reports, search, selection, splits
from chronofit.operators import stats as E


def frame(spark, values, key="k"):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values)], "k string, i long, v double")


def test_robust_scale_rules(spark):
    x = np.random.default_rng(1).normal(5, 2, 301)
    r = E.robust_scale(frame(spark, x), ["k"], "v").first()
    assert r.center == pytest.approx(np.median(x)) and r.scale == pytest.approx(1.4826 * np.median(abs(x - np.median(x))))
    flat = E.robust_scale(frame(spark, [1, 1, 1, 9]), ["k"], "v").first()
    assert flat.scale == pytest.approx(4.0)  # zero MAD: the sample deviation
    assert E.robust_scale(frame(spark, [2, 2]), ["k"], "v", 3.0).first().scale == 3.0


def test_clipped_delay_drops_outliers_and_small_groups(spark):
    x = np.concatenate([np.random.default_rng(2).normal(100, 5, 200), [900, -700, 400]])
    d = frame(spark, x).unionByName(frame(spark, [1, 2, 3], "few"))
    r = {x.k: x for x in E.clipped_delay(d, ["k"], "v").collect()}
    assert 190 <= r["k"].n_kept <= 200 and abs(r["k"]["mean"] - 100) < 2 and r["few"]["mean"] is None


def test_correlations_and_p(spark):
    g = np.random.default_rng(3)
    x = g.integers(0, 9, 120).astype(float)
    y = x + g.normal(0, 3, 120)
    d = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, y)], "k string, x double, y double")
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    r = E.correlations(d, ["k"], "x", "y").first()
    assert r.pearson == pytest.approx(np.corrcoef(x, y)[0, 1]) and r.spearman == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    assert E.student_two_sided(2.0, 10) == pytest.approx(0.07338803, rel=1e-6) and E.student_two_sided(0.0, 5) == pytest.approx(1.0)
    q = E.false_discovery(spark.createDataFrame([("k", p) for p in (0.01, 0.02, 0.03, 0.5)], "k string, p double"), ["k"], "p", "q")
    assert [round(x.q, 6) for x in q.orderBy("p").collect()] == [0.04, 0.04, 0.04, 0.5]


def test_gaussian_fit_recovers_sigma(spark):
    x = np.rint(np.random.default_rng(4).normal(3000, 40_000, 4000)).astype(int)
    d = spark.createDataFrame([("a", int(v)) for v in x] + [("b", 1)], "run_id string, v long")
    r = {x.run_id: x for x in fits.gaussian_ctr(d, ["run_id"], "v").collect()}
    assert r["a"].success and r["a"].n == 4000 and abs(r["a"].sigma_ps - 40) < 1.5 and abs(r["a"].mean_ps - 3) < 2.5
    assert r["a"].ctr_ps == pytest.approx(T.FWHM * r["a"].sigma_ps) and 0 < r["a"].ctr_error_ps < 3
    assert not r["b"].success and r["b"].message == "too few events"


def test_gaussian_fit_has_empty_bins_beyond_the_values():
    """Three values of one bin's width: worked out by scanning the likelihood over five bins."""
    counts = np.array([0.0, 30, 60, 30, 0])
    edges = np.arange(6) * 10.0 - 25
    mean, sigma, _, _ = fits.binned_gaussian(edges, counts, 1.0, 8.0, (2.0, 100.0), (-25.0, 25.0))
    cdf = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))

    def loss(s):
        p = np.diff([cdf(e / s) for e in edges])
        return -(counts * np.log(np.maximum(p / p.sum(), 1e-300))).sum()

    grid = np.linspace(4, 12, 4001)
    assert abs(mean) < 1e-6 and sigma == pytest.approx(grid[np.argmin([loss(s) for s in grid])], abs=4e-3)


def test_peak_window_and_photopeak(spark):
    g = np.random.default_rng(5)
    x = np.concatenate([g.normal(200, 30, 400), g.normal(500, 10, 600)])
    d = spark.createDataFrame([("r", int(v), float(v)) for v in x], "run_id string, v long, mv double")
    p = fits.peak_window(d, ["run_id"], "v").first()
    assert abs(p.center - 500) < 3 and p.low < 490 and p.high > 520
    one = fits.peak_window(spark.createDataFrame([("r", 7)] * 60, "run_id string, v long"), ["run_id"], "v").first()
    assert one.low == one.high == 7 and fits.peak_window(d.limit(10), ["run_id"], "v").first().message == "too few events"
    q = fits.photopeak(d, ["run_id"], "mv", half_width=30.0).first()
    assert q.success and abs(q["mean"] - 500) < 2 and abs(q.sigma - 10) < 2
    assert not fits.photopeak(d.limit(5), ["run_id"], "mv").first().success


def test_bootstrap_is_near_theory(spark):
    x = np.random.default_rng(6).normal(0, 10, 500)
    r = E.bootstrap_ctr(frame(spark, x), ["k"], "i", "v", 200).first()
    assert r.n == 500 and r.ctr_uncertainty_ps == pytest.approx(T.FWHM * 10 / math.sqrt(1000), rel=0.3)
    assert E.bootstrap_ctr(frame(spark, [1, 2]), ["k"], "i", "v", 20).first().ctr_uncertainty_ps is None


def test_alignment_filter_minimum(spark):
    d = frame(spark, [*range(30), 5000])
    assert selection.alignment_filter(d, ["k"], ["v"]).count() == 30
    assert selection.alignment_filter(d, ["k"], ["v"], minimum=100).count() == 31


def test_splits_partition_and_sizes(spark):
    d = frame(spark, range(53))
    s = splits.holdout(d, ["k"], "i", 0.2, 1).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in s} == {"blind": 11, "development": 42}
    f = splits.folds(d, ["k"], "i", 5, 1).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in f] == [11, 11, 11, 10, 10]
    few = splits.holdout(frame(spark, range(3)), ["k"], "i", 0.2, 1)
    assert {r.split for r in few.collect()} == {None}


def wave(spark, *traces):
    return spark.createDataFrame([(i, [float(v) for v in t]) for i, t in enumerate(traces)], "i int, y array<double>")


def one(df, col):
    return [r[0] for r in df.orderBy("i").select(col).collect()]


def test_crossings(spark):
    y = F.col("y")
    d = wave(spark, [0, 2, 4, 3, 6, 1], [5, 6, 7], [0, 0, 0], [0, 3, 5], [9, 1, 2])
    assert one(d, W.first_crossing(y, 3.0)) == [1.5, None, None, 1.0, None]
    assert one(d, W.last_crossing_before_peak(y, 3.5)) == [pytest.approx(3 + 0.5 / 3), None, None, pytest.approx(1.25), None]
    assert one(d, W.leading_edge(y, 3.0)) == [1.5, None, None, 1.0, None]
    assert one(d, W.leading_edge(y, -1.0)) == [None] * 5


def test_windows_leave_no_trace(spark):
    y = F.col("y")
    d = wave(spark, range(10))
    assert one(d, W.anchored_window(y, F.lit(4), 2, 3)) == [[2, 3, 4, 5, 6, 7]]
    assert one(d, W.anchored_window(y, F.lit(1), 2, 3)) == [None]
    assert one(d, W.realigned(y, F.lit(8))) == [[8, 9] + [None] * 8]
    assert one(d, W.crop(y, F.lit(0), 2, 3)) == [[0, 1, 2, 3, 4]]
    assert one(d, W.subsample(y, 4)) == [[0, 4, 8]]


def test_low_pass_keeps_slow_and_kills_fast(spark):
    t = np.arange(200)
    slow, fast = np.sin(2 * np.pi * t / 100), np.sin(2 * np.pi * t / 2.5)
    d = wave(spark, slow + fast, slow, [3.0] * 50)
    got = one(d, W.low_pass(0.2, 4)("y"))
    assert np.abs(np.array(got[0]) - slow)[20:-20].max() < 0.02 and np.abs(np.array(got[1]) - slow)[20:-20].max() < 0.02
    assert np.allclose(got[2], 3.0)
    with pytest.raises(ValueError):
        W.low_pass(1.0, 4)


def test_linear_regression_is_antisymmetric_and_near_optimal(spark):
    g = np.random.default_rng(8)
    a, b = g.normal(size=(300, 5)), g.normal(size=(300, 5))
    w = np.array([1.0, -2, 0.5, 0, 3])
    y = (a - b) @ w + g.normal(0, 0.1, 300)
    rows = [("k", p.tolist(), q.tolist(), float(v)) for p, q, v in zip(a, b, y)]
    d = spark.createDataFrame(rows, "k string, a array<double>, b array<double>, y double")
    fit = lambda x, y: search.insensitive_fit(d.select("k", x.alias("x"), y.alias("y")), ["k"], "x", "y", 10.0, 0.05, 15).first()
    f = fit(search.antisymmetric(F.col("a"), F.col("b")), F.col("y"))
    assert np.abs(np.array(f.weights) - w).max() < 0.05
    swapped = fit(search.antisymmetric(F.col("b"), F.col("a")), -F.col("y"))
    assert np.allclose(f.weights, swapped.weights, atol=1e-6)
    r = np.abs(y - (a - b) @ w) - 0.05
    assert f.objective <= 0.5 * w @ w + 10 * np.maximum(r, 0).sum() + 1e-6


def test_shift_test_and_p(spark):
    g = np.random.default_rng(9)
    x = g.normal(size=(40, 16))
    d = spark.createDataFrame([(i, v.tolist(), (v + 0.1 * g.normal(size=16)).tolist()) for i, v in enumerate(x)], "i long, a array<double>, b array<double>")
    r = reports.permutation_p(reports.shift_test(d, "i", "a", "b", 40, [0, *range(1, 20)])).first()
    assert r.matched > 0.9 and r.p == pytest.approx(1 / 20)


def test_codes(spark):
    d = spark.createDataFrame([("a", "accepted"), ("b", "nonsense")], "s string, t string")
    assert [tuple(r) for r in d.select(T.side_code(F.col("s")), T.status_code(F.col("t"))).collect()] == [(0, 0), (1, 255)]
    with pytest.raises(Exception, match="not a side"):
        d.select(T.side_code(F.lit("c"))).collect()


def test_epsilon_by_key_is_the_fit_of_that_epsilon(spark):
    g = np.random.default_rng(21)
    x = g.normal(0, 1, (80, 2))
    y = x @ [2.0, -1.0] + g.normal(0, 0.3, 80)
    d = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, y double")
    both = search.insensitive_fit(d.select("*", F.explode(F.array(F.lit(0.1), F.lit(1.0))).alias("e")), ["e"], "x", "y", 1.0, "e", 25)
    for r in both.collect():
        alone = search.insensitive_fit(d, [], "x", "y", 1.0, r.e, 25).first()
        assert r.weights == pytest.approx(alone.weights, rel=1e-6) and r.objective == pytest.approx(alone.objective, rel=1e-9)


def test_final_evaluation_fits_development_rows_and_leaves_blind_ones_alone(spark):
    g = np.random.default_rng(22)
    x = g.normal(0, 1, (120, 2))
    y = x @ [3.0, 1.0] + g.normal(0, 0.2, 120)
    y[100:] += 50  # blind rows alone are shifted: a fit that saw them would differ
    rows = [(i, i % 3 if i < 100 else None, i < 100, x[i].tolist(), float(y[i]), "own") for i in range(120)] + [(120, 0, True, None, 1.0, "own"), (121, 0, True, [1.0, 1.0], None, "own")]
    d = spark.createDataFrame(rows, "id int, fold int, dev boolean, x array<double>, y double, residual string")
    out = search.final_evaluation(d, "x", "y", "fold", 3, F.col("dev"), 1.0, [0.05, 30.0], 25).toPandas().sort_values("id")
    assert out.id.tolist() == list(range(120)) and set(out.epsilon) == {0.05} and (out.split == np.where(out.id < 100, "development", "blind")).all()
    alone = search.insensitive_fit(d.where("dev"), [], "x", "y", 1.0, 0.05, 25).first()
    assert out.residual.to_numpy() == pytest.approx(y - x @ np.array(alone.weights), abs=1e-6)
    assert out.residual[out.split == "blind"].mean() > 45
    assert search.final_evaluation(d.where("not dev"), "x", "y", "fold", 3, F.col("dev"), 1.0, [0.05], 25).count() == 0


def test_refit_bootstrap_is_near_the_fit_error(spark):
    v = np.rint(np.random.default_rng(23).normal(0, 30_000, 600)).astype(int)
    d = spark.createDataFrame([("a", i, int(x)) for i, x in enumerate(v)] + [("few", 1, 5)], "k string, id long, v long")
    r = {x.k: x for x in fits.bootstrap_gaussian(d, ["k"], "id", "v", 20).collect()}
    fit = fits.gaussian_ctr(d.where("k = 'a'"), ["k"], "v").first()
    assert r["a"].fits >= 16 and 0.4 * fit.ctr_error_ps < r["a"].ctr_uncertainty_ps < 2.5 * fit.ctr_error_ps
    assert r["few"].fits == 0 and r["few"].ctr_uncertainty_ps is None


def test_shifts_are_drawn_between_one_and_n_less_one():
    s = reports.drawn_shifts(40, 200, 17)
    assert s[0] == 0 and sorted(s) == list(range(40)) and reports.drawn_shifts(1, 9, 17) == [0] == reports.drawn_shifts(0, 9, 17)


def test_partners_are_bijections_without_fixed_points_or_a_pattern(spark):
    events = spark.range(97).withColumnRenamed("id", "i")
    got = reports.random_pairs(events, "i", 97, 6, 5).collect()
    steps = set()
    for draw in range(1, 7):
        j = {r.i: r.j for r in got if r.draw == draw}
        assert sorted(j) == sorted(j.values()) == list(range(97)) and all(k != v for k, v in j.items())
        steps |= {(v - k) % 97 for k, v in j.items()}
    assert len(steps) > 90  # no cyclic shift
    assert reports.random_pairs(events.limit(1), "i", 1, 3, 5).isEmpty()
    two = reports.random_pairs(spark.range(2).withColumnRenamed("id", "i"), "i", 2, 3, 5).collect()
    assert all(r.j == 1 - r.i for r in two) and len(two) == 6


def test_pair_similarity_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(reports, "PAIR_BLOCK", 5)
    g = np.random.default_rng(12)
    x, y = g.normal(size=(2, 23, 7))
    x[4] = 0
    d = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k long, a array<double>, b array<double>").repartition(3)
    pairs = [(t, i, (5 * i + t) % 25) for t in range(4) for i in range(23)]
    got = {(r.draw, r.i, r.j): r.similarity for r in reports.pair_similarity(d, "k", "a", "b", spark.createDataFrame(pairs, "draw int, i long, j long")).collect()}
    want = {(t, i, j): x[i] @ y[j] / np.linalg.norm(x[i]) / np.linalg.norm(y[j]) for t, i, j in pairs if i != 4 and j < 23}
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) for c in want)


def test_regression_rows_are_packed_by_key():
    rows = pa.RecordBatch.from_pydict({"_key": ["b", "a", "b"], "x": [[1.0, 2.0], [3.0, 4.0], [5.0, None]], "y": [1.0, 2.0, 3.0], "_e": [0.1, 0.2, 0.3]})
    a, b = next(search._blocks([rows])).to_pylist()
    assert (a["_key"], b["_key"]) == ("a", "b") and np.frombuffer(a["x"]).tolist() == [3.0, 4.0]
    assert np.frombuffer(b["y"]).tolist() == [1.0, 3.0] and np.frombuffer(b["e"]).tolist() == [0.1, 0.3]
    assert np.array_equal(np.frombuffer(b["x"]), [1.0, 2.0, 5.0, np.nan], equal_nan=True)
    with pytest.raises(ValueError, match="differ in length"):
        next(search._blocks([pa.RecordBatch.from_pydict({"_key": ["a", "a"], "x": [[1.0], [1.0, 2.0]], "y": [1.0, 2.0], "_e": [0.1, 0.2]})]))
