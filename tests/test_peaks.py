"""Energy windows and photopeaks against plain numpy and hand-made peaks."""

import math

import numpy as np
import pytest

from chronofit.operators import fits


def window_by_hand(x, low_scale=2.0, high_scale=4.0, rightmost=True):
    x = np.sort(np.asarray(x, float))
    pad = max(1.0, 0.03 * (x[-1] - x[0]))
    grid = np.linspace(x[0] - pad, x[-1] + pad, 4096)
    h = len(x) ** -0.2 * 0.35 * x.std(ddof=1)
    y = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1)
    top = [k for k in range(1, 4095) if y[k - 1] < y[k] > y[k + 1] and y[k] >= 0.12 * y.max()]
    k = (top[-1] if rightmost else max(top, key=lambda i: y[i])) if top else int(y.argmax())
    i = j = k
    while i > 0 and y[i] > y[k] / 2:
        i -= 1
    while j < 4095 and y[j] > y[k] / 2:
        j += 1
    core = x[(x >= math.floor(grid[i])) & (x <= math.ceil(grid[j]))]
    core = core if len(core) >= 2 else x
    c = np.median(core)
    s = 1.4826 * np.median(np.abs(core - c)) or core.std(ddof=1) or max((grid[j] - grid[i]) / 2.355, 1.0)
    low, high = math.floor(c - low_scale * s), math.ceil(c + high_scale * s)
    low, high = (low, high) if low < high else (x[0], x[-1])
    return low, high, grid[k], c, s, int(((x >= low) & (x <= high)).sum())


def groups():
    g = np.random.default_rng(3)
    return {
        "two peaks": np.rint(np.concatenate([g.normal(200, 30, 900), g.normal(500, 10, 300)])), "a high peak before a low one": np.rint(np.concatenate([g.normal(100, 5, 900), g.normal(300, 20, 200)])),
        "half alike": np.concatenate([np.full(60, 40.0), np.rint(g.normal(300, 50, 30))]), "alike but one": np.concatenate([np.full(70, 10.0), [4000.0]]), "two values": np.array([5.0] * 30 + [6.0] * 30), "wide": np.rint(g.uniform(0, 100_000, 300)),
    }


@pytest.mark.parametrize("rightmost", [True, False])
def test_peak_windows(spark, rightmost):
    made = groups()
    rows = [(k, int(v)) for k, x in made.items() for v in x] + [("same", 9)] * 55 + [("few", 1), ("few", 2)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(6)
    got = {r.k: r for r in fits.peak_window(df, ["k"], "v", rightmost=rightmost).collect()}
    for k, x in made.items():
        low, high, peak, center, scale, n = window_by_hand(x, rightmost=rightmost)
        assert n >= 5 and (got[k].low, got[k].high, got[k].center, got[k].n, got[k].message) == (low, high, center, len(x), ""), k
        assert got[k].peak == pytest.approx(peak) and got[k].scale == pytest.approx(scale), k
    assert (got["same"].low, got["same"].high, got["same"].peak, got["same"].scale) == (9, 9, 9, 1)
    assert got["few"].message == "too few events" and got["few"].low is None
    strict = {r.k: r for r in fits.peak_window(df.where("k = 'two values'"), ["k"], "v", inside=100, rightmost=rightmost).collect()}
    assert strict["two values"].message == "too few events in the peak" and strict["two values"].low is None


def test_local_maxima_take_the_middle_of_flat_tops():
    assert fits.local_maxima(np.array([0, 1, 0, 2, 2, 2, 1, 3, 3])).tolist() == [1, 4]
    assert fits.local_maxima(np.array([0, 1, 1, 2, 1])).tolist() == [3] and not len(fits.local_maxima(np.ones(5)))


def peak_counts(n, mean, sigma, width, low=0, high=1000):
    x = np.arange(low, high, width) + width / 2
    return x, np.rint(n * width / sigma / math.sqrt(2 * math.pi) * np.exp(-0.5 * ((x - mean) / sigma) ** 2)).astype(int)


def test_photopeak_errors_and_chi_square(spark):
    x, y = peak_counts(40_000, 500.0, 12.0, 1.0)
    rows = [("r", float(v)) for v, n in zip(x, y, strict=True) for _ in range(n)] + [("few", 1.0)] * 19 + [("nan", float("nan"))] * 30
    df = spark.createDataFrame(rows, "k string, mv double").repartition(4)
    got = {r.k: r for r in fits.photopeak(df, ["k"], "mv", half_width=40.0).collect()}
    r = got["r"]
    assert r.success and r["mean"] == pytest.approx(500, abs=0.02) and r.sigma == pytest.approx(12, abs=0.05)
    inside = y[(x >= r.fit_low) & (x <= r.fit_high)]
    assert r.mean_error == pytest.approx(12 / math.sqrt(inside.sum()), rel=0.1) and r.sigma_error == pytest.approx(12 / math.sqrt(2 * inside.sum()), rel=0.35)
    assert r.chi2 < 0.1 * r.ndof and r.ndof == len(inside) - 3 and 1 <= r.iterations <= 6
    assert r.low == pytest.approx(r["mean"] - 2 * r.sigma) and r.high == pytest.approx(r["mean"] + 4 * r.sigma)
    assert not got["few"].success and got["few"].message == "too few values" and "nan" not in got


def test_photopeak_keeps_within_its_bounds():
    x = np.arange(20) + 0.5
    p, cov = fits.bounded_gaussian(x, 100 * np.exp(-0.5 * ((x - 30) / 4) ** 2), (50, 10, 5), (0, 5, 0.1), (np.inf, 15, 40))
    assert 5 <= p[1] <= 15 and 0.1 <= p[2] <= 40 and cov.shape == (3, 3)
    y = np.rint(300 * np.exp(-0.5 * ((x - 9.7) / 2.5) ** 2))
    p, cov = fits.bounded_gaussian(x, y, (100, 8, 5), (0, 0, 0.1), (np.inf, 20, 20))
    cost = lambda q: (((q[0] * np.exp(-0.5 * ((x - q[1]) / q[2]) ** 2) - y) ** 2) / np.maximum(y, 1)).sum()
    for k, step in ((0, 0.5), (1, 0.01), (2, 0.01)):
        for sign in (1, -1):
            q = p.copy()
            q[k] += sign * step
            assert cost(q) > cost(p)
    curve = np.array([[(cost(p + a + b) - cost(p + a - b) - cost(p - a + b) + cost(p - a - b)) / 8 / (1e-3 * s) ** 2 for b in [np.eye(3)[j] * 1e-3 * s]][0] for a, j, s in [(np.eye(3)[i] * 1e-3 * p[i], i, p[i]) for i in range(3)]])
    assert np.allclose(np.diag(np.linalg.inv(cov)), curve, rtol=0.2)


def test_a_failed_first_round_fails_the_row(spark):
    df = spark.createDataFrame([("r", 10.5)] * 30, "k string, mv double")
    r = fits.photopeak(df, ["k"], "mv").first()
    assert not r.success and r.message == "too few populated bins" and r["mean"] is None
