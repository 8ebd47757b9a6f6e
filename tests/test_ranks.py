"""Exact ranks and quantiles against plain sorting, with ranges and brackets so small that many are needed."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofit.operators import quantiles as Q
from chronofit.operators import splits
from chronofit.operators import stats as E


@pytest.fixture(params=[(16, 8), (1024, 4096)])
def small(request, monkeypatch):
    monkeypatch.setattr(Q, "BINS", request.param[0])
    monkeypatch.setattr(Q, "FEW", request.param[1])


def groups():
    g = random.Random(1)
    return {
        "uniform": [g.random() for _ in range(500)], "ties": [float(g.choice([1, 1, 1, 2, 7])) for _ in range(400)], "one": [3.5], "two": [1.0, 2.0], "same": [4.25] * 300, "signed": [g.gauss(0, 1) * 10 ** g.randrange(-8, 8) for _ in range(300)],
        "far": [1e308, -1e308, 0.0, 5e-324, -5e-324, 1e-320, 2e-320, 3.0], "tiny": [5e-324 * k for k in range(9)], "odd": [float("nan"), float("inf"), 1.0, None, 2.0, -float("inf")], "none": [None, float("nan")],
    }


def test_quantiles_are_exact(spark, small):
    rows = [(k, x) for k, xs in groups().items() for x in xs] + [(None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    fractions = [0.0, 0.1587, 0.25, 0.5, 0.8413, 1.0]
    got = {r._group.k: (r.n, r.q) for r in Q.quantiles(Q.counted(df, ["k"], F.col("x")), fractions).collect()}
    want = {r.k: r.q for r in df.withColumn("x", E.finite(F.col("x"))).where("x is not null").groupBy("k").agg(F.percentile("x", F.array(*map(F.lit, fractions))).alias("q")).collect()}
    assert got.keys() == want.keys() and "none" not in got
    for k, (n, q) in got.items():
        kept = [x for x in groups().get(k, [1.0, 3.0]) if x is not None and math.isfinite(x)]
        assert n == len(kept) and q == want[k], k


def test_scales_and_clipping(spark, small):
    g = random.Random(2)
    rows = [("a", round(g.gauss(100, 5))) for _ in range(400)] + [("a", 9000)] * 12 + [("b", 7)] * 30 + [("c", g.randrange(50)) for _ in range(10)]
    df = spark.createDataFrame(rows, "k string, x int").repartition(4)
    for r in E.robust_scale(df, ["k"], "x").collect():
        x = np.array([v for k, v in rows if k == r.k], float)
        mad = np.median(np.abs(x - np.median(x)))
        assert r.n == len(x) and r.center == np.median(x) and math.isclose(r.scale, 1.4826 * mad if mad else x.std(ddof=1), abs_tol=1e-12)
    for r in E.span_scale(df, ["k"], "x").collect():
        x = np.array([v for k, v in rows if k == r.k], float)
        lo, hi = np.quantile(x, [0.1587, 0.8413])
        assert r.center == np.median(x) and math.isclose(r.scale, (hi - lo) / 2 if hi > lo else 1.0, rel_tol=1e-12)
    assert E.robust_scale(df, [], "x").first().n == len(rows)
    for r in E.clipped_delay(df, ["k"], "x").collect():
        x = kept = np.array([v for k, v in rows if k == r.k], float)
        rounds = 0
        while len(x) >= 20 and rounds < 8:
            c = np.median(kept)
            mad = np.median(np.abs(kept - c))
            s = max(2.0, 1.4826 * mad if mad else kept.std(ddof=1))
            new = x[np.abs(x - c) <= 3.5 * s]
            if len(new) < 20 or len(new) == len(kept):
                break
            kept, rounds = new, rounds + 1
        if len(x) < 20:
            assert r.mean is None and r.n_input == 10
        else:
            assert (r.n_input, r.n_kept, r.rounds) == (len(x), len(kept), rounds) and math.isclose(r.mean, kept.mean()) and math.isclose(r.deviation, kept.std(ddof=1), abs_tol=1e-9)


@pytest.mark.parametrize("size", [3, 50_000])
def test_splits_are_those_of_the_sorted_hashes(spark, monkeypatch, size):
    monkeypatch.setattr(splits, "RANGE", size)
    rows = [("a", i) for i in range(203)] + [("b", i) for i in range(3)] + [(None, i) for i in range(11)] + [("c", 0)]
    df = spark.createDataFrame(rows, "k string, i long").repartition(4)
    order = {k: sorted((i for j, i in rows if j == k), key=lambda i: hashlib.sha256(f"9|{i}".encode()).hexdigest()) for k in {r[0] for r in rows}}
    got = {(r.k, r.i): r.fold for r in splits.folds(df, ["k"], "i", 5, 9).collect()}
    for k, ids in order.items():
        parts = np.array_split(np.arange(len(ids)), 5)
        assert {(k, ids[p]): f for f, part in enumerate(parts) for p in part}.items() <= got.items()
    assert len(got) == len(rows)
    held = {(r.k, r.i): r.split for r in splits.holdout(df, ["k"], "i", 0.2, 9).collect()}
    for k, ids in order.items():
        n = max(1, min(round(len(ids) * 0.2), len(ids) - 2))
        assert all(held[k, i] == (None if len(ids) < 5 else "blind" if p < n else "development") for p, i in enumerate(ids))
    three = {(r.k, r.i): r.split for r in splits.three_way(df.where("k = 'a'"), ["k"], "i", 0.2, 0.25, 9).collect()}
    assert [three["a", i] for i in order["a"]] == ["blind"] * 41 + ["validation"] * 40 + ["train"] * 122
    assert splits.folds(df, [], "i", 2, 9).groupBy("fold").count().where("count = 109").count() == 2


@pytest.mark.parametrize("held", [0, 256])
def test_replicate_sums_are_those_of_the_weights(spark, monkeypatch, held):
    monkeypatch.setattr(E, "HELD_GROUPS", held)
    g = np.random.default_rng(3)
    rows = [(k, i, float(x)) for k in ("a", "b", None) for i, x in enumerate(g.normal(size=300))] + [("a", 999, None)]
    df = spark.createDataFrame(rows, "k string, i long, x double").repartition(3)
    cells = [F.floor(F.col("x")), F.floor(F.col("x") * 2) + 100]
    got = {(r.k, r.cell, r.rep): (r.n, r.s, r.q) for r in E.replicate_sums(df, ["k"], F.xxhash64("i"), F.col("x"), 7, cells).collect()}
    hashes = {r.i: r.h for r in df.select("i", F.xxhash64("i").alias("h")).collect()}
    want = {}
    for k, i, x in rows:
        if x is None:
            continue
        w = E.poisson_weights(np.array([hashes[i]]), 7)[0]
        for cell in (math.floor(x), math.floor(2 * x) + 100):
            for rep in range(7):
                n, s, q = want.get((k, cell, rep), (0, 0, 0))
                want[k, cell, rep] = (n + w[rep], s + w[rep] * x, q + w[rep] * x * x)
    assert got.keys() == want.keys() and all(np.allclose(got[c], want[c]) for c in want)
    weights = E.poisson_weights(g.integers(-(2**63), 2**63 - 1, 20_000), 50)
    assert abs(weights.mean() - 1) < 0.01 and abs(weights.var() - 1) < 0.02 and abs((weights == 0).mean() - math.exp(-1)) < 0.005
    assert abs(np.corrcoef(weights[:, 0], weights[:, 1])[0, 1]) < 0.03
