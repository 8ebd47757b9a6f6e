"""Whitening against plain double-precision linear algebra and whole-number arithmetic."""

from fractions import Fraction

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from chronofit.llm import queries, whitening
from chronofit.llm.bidiagonal import singular_system, singular_values
from chronofit.llm.common import table

G = np.random.default_rng(1)


def turned(values):
    n = len(values)
    q = lambda: np.linalg.qr(G.normal(size=(n, n)))[0]
    return (q() * np.asarray(values)) @ q()


HARD = {
    "random": G.normal(size=(300, 40)), "nearly alike": G.normal(size=(20_000, 32)), "graded": turned(10.0 ** np.linspace(0, -6, 40)), "all alike": turned(np.full(40, 3.0)),
    "groups": turned(np.repeat([5, 1, 1e-2], 12)), "groups within rounding": turned(np.repeat([5, 1, 1e-2], 12) * (1 + 1e-12 * G.normal(size=36))), "groups within 1e-6": turned(np.repeat([5, 1, 1e-2], 12) * (1 + 1e-6 * G.normal(size=36))),
    "low rank": G.normal(size=(100, 5)) @ G.normal(size=(5, 30)), "identity": np.eye(20), "diagonal with zero": np.diag(np.arange(20.0)), "copies": np.kron(np.eye(3), G.normal(size=(8, 8))), "zero": np.zeros((9, 6)), "one": np.ones((4, 1)),
    "ones beside the diagonal": np.eye(30) + np.diag(np.ones(29), 1),
}


@pytest.mark.parametrize("name", HARD)
def test_singular_system(name):
    a = HARD[name]
    values, axes = singular_system(np.linalg.qr(a, mode="r"))
    want = np.linalg.svd(a, compute_uv=False)
    k = len(values)
    assert k == (want > want[0] * 1e-13).sum() and np.allclose(values, want[:k], rtol=1e-9)
    assert np.abs(axes.T @ axes - np.eye(k)).max(initial=0) < 1e-9
    assert np.abs((a @ axes / values).T @ (a @ axes / values) - np.eye(k)).max(initial=0) < 1e-7


def test_dqds_is_accurate_for_tiny_values():
    d, e = 10.0 ** -np.arange(20), 10.0 ** -np.arange(1, 20) / 3
    got = singular_values(d, e)
    # the product of the values is that of the diagonal, which plain methods lose
    assert np.isclose(np.log(got).sum(), np.log(d).sum(), rtol=1e-12)


def brute(rows, components=32):
    kept = [(i, v) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    sizes = [len(v) for _, v in kept]
    size = max(set(sizes), key=lambda k: (sizes.count(k), k))
    kept = [(i, [int(np.floor(64 * float(x))) + 1_000_000 for x in v]) for i, v in kept if len(v) == size]
    n, s = len(kept), [sum(c) for c in zip(*(v for _, v in kept), strict=True)]
    deviation = [sum((n * x - t) ** 2 for x, t in zip(v, s, strict=True)) for _, v in kept]
    y = np.array([[float(Fraction(n * x - t, n)) for x, t in zip(v, s, strict=True)] for _, v in kept])
    cov = y.T @ y / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    k = min(components, int((e > e[0] * 1e-12).sum()))
    return [i for i, _ in kept], n, deviation, y @ q[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(cov)


def check(got, rows):
    ids, n, deviation, w, explained = brute(rows)
    k = w.shape[1]
    assert len(got) == len(ids) * k
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for c in range(1, k + 1):
        mine = np.array([by[i, c][0].whitened for i in ids])
        sign = np.sign(mine @ w[:, c - 1])
        assert np.allclose(sign * mine, w[:, c - 1], atol=1e-6)
        assert np.isclose(by[ids[0], c][0].explained, explained[c - 1], rtol=1e-9)
    assert all(by[i, 1][0].deviation == d and by[i, 1][0].n == n for i, d in zip(ids, deviation, strict=True))
    assert all(r.identity_error <= 1e-9 for r in got)


def test_query_on_the_whole_table(spark):
    got = queries.op13_whitening(spark, SMALL).collect()
    check(got, [(r.vec_id, r.embedding) for r in table(spark, SMALL, "embeddings").collect()])


def test_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)  # several rounds of triangles
    rows = [(i, (G.normal(size=6) * [1, 2, 3, 4, 5, 6]).tolist(), "x", 1) for i in range(200)]
    rows += [(200, rows[7][1], "x", 1), (201, rows[7][1], "x", 1), (202, None, "x", 1), (203, [], "x", 1), (204, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x", 1), (205, [float("nan")] * 6, "x", 1), (206, [float("inf")] + [0.0] * 5, "x", 1), (207, [1.0, 2.0], "x", 1), (208, [3e30] + [0.0] * 5, "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, n int").repartition(9)
    whole = [r[:2] for r in rows if r[0] != 208]
    few = df.where("vec_id <> 208")
    few.write.parquet(str(tmp_path / "embeddings.parquet"))
    check(queries.op13_whitening(spark, str(tmp_path)).collect(), whole)
    model = whitening.fit(df)
    far = {r.id: r.deviation for r in whitening.transform(df, model).collect()}
    assert len(far) == 203 and model.n == 203
    xs = [[1 << 45 if x > 1e20 else int(np.floor(64 * x)) + 1_000_000 for x in v] for i, v, *_ in rows if i in far]
    sums = [sum(c) for c in zip(*xs, strict=True)]
    assert sorted(map(int, far.values())) == sorted(sum((203 * x - s) ** 2 for x, s in zip(v, sums, strict=True)) for v in xs)
    same = df.where("vec_id in (7, 200, 201)")
    assert len(whitening.fit(same).values) == 0 and [len(r.whitened) for r in whitening.transform(same, whitening.fit(same)).collect()] == [0, 0, 0]
    assert whitening.fit(df.limit(0)) is None and whitening.fit(df.where("vec_id = 202")) is None
    flat = df.where("vec_id < 202").withColumn("embedding", F.expr("array_append(slice(embedding, 1, 5), 1.0D)"))
    assert len(whitening.fit(flat).values) == 5
