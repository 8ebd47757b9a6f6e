"""Whitening of embeddings: blockwise QR of the centred rows, and the singular system of its factor."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bidiagonal import singular_system
from .common import Scratch, small_batches

#: Entries become whole numbers: floor(SCALE * entry) + OFFSET, held within +-LARGEST.
SCALE, OFFSET, LARGEST = 64, 1_000_000, 1 << 45
#: Triangular factors that one task stacks, in vectors' lengths of rows.
FAN_IN = 16


@dataclass(frozen=True)
class Whitening:
    """The mean is base + rest / n, exactly; axes are unit eigenvectors of the covariance as rows, by falling eigenvalue."""

    n: int
    base: np.ndarray
    rest: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, to double precision whatever the mean's size."""
        return (x - self.base) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums over dimensions of (n * x - S) squared, exactly."""
        d = x - self.base
        most = self.n * (int(np.abs(d).max(initial=0)) + 1)
        if most * most * x.shape[1] < 1 << 63:
            m = self.n * d - self.rest
            return pa.array(np.einsum("ij,ij->i", m, m)).cast(pa.decimal128(38, 0))
        m = self.n * d.astype(object) - self.rest.astype(object)
        return pa.array([_decimal(int((row * row).sum())) for row in m], pa.decimal128(38, 0))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.axes / np.sqrt(self.values)[:, None]).T


def _decimal(x: int) -> Decimal | None:
    return Decimal(x) if abs(x) < 10**38 else None


def _whole(column: pa.Array, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column that hold finite numbers only, by length: their places and their entries as whole numbers."""
    lists = column.cast(pa.list_(pa.float64()))
    lengths = np.asarray(lists.value_lengths().fill_null(0))
    flat = lists.flatten()
    ok = np.isfinite(np.asarray(flat.fill_null(float("nan"))))
    values = np.asarray(flat.fill_null(0.0))
    starts = np.cumsum(lengths) - lengths
    for k in np.unique(lengths) if size is None else [size]:
        rows = np.flatnonzero(lengths == k)
        if not k or not len(rows):
            continue
        at = starts[rows][:, None] + np.arange(k)
        good = ok[at].all(axis=1)
        if good.any():
            with np.errstate(over="ignore"):
                yield rows[good], np.clip(np.floor(SCALE * values[at[good]]) + OFFSET, -LARGEST, LARGEST).astype(np.int64)


def _sums(vectors: DataFrame) -> DataFrame:
    """size, pos, n, s: the sums of every dimension of the vectors of each length, added up in each partition first."""

    def run(batches):
        kept: dict[int, list] = {}
        for b in batches:
            for _, x in _whole(b.column(0)):
                have = kept.setdefault(x.shape[1], [0, [0] * x.shape[1]])
                have[0] += len(x)
                have[1] = [p + q for p, q in zip(have[1], x.sum(axis=0).tolist(), strict=True)]
        for size, (n, sums) in kept.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))],
                names=["size", "pos", "n", "s"],
            )

    return vectors.mapInArrow(run, "size int, pos int, n long, s decimal(38,0)").groupBy("size", "pos").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))


def _emit(matrix: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(matrix), pa.list_(pa.float64()))], names=["r"])


def _stack(have: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if have is None else np.concatenate([have, rows]), mode="r")


def triangular_factor(scratch: Scratch, vectors: DataFrame, size: int, n: int, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of all centred vectors of a length.

    Every partition reduces its rows to a triangle, block by block. Rows of triangles may be stacked in any company, so
    they are dealt anew, FAN_IN triangles a task, and reduced again, until one triangle is left for the driver.
    """

    def first(batches):
        r = None
        for b in batches:
            for _, x in _whole(b.column(0), size):
                r = _stack(r, (x - base) - rest / n)
        if r is not None:
            yield _emit(r)

    def again(batches):
        r = None
        for b in batches:
            r = _stack(r, np.asarray(b.column(0).flatten()).reshape(-1, size))
        if r is not None:
            yield _emit(r)

    rows = scratch.save(vectors.mapInArrow(first, "r array<double>"), "triangles")
    while (left := rows.count()) > size:
        rows, old = scratch.save(rows.repartition(-(-left // (FAN_IN * size))).mapInArrow(again, "r array<double>"), "triangles"), rows
        scratch.drop(old)
    out = np.array([x["r"] for x in rows.collect()]).reshape(-1, size)  # `size` rows at most
    scratch.drop(rows)
    return out


def fit(df: DataFrame, vector_col: str = "embedding", components: int = 32) -> Whitening | None:
    """The whitening of all vectors of finite numbers, None where there are none.

    Entries count as floor(64 * entry) + 1000000 (beyond +-2**45 as that bound). Null and empty vectors and those with
    null or non-finite entries are left out, as are those whose length isn't the most frequent one (of equally frequent
    ones, the greatest). Repeated rows count as often as they occur. Eigenvalues that are zero to rounding have no
    component, so fewer than `components` may come out, or none where all vectors are equal.
    """
    scratch = Scratch(df.sparkSession, "whitening")
    vectors = df.select(F.col(f"`{vector_col}`").alias("v")).where("v is not null")
    sums = scratch.save(_sums(vectors), "sums")
    most = sums.where("pos = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return None
    n, size = most["n"], most["size"]
    s = [int(r["s"]) for r in sums.where(F.col("size") == size).orderBy("pos").collect()]
    base, rest = np.array([x // n for x in s], dtype=np.int64), np.array([x % n for x in s], dtype=np.int64)
    r = triangular_factor(scratch, vectors, size, n, base, rest)
    if len(r) < size:
        r = np.concatenate([r, np.zeros((size - len(r), size))])
    values, axes = singular_system(r)
    k = min(components, len(values))
    axes = axes[:, :k].T
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=1)[:, None], axis=1) < 0, -1.0, 1.0)
    scratch.drop(sums)
    return Whitening(n, base, rest, axes, values[:k] ** 2 / n, float((r * r).sum() / n))


def transform(df: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, deviation, whitened): a row for each vector that fit() would take; further columns aren't read.

    deviation, a decimal, is the exact sum of (n * x - S) squared, null beyond 38 digits; whitened holds the components.
    """
    small_batches(df.sparkSession)
    kind = df.select(F.col(f"`{id_col}`").alias("id")).schema["id"].dataType.simpleString()
    size = len(model.base)

    def run(batches):
        for b in batches:
            for rows, x in _whole(b.column(1), size):
                w = model.whitened(x)
                offsets = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(w).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), model.deviations(x), lists], names=["id", "deviation", "whitened"])

    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")).where("v is not null").mapInArrow(run, f"id {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(df: DataFrame, model: Whitening, vector_col: str = "embedding") -> float:
    """Greatest absolute entry of the covariance of all whitened vectors, less the identity; products are added up in each partition first."""
    size, k = len(model.base), len(model.values)

    def run(batches):
        total, products = np.zeros(k), np.zeros((k, k))
        for b in batches:
            for _, x in _whole(b.column(0), size):
                w = model.whitened(x)
                total, products = total + w.sum(axis=0), products + w.T @ w
        i, j = np.triu_indices(k)
        sums = [*total, *products[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array([-1] * k + i.tolist(), pa.int32()), pa.array([*range(k), *j.tolist()], pa.int32()), pa.array(sums, pa.float64())], names=["i", "j", "s"])

    if not k:
        return 0.0
    rows = df.select(F.col(f"`{vector_col}`").alias("v")).where("v is not null").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # k * (k + 3) / 2 sums
    mean, cov = np.zeros(k), np.zeros((k, k))
    for r in rows:
        if r["i"] < 0:
            mean[r["j"]] = r["s"] / model.n
        else:
            cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["s"] / model.n
    return float(np.abs(cov - np.outer(mean, mean) - np.eye(k)).max())
