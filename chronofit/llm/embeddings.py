"""Near-duplicate embeddings: a subspace pigeonhole join of rotated unit vectors, verified by exact cosine.

Two unit vectors with cosine c lie at the squared distance 2 - 2c. A rotation keeps it and spreads it evenly,
so if it is at most D, at least one of B blocks of coordinates has a squared distance of D / B or less. Each
block is joined by range: vectors fall in cells along the block's first coordinate, as wide as the block's
radius, so partners lie in the same or in adjacent cells. Cells are dealt into chunks; a task compares two
chunks, keeps those within the block's budget, and verifies them at once. A pair that fits several blocks
counts in the first of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles as S
from .common import Scratch, components

BLOCKS, CHUNK, SEED = 4, 8192, 11
_SLACK = 1e-9


def rotate(x: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Two rounds of random signs and a Hadamard transform, on zero-padded rows; orthogonal, and by sums and
    differences alone, so a row's result doesn't depend on the rows beside it."""
    n, d = x.shape
    size = 1 << max(0, d - 1).bit_length()
    out = np.zeros((n, size))
    out[:, :d] = x
    for r in range(2):
        bits = S.mix(np.arange(size, dtype=S.U) + S.U(seed * 1000 + r * 7919 + 1))
        out *= np.where(bits & S.U(1), 1.0, -1.0)
        h = 1
        while h < size:
            v = out.reshape(n, size // (2 * h), 2, h)
            a, b = v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]
            out = np.stack([a, b], axis=2).reshape(n, size)
            h *= 2
        out /= np.sqrt(size)
    return out


def _unit(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((raw * raw).sum(axis=1))
    return raw / norm[:, None], norm


def _blocks(size: int, blocks: int) -> list[slice]:
    edge = np.linspace(0, size, min(blocks, size) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edge, edge[1:], strict=False)]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of each pair (a, b) in a forest whose labels never exceed their nodes."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            new = label[label]
            if (new == label).all():
                break
            label[:] = new


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """(id, n_links, component_id, kept), a row for each input row.

    Links are all pairs with cosine >= `cosine` in double precision. Vectors that are null, empty, zero or hold a
    null or non-finite component link with nothing, as do null ids; vectors of different lengths never link.
    n_links counts the other vectors linked directly, copies included; component_id is the least id reachable.
    Rows that share an id are one node. Equal vectors are merged before the join and counted by weight.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    single = isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType)
    kind = np.dtype("<f4" if single else "<f8")
    total = max(0.0, 2 - 2 * cosine)

    def pack(batches):
        for b in batches:
            keys, raws, dims = [], [], []
            for x in b.column(1).to_pylist():
                v = None if x is None or not x or None in x else np.array(x, dtype=kind)
                with np.errstate(over="ignore"):
                    ok = v is not None and np.isfinite(v).all() and 0 < float((v.astype(float) ** 2).sum()) < np.inf
                raws.append((v + kind.type(0)).tobytes() if ok else None)  # -0 becomes 0
                dims.append(len(v) if ok else 0)
            data = [r or b"" for r in raws]
            buf = np.frombuffer(b"".join(data), np.uint8)
            ends = np.cumsum([len(r) for r in data])
            starts = ends - [len(r) for r in data]
            h1, h2 = S.span_hashes(buf, starts, ends), S.span_hashes(buf, starts, ends, np.arange(255, -1, -1))
            keys = [None if r is None else p.tobytes() + q.tobytes() for r, p, q in zip(raws, h1, h2, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(raws, pa.binary()), pa.array(dims, pa.int32())], names=["id", "key", "raw", "dim"])

    packed = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("v")).mapInArrow(pack, "id long, key binary, raw binary, dim int")
    rows = scratch.save(packed.withColumn("key", F.when(F.col("id").isNotNull(), F.col("key"))), "rows")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("w"))
    classes = scratch.save(classes, "classes")
    reps = rows.where("key is not null").join(classes.select("key", F.col("rep").alias("id"), "w"), ["key", "id"]).dropDuplicates(["key"]).select("id", "w", "raw", "dim")

    def place(batches):
        for b in batches:
            dims = b.column(3).to_numpy()
            cells: list[list[int]] = [[] for _ in dims]
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.stack([np.frombuffer(b.column(2)[int(i)].as_py(), kind) for i in at]).astype(float)
                r = rotate(_unit(x)[0])
                parts = _blocks(r.shape[1], blocks)
                width = np.sqrt(total / len(parts) + _SLACK) * (1 + 1e-9)
                c = np.floor(r[:, [p.start for p in parts]] / width).astype(int)
                for i, row in zip(at, c.tolist(), strict=True):
                    cells[i] = row
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int32()))], names=["id", "w", "raw", "dim", "cells"])

    placed = scratch.save(reps.mapInArrow(place, "id long, w long, raw binary, dim int, cells array<int>"), "placed")
    every = placed.select("id", "dim", F.posexplode("cells").alias("b", "c"))
    size = every.groupBy("dim", "b", "c").agg(F.ceil(F.count("*") / chunk).cast("int").alias("s"))
    beside = lambda step, name: size.select("dim", "b", (F.col("c") + step).alias("c"), F.col("s").alias(name))
    plan = size.join(beside(-1, "after"), ["dim", "b", "c"], "left").join(beside(1, "before"), ["dim", "b", "c"], "left")
    sub = lambda s: F.pmod(F.xxhash64("id", "b"), F.col(s)).cast("int")
    tile = lambda c, k, i, j, side: F.struct(c.alias("c"), F.lit(k).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    to = lambda s, f: F.when(F.col(s) > 0, F.transform(F.sequence(F.lit(0), F.col(s) - 1), f)).otherwise(F.array().cast("array<struct<c:int,kind:int,i:int,j:int,side:int>>"))
    own = F.col("own")
    # posexplode's rows meet their cell's plan; the vectors are then dealt to every tile of their chunks
    dealt = (
        placed.select("id", "w", "raw", "dim", F.posexplode("cells").alias("b", "c")).join(plan, ["dim", "b", "c"]).withColumn("own", sub("s"))
        .withColumn("t", F.explode(F.concat(
            to("s", lambda o: tile(F.col("c"), 0, F.least(own, o), F.greatest(own, o), (own > o).cast("int"))),
            to("after", lambda o: tile(F.col("c"), 1, own, o, F.lit(0))),
            to("before", lambda o: tile(F.col("c") - 1, 1, o, own, F.lit(1))),
        )))
        .select("id", "w", "raw", "dim", "b", "t.*")
    )

    def compare(t: pa.Table) -> pa.Table:
        node, w, side = (t.column(x).to_numpy() for x in ("id", "w", "side"))
        b, same = t.column("b")[0].as_py(), t.column("kind")[0].as_py() == 0 and t.column("i")[0].as_py() == t.column("j")[0].as_py()
        raw = np.stack([np.frombuffer(x, kind) for x in t.column("raw").to_pylist()]).astype(float)
        order = np.lexsort((node, side))
        node, w, side, raw = node[order], w[order], side[order], raw[order]
        unit, norm = _unit(raw)
        rot = rotate(unit)
        parts = _blocks(rot.shape[1], blocks)
        budget = total / len(parts) + _SLACK
        block = np.ascontiguousarray(rot[:, parts[b]])
        sq = (block * block).sum(axis=1)
        first = 0 if same else int(np.searchsorted(side, 1))
        links = np.zeros(len(node), np.int64)
        label = np.arange(len(node))
        for a in range(0, len(node) if same else first, 512):
            z = min(a + 512, len(node) if same else first)
            lo = a if same else first
            d2 = sq[a:z, None] + sq[None, lo:] - 2 * (block[a:z] @ block[lo:].T)
            p, q = np.nonzero(d2 <= budget + 1e-9)
            p, q = p + a, q + lo
            if same:
                up = p < q
                p, q = p[up], q[up]
            for k in range(0, len(p), 1 << 15):
                i, j = p[k : k + (1 << 15)], q[k : k + (1 << 15)]
                for e, part in enumerate(parts[: b + 1]):
                    d = ((rot[i, part] - rot[j, part]) ** 2).sum(axis=1)
                    ok = d <= budget if e == b else d > budget
                    i, j = i[ok], j[ok]
                ok = (raw[i] * raw[j]).sum(axis=1) / (norm[i] * norm[j]) >= cosine
                i, j = i[ok], j[ok]
                links += np.bincount(i, weights=w[j], minlength=len(node)).astype(np.int64) + np.bincount(j, weights=w[i], minlength=len(node)).astype(np.int64)
                _merge(label, i, j)
        some = np.flatnonzero(links)
        return pa.table({"id": pa.array(node[some], pa.int64()), "n": pa.array(links[some], pa.int64()), "root": pa.array(node[label[some]], pa.int64())})

    found = scratch.save(dealt.groupBy("dim", "b", "c", "kind", "i", "j").applyInArrow(compare, "id long, n long, root long"), "links")
    count = found.groupBy("id").agg(F.sum("n").alias("n"))
    comp = components(scratch, found.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")))
    of = classes.join(count.withColumnRenamed("id", "rep"), "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    of = of.select("key", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("comp", "rep").alias("comp"))
    out = rows.select("id", "key").join(of, "key", "left")
    cid = F.coalesce("comp", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"), F.coalesce(F.col("id") == cid, F.lit(True)).alias("kept"))
