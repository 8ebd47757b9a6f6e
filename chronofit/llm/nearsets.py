"""Exact verification of near-duplicate candidates: which sets that share a band are linked.

Both MinHash operators end here. Every band's least member is its hub. Each member is held against its least hub, then
against those that it isn't with yet, so a group of copies costs one comparison a member; only bands whose other members then still lie in several
components are looked at again, those outside the most frequent component against all, in tiles of about 2 x `chunk` members. A
tile gives a spanning forest of its links, so no list of pairs is ever made, and no group of any size meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bit_filter, components, with_bits

CHUNK = 256
#: Members of a band up to which bands are compared many at a time.
SMALL = 24
_COLUMNS = 1 << 13


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left set with each right one, by products of 0/1 matrices over the left sets' elements."""
    el = np.unique(np.concatenate(left))
    total = np.zeros((len(left), len(right)), np.float32)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        x, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(el, x), len(el) - 1)
        ok = el[at] == x
        at, of = at[ok], of[ok]
        order = np.argsort(at, kind="stable")
        return at[order], of[order]

    sides = [places(left), places(right)]
    for a in range(0, len(el), _COLUMNS):
        width, parts = min(_COLUMNS, len(el) - a), []
        for n, (at, of) in zip((len(left), len(right)), sides, strict=True):
            i, j = np.searchsorted(at, [a, a + width])
            m = np.zeros((n, width), np.float32)
            m[of[i:j], at[i:j] - a] = 1
            parts.append(m)
        total += parts[0] @ parts[1].T
    return total


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer edges that join what the edges (a, b) join: each node with the least of its component."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while (root[x] != root[y]).any():
        least = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], least)
        np.minimum.at(root, root[y], least)
        root = root[root]
    u = np.flatnonzero(root != np.arange(len(names)))
    return names[u], names[root[u]]


def pair_overlaps(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the sets a[i] and b[i], and of their intersections; sets are ascending unsigned 64-bit integers in a binary."""
    parts, of, sizes = [], [], []
    for column in (a, b):
        raw = [np.frombuffer(x, np.uint64) for x in column.to_pylist()]
        n = np.array([len(x) for x in raw], np.int64)
        parts += raw
        of.append(np.repeat(np.arange(len(raw)), n))
        sizes.append(n)
    el, pair = np.concatenate(parts or [np.zeros(0, np.uint64)]), np.concatenate(of)
    order = np.lexsort((el, pair))
    el, pair = el[order], pair[order]
    same = (el[1:] == el[:-1]) & (pair[1:] == pair[:-1])
    return sizes[0], sizes[1], np.bincount(pair[1:][same], minlength=len(a))


def _hub_links(star: DataFrame, sets: DataFrame, over: int, under: int) -> DataFrame:
    """Of the pairs (node, hub) those that link, as (u, v)."""

    def check(batches):
        for b in batches:
            m, n, both = pair_overlaps(b.column(2), b.column(3))
            ok = pa.array(under * both >= over * (m + n - both))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["u", "v"])

    # both sides are written alike, so that Spark deals the sets out once for the two joins
    own, other = (sets.select(F.col("node").alias(x), F.col("elements").alias(y)) for x, y in (("u", "a"), ("v", "b")))
    pairs = star.join(own, star.node == own.u).join(other, star.hub == other.v)
    return pairs.select("node", "hub", "a", "b").mapInArrow(check, "u long, v long")


def _small_links(members: DataFrame, sets: DataFrame, over: int, under: int) -> DataFrame:
    """_tile_links() for bands of at most SMALL members: many bands at a time, in partitions sorted by band."""

    def judge(t: pa.Table) -> pa.RecordBatch:
        h, label = t.column("h").to_numpy(), t.column("label").to_numpy()
        raw = [np.frombuffer(x, np.uint64) for x in t.column("elements").to_pylist()]
        size = np.array([len(x) for x in raw], np.int64)
        el, of = np.concatenate(raw), np.repeat(np.arange(len(raw)), size)
        band = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
        order = np.lexsort((el, band[of]))
        el, of = el[order], of[order]
        pairs, step = [np.zeros(0, np.int64)], 1
        while True:  # members of a band that share an element stand side by side
            same = (el[step:] == el[:-step]) & (band[of[step:]] == band[of[:-step]])
            if not same.any():
                break
            a, b = of[:-step][same], of[step:][same]
            pairs.append(np.minimum(a, b) * len(raw) + np.maximum(a, b))
            step += 1
        pair, both = np.unique(np.concatenate(pairs), return_counts=True)
        a, b = pair // max(1, len(raw)), pair % max(1, len(raw))
        ok = (under * both >= over * (size[a] + size[b] - both)) & (label[a] != label[b])
        u, v = forest(label[a[ok]], label[b[ok]])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def run(batches):
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            h = t.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1])) if len(h) else 0
            if cut:
                yield judge(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and len(held):
            yield judge(held)

    rows = sets.join(members, "node").select("h", F.col("c").alias("label"), "elements")
    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, "u long, v long")


def _tile_links(members: DataFrame, sets: DataFrame, over: int, under: int, chunk: int) -> DataFrame:
    """members: (node, h, c). Edges (u, v) between the labels c of those members of a band that link and differ in c.

    The members of a band's most frequent label needn't meet each other. So the others are the left side, all are the
    right side, both are dealt into chunks by hash, and each pair of chunks is a tile.
    """
    sizes = members.groupBy("h", "c").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("h").agg(F.sum("n").alias("n"), F.max(F.struct("n", "c")).alias("top"))
    parts = lambda n: F.ceil(n / chunk).cast("int")
    sizes = sizes.select("h", F.col("top.c").alias("top"), parts(F.col("n") - F.col("top.n")).alias("lefts"), parts(F.col("n")).alias("rights"))
    dealt = members.join(sizes, "h")
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = dealt.select("node", "h", F.col("c").alias("label"), F.lit(1).alias("side"), others("lefts").alias("i"), mine("rights").alias("j"))
    left = dealt.where("c <> top").select("node", "h", F.col("c").alias("label"), F.lit(0).alias("side"), mine("lefts").alias("i"), others("rights").alias("j"))
    tiles = sets.join(left.union(right), "node").select("label", "elements", "h", "side", "i", "j")

    def tile(t: pa.Table) -> pa.Table:
        label, side = t.column("label").to_numpy(), t.column("side").to_numpy()
        raw = [np.frombuffer(x, np.uint64) for x in t.column("elements").to_pylist()]
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        u = v = np.zeros(0, np.int64)
        if len(x) and len(y):
            both = overlaps([raw[k] for k in x], [raw[k] for k in y]).astype(np.float64)
            size = np.array([len(r) for r in raw])
            ok = under * both >= over * (size[x][:, None] + size[y][None, :] - both)
            a, b = np.nonzero(ok & (label[x][:, None] != label[y][None, :]))
            u, v = forest(label[x][a], label[y][b])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return tiles.groupBy("h", "i", "j").applyInArrow(tile, "u long, v long")


def linked(scratch: Scratch, bands: DataFrame, sets_of: Callable[[DataFrame], DataFrame], over: int, under: int, chunk: int = CHUNK) -> DataFrame:
    """bands (h, node) -> (node, comp): components of the links among nodes that share a band.

    sets_of gives (node, elements binary) for a table of nodes: each node's set as ascending unsigned 64-bit
    integers, or several where the node stands for several. Sets link if under * intersection >= over * union.
    Every pair that shares a band is decided, by exact sets, unless its two nodes are known to be in one
    component already. Nodes that share no band are left out.
    """
    # most bands stand alone; a filter of fixed size keeps them out of the joins, and what it lets through has no hub
    shared = bit_filter(bands.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    several = scratch.save(with_bits(bands, "h", shared).select("h", "node"), "several")
    scratch.sweep()
    hubs = several.groupBy("h").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub <> top").select("h", "hub")
    members = scratch.save(several.join(hubs, "h").select("h", "node", "hub"), "members")
    scratch.drop(several)
    scratch.sweep()
    sets = scratch.save(sets_of(members.select("node").distinct()), "sets")
    scratch.sweep()
    star = scratch.save(members.where("node <> hub").select("node", "hub").distinct(), "star")
    # a member meets the least of its hubs first, and of the others only those that it isn't yet known to be with
    least = star.groupBy("node").agg(F.min("hub").alias("hub"))
    met = scratch.save(_hub_links(least, sets, over, under), "met")
    near = scratch.save(components(scratch, met), "near")
    scratch.sweep()
    at = lambda name: near.select(F.col("node").alias(name), F.col("comp").alias(f"{name}_comp"))
    apart = F.coalesce("node_comp", "node") != F.coalesce("hub_comp", "hub")
    others = star.join(least, ["node", "hub"], "left_anti").join(at("node"), "node", "left").join(at("hub"), "hub", "left").where(apart).select("node", "hub")
    first = scratch.save(components(scratch, met.union(_hub_links(others, sets, over, under))), "first")
    scratch.drop(star, met, near)
    scratch.sweep()
    # the hub has met all others; what is left are pairs of the others
    labelled = members.where("node <> hub").select("h", "node").join(first, "node", "left").select("h", "node", F.coalesce("comp", "node").alias("c"))
    open_ = labelled.groupBy("h").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("h")
    rest = scratch.save(labelled.join(open_, "h").select("node", "h", "c"), "open")
    done = first
    if not rest.isEmpty():
        size = rest.groupBy("h").agg(F.count("*").alias("n"))
        few = rest.join(size.where(F.col("n") <= min(SMALL, chunk)).select("h"), "h", "left_semi")
        many = rest.join(size.where(F.col("n") > min(SMALL, chunk)).select("h"), "h", "left_semi")
        edges = _small_links(few, sets, over, under).union(_tile_links(many, sets, over, under, chunk))
        more = components(scratch, edges).select(F.col("node").alias("c"), F.col("comp").alias("to"))
        known = members.select("node").distinct().join(first, "node", "left").select("node", F.coalesce("comp", "node").alias("c"))
        done = scratch.save(known.join(more, "c", "left").select("node", F.coalesce("to", "c").alias("comp")), "groups")
        scratch.drop(first)
    scratch.drop(members, sets, rest)
    scratch.sweep()
    return done
