"""One-to-one matching of two time-ordered lists in slices of bounded time.

A matcher looks at the first element left on each side, its heads. Once both lie at or after a border, all that the past
has left behind is how far it has reached over the border, a small number. So each slice of time is solved on its own for
every number that can enter it, which gives a function from what enters to what leaves; the functions are composed along
each key, first inside blocks of slices, then over the blocks; and every slice keeps the pairs of the number that does
enter. No task sees more of a key than one slice, or a row for each slice of a block, or a row for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Reaches (windows, longest durations) in a slice of time.
SLICE = 256
#: Slices whose functions are composed together.
BLOCK = 1024

Function = list[int]
#: Slice, with (least entry, greatest entry, place in a, place in b) of every pair.
Solution = tuple[Function, list[tuple[int, int, int, int]] | np.ndarray]


def apply_table(f: Function, x: int) -> int:
    """A table [least argument, value there, value at the next, ...]."""
    return f[1 + min(max(x - f[0], 0), len(f) - 2)]  # what can't enter is held at an end


def compose_tables(f: Function, g: Function) -> Function:
    return [f[0], *(apply_table(g, y) for y in f[1:])]


def apply_clamp(f: Function, x: int) -> int:
    """A shift with limits, [shift, least value, greatest value]."""
    return max(f[1], min(x + f[0], f[2]))


def compose_clamps(f: Function, g: Function) -> Function:
    return [f[0] + g[0], apply_clamp(g, f[1]), apply_clamp(g, f[2])]


def _types(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def _of_group(pdf: pd.DataFrame, keys: Sequence[str], n: int) -> dict[str, pd.Series]:
    """The keys of a group, n times, as columns that keep their type when n is 0."""
    return {k: pd.Series([pdf[k].iloc[0]] * n, dtype=object) for k in keys}


def carried(functions: DataFrame, keys: Sequence[str], apply: Callable, compose: Callable) -> DataFrame:
    """keys, slice, state: what enters each slice. functions: keys, slice, fn; nothing enters a slice that follows a missing one."""
    keys = list(keys)
    kinds = _types(functions, keys)
    d = functions.withColumn("block", F.floor(F.col("slice") / BLOCK))

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slice")
        fn, last = None, None
        for at, f in zip(pdf.slice.tolist(), pdf.fn, strict=True):
            f = [int(x) for x in f]
            if fn is None:
                fn = f
            elif last + 1 == at:
                fn = compose(fn, f)
            else:  # what entered the block can't be felt any more
                y = apply(f, 0)
                fn = [fn[0], *([y] * (len(fn) - 1))] if apply is apply_table else [0, y, y]
            last = at
        head = pdf.iloc[0]
        return pd.DataFrame([[*head[keys], int(head.block), int(head.slice), last, fn]], columns=[*keys, "block", "first", "last", "fn"])

    def over_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        states, state, last = [], 0, None
        for first, end, f in zip(pdf["first"].tolist(), pdf["last"].tolist(), pdf.fn, strict=True):
            state = state if last is not None and last + 1 == first else 0
            states.append(state)
            state, last = apply([int(x) for x in f], state), end
        return pd.DataFrame({**_of_group(pdf, keys, len(states)), "block": pdf.block.tolist(), "entering": states})

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slice")
        states, state, last = [], int(pdf.entering.iloc[0]), None
        for at, f in zip(pdf.slice.tolist(), pdf.fn, strict=True):
            if last is not None and last + 1 != at:
                state = 0
            states.append(state)
            state, last = apply([int(x) for x in f], state), at
        return pd.DataFrame({**_of_group(pdf, keys, len(states)), "slice": pdf.slice.tolist(), "state": states})

    blocks = d.groupBy(*keys, "block").applyInPandas(whole, f"{kinds}, block long, first long, last long, fn array<long>")
    entering = blocks.groupBy(*keys).applyInPandas(over_blocks, f"{kinds}, block long, entering long")
    return d.join(entering, [*keys, "block"]).groupBy(*keys, "block").applyInPandas(inside, f"{kinds}, slice long, state long")


def paths(entries: tuple[int, int], n: tuple[int, int], inside: Callable[[int, int], bool], step: Callable[[int, int], tuple[int, int]], behind: tuple[int, int]) -> Solution:
    """Solve a slice by walking from every entry until the walk meets an earlier one.

    An entry k > 0 finds k elements of b taken, k < 0 as many of a. step gives the next heads; where both move on, they
    are a pair. A walk is over where inside() no longer holds; behind says where the next slice begins on either side.
    Walks never cross, so a pair belongs to a range of entries.
    """
    seen: dict[tuple[int, int], tuple[int, int] | None] = {}
    span: dict[tuple[int, int], list[int]] = {}
    starts = {k: (max(-k, 0), max(k, 0)) for k in range(-entries[0], entries[1] + 1)}
    for k, at in starts.items():
        low_high = span.setdefault(at, [k, k])
        low_high[:] = min(low_high[0], k), max(low_high[1], k)
        while at not in seen:
            seen[at] = step(*at) if at[0] < n[0] and at[1] < n[1] and inside(*at) else None
            if seen[at] is None:
                break
            at = seen[at]
    pairs, leaves = [], {}
    for at in sorted(seen, key=sum):  # every step moves on, so a place comes before those that it leads to
        nxt = seen[at]
        if nxt is None:
            leaves[at] = max(0, at[1] - behind[1]) - max(0, at[0] - behind[0])
            continue
        low, high = span[at]
        to = span.setdefault(nxt, [low, high])
        to[:] = min(to[0], low), max(to[1], high)
        if nxt == (at[0] + 1, at[1] + 1):
            pairs.append((low, high, *at))
    for at in sorted(seen, key=sum, reverse=True):
        if seen[at] is not None:
            leaves[at] = leaves[seen[at]]
    return [-entries[0], *(leaves[starts[k]] for k in range(-entries[0], entries[1] + 1))], pairs


def sliced_pairs(d: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str], reach: int, solve: Callable[[pd.DataFrame, pd.DataFrame, int, int], Solution]) -> DataFrame:
    """One-to-one pairs of the two sides of d: keys, and columns with _a and _b.

    d: keys, side (0 is a, 1 is b), t and the columns. A slice is SLICE reaches of time; solve gets both sides from one reach
    before it to two reaches after it, in the order of t and `order`.
    """
    keys, columns = list(keys), list(columns)
    width = SLICE * max(1, reach)
    at = lambda shift: F.floor((F.col("t") + shift) / width)
    rows = d.withColumn("slice", F.explode(F.array_distinct(F.array(at(-2 * reach), at(0), at(reach)))))
    kinds, payload = _types(rows, keys), _types(rows, columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", *order], kind="stable")
        no = int(pdf.slice.iloc[0])
        a, b = pdf[pdf.side == 0], pdf[pdf.side == 1]
        fn, pairs = solve(a, b, no * width, (no + 1) * width)
        pairs = np.asarray(pairs, dtype=np.int64).reshape(-1, 4)
        a0, b0 = int((a.t.to_numpy() < no * width).sum()), int((b.t.to_numpy() < no * width).sum())
        a, b = a.iloc[a0:].iloc[pairs[:, 2]], b.iloc[b0:].iloc[pairs[:, 3]]
        out = {**_of_group(pdf, keys, len(pairs) + 1), "slice": no, "low": [0, *pairs[:, 0].tolist()], "high": [0, *pairs[:, 1].tolist()], "fn": [fn, *[None] * len(pairs)]}
        for side, x in (("a", a), ("b", b)):
            out |= {f"{c}_{side}": pd.Series([None, *x[c].tolist()], dtype=object) for c in columns}
        return pd.DataFrame(out)

    both = ", ".join(f"`{c}_{s}` {kind}" for s in "ab" for c, kind in (x.strip("`").split("` ") for x in payload.split(", ")))
    found = cut(rows.groupBy(*keys, "slice").applyInPandas(run, f"{kinds}, slice long, low long, high long, fn array<long>, {both}"))
    states = carried(found.where("fn is not null").select(*keys, "slice", "fn"), keys, apply_table, compose_tables)
    kept = found.where("fn is null").join(states, [*keys, "slice"]).where("state between low and high")
    return kept.select(*keys, *(f"{c}_{s}" for s in "ab" for c in columns))


def _split(t: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    k = int(np.searchsorted(t, start))
    return t[:k], t[k:]


def _copies(before: np.ndarray, start: int, window: int) -> int:
    """How many elements of one side within a window before the border repeat another's time."""
    near = before[before >= start - window]
    return len(near) - len(np.unique(near))


def nearest_solver(window: int, later_wins: bool = False) -> Callable[[pd.DataFrame, pd.DataFrame, int, int], Solution]:
    """Nearest one-to-one pairs within a window.

    Of the two heads the earlier decides (a where they are equal). It is given up if the other head is out of the window,
    or if the next element of its own side is nearer to that head; with later_wins, which takes distinct times of a, also if
    the next of a is as near. Otherwise the heads are a pair.
    """

    def adjacent(a: np.ndarray, b: np.ndarray, end: int) -> tuple[int, np.ndarray, np.ndarray]:
        """Without repeated times: an element can only be paired with the next one of both sides together.

        If it has been taken already, the next but one decides, so in an unbroken run of candidates every other one counts.
        """
        t, side = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
        own = np.concatenate([np.arange(len(a)), np.arange(len(b))])
        none = max(a[-1:].max(initial=0), b[-1:].max(initial=0)) + 2 * window + 2
        following = np.concatenate([x for c in (a, b) for x in (c[1:], np.full(min(1, len(c)), none))])
        order = np.lexsort((side, t))
        t, side, own, following = t[order], side[order], own[order], following[order]
        if len(t) < 2:
            return 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        d, beyond = t[1:] - t[:-1], following[:-1] - t[1:]
        candidate = (side[1:] != side[:-1]) & (d <= window) & ~((beyond < d) | (later_wins & (side[:-1] == 0) & (beyond == d)))
        at = np.arange(len(candidate))
        run = at - np.maximum.accumulate(np.where(candidate, -1, at))
        pair = candidate & (run % 2 == 1)
        limit = int(np.searchsorted(t, end))
        leaving = 0 if limit in (0, len(t)) or not pair[limit - 1] else (1 if side[limit] else -1)
        p = np.flatnonzero(pair[:limit])
        first = side[p] == 0
        return leaving, np.where(first, own[p], own[p + 1]), np.where(first, own[p + 1], own[p])

    def solve(a_rows: pd.DataFrame, b_rows: pd.DataFrame, start: int, end: int) -> Solution:
        (a_before, a), (b_before, b) = _split(a_rows.t.to_numpy(), start), _split(b_rows.t.to_numpy(), start)
        most_a = min(int(np.searchsorted(a, start + window, "right")), 1 + _copies(b_before, start, window), len(a))
        most_b = min(int(np.searchsorted(b, start + window, "right")), 1 + _copies(a_before, start, window), len(b))
        if len(np.unique(a)) == len(a) and len(np.unique(b)) == len(b) and max(most_a, most_b) < 2:
            fn, found = [-most_a], []
            for k in range(-most_a, most_b + 1):
                leaving, i, j = adjacent(a[max(-k, 0) :], b[max(k, 0) :], end)
                fn.append(leaving)
                found.append(np.stack([np.full(len(i), k), i + max(-k, 0), j + max(k, 0)], axis=1))
            found = np.concatenate(found)
            if not len(found):
                return fn, []
            code, which = np.unique(found[:, 1] * (len(b) + 1) + found[:, 2], return_inverse=True)
            low, high = np.full(len(code), 1), np.full(len(code), -1)
            np.minimum.at(low, which, found[:, 0])
            np.maximum.at(high, which, found[:, 0])
            return fn, np.stack([low, high, code // (len(b) + 1), code % (len(b) + 1)], axis=1)
        x, y = a.tolist(), b.tolist()

        def step(i: int, j: int) -> tuple[int, int]:
            early, late = (x, y) if x[i] <= y[j] else (y, x)
            p, q = (i, j) if early is x else (j, i)
            apart = late[q] - early[p]
            rival = abs(late[q] - early[p + 1]) if p + 1 < len(early) else window + 1
            given_up = apart > window or rival < apart or (later_wins and early is x and rival == apart)
            return (i + (early is x), j + (early is y)) if given_up else (i + 1, j + 1)

        behind = (int(np.searchsorted(a, end)), int(np.searchsorted(b, end)))
        return paths((most_a, most_b), (len(x), len(y)), lambda i, j: x[i] < end or y[j] < end, step, behind)

    return solve


def overlap_solver(longest: int) -> Callable[[pd.DataFrame, pd.DataFrame, int, int], Solution]:
    """One-to-one overlapping intervals [t, trail] of at most `longest`: heads that overlap are a pair, else the one that ends first is given up."""

    def solve(a_rows: pd.DataFrame, b_rows: pd.DataFrame, start: int, end: int) -> Solution:
        a, b = (x[x.t >= start] for x in (a_rows, b_rows))
        (x, u), (y, v) = ((s.t.tolist(), s.trail.tolist()) for s in (a, b))
        near = lambda s: int((s.t.to_numpy() <= start + longest).sum())

        def step(i: int, j: int) -> tuple[int, int]:
            if x[i] <= v[j] and y[j] <= u[i]:
                return i + 1, j + 1
            return (i + 1, j) if u[i] < v[j] else (i, j + 1)

        before = lambda s: int((s.t.to_numpy() < end).sum())
        reaching = lambda s: int((s.t < start).sum())
        entries = (min(near(a), reaching(b_rows)), min(near(b), reaching(a_rows)))
        return paths(entries, (len(x), len(y)), lambda i, j: x[i] < end or y[j] < end, step, (before(a), before(b)))

    return solve


def first_in_line(leads: DataFrame, trails: DataFrame, keys: Sequence[str], shortest: int, longest: int) -> DataFrame:
    """keys, lead, trail, nested: in time order, each trail takes the earliest lead left that is `shortest` to `longest` before it.

    nested counts the leads between the two. leads: keys, lead; trails: keys, trail. Of a border, what matters is how many of the leads from `longest` before it on
    are gone. A trail raises that number by one, up to the leads before it; the next border lowers it by those that have
    become too old. A slice of such steps is a shift with limits, whatever the number, so slices compose.
    """
    keys = list(keys)
    width = SLICE * max(1, longest)
    at = lambda shift: F.floor((F.col("t") + shift) / width)
    a = leads.select(*keys, F.col("lead").alias("t"), F.lit(0).alias("side")).withColumn("slice", F.explode(F.array_distinct(F.array(at(0), at(longest)))))
    b = trails.select(*keys, F.col("trail").alias("t"), F.lit(1).alias("side")).withColumn("slice", at(0))
    rows = cut(a.unionByName(b))
    kinds = _types(rows, keys)

    def parts(pdf: pd.DataFrame):
        no = int(pdf.slice.iloc[0])
        lead, trail = (np.sort(pdf.t[pdf.side == s].to_numpy()) for s in (0, 1))
        lead = lead[lead >= no * width - longest]
        return no, lead, trail, np.searchsorted(lead, trail - longest), np.searchsorted(lead, trail - shortest, "right")

    def function(pdf: pd.DataFrame) -> pd.DataFrame:
        no, lead, _, old, ripe = parts(pdf)
        gone = int(np.searchsorted(lead, (no + 1) * width - longest))
        f = [0, 0, len(lead)]
        for o, r in zip(old.tolist(), ripe.tolist(), strict=True):
            f = compose_clamps(compose_clamps(f, [0, o, len(lead)]), [1, 0, r])
        f = compose_clamps(f, [-gone, 0, len(lead)])
        return pd.DataFrame([[*pdf.iloc[0][keys], no, f]], columns=[*keys, "slice", "fn"])

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        _, lead, trail, old, ripe = parts(pdf)
        p, out = int(pdf.state.iloc[0]), []
        for k, (o, r) in enumerate(zip(old.tolist(), ripe.tolist(), strict=True)):
            p = max(p, o)
            if p < r:
                out.append((p, k))
                p += 1
        i, k = np.array(out, dtype=np.int64).reshape(-1, 2).T
        return pd.DataFrame({**_of_group(pdf, keys, len(i)), "lead": lead[i], "trail": trail[k], "nested": np.searchsorted(lead, trail[k]) - i - 1})

    states = carried(rows.groupBy(*keys, "slice").applyInPandas(function, f"{kinds}, slice long, fn array<long>"), keys, apply_clamp, compose_clamps)
    return rows.join(states, [*keys, "slice"]).groupBy(*keys, "slice").applyInPandas(pairs, f"{kinds}, lead long, trail long, nested long")
