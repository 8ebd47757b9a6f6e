"""Matching in slices against plain walks over whole lists: dense boards, repeated times, many slices and blocks, gaps."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from chronofit.operators import matching, pulses


@pytest.fixture(params=[(2, 3), (8, 1024)])
def small_slices(request, monkeypatch):
    monkeypatch.setattr(matching, "SLICE", request.param[0])
    monkeypatch.setattr(matching, "BLOCK", request.param[1])


def nearest_by_hand(a, b, window, later=False):
    """Whole ascending lists of (time, name): the earlier head waits for the other only if no follower of its own would fit it better."""
    a, b, out = deque(a), deque(b), []
    while a and b:
        mine, other = (a, b) if a[0][0] <= b[0][0] else (b, a)
        d = other[0][0] - mine[0][0]
        follower = abs(other[0][0] - mine[1][0]) if len(mine) > 1 else None
        better = follower is not None and (follower < d or (later and mine is a and follower == d))
        if d > window or better:
            mine.popleft()
        else:
            out.append((a.popleft(), b.popleft()))
    return out


def dense(g, n, reach, copies):
    """Times without long pauses but for a few gaps, some of them repeated."""
    t, out = 0, []
    while len(out) < n:
        t += g.randrange(0 if copies else 1, 4) if g.random() < 0.98 else g.randrange(reach * 9)
        out.append(t)
    return out


@pytest.mark.parametrize("same_board", [True, False])
def test_coincidences(spark, small_slices, same_board):
    g = random.Random(3 + same_board)
    rows = [(run, board, channel, t) for run in "rs" for board in range(2) for channel in (1, 5) for t in sorted(set(dense(g, 500, 6, False)))]
    d = spark.createDataFrame(rows, "run_id string, board int, channel int, lead long").repartition(7)
    want = set()
    for run in "rs":
        for board in range(2) if same_board else [None]:
            side = lambda c: sorted((r[3], r[1]) for r in rows if r[0] == run and r[2] == c and board in (None, r[1]))  # noqa: B023, E731
            want |= {(run, x[1], y[1], x[0], y[0]) for x, y in nearest_by_hand(side(1), side(5), 6)}
    assert {tuple(r) for r in pulses.coincidences(d, 1, 5, 6, same_board).collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_nearest_with_repeated_times(spark, small_slices, seed):
    g = random.Random(seed)
    lists = {}
    for key in range(8):
        lists[key] = ([(t, i) for i, t in enumerate(sorted(dense(g, 150, 5, key % 4 in (1, 3))))], [(t, i) for i, t in enumerate(sorted(dense(g, 150, 5, key % 4 in (2, 3))))])
    rows = [(k, side, t, i) for k, both in lists.items() for side, xs in enumerate(both) for t, i in xs]
    d = spark.createDataFrame(rows, "k int, side int, t long, name long").repartition(5)
    got = matching.sliced_pairs(d, ["k"], ["name"], ["name"], 5, matching.nearest_solver(5)).collect()
    assert {tuple(r) for r in got} == {(k, x[1], y[1]) for k, (a, b) in lists.items() for x, y in nearest_by_hand(a, b, 5)}
    assert len(got) == len({(r.k, r.name_a) for r in got}) == len({(r.k, r.name_b) for r in got})


def test_recorded_durations_prefer_the_later_lead(spark, small_slices):
    g = random.Random(9)
    leads = sorted(set(dense(g, 600, 3, False)))
    trails = sorted({(t + (q := g.randrange(5, 60)), q + g.randrange(-3, 4)) for t in leads if g.random() < 0.8})
    rows = [("r", 0, 1, 1, t, None) for t in leads] + [("r", 0, 1, 0, t, q) for t, q in trails]
    edges = spark.createDataFrame(rows, "run_id string, board int, channel int, edge int, toa_lsb long, tot_lsb long").repartition(5)
    want = nearest_by_hand([(t, None) for t in leads], sorted((t - q, (t, q)) for t, q in trails if 1 <= q <= 50), 3, later=True)
    want = {(x[0], *y[1]) for x, y in want if 1 <= y[1][0] - x[0] <= 50}
    assert {(r.lead, r.trail, r.tot_lsb) for r in pulses.recorded_pulses(edges, 3, 1, 50).collect()} == want


def test_first_in_line(spark, small_slices):
    g = random.Random(4)
    rows, want = [], set()
    for key in range(5):
        lead, trail = sorted(set(dense(g, 400, 20, False))), sorted(set(dense(g, 400 if key else 60, 20, False)))
        rows += [(key, 0, t) for t in lead] + [(key, 1, t) for t in trail]
        left = list(lead)
        for t in trail:
            fit = next((x for x in left if t - 20 <= x <= t - 2), None)
            if fit is not None:
                want.add((key, fit, t))
                left.remove(fit)
    d = spark.createDataFrame(rows, "k int, side int, t long").repartition(6)
    got = matching.first_in_line(d.where("side = 0").select("k", F.col("t").alias("lead")), d.where("side = 1").select("k", F.col("t").alias("trail")), ["k"], 2, 20)
    assert {tuple(r)[:3] for r in got.collect()} == want


@pytest.mark.parametrize("flags", [(True, False), (True, True), (False, True)])
def test_accounting_looks_at_free_edges_only(spark, small_slices, flags):
    g = random.Random(8)
    rows, want = [], {}
    for board in range(3):
        leads = sorted(set(dense(g, 120, 20, False)))
        trails = sorted(set(dense(g, 120, 20, False)))
        durations = {t: g.choice([None, 0, 5, 9, 400]) for t in trails}
        rows += [("r", board, 1, 1, t, None) for t in leads] + [("r", board, 1, 0, t, durations[t]) for t in trails]
        taken = [(x[0], y[1]) for x, y in nearest_by_hand([(t, None) for t in leads], sorted((t - q, t) for t, q in durations.items() if q and q <= 20), 2, later=True) if 2 <= y[1] - x[0] <= 20]
        free = [t for t in leads if t not in {x for x, _ in taken}]
        line = [t for t in trails if t not in {y for _, y in taken} and flags[bool(durations[t])]]
        left, made, late = list(free), [], 0
        for t in line:
            fit = next((x for x in left if t - 20 <= x <= t - 2), None)
            if fit is None:
                late += any(x < t for x in free)
            else:
                left.remove(fit)
                made.append((fit, t))
        nested = sum(sum(x < y < t for y in free) for x, t in made)
        want[board] = (len(left), len(line) - len(made), late, sum(x < line[-1] - 20 for x in left) if line else 0, nested)
    edges = spark.createDataFrame(rows, "run_id string, board int, channel int, edge int, toa_lsb long, tot_lsb long").repartition(5)
    recorded = pulses.recorded_pulses(edges, 2, 2, 20)
    got = pulses.fallback_accounting(edges, recorded, pulses.fallback_pulses(edges, recorded, 2, 20, *flags), 20, *flags)
    assert {r.board: (r.unmatched_leads, r.unmatched_trails, r.too_short, r.too_long, r.nested) for r in got.collect()} == want


def test_overlaps(spark, small_slices):
    g = random.Random(6)
    rows, want = [], set()
    for board in range(4):
        sides = [sorted((t, t + g.randrange(12)) for t in dense(g, 300, 12, True)) for _ in range(2)]
        rows += [("r", board, c, *x) for c, xs in zip((3, 7), sides, strict=True) for x in xs]
        a, b = map(deque, sides)
        while a and b:
            if a[0][0] <= b[0][1] and b[0][0] <= a[0][1]:
                want.add((board, *a.popleft(), *b.popleft()))
            else:
                (a if a[0][1] < b[0][1] else b).popleft()
    d = spark.createDataFrame(rows, "run_id string, board int, channel int, lead long, trail long").repartition(5)
    for longest in (12, None):
        assert {tuple(r)[1:] for r in pulses.overlap_pairs(d, 3, 7, longest=longest).collect()} == want
    with pytest.raises(Exception, match="longer than"):
        pulses.overlap_pairs(d, 3, 7, longest=5).collect()


def test_a_slice_is_all_that_a_task_holds(spark, monkeypatch):
    """One board whose edges never pause: no slice gets more rows than its stretch of time and the reaches around it hold."""
    monkeypatch.setattr(matching, "SLICE", 4)
    sizes = spark.sparkContext.accumulator(0)
    plain = matching.nearest_solver(5)

    def solve(a, b, start, end):
        assert len(a) + len(b) <= 2 * (end - start + 3 * 5) and a.t.between(start - 5, end + 10).all()
        sizes.add(1)
        return plain(a, b, start, end)

    rows = [(0, side, t) for t in range(3000) for side in (0, 1)]
    d = spark.createDataFrame(rows, "k int, side int, t long")
    assert matching.sliced_pairs(d, ["k"], ["t"], [], 5, solve).where("t_a = t_b").count() == 3000
    assert sizes.value >= 3000 // 20
    assert matching.sliced_pairs(d.limit(0), ["k"], ["t"], [], 5, plain).isEmpty()
