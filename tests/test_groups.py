import numpy as np
import pandas as pd
import pytest
from chronofit.operators import groups
from chronofit.plans import stat_queries

from conftest import SMALL, same

SETTINGS = {"voltage": 40, "acquisition_mode": "TRG_MATCHING", "energy_threshold_mv": 10.0, "timing_threshold_mv": 5.0, "measurement_mode": 1, "toa_lsb_ps": 3.125, "tot_lsb_ps": 3.125}
WINDOW = 400


def run(name, n, seed, delay=100.0, decoys=0.3):
    """Hits of n events: two energy pulses of about 1000, a timing lead `delay` before each, and in some an earlier decoy or none of the leads."""
    g, hits = np.random.default_rng(seed), []
    for e in range(n):
        t = 10_000 * e + 5_000
        for energy, timing in ((1, 3), (5, 7)):
            lead = t + int(g.integers(0, 50))
            hits += [(name, e, energy, 1, lead), (name, e, energy, 0, lead + int(g.normal(1000, 20)))]
            time = lead - int(round(g.normal(delay, 4)))
            if e % 40 != 39 or timing == 7:
                hits.append((name, e, timing, 1, time))
            if g.random() < decoys:
                hits.append((name, e, timing, 1, lead - (20 if g.random() < 0.5 else 250)))
    return hits


def tables(spark, runs):
    hits = [h for name, n, seed, _ in runs for h in run(name, n, seed)]
    h = spark.createDataFrame(pd.DataFrame(hits, columns=["run_id", "event_index", "channel", "edge", "toa_lsb"])) if hits else spark.createDataFrame([], "run_id string, event_index long, channel long, edge long, toa_lsb long")
    r = pd.DataFrame([{"run_id": name, "run_number": k, **SETTINGS, **other} for k, (name, _, _, other) in enumerate(runs)])
    return h, spark.createDataFrame(r)


def robust(x):
    c = np.median(x)
    m = 1.4826 * np.median(np.abs(x - c))
    return c, max(2.0, m if m > 0 else np.std(x, ddof=1))


def by_hand(hits, names, row):
    """Counts, average delays and alignments of one group by a walk over its events, within the energy windows of `row`."""
    lsb, ev = SETTINGS["toa_lsb_ps"], {}
    for name, e, channel, edge, t in hits:
        if name in names:
            ev.setdefault((name, e), {}).setdefault((channel, edge), []).append(t)
    pool, chosen = 0, []
    for h in ev.values():
        side = {}
        for s, c, t in (("a", 1, 3), ("b", 5, 7)):
            lead = min(h[c, 1])
            side[s] = lead, min(x for x in h[c, 0] if x > lead) - lead, [x for x in h.get((t, 1), []) if lead - WINDOW < x < lead]
        if side["a"][2] and side["b"][2]:
            pool += 1
            if all(row[f"peak_{s}_low_ps"] <= side[s][1] * lsb <= row[f"peak_{s}_high_ps"] for s in "ab"):
                chosen.append(side)
    mean = {}
    for s in "ab":
        every = np.array([x[s][0] - x[s][2][0] for x in chosen if len(x[s][2]) == 1], float)
        keep = every
        for _ in range(8):
            c, scale = robust(keep)
            new = every[np.abs(every - c) <= 3.5 * scale]
            if len(new) < 20 or np.array_equal(new, keep):
                break
            keep = new
        mean[s] = keep.mean()
    best = {s: np.array([min(x[s][2], key=lambda t: (abs(x[s][0] - t - mean[s]), -t)) - x[s][0] for x in chosen]) for s in "ab"}  # noqa: B023
    last = {s: np.array([max(x[s][2]) - x[s][0] for x in chosen]) for s in "ab"}
    near = lambda al: np.all([np.abs(al[s] - robust(best[s])[0]) <= 5 * robust(best[s])[1] for s in "ab"], axis=0)
    return pool, len(chosen), mean, {s: robust(best[s]) for s in "ab"}, int(near(best).sum()), int((near(best) & ~near(last)).sum())


def test_groups_are_analysed_as_a_walk_would_and_fail_alone(spark):
    runs = [("Run1", 300, 1, {}), ("Run2", 200, 2, {}), ("Run3", 30, 3, {"voltage": 41}), ("Run4", 0, 4, {"voltage": 42}), ("Run5", 250, 5, {"toa_lsb_ps": 3.0})]
    hits, table = tables(spark, runs)
    got = {r.run_ids: r.asDict() for r in groups.group_analysis(hits.unionByName(hits.limit(0)).repartition(5), table, WINDOW).collect()}
    assert set(got) == {"Run1,Run2", "Run3", "Run4", "Run5"}
    assert [got[k]["status"] for k in ("Run1,Run2", "Run3", "Run4", "Run5")] == ["complete", "failed", "failed", "complete"]
    assert got["Run3"]["error"] == "energy window a: too few events" and got["Run4"]["error"] == "no candidate events"
    assert got["Run3"]["ctr_ps"] is None and got["Run3"]["candidate_events"] is None and got["Run3"]["voltage"] == 41
    row = got["Run1,Run2"]
    rows = [h for name, n, seed, _ in runs for h in run(name, n, seed)]
    pool, chosen, mean, align, kept, repaired = by_hand(rows, {"Run1", "Run2"}, row)
    assert (row["run_count"], row["candidate_events"], row["energy_selected_events"], row["matched_events"], row["fit_selected_events"], row["corrected_alignments"]) == (2, pool, chosen, chosen, kept, repaired)
    assert repaired > 10 and 0 < chosen < pool and row["overall_selection_fraction"] == pytest.approx(kept / pool)
    for s in "ab":
        assert row[f"average_delay_{s}_ps"] == pytest.approx(mean[s] * 3.125) and (row[f"alignment_{s}_center_ps"], row[f"alignment_{s}_scale_ps"]) == pytest.approx([x * 3.125 for x in align[s]])
        assert abs(row[f"average_delay_{s}_ps"] / 3.125 - 100) < 2
    assert row["ctr_ps"] == pytest.approx(2.3548 * row["gaussian_sigma_ps"], rel=1e-4) and row["gaussian_sigma_error_ps"] > 0 and row["ndof"] > 0
    assert row["reduced_chi_square"] == pytest.approx(row["chi_square"] / row["ndof"])


def test_groups_without_hits_or_runs(spark):
    hits, table = tables(spark, [("Run1", 0, 1, {}), ("Run2", 0, 1, {"voltage": 41})])
    assert [(r.status, r.error) for r in groups.group_analysis(hits, table, WINDOW).collect()] == [("failed", "no candidate events")] * 2
    assert groups.group_analysis(hits, table.limit(0), WINDOW).isEmpty()


def test_group_queries(spark, duck):
    same(stat_queries.e8_group_candidates(spark, SMALL), duck.sql(stat_queries.E8B).df())
    rows = stat_queries.e8_group_analysis(spark, SMALL).collect()
    assert len(rows) == 4 and all((r.error == "") == (r.status == "complete") == (r.ctr_ps is not None) for r in rows)
    assert sorted((r.voltage, r.status) for r in rows) == [(40, "complete"), (41, "complete"), (42, "complete"), (49, "failed")]
    assert all(0 < r.fit_selected_events <= r.matched_events == r.energy_selected_events < r.candidate_events and r.corrected_alignments > 0 for r in rows if r.voltage < 49)
