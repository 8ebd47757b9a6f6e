"""Pooled analysis of compatible runs: one chain of stages for all groups at once, and one summary row for each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pulses as P
from .fits import gaussian_ctr, peak_window
from .lineage import cut
from .reports import GROUP, compatible_groups
from .selection import in_windows
from .stats import clipped_delay, robust_scale

#: What makes runs poolable: the settings, and the header of their files.
POOLABLE = (*GROUP, "measurement_mode", "toa_lsb_ps", "tot_lsb_ps")
_EVENT = ["run_id", "event_index"]
#: The same for joins, which sort by the first column for as long as that differs.
_JOINED = ["event_index", "run_id"]


def pooled_candidates(hits: DataFrame, members: DataFrame, window: int, energy: tuple[int, int] = (1, 5), timing: tuple[int, int] = (3, 7)) -> DataFrame:
    """Accepted candidate events of all runs of the groups: group_id, run_id, event_index, lead_a, lead_b, duration_a, duration_b.

    members: run_id, group_id. Hits of runs that are in no group, or have no id, are left out.
    """
    accepted = P.trigger_candidates(hits, window, energy, timing).where("reason = 'accepted'").join(members.select("run_id", "group_id"), "run_id")
    return accepted.select("group_id", *_EVENT, "lead_a", "lead_b", *((F.col(f"trail_{s}") - F.col(f"lead_{s}")).alias(f"duration_{s}") for s in "ab"))


def group_members(runs: DataFrame, keys: Sequence[str] = POOLABLE) -> tuple[DataFrame, DataFrame]:
    """The groups (keys, group_id, run_ids, run_count) and the members (run_id, group_id, toa_lsb_ps) of runs."""
    groups = compatible_groups(runs, keys).withColumnRenamed("n_runs", "run_count")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
    return groups, runs.alias("r").join(groups.alias("g"), same).select("r.run_id", "g.group_id", "r.toa_lsb_ps")


def _by_side(events: DataFrame, value: str) -> DataFrame:
    """group_id, side, value: the two values of each event."""
    pair = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{value}_{s}").alias("value")) for s in "ab"))
    return events.select("group_id", F.explode(pair).alias("_p")).select("group_id", "_p.*")


def _of(side: str, column: str, name: str) -> Column:
    return F.max(F.when(F.col("side") == side, F.col(column))).alias(name)


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.nullif(F.col(b), F.lit(0))


def group_analysis(
    hits: DataFrame, runs: DataFrame, window: int, energy: tuple[int, int] = (1, 5), timing: tuple[int, int] = (3, 7), longest: float | None = None,
    z: float = 5.0, least: int = 20, keys: Sequence[str] = POOLABLE, peak: dict | None = None, delay: dict | None = None, fit: dict | None = None,
) -> DataFrame:
    """Energy windows, average delays, matching, alignment and the timing fit of every group of compatible runs: a row for each group.

    hits: run_id, event_index, channel, edge, toa_lsb; runs: run_id, run_number and the keys, toa_lsb_ps among them.
    Windows and delays are those of a group's pooled events; matching goes by run with its group's delays. A
    stage that a group can't pass leaves `status` failed, `error` with the first stage's reason, and null for all that a complete
    analysis would fill; the other groups aren't touched. Every stage treats all groups in the same jobs; what a
    stage keeps is written once, with one row for each event (each candidate for the matching). peak, delay and fit
    are options of peak_window(), clipped_delay() and gaussian_ctr(); longest is the greatest deviation from the average
    delay; under `least` matched events the alignment filter lets all pass. Repeated hits count as one edge in time; without hits every group is a failure row, without runs there are no rows.
    """
    g = ["group_id"]
    groups, members = (cut(x) for x in group_members(runs, keys))
    count = lambda df, name: df.groupBy(*g).agg(F.count("*").alias(name))

    pool = cut(pooled_candidates(hits, members, window, energy, timing))
    low_high = cut(peak_window(_by_side(pool, "duration"), [*g, "side"], "value", **(peak or {})))
    windows = cut(low_high.groupBy(*g).agg(*(_of(s, c, n.format(s)) for s in "ab" for c, n in (("low", "duration_{}_low"), ("high", "duration_{}_high"), ("message", "_peak_{}")))))
    both = windows.where("_peak_a = '' and _peak_b = ''")
    selected = cut(in_windows(pool, both, g, ["duration_a", "duration_b"]))

    # the pool has each event's pulses already, so only timing leads are read again
    leads = hits.where(F.col("channel").isin(*timing) & (F.col("edge") == 1)).select(*_EVENT, "channel", "edge", "toa_lsb")
    sides = cut(P.preceding_leads(leads.join(selected.drop(*g), _JOINED), window, timing))
    samples = P.calibration_samples(sides).join(members.select("run_id", "group_id"), "run_id")
    models = cut(clipped_delay(samples, [*g, "side"], "delay", **(delay or {})).where("mean is not null"))
    delays = models.groupBy(*g).agg(*(_of(s, c, f"_{c}_{s}") for s in "ab" for c in ("mean", "deviation", "n_kept")))

    by_run = members.join(models, g).select("run_id", "side", "mean")
    wide = cut(P.matches_wide(P.match_delays(sides, by_run, longest)))
    events = wide.where("status = 'accepted'").join(selected, _JOINED)
    matched = cut(events.select(*g, *_EVENT, *((F.col(f"time_{s}") - F.col(f"lead_{s}")).alias(f"alignment_{s}") for s in "ab"), (F.col("time_b") - F.col("time_a")).alias("timing_lsb")))
    centers = cut(robust_scale(_by_side(matched, "alignment"), [*g, "side"], "value", 2.0).groupBy(*g).agg(*(_of(s, c, f"{c}_{s}") for s in "ab" for c in ("n", "center", "scale"))))
    near = [(F.col(f"n_{s}") < least) | (F.abs(F.col(f"alignment_{s}") - F.col(f"center_{s}")) <= z * F.col(f"scale_{s}")) for s in "ab"]
    kept = matched.join(centers, g).where(near[0] & near[1]).select(*matched.columns)
    centers = centers.drop("n_a", "n_b")
    lsb = members.select(*g, "toa_lsb_ps").distinct()
    final = cut(kept.join(lsb, g).select(*g, F.rint(F.col("timing_lsb") * F.col("toa_lsb_ps") * 1000).cast("long").alias("fs")))
    fitted = gaussian_ctr(final, g, "fs", **(fit or {})).select(*g, *(F.col(c).alias(f"_{c}") for c in ("success", "n", "mean_ps", "mean_error_ps", "sigma_ps", "ctr_ps", "ctr_error_ps", "deviance", "ndof", "message")))
    repaired = P.repaired_alignments(wide, members.join(centers, g).drop(*g, "toa_lsb_ps"), z).join(members, "run_id").groupBy(*g).agg(F.sum("repaired").alias("_repaired"))

    out = groups
    for part in (count(pool, "candidate_events"), windows, count(selected, "energy_selected_events"), delays, count(matched, "matched_events"), centers, count(final, "fit_selected_events"), fitted, repaired):
        out = out.join(part, g, "left")
    for n in ("candidate_events", "energy_selected_events", "matched_events", "fit_selected_events"):
        out = out.withColumn(n, F.coalesce(n, F.lit(0)))
    failed = lambda s: F.when(F.col(f"_peak_{s}") != "", F.concat(F.lit(f"energy window {s}: "), F.col(f"_peak_{s}")))
    error = F.coalesce(
        F.when(F.col("candidate_events") == 0, "no candidate events"), failed("a"), failed("b"), F.when(F.col("energy_selected_events") == 0, "no event in both energy windows"),
        *(F.when(F.col(f"_mean_{s}").isNull(), f"average delay {s}: too few unambiguous events") for s in "ab"), F.when(F.col("matched_events") == 0, "no matched events"),
        F.when(F.col("fit_selected_events") == 0, "no event passes the alignment filter"), F.when(~F.coalesce("_success", F.lit(False)), F.concat(F.lit("timing fit: "), F.coalesce("_message", F.lit("")))), F.lit(""),
    )
    out = out.withColumn("error", error).withColumn("status", F.when(F.col("error") == "", "complete").otherwise("failed"))
    ps = lambda c: F.col(c) * F.col("toa_lsb_ps")
    sigma_error = F.col("_ctr_error_ps") * F.col("_sigma_ps") / F.col("_ctr_ps")
    fields = {
        **{c: F.col(c) for c in ("candidate_events", "energy_selected_events")}, "energy_selection_fraction": _ratio("energy_selected_events", "candidate_events"),
        "matched_events": F.col("matched_events"), "matching_efficiency": _ratio("matched_events", "energy_selected_events"),
        "fit_selected_events": F.col("fit_selected_events"), "fit_selection_fraction": _ratio("fit_selected_events", "matched_events"), "overall_selection_fraction": _ratio("fit_selected_events", "candidate_events"),
        **{f"peak_{s}_{e}_ps": ps(f"duration_{s}_{e}") for s in "ab" for e in ("low", "high")},
        **{f"alignment_{s}_{e}_ps": ps(f"{e}_{s}") for s in "ab" for e in ("center", "scale")},
        **{f"average_delay_{s}{e}": x for s in "ab" for e, x in (("_ps", ps(f"_mean_{s}")), ("_std_ps", ps(f"_deviation_{s}")), ("_training_events", F.col(f"_n_kept_{s}")))},
        "gaussian_area_events": F.col("_n"), "gaussian_mean_ps": F.col("_mean_ps"), "gaussian_mean_error_ps": F.col("_mean_error_ps"), "gaussian_sigma_ps": F.col("_sigma_ps"), "gaussian_sigma_error_ps": sigma_error,
        "ctr_ps": F.col("_ctr_ps"), "ctr_error_ps": F.col("_ctr_error_ps"), "chi_square": F.col("_deviance"), "ndof": F.col("_ndof"), "reduced_chi_square": F.col("_deviance") / F.nullif(F.col("_ndof"), F.lit(0)),
        "corrected_alignments": F.coalesce("_repaired", F.lit(0)),
    }
    complete = F.col("status") == "complete"
    return out.select("group_id", *keys, "run_count", "run_ids", "status", "error", *(F.when(complete, x).alias(n) for n, x in fields.items()))
