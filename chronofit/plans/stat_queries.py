"""Queries over measurements, runs and result tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofit.functions import timing as T
from chronofit.operators import fits, groups, reports, search, selection, splits
from chronofit.operators import stats as E
from chronofit.sources import tables

from . import mappings as M

_M = "WITH " + M.MEASUREMENTS_SQL
_R = "WITH " + M.RUNS_SQL
_S = "WITH " + M.RESULTS_SQL
K = 2.3548200450309493


def _robust(value: str, table: str = "m", key: str = "run_id", floor: float = 0) -> str:
    return f"""c AS (SELECT {key}, count({value}) AS n, median({value}) AS center, stddev_samp({value}) AS sd FROM {table} GROUP BY 1),
d AS (SELECT {key}, median(abs({value} - center)) AS mad FROM {table} JOIN c USING ({key}) GROUP BY 1),
robust AS (SELECT {key}, n, center, greatest(CASE WHEN mad > 0 THEN 1.4826 * mad ELSE coalesce(sd, 0.0) END, {float(floor)}) AS scale FROM c JOIN d USING ({key}))"""


def a12_schema_union(spark, sf):
    m = M.measurements(spark, sf)
    runs = [m.where(F.col("run_id").like(f"{c}%")) for c in "ANR"]
    return tables.checked_union(runs)


A12 = f"{_M} SELECT * FROM m"


def a13_plain_table(spark, sf):
    d = M.measurements(spark, sf).withColumn("ratio", F.col("duration_a").cast("double") / F.nullif(F.col("duration_b").cast("double"), F.lit(0.0)))
    return tables.plain(d, ["event_index", "run_id", "ratio"])


A13 = f"{_M} SELECT event_index, run_id, duration_a / nullif(duration_b, 0) AS ratio FROM m"


def a14_codes(spark, sf):
    status = F.element_at(F.array(*map(F.lit, (*T.STATUSES, "other"))), (F.col("event_index") % 9 + 1).cast("int"))
    d = M.measurements(spark, sf).select("event_index", F.when(F.col("alignment_a") % 2 == 0, "a").otherwise("b").alias("side"), status.alias("status"))
    return d.groupBy(T.side_code(F.col("side")).alias("side"), T.status_code(F.col("status")).alias("code")).agg(F.count("*").alias("n"), F.first(T.status_name(T.status_code(F.col("status")))).alias("name"))


A14 = _M + ", s AS (SELECT alignment_a % 2 AS side, CASE WHEN event_index % 9 = 8 THEN 255 ELSE event_index % 9 END AS code FROM m) SELECT side, code, count(*) AS n, coalesce([" + ", ".join(f"'{x}'" for x in T.STATUSES) + "][code + 1], 'unknown') AS name FROM s GROUP BY 1, 2, 4"


def a16_upsert(spark, sf):
    r = M.results(spark, sf).select("file_id", "mode", "model", "candidate", "ctr_ps", "row_id")
    old, new = r.where("row_id % 3 <> 0"), r.where("row_id % 3 = 0")
    return reports.upserted(old, new, ["file_id", "mode", "model", "candidate"], "row_id")


A16 = f"{_S} SELECT file_id, mode, model, candidate, arg_max(ctr_ps, row_id) AS ctr_ps, max(row_id) AS row_id FROM results GROUP BY 1, 2, 3, 4"


def b1_window_conversions(spark, sf):
    r = M.runs(spark, sf).withColumn("lsb", 3.125 * (1 + F.col("run_number") % 3))
    low, high = T.duration_limits_lsb(F.lit(0.0), F.lit(200.0), F.col("lsb"))
    return r.select("run_id", T.window_lsb(F.col("timing_threshold_mv"), F.col("lsb")).alias("window_lsb"), low.alias("low_lsb"), high.alias("high_lsb"), T.tot_tolerance_lsb(F.lit(0.05), F.col("lsb"), F.lit(25.0)).alias("tolerance_lsb"))


B1 = f"{_R}, l AS (SELECT *, 3.125 * (1 + run_number % 3) AS lsb FROM runs) SELECT run_id, greatest(1, ceil(timing_threshold_mv * 1000 / lsb)) AS window_lsb, 1 AS low_lsb, greatest(1, floor(200.0 * 1000 / lsb)) AS high_lsb, greatest(ceil(0.05 * 1000 / lsb), greatest(1, ceil(25.0 / 1000 * 1000 / lsb))) AS tolerance_lsb FROM l"


def b27_voltage(spark, sf):
    name = F.concat(F.lit("scan_"), F.col("voltage").cast("string"), F.when(F.col("run_number") % 3 == 0, "mV_x").otherwise("V_x"))
    return M.runs(spark, sf).select("run_id", T.voltage_from_name(name, r"_(\d+(?:\.\d+)?)V").alias("voltage"))


B27 = f"{_R} SELECT run_id, CASE WHEN run_number % 3 <> 0 THEN voltage::DOUBLE END AS voltage FROM runs"


def c2_peak_window(spark, sf):
    return fits.peak_window(M.measurements(spark, sf).where("duration_a > 0"), ["run_id"], "duration_a")


def c3_in_windows(spark, sf):
    m = M.measurements(spark, sf)
    w = E.robust_scale(m, ["run_id"], "duration_a").select("run_id", (F.col("center") - F.col("scale")).alias("duration_a_low"), (F.col("center") + F.col("scale")).alias("duration_a_high"))
    return selection.in_windows(m, w, ["run_id"], ["duration_a"]).groupBy("run_id").agg(F.count("*").alias("n"), F.sum("duration_a").alias("total"))


C3 = f"{_M}, {_robust('duration_a')} SELECT run_id, count(*) AS n, sum(duration_a) AS total FROM m JOIN robust USING (run_id) WHERE duration_a BETWEEN center - scale AND center + scale GROUP BY 1"


def c4_alignment_filter(spark, sf):
    d = selection.alignment_filter(M.measurements(spark, sf), ["run_id"], ["alignment_a"], z=1.0)
    return d.groupBy("run_id").agg(F.count("*").alias("n"), F.sum("alignment_a").alias("total"))


C4 = f"{_M}, {_robust('alignment_a', floor=2)} SELECT run_id, count(*) AS n, sum(alignment_a) AS total FROM m JOIN robust USING (run_id) WHERE abs(alignment_a - center) <= scale GROUP BY 1"


def c7_photopeak_cohort(spark, sf):
    d = M.measurements(spark, sf).withColumn("noise", F.col("alignment_b") / 10.0)
    out = selection.photopeak_cohort(d, ["run_id"], ["alignment_a"], ["noise"], "alignment_b", (5, 90), z=1.0, bin_mv=20.0, quantile=0.2, half_width=200.0)
    return out.select("run_id", "event_index", "alignment_a", "alignment_b", "noise")


def c10_relative_quality(spark, sf):
    d = selection.relative_quality(M.results(spark, sf).groupBy("file_id", "mode", "model").agg(F.min("ctr_ps").alias("ctr_ps")), ["file_id", "mode"], "model", "ctr_ps", "MACHINERY", 1.5)
    return d.select("file_id", "mode", "model", "ctr_ps", "ratio", "included")


C10 = f"{_S}, g AS (SELECT file_id, mode, model, min(ctr_ps) AS ctr_ps FROM results GROUP BY 1, 2, 3), b AS (SELECT file_id, mode, ctr_ps AS base FROM g WHERE model = 'MACHINERY') SELECT file_id, mode, model, ctr_ps, ctr_ps / base AS ratio, model = 'MACHINERY' OR coalesce(ctr_ps / base <= 1.5, false) AS included FROM g LEFT JOIN b USING (file_id, mode)"


def c11_included_runs(spark, sf):
    return selection.included_runs(M.runs(spark, sf), "run_id", ["run3", "RUN007", "12"]).select("run_id", "voltage")


C11 = f"{_R} SELECT run_id, voltage FROM runs WHERE run_number IN (3, 7, 12)"


def d19_on_voltage(spark, sf):
    scope = M.results(spark, sf).select("voltage", "ctr_ps", "row_id")
    return reports.on_voltage(M.runs(spark, sf), scope, "ctr_ps", "row_id")


D19 = f"WITH {M.RUNS_SQL}, {M.RESULTS_SQL}, r AS (SELECT voltage, arg_max(ctr_ps, row_id) AS right_ps FROM results GROUP BY 1) SELECT voltage, run_id, ctr_ps AS left_ps, right_ps, ctr_ps - right_ps AS difference_ps FROM runs JOIN r USING (voltage)"


def _selected_blind(spark, sf):
    r = M.results(spark, sf)
    keys = ["file_id", "mode", "model"]
    return r.where("fold < 4").groupBy(*keys).agg(F.min("ctr_ps").alias("selection_ps")), r.where("fold = 4").groupBy(*keys).agg(F.min("ctr_ps").alias("blind_ps"))


def d20_selection_against_blind(spark, sf):
    return reports.selection_against_blind(*_selected_blind(spark, sf))[1]


D20 = f"{_S}, s AS (SELECT file_id, mode, model, min(ctr_ps) AS a FROM results WHERE fold < 4 GROUP BY 1, 2, 3), b AS (SELECT file_id, mode, model, min(ctr_ps) AS b FROM results WHERE fold = 4 GROUP BY 1, 2, 3) SELECT mode, count(*) AS n, CASE WHEN count(*) >= 3 THEN corr(a, b) END AS pearson FROM s JOIN b USING (file_id, mode, model) GROUP BY 1"


def e1_robust_scale(spark, sf):
    return E.robust_scale(M.measurements(spark, sf), ["run_id"], "timing_lsb", 2.0)


E1 = f"{_M}, {_robust('timing_lsb', floor=2)} SELECT * FROM robust"


def e3_gaussian_ctr(spark, sf):
    d = M.measurements(spark, sf).select("run_id", ((F.col("duration_a") + F.col("duration_b")) * 10).alias("delta_fs"))
    return fits.gaussian_ctr(d, ["run_id"], "delta_fs", most_ps=500.0)


def e3_span_scale(spark, sf):
    return E.span_scale(M.measurements(spark, sf), ["run_id"], "timing_lsb")


E3B = f"{_M} SELECT run_id, median(timing_lsb) AS center, (quantile_cont(timing_lsb, 0.8413) - quantile_cont(timing_lsb, 0.1587)) / 2 AS scale FROM m GROUP BY 1"


def e6_bootstrap(spark, sf):
    return E.bootstrap_ctr(M.measurements(spark, sf), ["run_id"], "event_index", "alignment_b")


def e7_compatible_groups(spark, sf):
    return reports.compatible_groups(M.runs(spark, sf)).drop("group_id")


E7 = f"{_R} SELECT voltage, acquisition_mode, energy_threshold_mv, timing_threshold_mv, string_agg(run_id, ',' ORDER BY run_number) AS run_ids, count(*) AS n_runs FROM runs GROUP BY 1, 2, 3, 4"


def e7_event_offsets(spark, sf):
    return reports.event_offsets(M.runs(spark, sf).withColumn("n", F.col("run_number") * 3 + 1), "n").select("run_id", "event_offset")


E7B = f"{_R} SELECT run_id, coalesce(sum(run_number * 3 + 1) OVER (PARTITION BY voltage, acquisition_mode, energy_threshold_mv, timing_threshold_mv ORDER BY run_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS event_offset FROM runs"


def e8_group_summary(spark, sf):
    m = M.measurements(spark, sf).withColumn("group_id", F.substring("run_id", 1, 1))
    total = m.groupBy("group_id").agg(F.count("*").alias("events"), F.array_join(F.array_sort(F.collect_set("run_id")), ",").alias("runs"))
    kept = selection.alignment_filter(m, ["group_id"], ["alignment_a", "alignment_b"], z=1.0)
    s = E.residual_metrics(kept, ["group_id"], "timing_lsb").select("group_id", "n", "mean_ps", "ctr_ps")
    return total.join(s, "group_id", "left").withColumn("fraction", F.coalesce("n", F.lit(0)) / F.col("events"))


E8 = f"""{_M}, g AS (SELECT *, run_id[1] AS group_id FROM m), a AS (SELECT group_id, median(alignment_a) AS ca, median(alignment_b) AS cb FROM g GROUP BY 1),
s AS (SELECT group_id, ca, cb, greatest(2, 1.4826 * median(abs(alignment_a - ca))) AS sa, greatest(2, 1.4826 * median(abs(alignment_b - cb))) AS sb FROM g JOIN a USING (group_id) GROUP BY 1, 2, 3),
k AS (SELECT group_id, count(*) AS n, avg(timing_lsb) AS mean_ps, stddev_samp(timing_lsb) * {K} AS ctr_ps FROM g JOIN s USING (group_id) WHERE abs(alignment_a - ca) <= sa AND abs(alignment_b - cb) <= sb GROUP BY 1),
t AS (SELECT group_id, count(*) AS events, string_agg(DISTINCT run_id, ',' ORDER BY run_id) AS runs FROM g GROUP BY 1) SELECT t.*, n, mean_ps, ctr_ps, n / events AS fraction FROM t LEFT JOIN k USING (group_id)"""


def _group_input(spark, sf):
    """Hits of seven runs from the order lines, an event each, and a table of these runs with four settings.

    Lines numbered 3 and 5 have a second timing lead; the timing leads of Run6, alone with its setting, come too late to be candidates.
    """
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("line"), F.floor("l_quantity").alias("q"))
    o, p, s, lead_b = F.col("o"), F.col("p"), F.col("s"), 1000 + F.col("p") % 11
    hit = lambda channel, edge, toa: F.struct(F.lit(channel).alias("channel"), F.lit(edge).alias("edge"), toa.cast("long").alias("toa_lsb"))
    time_b = F.when(s % 7 == 6, lead_b + 5).otherwise(lead_b - 90 - (o % 17 + p % 7 + s % 5))
    six = F.array(
        hit(1, 1, F.lit(1000)), hit(1, 0, 1000 + F.col("q") + 15 * (p % 13 + o % 11 + s % 7)), hit(5, 1, lead_b), hit(5, 0, lead_b + F.col("q") + 12 * (p % 11 + o % 13 + s % 9)), hit(3, 1, 900 - (s % 13 + o % 7 + p % 5)), hit(7, 1, time_b),
        hit(3, 1, F.when(F.col("line") == 3, 970)), hit(7, 1, F.when((F.col("line") == 5) & (s % 7 < 6), lead_b - 400)),
    )
    hits = lines.select(F.concat(F.lit("Run"), (s % 7).cast("string")).alias("run_id"), (10 * o + F.col("line")).alias("event_index"), F.explode(six).alias("h")).select("run_id", "event_index", "h.*").where("toa_lsb is not null")
    fixed = {"acquisition_mode": F.lit("TRG_MATCHING"), "energy_threshold_mv": F.lit(10.0), "timing_threshold_mv": F.lit(5.0), "measurement_mode": F.lit(1), "toa_lsb_ps": F.lit(3.0), "tot_lsb_ps": F.lit(3.0)}
    runs = lines.select((s % 7).alias("run_number")).distinct()
    voltage = F.when(F.col("run_number") == 6, 49).otherwise(40 + F.col("run_number") % 3)
    return hits, runs.select(F.concat(F.lit("Run"), F.col("run_number").cast("string")).alias("run_id"), "run_number", voltage.alias("voltage")).withColumns(fixed)


def e8_group_analysis(spark, sf):
    return groups.group_analysis(*_group_input(spark, sf), 500)


def e8_group_candidates(spark, sf):
    hits, runs = _group_input(spark, sf)
    found, members = groups.group_members(runs)
    pool = groups.pooled_candidates(hits, members, 500)
    return pool.join(found.select("group_id", "voltage", "run_ids"), "group_id").drop("group_id")


E8B = """WITH l AS (SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_linenumber AS line, floor(l_quantity)::BIGINT AS q, l_partkey % 11 + 1000 AS lead_b FROM lineitem),
x AS (SELECT 'Run' || (s % 7) AS run_id, o * 10 + line AS event_index, unnest([1, 1, 5, 5, 3, 7, 3, 7]) AS channel, unnest([1, 0, 1, 0, 1, 1, 1, 1]) AS edge,
 unnest([1000, 1000 + q + 15 * (p % 13 + o % 11 + s % 7), lead_b, lead_b + q + 12 * (p % 11 + o % 13 + s % 9), 900 - (s % 13 + o % 7 + p % 5), CASE WHEN s % 7 = 6 THEN lead_b + 5 ELSE lead_b - 90 - (o % 17 + p % 7 + s % 5) END, CASE WHEN line = 3 THEN 970 END, CASE WHEN line = 5 AND s % 7 < 6 THEN lead_b - 400 END]) AS toa FROM l),
r AS (SELECT DISTINCT 'Run' || (s % 7) AS run_id, CASE WHEN s % 7 = 6 THEN 49 ELSE 40 + s % 7 % 3 END AS voltage, s % 7 AS run_number FROM l), g AS (SELECT voltage, string_agg(run_id, ',' ORDER BY run_number) AS run_ids FROM r GROUP BY 1),
f AS (SELECT run_id, event_index, channel, min(toa) AS lead FROM x WHERE edge = 1 AND channel IN (1, 5) GROUP BY 1, 2, 3),
d AS (SELECT run_id, event_index, channel, lead, min(toa) - lead AS duration FROM f JOIN x USING (run_id, event_index, channel) WHERE edge = 0 AND toa > lead GROUP BY 1, 2, 3, 4),
c AS (SELECT DISTINCT d.* FROM d JOIN x ON x.run_id = d.run_id AND x.event_index = d.event_index AND x.channel = d.channel + 2 WHERE toa < lead AND toa > lead - 500)
SELECT a.run_id, a.event_index, a.lead AS lead_a, b.lead AS lead_b, a.duration AS duration_a, b.duration AS duration_b, voltage, run_ids FROM c a JOIN c b USING (run_id, event_index) JOIN r USING (run_id) JOIN g USING (voltage) WHERE a.channel = 1 AND b.channel = 5"""


def e9_run_summary(spark, sf):
    s = E.residual_metrics(M.results(spark, sf).withColumn("run_id", F.concat(F.lit("Run"), F.col("file_id").cast("string"))), ["run_id"], "ctr_ps")
    return M.runs(spark, sf).select("run_id", "voltage", "acquisition_mode", "energy_threshold_mv", "timing_threshold_mv").join(s.select("run_id", "n", "mean_ps", "std_ps"), "run_id", "left")


E9 = f"WITH {M.RUNS_SQL}, {M.RESULTS_SQL}, s AS (SELECT concat('Run', file_id) AS run_id, count(ctr_ps) AS n, avg(ctr_ps) AS mean_ps, stddev_samp(ctr_ps) AS std_ps FROM results GROUP BY 1) SELECT r.run_id, voltage, acquisition_mode, energy_threshold_mv, timing_threshold_mv, n, mean_ps, std_ps FROM runs r LEFT JOIN s USING (run_id)"


def e11_alignment_summary(spark, sf):
    m = M.measurements(spark, sf)
    both = m.withColumn("stage", F.lit("before")).unionByName(selection.alignment_filter(m, ["run_id"], ["alignment_a"], z=1.0).withColumn("stage", F.lit("after")))
    return E.quantile_summary(both.withColumn("mode", F.substring("run_id", 2, 1)), ["mode", "stage"], "alignment_a")


E11 = f"""{_M}, {_robust('alignment_a', floor=2)}, b AS (SELECT run_id[2] AS mode, 'before' AS stage, alignment_a AS x FROM m UNION ALL SELECT run_id[2], 'after', alignment_a FROM m JOIN robust USING (run_id) WHERE abs(alignment_a - center) <= scale)
SELECT mode, stage, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS std, median(x) AS median, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, quantile_cont(x, 0.01) AS p1, quantile_cont(x, 0.99) AS p99 FROM b GROUP BY 1, 2"""


def e12_correlations(spark, sf):
    return E.correlations(M.measurements(spark, sf), ["run_id"], "duration_a", "timing_lsb")


E12 = f"""{_M}, r AS (SELECT run_id, duration_a::DOUBLE AS x, timing_lsb::DOUBLE AS y, rank() OVER (PARTITION BY run_id ORDER BY duration_a) + (count(*) OVER (PARTITION BY run_id, duration_a) - 1) / 2 AS rx, rank() OVER (PARTITION BY run_id ORDER BY timing_lsb) + (count(*) OVER (PARTITION BY run_id, timing_lsb) - 1) / 2 AS ry FROM m)
SELECT run_id, count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2 FROM r GROUP BY 1"""


def e12_plane(spark, sf):
    m = M.measurements(spark, sf)
    p = E.plane(m, ["run_id"], "duration_a", "duration_b", "timing_lsb")
    c = m.join(p, "run_id").withColumn("corrected", F.col("timing_lsb") - F.expr("b0 + b1 * duration_a + b2 * duration_b"))
    return c.groupBy("run_id").agg(F.stddev_samp("timing_lsb").alias("std_before"), F.stddev_samp("corrected").alias("std_after"))


E12B = f"""{_M}, s AS (SELECT run_id, covar_pop(duration_a, duration_a) AS s11, covar_pop(duration_b, duration_b) AS s22, covar_pop(duration_a, duration_b) AS s12, covar_pop(duration_a, timing_lsb) AS s1y, covar_pop(duration_b, timing_lsb) AS s2y FROM m GROUP BY 1),
b AS (SELECT run_id, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s)
SELECT run_id, stddev_samp(timing_lsb) AS std_before, stddev_samp(timing_lsb - b1 * duration_a - b2 * duration_b) AS std_after FROM m JOIN b USING (run_id) GROUP BY 1"""


def e13_binned_profile(spark, sf):
    return E.binned_profile(M.measurements(spark, sf), ["run_id"], "duration_a", "timing_lsb")


E13 = f"""{_M}, r AS (SELECT run_id, min(duration_a) AS lo, max(duration_a) AS hi, least(40, greatest(10, floor(sqrt(count(duration_a)))))::INTEGER AS k FROM m GROUP BY 1),
b AS (SELECT m.run_id, least(floor((duration_a - lo) / (hi - lo) * k), k - 1)::INTEGER AS bin, duration_a, timing_lsb FROM m JOIN r USING (run_id))
SELECT run_id, bin, count(*) AS n, median(duration_a) AS x_median, median(timing_lsb) AS y_median, stddev_samp(timing_lsb) AS y_std FROM b GROUP BY 1, 2 HAVING count(*) >= 20"""


def e16_led_study(spark, sf):
    m = selection.mismatch_filter(M.measurements(spark, sf), ["run_id"], ["timing_lsb"], most_ps=20000.0)
    d = m.withColumn("difference", F.col("timing_lsb") - F.col("duration_a"))
    return d.groupBy("run_id").agg(F.count("*").alias("n"), F.corr("duration_a", "timing_lsb").alias("pearson"), F.avg("difference").alias("mean"), F.percentile("difference", 0.5).alias("median"), F.stddev_samp("difference").alias("std"))


E16 = f"{_M}, c AS (SELECT run_id, median(timing_lsb) AS c FROM m GROUP BY 1), d AS (SELECT m.*, timing_lsb - duration_a AS x FROM m JOIN c USING (run_id) WHERE abs(timing_lsb - c) <= 20000) SELECT run_id, count(*) AS n, corr(duration_a, timing_lsb) AS pearson, avg(x) AS mean, median(x) AS median, stddev_samp(x) AS std FROM d GROUP BY 1"


def e19_correction_matrix(spark, sf):
    r = M.results(spark, sf).groupBy(F.concat_ws("-", F.col("file_id").cast("string"), F.col("candidate").cast("string")).alias("event_index"), "model").agg(F.max("ctr_ps").alias("value"))
    return reports.correction_matrix(r, ["BUILDING", "MACHINERY", "HOUSEHOLD"])


E19 = f"""{_S}, e AS (SELECT file_id, candidate, max(ctr_ps) FILTER (WHERE model = 'BUILDING') AS a, max(ctr_ps) FILTER (WHERE model = 'MACHINERY') AS b, max(ctr_ps) FILTER (WHERE model = 'HOUSEHOLD') AS c FROM results GROUP BY 1, 2), w AS (SELECT * FROM e WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL),
l AS (SELECT 'BUILDING' AS model, file_id, candidate, a AS v FROM w UNION ALL SELECT 'MACHINERY', file_id, candidate, b FROM w UNION ALL SELECT 'HOUSEHOLD', file_id, candidate, c FROM w)
SELECT x.model AS model_a, y.model AS model_b, count(*) AS n, corr(x.v, y.v) AS pearson FROM l x JOIN l y USING (file_id, candidate) GROUP BY 1, 2"""


def e20_counts_table(spark, sf):
    r = M.results(spark, sf)
    n = r.groupBy("file_id", "mode", "fold").agg(F.count("*").alias("n"))
    return r.groupBy("file_id").agg(F.percentile("voltage", 0.5).alias("voltage"), F.count("*").alias("total")).join(n.groupBy("file_id").agg(F.mode("n", True).alias("typical_n")), "file_id")


E20 = f"{_S}, n AS (SELECT file_id, mode, fold, count(*) AS n FROM results GROUP BY 1, 2, 3), t AS (SELECT file_id, n, count(*) AS k FROM n GROUP BY 1, 2), y AS (SELECT file_id, arg_min(n, (-k, n)) AS typical_n FROM t GROUP BY 1) SELECT r.file_id, median(voltage) AS voltage, count(*) AS total, any_value(typical_n) AS typical_n FROM results r JOIN y USING (file_id) GROUP BY 1"


def e21_ctr_by_voltage(spark, sf):
    return reports.ctr_by_voltage(M.runs(spark, sf).where("timing_threshold_mv = 6").withColumn("error", F.abs(F.col("ctr_ps")) / 10), "ctr_ps", "error")


E21 = f"{_R} SELECT voltage, avg(ctr_ps) AS ctr_ps, sqrt(sum((abs(ctr_ps) / 10) * (abs(ctr_ps) / 10))) AS error_ps, count(*) AS n FROM runs WHERE timing_threshold_mv = 6 GROUP BY 1"


def e22_best_by_count(spark, sf):
    r = M.results(spark, sf)
    base = r.where("model = 'BUILDING'").groupBy("mode", "voltage").agg(F.min("ctr_ps").alias("baseline_ps"))
    return reports.best_by_count(r.where("model = 'MACHINERY'"), ["mode", "voltage"], "candidate", "ctr_ps", base)


E22 = f"{_S}, b AS (SELECT mode, voltage, min(ctr_ps) AS baseline_ps FROM results WHERE model = 'BUILDING' GROUP BY 1, 2), a AS (SELECT mode, voltage, candidate, min(ctr_ps) AS best_ps FROM results WHERE model = 'MACHINERY' GROUP BY 1, 2, 3) SELECT a.*, baseline_ps, 100 * (baseline_ps - best_ps) / baseline_ps AS improvement_pct FROM a JOIN b USING (mode, voltage)"


def e23_integer_histogram(spark, sf):
    return E.integer_histogram(M.measurements(spark, sf), ["run_id"], "duration_a", 250)


E23 = f"{_M} SELECT run_id, floor(duration_a / 250) * 250 AS edge, count(*) AS n FROM m GROUP BY 1, 2"


def e23_density_histogram(spark, sf):
    return E.density_histogram(M.measurements(spark, sf), ["run_id"], "timing_lsb", 40, 3.0)


E23B = f"""{_M}, {_robust('timing_lsb')}, s AS (SELECT run_id, center - 3 * scale AS lo, 6 * scale / 40 AS w FROM robust), h AS (SELECT run_id, w, least(floor((timing_lsb - lo) / w), 39)::INTEGER AS bin, count(*) AS n FROM m JOIN s USING (run_id) WHERE timing_lsb BETWEEN lo AND lo + 40 * w GROUP BY 1, 2, 3)
SELECT run_id, bin, n, n / sum(n) OVER (PARTITION BY run_id) / w AS density FROM h"""


def e24_series(spark, sf):
    r = M.results(spark, sf)
    return r.groupBy("voltage", "mode").pivot("model", ["BUILDING", "MACHINERY"]).agg(F.min("ctr_ps"))


E24 = f"{_S} SELECT voltage, mode, min(ctr_ps) FILTER (WHERE model = 'BUILDING') AS BUILDING, min(ctr_ps) FILTER (WHERE model = 'MACHINERY') AS MACHINERY FROM results GROUP BY 1, 2"


def e25_blind_fits(spark, sf):
    d = M.results(spark, sf).select("mode", "model", F.rint(F.col("ctr_ps") * 1000).cast("long").alias("delta_fs"))
    return fits.gaussian_ctr(d, ["mode", "model"], "delta_fs", min_events=20)


def f1_extremes(spark, sf):
    return reports.extremes(M.results(spark, sf), ["file_id", "mode"], "ctr_ps", "row_id", 3).select("file_id", "mode", "place", "row_id", "ctr_ps")


F1 = f"{_S}, r AS (SELECT *, row_number() OVER (PARTITION BY file_id, mode ORDER BY ctr_ps DESC, row_id) AS place FROM results) SELECT file_id, mode, place, row_id, ctr_ps FROM r WHERE place <= 3"


def f4_nearest_row(spark, sf):
    return reports.nearest_row(M.results(spark, sf), ["mode", "model"], "voltage", 42.3, "ctr_ps").select("mode", "model", "voltage", "row_id", "ctr_ps")


F4 = f"{_S}, r AS (SELECT *, row_number() OVER (PARTITION BY mode, model ORDER BY abs(voltage - 42.3), ctr_ps) AS k FROM results) SELECT mode, model, voltage, row_id, ctr_ps FROM r WHERE k = 1"
_ORDER = "sha256('17|' || row_id::VARCHAR), row_id"


def g1_holdout(spark, sf):
    return splits.holdout(M.results(spark, sf), ["file_id"], "row_id", 0.2, 17).select("row_id", "split")


G1 = f"{_S}, r AS (SELECT row_id, row_number() OVER (PARTITION BY file_id ORDER BY {_ORDER}) AS k, count(*) OVER (PARTITION BY file_id) AS n FROM results) SELECT row_id, CASE WHEN n >= 5 THEN CASE WHEN k <= greatest(1, least(round_even(n * 0.2, 0), n - 2)) THEN 'blind' ELSE 'development' END END AS split FROM r"


def g2_inner_holdout(spark, sf):
    dev = splits.holdout(M.results(spark, sf), ["file_id"], "row_id", 0.2, 17).where("split = 'development'").drop("split")
    return splits.holdout(dev, ["file_id"], "row_id", 0.25, "inner", "validation", "train", 3, 1).groupBy("file_id", "split").agg(F.count("*").alias("n"), F.sum("row_id").alias("total"))


G2 = f"{_S}, g AS ({G1.replace(_S + ', r', 'WITH r')}), d AS (SELECT r.* FROM results r JOIN g USING (row_id) WHERE split = 'development'), s AS (SELECT file_id, row_id, row_number() OVER (PARTITION BY file_id ORDER BY sha256('inner|' || row_id::VARCHAR), row_id) AS k, count(*) OVER (PARTITION BY file_id) AS n FROM d) SELECT file_id, CASE WHEN n >= 3 THEN CASE WHEN k <= greatest(1, least(round_even(n * 0.25, 0), n - 1)) THEN 'validation' ELSE 'train' END END AS split, count(*) AS n, sum(row_id) AS total FROM s GROUP BY 1, 2"


def g3_folds(spark, sf):
    return splits.folds(M.results(spark, sf), ["file_id"], "row_id", 5, 17).withColumnRenamed("fold", "f").select("row_id", F.col("f").alias("fold"))


G3 = f"{_S} SELECT row_id, ntile(5) OVER (PARTITION BY file_id ORDER BY {_ORDER}) - 1 AS fold FROM results"


def g4_fold_roles(spark, sf):
    d = splits.folds(M.results(spark, sf).drop("fold"), ["file_id"], "row_id", 5, 17)
    return splits.fold_roles(d, 5).groupBy("file_id", "outer_fold", "role").agg(F.count("*").alias("n"), F.sum("row_id").alias("total"))


G4 = f"{_S}, f AS (SELECT file_id, row_id, ntile(5) OVER (PARTITION BY file_id ORDER BY {_ORDER}) - 1 AS fold FROM results), o AS (SELECT f.*, unnest([0, 1, 2, 3, 4]) AS outer_fold FROM f) SELECT file_id, outer_fold, CASE WHEN fold = outer_fold THEN 'score' ELSE 'train' END AS role, count(*) AS n, sum(row_id) AS total FROM o GROUP BY 1, 2, 3"


def g5_three_way(spark, sf):
    return splits.three_way(M.results(spark, sf), ["file_id"], "row_id", 0.2, 0.25, 17).select("row_id", "split")


G5 = f"{_S}, r AS (SELECT row_id, row_number() OVER (PARTITION BY file_id ORDER BY {_ORDER}) AS k, count(*) OVER (PARTITION BY file_id) AS n FROM results), b AS (SELECT *, greatest(1, least(round_even(n * 0.2, 0), n - 2)) AS b FROM r), v AS (SELECT *, greatest(1, least(round_even((n - b) * 0.25, 0), n - b - 1)) AS v FROM b) SELECT row_id, CASE WHEN k <= b THEN 'blind' WHEN k <= b + v THEN 'validation' ELSE 'train' END AS split FROM v"


def h1_candidates(spark, sf):
    modes = M.results(spark, sf).select("mode").distinct()
    values = spark.read.parquet(f"{sf}/region.parquet").select((F.col("r_regionkey") * 10 + 5).alias("threshold"))
    s = search.subsets(values, "threshold", 1, 3).select(F.array_join("subset", ",").alias("thresholds"))
    return search.product([modes, s])


H1 = f"{_S}, t AS (SELECT r_regionkey * 10 + 5 AS t FROM region), s AS (SELECT t::VARCHAR AS thresholds FROM t UNION ALL SELECT a.t || ',' || b.t FROM t a JOIN t b ON b.t > a.t UNION ALL SELECT a.t || ',' || b.t || ',' || c.t FROM t a JOIN t b ON b.t > a.t JOIN t c ON c.t > b.t) SELECT mode, thresholds FROM (SELECT DISTINCT mode FROM results), s"


def h2_candidate_choice(spark, sf):
    s = search.candidate_scores(M.results(spark, sf), ["mode", "model"], "candidate", "fold", "ctr_ps")
    return search.choose(s, ["mode", "model"], "candidate")


H2 = f"""{_S}, f AS (SELECT mode, model, candidate, fold, stddev_samp(ctr_ps) * {K} AS c FROM results GROUP BY 1, 2, 3, 4), s AS (SELECT mode, model, candidate, avg(c) AS score_ps, stddev_samp(c) AS fold_std_ps, count(c) AS folds FROM f GROUP BY 1, 2, 3),
p AS (SELECT mode, model, candidate, count(ctr_ps) AS n, avg(ctr_ps) AS mean_ps, sqrt(avg(ctr_ps * ctr_ps)) AS rmse_ps FROM results GROUP BY 1, 2, 3), b AS (SELECT mode, model, arg_min(candidate, (score_ps, candidate)) AS best FROM s WHERE score_ps IS NOT NULL GROUP BY 1, 2)
SELECT s.*, n, mean_ps, rmse_ps, coalesce(candidate = best, false) AS selected FROM s JOIN p USING (mode, model, candidate) LEFT JOIN b USING (mode, model)"""


def h8_final_evaluation(spark, sf):
    d = splits.holdout(M.results(spark, sf), ["file_id"], "row_id", 0.2, 17)
    s = E.residual_metrics(d, ["mode", "model", "split"], "ctr_ps").select("mode", "model", "split", "n", "mean_ps", "ctr_ps")
    return selection.relative_quality(s.where("split = 'blind'"), ["mode"], "model", "ctr_ps", "BUILDING", 2.0).select("mode", "model", "n", "mean_ps", "ctr_ps", "ratio", "included")


H8 = f"{_S}, g AS ({G1.replace(_S + ', r', 'WITH r')}), s AS (SELECT mode, model, count(ctr_ps) AS n, avg(ctr_ps) AS mean_ps, stddev_samp(ctr_ps) * {K} AS ctr_ps FROM results JOIN g USING (row_id) WHERE split = 'blind' GROUP BY 1, 2), b AS (SELECT mode, ctr_ps AS base FROM s WHERE model = 'BUILDING') SELECT mode, model, n, mean_ps, ctr_ps, ctr_ps / base AS ratio, model = 'BUILDING' OR coalesce(ctr_ps / base <= 2, false) AS included FROM s LEFT JOIN b USING (mode)"


def h9_nested_evaluation(spark, sf):
    r = M.results(spark, sf).withColumn("fold", F.pmod(F.floor(F.col("row_id") / 20), F.lit(3)))
    return search.nested_evaluation(r, ["mode"], "candidate", "fold", "ctr_ps")


H9 = f"""{_S}, f AS (SELECT mode, candidate, (row_id // 20) % 3 AS fold, stddev_samp(ctr_ps) * {K} AS c FROM results GROUP BY 1, 2, 3), t AS (SELECT *, (sum(c) OVER w - c) / (count(c) OVER w - 1) AS inr, count(c) OVER w AS k FROM f WINDOW w AS (PARTITION BY mode, candidate)),
b AS (SELECT mode, fold, arg_min(c, (inr, candidate)) AS c FROM t WHERE k > 1 AND inr IS NOT NULL GROUP BY 1, 2) SELECT mode, count(*) AS folds, avg(c) AS mean_ctr_ps, stddev_samp(c) AS std_ctr_ps FROM b GROUP BY 1"""


_N = "a12_schema_union:A12 a13_plain_table:A13 a14_codes:A14 a16_upsert:A16 b1_window_conversions:B1 b27_voltage:B27 c2_peak_window: c3_in_windows:C3 c4_alignment_filter:C4 c7_photopeak_cohort: c10_relative_quality:C10 c11_included_runs:C11 d19_on_voltage:D19 d20_selection_against_blind:D20 e1_robust_scale:E1 e3_gaussian_ctr: e3_span_scale:E3B e6_bootstrap: e7_compatible_groups:E7 e7_event_offsets:E7B e8_group_summary:E8 e8_group_analysis: e8_group_candidates:E8B e9_run_summary:E9 e11_alignment_summary:E11 e12_correlations:E12 e12_plane:E12B e13_binned_profile:E13 e16_led_study:E16 e19_correction_matrix:E19 e20_counts_table:E20 e21_ctr_by_voltage:E21 e22_best_by_count:E22 e23_integer_histogram:E23 e23_density_histogram:E23B e24_series:E24 e25_blind_fits: f1_extremes:F1 f4_nearest_row:F4 g1_holdout:G1 g2_inner_holdout:G2 g3_folds:G3 g4_fold_roles:G4 g5_three_way:G5 h1_candidates:H1 h2_candidate_choice:H2 h8_final_evaluation:H8 h9_nested_evaluation:H9"
QUERIES = {n: (globals()[n], globals()[s] if s else None) for n, s in (x.split(":") for x in _N.split())}
