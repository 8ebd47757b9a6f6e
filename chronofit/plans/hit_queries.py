"""Queries over edges, pulses, coincidences and matches, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofit.operators import pulses as P
from chronofit.operators import selection as C
from chronofit.operators import stats as E

from . import mappings as M

# Windows in LSB (seconds here) that give data: timing, pulse duration, duration tolerance, coincidence.
TIMING, LONGEST, TOLERANCE, NEAR = 43200, 43200, 1800, 3600

_EARLIEST = """l{s} AS (SELECT run_id, event_index, min(toa_lsb) AS lead FROM hits WHERE channel = {e} AND edge = 1 GROUP BY 1, 2),
p{s} AS (SELECT l.run_id, l.event_index, lead, min(toa_lsb) AS trail FROM l{s} l JOIN hits h ON h.run_id = l.run_id AND h.event_index = l.event_index AND h.channel = {e} AND h.edge = 0 AND h.toa_lsb > lead GROUP BY 1, 2, 3),
c{s} AS (SELECT p.run_id, p.event_index, '{s}' AS side, lead, trail - lead AS duration, toa_lsb AS time, lead - toa_lsb AS delay
  FROM p{s} p JOIN hits h ON h.run_id = p.run_id AND h.event_index = p.event_index AND h.channel = {t} AND h.edge = 1 AND toa_lsb < lead AND toa_lsb > lead - 43200)"""
_SIDES = "WITH " + M.HITS_SQL + ", " + _EARLIEST.format(s="a", e=1, t=3) + ", " + _EARLIEST.format(s="b", e=5, t=7) + ", cand AS (SELECT * FROM ca UNION ALL SELECT * FROM cb)"
_MODELS = """, models AS (SELECT run_id, side, avg(delay) AS mean FROM (SELECT run_id, event_index, side, count(*) AS n, any_value(delay) AS delay FROM cand GROUP BY 1, 2, 3) WHERE n = 1 GROUP BY 1, 2),
scored AS (SELECT c.*, abs(delay - mean) AS deviation FROM cand c JOIN models USING (run_id, side)),
best AS (SELECT run_id, event_index, side, arg_min(time, (deviation, -time)) AS time, arg_min(delay, (deviation, -time)) AS delay, min(deviation) AS deviation, max(time) AS baseline_time, count(*) AS n_candidates FROM scored GROUP BY 1, 2, 3),
side_rows AS (SELECT *, time <> baseline_time AS changed, 'accepted' AS status FROM best)"""
_WIDE = """, wide AS (SELECT run_id, event_index, max(time) FILTER (WHERE side = 'a') AS time_a, max(time) FILTER (WHERE side = 'b') AS time_b,
 max(deviation) FILTER (WHERE side = 'a') AS deviation_a, max(deviation) FILTER (WHERE side = 'b') AS deviation_b, bool_or(changed) AS changed, max(n_candidates) AS n_candidates,
 CASE WHEN count(*) = 2 THEN 'accepted' ELSE 'no_candidate' END AS status FROM side_rows GROUP BY 1, 2)"""


def _edges(spark, sf):
    return P.unique_edges(M.hits(spark, sf))


def _pulses(spark, sf):
    return P.pulse_table(_edges(spark, sf), TOLERANCE, 1, LONGEST)


def _candidates(spark, sf):
    return P.side_candidates(M.hits(spark, sf), TIMING)


def _models(spark, sf):
    return P.calibration_samples(_candidates(spark, sf)).groupBy("run_id", "side").agg(F.avg("delay").alias("mean"))


def _sides(spark, sf):
    return P.match_delays(_candidates(spark, sf), _models(spark, sf))


def _leads(spark, sf):
    return M.hits(spark, sf).where("edge = 1").select("run_id", "board", "channel", F.col("toa_lsb").alias("lead")).distinct()


def d1_unique_edges(spark, sf):
    return _edges(spark, sf).drop("seq")


D1 = f"WITH {M.HITS_SQL} SELECT run_id, board, channel, edge, toa_lsb, CASE WHEN edge = 0 THEN tot_lsb END AS tot_lsb, count(*) - 1 AS duplicates FROM hits GROUP BY 1, 2, 3, 4, 5, 6"


def d2_recorded_pulses(spark, sf):
    return P.recorded_pulses(_edges(spark, sf), TOLERANCE, 1, LONGEST)


def d3_fallback_pulses(spark, sf):
    e = _edges(spark, sf)
    return P.fallback_pulses(e, P.recorded_pulses(e, TOLERANCE, 1, LONGEST), 1, LONGEST, True, True)


def d4_pulse_table(spark, sf):
    return _pulses(spark, sf)


def d5_coincidences(spark, sf):
    return P.coincidences(_leads(spark, sf), 1, 5, NEAR)


def d6_candidate_lists(spark, sf):
    leads = _leads(spark, sf)
    # pairs within 60: an equi-join on buckets of that width
    bucket = lambda c: F.floor(F.col(c) / 60)
    first = leads.where("channel = 1").select("run_id", "board", F.col("lead").alias("lead_a")).withColumn("k", bucket("lead_a"))
    second = leads.where("channel = 5").select("run_id", "board", F.col("lead").alias("lead_b")).withColumn("k", F.explode(F.sequence(bucket("lead_b") - 1, bucket("lead_b") + 1)))
    near = first.join(second, ["run_id", "board", "k"]).where(F.abs(F.col("lead_a") - F.col("lead_b")) <= 60).drop("k")
    return P.candidate_lists(near, leads, 7200, text=True).select("run_id", "board", "lead_a", "lead_b", "candidates_a", "candidates_b")


D6 = f"""WITH {M.HITS_SQL}, t AS (SELECT DISTINCT run_id, board, channel, toa_lsb AS lead FROM hits WHERE edge = 1),
n AS (SELECT a.run_id, a.board, a.lead AS lead_a, b.lead AS lead_b FROM t a JOIN t b ON a.run_id = b.run_id AND a.board = b.board AND a.channel = 1 AND b.channel = 5 AND abs(a.lead - b.lead) <= 60),
x AS (SELECT n.run_id, n.board, lead_a, lead_b, string_agg(t.lead::VARCHAR, ',' ORDER BY t.lead) AS candidates_a FROM n JOIN t ON t.run_id = n.run_id AND t.board = n.board AND t.channel = 3 AND t.lead < lead_a AND t.lead > greatest(0, lead_a - 7200) GROUP BY 1, 2, 3, 4),
y AS (SELECT n.run_id, n.board, lead_a, lead_b, string_agg(t.lead::VARCHAR, ',' ORDER BY t.lead) AS candidates_b FROM n JOIN t ON t.run_id = n.run_id AND t.board = n.board AND t.channel = 7 AND t.lead < lead_b AND t.lead > greatest(0, lead_b - 7200) GROUP BY 1, 2, 3, 4)
SELECT * FROM x JOIN y USING (run_id, board, lead_a, lead_b)"""


def d7_in_event_pairs(spark, sf):
    return P.in_event_pairs(M.hits(spark, sf))


D7 = f"""WITH RECURSIVE {M.HITS_SQL}, g AS (SELECT run_id, event_index, channel, coalesce(list(toa_lsb ORDER BY toa_lsb) FILTER (WHERE edge = 1), []) AS l, coalesce(list(toa_lsb ORDER BY toa_lsb) FILTER (WHERE edge = 0), []) AS t FROM hits GROUP BY 1, 2, 3),
w AS (SELECT run_id, event_index, channel, l, t, 0 AS pulse, CAST(NULL AS BIGINT) AS lead, CAST(NULL AS BIGINT) AS trail FROM g
  UNION ALL SELECT run_id, event_index, channel, l[2:], list_filter(t, lambda x: x > l[1])[2:], pulse + 1, l[1], list_filter(t, lambda x: x > l[1])[1] FROM w WHERE len(l) > 0 AND len(list_filter(t, lambda x: x > l[1])) > 0)
SELECT run_id, event_index, channel, pulse - 1 AS pulse, lead, trail FROM w WHERE pulse > 0"""


def d8_earliest_pulse(spark, sf):
    return P.earliest_pulse(M.hits(spark, sf), 1)


D8 = f"{_SIDES} SELECT * FROM pa"


def d9_leads_before(spark, sf):
    h = M.hits(spark, sf)
    return P.leads_before(h, 3, P.earliest_pulse(h, 1), TIMING)


D9 = f"{_SIDES} SELECT run_id, event_index, lead, time FROM ca"


def d10_overlap_support(spark, sf):
    p = P.in_event_pairs(M.hits(spark, sf)).where(F.col("trail") - F.col("lead") <= LONGEST)
    side = lambda c: p.where(F.col("channel") == c).select("run_id", "event_index", "lead", "trail")
    return P.overlap_support(side(1), side(3), ["run_id", "event_index"])


D10 = D7.replace("SELECT run_id, event_index, channel, pulse - 1 AS pulse, lead, trail FROM w WHERE pulse > 0", """, p AS (SELECT run_id, event_index, channel, lead, trail FROM w WHERE pulse > 0 AND trail - lead <= 43200)
SELECT DISTINCT a.run_id, a.event_index, a.lead, a.trail FROM p a JOIN p b ON a.run_id = b.run_id AND a.event_index = b.event_index AND a.channel = 1 AND b.channel = 3 AND a.lead <= b.trail AND b.lead <= a.trail""")


def d11_overlap_pairs(spark, sf):
    return P.overlap_pairs(_pulses(spark, sf), 3, 7, longest=LONGEST)


def d12_overlapping_candidates(spark, sf):
    p = _pulses(spark, sf)
    near = P.coincidences(_leads(spark, sf), 1, 5, NEAR).select("run_id", "board", "lead_a", "lead_b")
    return P.overlapping_candidates(P.overlap_pairs(p, 3, 7, longest=LONGEST), near, 7200)


def d13_trigger_candidates(spark, sf):
    return P.trigger_candidates(M.hits(spark, sf), TIMING)


D13 = f"""{_SIDES}, e AS (SELECT DISTINCT run_id, event_index FROM hits), na AS (SELECT run_id, event_index, count(*) AS n_a FROM ca GROUP BY 1, 2), nb AS (SELECT run_id, event_index, count(*) AS n_b FROM cb GROUP BY 1, 2)
SELECT e.run_id, e.event_index, pa.lead AS lead_a, pa.trail AS trail_a, pb.lead AS lead_b, pb.trail AS trail_b, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b,
 CASE WHEN pa.lead IS NULL THEN 'missing_pulse_a' WHEN pb.lead IS NULL THEN 'missing_pulse_b' WHEN n_a IS NULL THEN 'no_candidate_a' WHEN n_b IS NULL THEN 'no_candidate_b' ELSE 'accepted' END AS reason
FROM e LEFT JOIN pa USING (run_id, event_index) LEFT JOIN pb USING (run_id, event_index) LEFT JOIN na USING (run_id, event_index) LEFT JOIN nb USING (run_id, event_index)"""


def d14_calibration_samples(spark, sf):
    return P.calibration_samples(_candidates(spark, sf))


D14 = f"{_SIDES} SELECT run_id, event_index, side, any_value(duration) AS duration, any_value(delay) AS delay FROM cand GROUP BY 1, 2, 3 HAVING count(*) = 1"


def d15_match_delays(spark, sf):
    return _sides(spark, sf)


D15 = f"{_SIDES}{_MODELS} SELECT run_id, event_index, side, time, delay, deviation, baseline_time, changed, n_candidates, status FROM side_rows"


def d16_matched_hits(spark, sf):
    return P.matched_hits(P.trigger_candidates(M.hits(spark, sf), TIMING), P.matches_wide(_sides(spark, sf)))


D16 = f"""{_SIDES}{_MODELS}{_WIDE}, ok AS (SELECT w.run_id, w.event_index, pa.lead AS la, pa.trail AS ta, pb.lead AS lb, pb.trail AS tb, time_a, time_b FROM wide w JOIN pa USING (run_id, event_index) JOIN pb USING (run_id, event_index) WHERE status = 'accepted'),
six AS (SELECT run_id, event_index, la AS toa_lsb, 1 AS channel, 1 AS edge FROM ok UNION ALL SELECT run_id, event_index, ta, 1, 0 FROM ok UNION ALL SELECT run_id, event_index, lb, 5, 1 FROM ok UNION ALL SELECT run_id, event_index, tb, 5, 0 FROM ok UNION ALL SELECT run_id, event_index, time_a, 3, 1 FROM ok UNION ALL SELECT run_id, event_index, time_b, 7, 1 FROM ok)
SELECT run_id, event_index, row_number() OVER (PARTITION BY run_id, event_index ORDER BY toa_lsb, channel, -edge) - 1 AS position, channel, edge, toa_lsb FROM six"""


def d17_matches_wide(spark, sf):
    return P.matches_wide(_sides(spark, sf)).select("run_id", "event_index", "time_a", "time_b", "deviation_a", "deviation_b", "changed", "n_candidates", "status")


D17 = f"{_SIDES}{_MODELS}{_WIDE} SELECT * FROM wide"


def d17_matches_long(spark, sf):
    return P.matches_long(P.matches_wide(_sides(spark, sf)))


D17B = f"{_SIDES}{_MODELS} SELECT run_id, event_index, side, time, delay, deviation, baseline_time, status FROM side_rows"


def d18_matching_summary(spark, sf):
    return P.matching_summary(P.matches_wide(_sides(spark, sf)))


D18 = f"{_SIDES}{_MODELS}{_WIDE} SELECT run_id, count(*) AS events, count(*) FILTER (WHERE status = 'accepted') AS accepted, count(*) FILTER (WHERE status <> 'accepted') AS rejected, count(*) FILTER (WHERE changed) AS changed, avg(deviation_a) AS deviation_a, avg(deviation_b) AS deviation_b FROM wide GROUP BY 1"


def c1_single_pulses(spark, sf):
    return C.single_pulses(M.hits(spark, sf).withColumn("event_index", F.floor(F.col("toa_lsb") / 1200)), timing=None)


C1 = f"""WITH {M.HITS_SQL}, g AS (SELECT run_id, toa_lsb // 1200 AS event_index, count(*) FILTER (WHERE channel = 1 AND edge = 1) AS la, count(*) FILTER (WHERE channel = 1 AND edge = 0) AS ta, count(*) FILTER (WHERE channel = 5 AND edge = 1) AS lb, count(*) FILTER (WHERE channel = 5 AND edge = 0) AS tb,
 min(toa_lsb) FILTER (WHERE channel = 1 AND edge = 1) AS ml, min(toa_lsb) FILTER (WHERE channel = 1 AND edge = 0) AS mt, min(toa_lsb) FILTER (WHERE channel = 5 AND edge = 1) AS nl, min(toa_lsb) FILTER (WHERE channel = 5 AND edge = 0) AS nt FROM hits GROUP BY 1, 2)
SELECT run_id, event_index, mt - ml AS duration_a, nt - nl AS duration_b FROM g WHERE la = 1 AND ta = 1 AND lb = 1 AND tb = 1 AND mt > ml AND nt > nl"""


def e2_clipped_delay(spark, sf):
    return E.clipped_delay(_candidates(spark, sf), ["run_id", "side"], "delay")


def e10_edge_accounting(spark, sf):
    h = M.hits(spark, sf)
    return P.edge_accounting(h, P.in_event_pairs(h))


E10 = D7.replace("SELECT run_id, event_index, channel, pulse - 1 AS pulse, lead, trail FROM w WHERE pulse > 0", """, u AS (SELECT run_id, board, channel, edge, toa_lsb, CASE WHEN edge = 0 THEN tot_lsb END AS tot, count(*) AS n FROM hits GROUP BY 1, 2, 3, 4, 5, 6),
p AS (SELECT run_id, channel, count(*) AS pulses FROM w WHERE pulse > 0 GROUP BY 1, 2),
e AS (SELECT run_id, channel, coalesce(sum(n) FILTER (WHERE edge = 1), 0) AS leads, coalesce(sum(n) FILTER (WHERE edge = 0), 0) AS trails, sum(n - 1) AS duplicates, count(*) FILTER (WHERE edge = 1) AS unique_leads, count(*) FILTER (WHERE edge = 0) AS unique_trails, count(*) FILTER (WHERE edge = 0 AND tot > 0) AS recorded_tot FROM u GROUP BY 1, 2)
SELECT e.*, coalesce(pulses, 0) AS pulses, unique_leads - coalesce(pulses, 0) AS unmatched_leads, unique_trails - coalesce(pulses, 0) AS unmatched_trails FROM e LEFT JOIN p USING (run_id, channel)""")


def flagship(spark, sf):
    """Trigger-mode residuals: metrics of the delays of unambiguous samples per run and side."""
    return E.residual_metrics(P.calibration_samples(_candidates(spark, sf)), ["run_id", "side"], "delay")


FLAGSHIP = f"""{_SIDES}, s AS (SELECT run_id, event_index, side, any_value(delay)::DOUBLE AS v FROM cand GROUP BY 1, 2, 3 HAVING count(*) = 1)
SELECT run_id, side, count(v) AS n, avg(v) AS mean_ps, stddev_samp(v) AS std_ps, stddev_samp(v) * 2.3548200450309493 AS ctr_ps, sqrt(avg(v * v)) AS rmse_ps, var_pop(v) AS variance_ps2 FROM s GROUP BY 1, 2"""

QUERIES = {
    "flagship": (flagship, FLAGSHIP), "d1_unique_edges": (d1_unique_edges, D1), "d2_recorded_pulses": (d2_recorded_pulses, None), "d3_fallback_pulses": (d3_fallback_pulses, None),
    "d4_pulse_table": (d4_pulse_table, None), "d5_coincidences": (d5_coincidences, None), "d6_candidate_lists": (d6_candidate_lists, D6), "d7_in_event_pairs": (d7_in_event_pairs, D7),
    "d8_earliest_pulse": (d8_earliest_pulse, D8), "d9_leads_before": (d9_leads_before, D9), "d10_overlap_support": (d10_overlap_support, D10), "d11_overlap_pairs": (d11_overlap_pairs, None),
    "d12_overlapping_candidates": (d12_overlapping_candidates, None), "d13_trigger_candidates": (d13_trigger_candidates, D13), "d14_calibration_samples": (d14_calibration_samples, D14),
    "d15_match_delays": (d15_match_delays, D15), "d16_matched_hits": (d16_matched_hits, D16), "d17_matches_wide": (d17_matches_wide, D17), "d17_matches_long": (d17_matches_long, D17B),
    "d18_matching_summary": (d18_matching_summary, D18), "c1_single_pulses": (c1_single_pulses, C1), "e2_clipped_delay": (e2_clipped_delay, None), "e10_edge_accounting": (e10_edge_accounting, E10),
}
