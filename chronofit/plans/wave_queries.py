"""Queries over sampled pulses, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofit.functions import extraction as X
from chronofit.functions import timing as T
from chronofit.functions import waveform as W
from chronofit.operators import fits, reports, search, selection, splits
from chronofit.operators import stats as E

from . import mappings as M

LEVELS = [50.0, 100.0, 150.0, 200.0]
FRACTIONS = [0.2, 0.5, 0.8]
STEP_PS, START_PS = 100.0, -1600.0
#: Cyclic shifts that the permutation test draws.
DRAWS = 200
_V = "WITH " + M.WAVES_SQL
#: Position of the first or last rising crossing of {lvl} in {y}, in samples.
_PAIRS = "list_filter(range(1, len({y})), lambda k: {y}[k] < {lvl} AND {y}[k + 1] >= {lvl})"
_PEAK = "list_position({y}, list_max({y}))"


def _sql_leading(y: str, lvl: str) -> str:
    k = f"list_filter(range(1, len({y}) + 1), lambda k: {y}[k] >= {lvl})[1]"
    return f"CASE WHEN {lvl} > 0 AND {k} > 1 THEN {k} - 2 + ({lvl} - {y}[{k} - 1]) / ({y}[{k}] - {y}[{k} - 1]) END"


def _sql_last(y: str, lvl: str) -> str:
    head = f"{y}[1:{_PEAK.format(y=y)}]"
    k = f"list_filter(range(1, len({head})), lambda k: {y}[k] < {lvl} AND {y}[k + 1] >= {lvl})[-1]"
    return f"{k} - 1 + ({lvl} - {y}[{k}]) / ({y}[{k} + 1] - {y}[{k}])"


def b2_millivolt(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("float") * F.lit(1000).cast("float")).cast("smallint")).alias("raw"))
    return e.select("vec_id", F.aggregate(T.millivolt(F.col("raw"), F.lit(0.25), F.lit(0.5)), F.lit(0.0), lambda s, x: s + x).alias("total_mv"), F.get(T.time_axis_ns(F.col("raw"), F.lit(1e-10), F.lit(-1.6e-9)), F.lit(20)).alias("t20_ns"))


B2 = "SELECT vec_id, list_sum(list_transform(embedding, lambda x: (floor(x::FLOAT * 1000)::DOUBLE * 0.25 - 0.5) * 1000)) AS total_mv, (20 * 1e-10 - 1.6e-9) * 1e9 AS t20_ns FROM embeddings"


def b3_basic_features(spark, sf):
    d = M.detectors(spark, sf)
    return d.select("vec_id", *(c.alias(k) for k, c in W.basic_features(F.col("mv"), 10, 150.0).items()))


B3 = f"""{_V}, b AS (SELECT vec_id, mv, list_avg(mv[1:10]) AS m FROM v)
SELECT vec_id, m AS baseline_mv, sqrt(list_avg(list_transform(mv[1:10], lambda x: (x - m) * (x - m)))) AS noise_mv, list_max(mv) AS amplitude_mv, list_position(mv, list_max(mv)) - 1 AS peak_index,
 coalesce(list_filter(range(0, len(mv)), lambda i: mv[i + 1] > 150)[1], -1) AS trigger_index FROM b"""


def b4_crop(spark, sf):
    c = W.crop(F.col("mv"), W.peak_index(F.col("mv")), 5, 8)
    return M.detectors(spark, sf).select("vec_id", F.size(c).alias("n"), F.get(c, F.lit(0)).alias("first_mv"), F.array_max(c).alias("peak_mv"))


B4 = f"""{_V}, p AS (SELECT vec_id, mv, {_PEAK.format(y='mv')} - 1 AS k FROM v), q AS (SELECT vec_id, mv[greatest(0, k - 6) + 1 : least(len(mv) - 1, k + 9) + 1] AS c FROM p)
SELECT vec_id, len(c) AS n, c[1] AS first_mv, list_max(c) AS peak_mv FROM q"""


def b5_led_grid(spark, sf):
    return M.detectors(spark, sf).select("vec_id", F.posexplode(W.led_grid(F.col("mv"), LEVELS)).alias("k", "at")).select("vec_id", "k", "at", W.femtoseconds(F.col("at"), 1e-10, -1.6e-9).alias("time_fs"))


B5 = " UNION ALL ".join(f"({_V} SELECT vec_id, {k} AS k, x AS at, CAST(round_even((-1.6e-9 + x * 1e-10) * 1e15, 0) AS BIGINT) AS time_fs FROM (SELECT vec_id, {_sql_leading('mv', str(t))} AS x FROM v))" for k, t in enumerate(LEVELS))


def b6_first_crossing(spark, sf):
    return M.detectors(spark, sf).select("vec_id", W.first_crossing(F.col("mv"), 80.0).alias("at"))


B6 = f"{_V}, k AS (SELECT vec_id, mv, {_PAIRS.format(y='mv', lvl='80')}[1] AS k FROM v) SELECT vec_id, k - 1 + (80 - mv[k]) / (mv[k + 1] - mv[k]) AS at FROM k"


def b7_cfd_grid(spark, sf):
    return M.detectors(spark, sf).select("vec_id", F.posexplode(W.cfd_grid(F.col("mv"), FRACTIONS)).alias("k", "at"))


B7 = " UNION ALL ".join(f"({_V} SELECT vec_id, {k} AS k, {_sql_last('mv', f'({f} * list_max(mv))')} AS at FROM v)" for k, f in enumerate(FRACTIONS))


def b8_timing_bundle(spark, sf):
    d = M.detectors(spark, sf).withColumn("c", W.crop(F.col("mv"), W.peak_index(F.col("mv")), 12, 12)).where("c is not null")
    return d.select("vec_id", F.array_max("c").alias("peak_mv"), W.leading_edge(F.col("c"), 100.0).alias("led"), W.last_crossing_before_peak(F.col("c"), 0.5 * F.array_max("c")).alias("cfd"))


B8 = f"""{_V}, p AS (SELECT vec_id, mv, {_PEAK.format(y='mv')} - 1 AS k FROM v), q AS (SELECT vec_id, mv[greatest(0, k - 13) + 1 : least(len(mv) - 1, k + 13) + 1] AS c FROM p WHERE len(mv) > 1)
SELECT vec_id, list_max(c) AS peak_mv, {_sql_leading('c', '100.0')} AS led, {_sql_last('c', '(0.5 * list_max(c))')} AS cfd FROM q"""


def b9_reference(spark, sf):
    d = M.detectors(spark, sf).select("vec_id", W.first_crossing(F.col("mv"), 90.0).alias("led"), W.last_crossing_before_peak(F.col("mv"), 0.3 * F.array_max("mv")).alias("cfd"), F.array_max("mv").alias("top"))
    return d.where("led is not null and cfd is not null and top > 0").select("vec_id", "led", "cfd")


B9 = f"{_V}, k AS (SELECT vec_id, mv, {_PAIRS.format(y='mv', lvl='90')}[1] AS k FROM v), r AS (SELECT vec_id, k - 1 + (90 - mv[k]) / (mv[k + 1] - mv[k]) AS led, {_sql_last('mv', '(0.3 * list_max(mv))')} AS cfd, list_max(mv) AS top FROM k) SELECT vec_id, led, cfd FROM r WHERE led IS NOT NULL AND cfd IS NOT NULL AND top > 0"


def b10_anchored_window(spark, sf):
    w = W.anchored_window(F.col("mv"), W.peak_index(F.col("mv")), 4, 6)
    return M.detectors(spark, sf).select("vec_id", F.aggregate(w, F.lit(0.0), lambda s, x: s + x).alias("total"), F.size(w).alias("n")).where("total is not null")


B10 = f"{_V}, p AS (SELECT vec_id, mv, {_PEAK.format(y='mv')} - 1 AS k FROM v) SELECT vec_id, list_sum(list_transform(mv[k - 3 : k + 7], lambda x: x::FLOAT::DOUBLE)) AS total, 11 AS n FROM p WHERE k >= 4 AND k + 7 <= len(mv)"


def b13_low_pass(spark, sf):
    return M.detectors(spark, sf).select("vec_id", W.low_pass(0.4, 4)("mv").alias("mv")).select("vec_id", F.size("mv").alias("n"), F.array_max("mv").alias("peak_mv"), W.mean(F.col("mv")).alias("mean_mv"))


def b15_realigned(spark, sf):
    s = W.realigned(F.col("mv"), (W.peak_index(F.col("mv")) - 32).cast("int"))
    return M.detectors(spark, sf).select("vec_id", F.get(s, F.lit(32)).alias("middle_mv"), F.size(F.filter(s, lambda x: x.isNull())).alias("n_outside"))


B15 = f"{_V}, p AS (SELECT vec_id, mv, {_PEAK.format(y='mv')} - 1 - 32 AS d FROM v) SELECT vec_id, mv[33 + d] AS middle_mv, len(list_filter(range(0, len(mv)), lambda i: i + d < 0 OR i + d >= len(mv))) AS n_outside FROM p"


def b16_relative_slice(spark, sf):
    y = F.slice("mv", 11, 21)
    return M.detectors(spark, sf).select("vec_id", W.mean(y).alias("mean_mv"), W.mean(W.subsample(y, 3)).alias("mean3_mv"))


B16 = f"{_V} SELECT vec_id, list_avg(mv[11:31]) AS mean_mv, list_avg(list_transform(range(0, 7), lambda i: mv[11 + 3 * i])) AS mean3_mv FROM v"


def b17_concatenated(spark, sf):
    both = F.concat(W.subsample(F.col("mv1"), 4), W.subsample(F.col("mv2"), 4))
    return M.pairs(spark, sf).select("event_index", F.size(both).alias("n"), W.mean(both).alias("mean_mv"))


B17 = f"{_V}, s AS (SELECT event_index, list_concat(list_transform(range(0, (len(mv1) + 3) // 4), lambda i: mv1[1 + 4 * i]), list_transform(range(0, (len(mv2) + 3) // 4), lambda i: mv2[1 + 4 * i])) AS b FROM pairs) SELECT event_index, len(b) AS n, list_avg(b) AS mean_mv FROM s"


def _times(spark, sf):
    p = M.pairs(spark, sf)
    fs = lambda c: W.femtoseconds(c, 1e-10, -1.6e-9)
    out = p.select("event_index", *(fs(W.first_crossing(F.col(f"mv{d}"), 80.0)).alias(f"led{d}") for d in (1, 2)), *(fs(W.last_crossing_before_peak(F.col(f"mv{d}"), 0.5 * F.array_max(f"mv{d}"))).alias(f"cfd{d}") for d in (1, 2)))
    return out


def _times_sql() -> str:
    fs = lambda x: f"CAST(round_even((-1.6e-9 + {x} * 1e-10) * 1e15, 0) AS BIGINT)"
    led = lambda d: f"(k{d} - 1 + (80 - mv{d}[k{d}]) / (mv{d}[k{d} + 1] - mv{d}[k{d}]))"
    cfd = lambda d: "(" + _sql_last(f"mv{d}", f"(0.5 * list_max(mv{d}))") + ")"
    return f"""{_V}, k AS (SELECT event_index, mv1, mv2, {_PAIRS.format(y='mv1', lvl='80')}[1] AS k1, {_PAIRS.format(y='mv2', lvl='80')}[1] AS k2 FROM pairs),
times AS (SELECT event_index, {fs(led(1))} AS led1, {fs(led(2))} AS led2, {fs(cfd(1))} AS cfd1, {fs(cfd(2))} AS cfd2 FROM k)"""


def b19_pair_deltas(spark, sf):
    return _times(spark, sf).select("event_index", T.delta_ps(F.col("led1"), F.col("led2")).alias("led_ps"), T.delta_ps(F.col("cfd1"), F.col("cfd2")).alias("cfd_ps"))


B19 = f"{_times_sql()} SELECT event_index, (led1 - led2) / 1000 AS led_ps, (cfd1 - cfd2) / 1000 AS cfd_ps FROM times"


def b20_factored_target(spark, sf):
    shift = T.anchor_shift_ps(F.col("led1"), F.col("cfd1"), F.col("led2"), F.col("cfd2"))
    return _times(spark, sf).select("event_index", shift.alias("shift_ps"), T.correction_target_ps(T.delta_ps(F.col("led1"), F.col("led2")), shift, F.lit(5.0)).alias("target_ps"))


B20 = f"{_times_sql()}, s AS (SELECT *, coalesce(((led1 - cfd1) - (led2 - cfd2)) / 1000, 0.0) AS shift_ps FROM times) SELECT event_index, shift_ps, (led1 - led2) / 1000 - shift_ps - 5 AS target_ps FROM s"


def b21_threshold_differences(spark, sf):
    d = W.threshold_differences(F.col("mv1"), F.col("mv2"), LEVELS[:3], STEP_PS)
    return M.pairs(spark, sf).select("event_index", F.posexplode(d).alias("k", "delta_ps"))


B21 = " UNION ALL ".join(f"({_V} SELECT event_index, {k} AS k, (({_sql_last('mv1', str(t))}) - ({_sql_last('mv2', str(t))})) * 100.0 AS delta_ps FROM pairs)" for k, t in enumerate(LEVELS[:3]))


def b22_pair_swap(spark, sf):
    swap = F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit("7|"), F.col("event_index").cast("string")), 256), 1, 4), 16, 10).cast("long"), F.lit(2)) == 1
    d = _times(spark, sf).withColumn("led_ps", T.delta_ps(F.col("led1"), F.col("led2")))
    return d.select("event_index", swap.alias("swapped"), F.when(swap, -F.col("led_ps")).otherwise(F.col("led_ps")).alias("led_ps"))


B22 = f"{_times_sql()}, s AS (SELECT *, ('0x' || sha256('7|' || event_index)[1:4])::BIGINT % 2 = 1 AS swapped FROM times) SELECT event_index, swapped, CASE WHEN swapped THEN -(led1 - led2) / 1000 ELSE (led1 - led2) / 1000 END AS led_ps FROM s"


def _shape(c):
    times = F.transform(F.col(c), lambda x, i: (i - 16) * 0.1)
    return W.shape_features(F.col(c), times, 16, 16)


def b23_shape_features(spark, sf):
    return M.detectors(spark, sf).select("vec_id", *(c.alias(k) for k, c in _shape("mv").items()))


B23 = f"""{_V}, t AS (SELECT vec_id, mv, list_transform(range(0, len(mv)), lambda i: (i - 16) * 0.1) AS t, list_avg(mv) AS m, list_min(mv) AS lo FROM v)
SELECT vec_id, list_max(mv) AS maximum, lo AS minimum, list_max(mv) - lo AS peak_to_peak, m AS average, sqrt(list_sum(list_transform(mv, lambda x: (x - m) * (x - m))) / (len(mv) - 1)) AS deviation,
 0.1 * (list_sum(mv) - (mv[1] + mv[-1]) / 2) AS area, 0.1 * (list_sum(list_transform(mv, lambda x: abs(x))) - (abs(mv[1]) + abs(mv[-1])) / 2) AS area_abs,
 t[list_position(mv, list_max(mv))] AS time_max, t[list_position(mv, lo)] AS time_min, list_dot_product(list_transform(mv, lambda x: x - lo), t) / list_sum(list_transform(mv, lambda x: x - lo)) AS centroid,
 list_dot_product(list_transform(mv, lambda x: x - m), list_transform(t, lambda x: x - list_avg(t))) / list_sum(list_transform(t, lambda x: (x - list_avg(t)) * (x - list_avg(t)))) AS slope,
 list_avg(mv[1:16]) AS early, list_avg(mv[-16:]) AS late, list_avg(mv[1:16]) - list_avg(mv[-16:]) AS early_late FROM t"""


def _asymmetries(spark, sf):
    p = M.pairs(spark, sf)
    a, b = _shape("mv1"), _shape("mv2")
    d = p.select("event_index", *(x.alias(f"a_{k}") for k, x in a.items()), *(x.alias(f"b_{k}") for k, x in b.items()))
    out = [(F.col(f"a_{k}") - F.col(f"b_{k}")).alias(f"delta_{k}") for k in a]
    out += [W.asymmetry(F.col(f"a_{k}"), F.col(f"b_{k}")).alias(f"asym_{k}") for k in a if k not in W.TIME_FEATURES]
    return d.select("event_index", *out)


def b24_asymmetric_features(spark, sf):
    return _asymmetries(spark, sf).select("event_index", "delta_maximum", "asym_maximum", "delta_time_max", "delta_average", "asym_area_abs")


B24 = f"""{_V}, s AS (SELECT event_index, list_max(mv1) AS a, list_max(mv2) AS b, (list_position(mv1, list_max(mv1)) - 17) * 0.1 AS ta, (list_position(mv2, list_max(mv2)) - 17) * 0.1 AS tb, list_avg(mv1) AS ma, list_avg(mv2) AS mb,
 0.1 * (list_sum(list_transform(mv1, lambda x: abs(x))) - (abs(mv1[1]) + abs(mv1[-1])) / 2) AS ra, 0.1 * (list_sum(list_transform(mv2, lambda x: abs(x))) - (abs(mv2[1]) + abs(mv2[-1])) / 2) AS rb FROM pairs)
SELECT event_index, a - b AS delta_maximum, (a - b) / (abs(a) + abs(b)) AS asym_maximum, ta - tb AS delta_time_max, ma - mb AS delta_average, (ra - rb) / (abs(ra) + abs(rb)) AS asym_area_abs FROM s"""


def b25_similarity(spark, sf):
    return M.pairs(spark, sf).select("event_index", W.cosine(F.col("mv1"), F.col("mv2")).alias("cosine"), W.cosine(W.centred(F.col("mv1")), W.centred(F.col("mv2"))).alias("pearson"))


B25 = f"{_V}, c AS (SELECT event_index, mv1, mv2, list_transform(mv1, lambda x: x - list_avg(mv1)) AS c1, list_transform(mv2, lambda x: x - list_avg(mv2)) AS c2 FROM pairs) SELECT event_index, list_cosine_similarity(mv1, mv2) AS cosine, list_cosine_similarity(c1, c2) AS pearson FROM c"


def b26_centred_components(spark, sf):
    d = _times(spark, sf).select("event_index", T.delta_ps(F.col("led1"), F.col("led2")).alias("led"), T.delta_ps(F.col("cfd1"), F.col("cfd2")).alias("final")).where("led is not null and final is not null")
    return d.select("event_index", *(c.alias(k) for k, c in T.centred(F.col("led"), F.col("final"), F.lit(3.0), F.lit(1.0)).items()))


B26 = f"{_times_sql()}, d AS (SELECT event_index, (led1 - led2) / 1000 AS led, (cfd1 - cfd2) / 1000 AS fin FROM times WHERE led1 IS NOT NULL AND led2 IS NOT NULL AND cfd1 IS NOT NULL AND cfd2 IS NOT NULL), c AS (SELECT event_index, led - 3 AS led_c, fin - led - 1 AS corr_c FROM d) SELECT event_index, led_c, corr_c, led_c + corr_c AS final_c, abs(led_c) - abs(led_c + corr_c) AS gain FROM c"


def e4_grid_scan(spark, sf):
    p = M.pairs(spark, sf)
    fs = lambda y: F.transform(W.led_grid(F.col(y), LEVELS[:3]), lambda x: F.rint(x * 1e5).cast("long"))
    d = p.select(F.lit("all").alias("run_id"), fs("mv1").alias("a"), fs("mv2").alias("b"))
    return fits.grid_scan(d, ["run_id"], "a", "b", most_ps=500.0, min_events=50).select("run_id", "parameter", "success", "n", "mean_ps", "ctr_ps", "efficiency")


def e5_threshold_metrics(spark, sf):
    return search.threshold_scan(M.pairs(spark, sf), [], "mv1", "mv2", LEVELS[:3], STEP_PS)


_SCAN = " UNION ALL ".join(f"SELECT {k} AS parameter, (({_sql_leading('mv1', str(t))}) - ({_sql_leading('mv2', str(t))})) * 100.0 AS v FROM pairs" for k, t in enumerate(LEVELS[:3]))
E5 = f"{_V}, s AS ({_SCAN}) SELECT parameter, count(v) AS n, avg(v) AS mean_ps, stddev_samp(v) AS std_ps, stddev_samp(v) * 2.3548200450309493 AS ctr_ps, sqrt(avg(v * v)) AS rmse_ps, var_pop(v) AS variance_ps2 FROM s GROUP BY 1"


def e15_error_populations(spark, sf):
    d = b19_pair_deltas(spark, sf).where("led_ps is not null").withColumn("k", F.lit(1))
    out = reports.error_populations(d, ["k"], "led_ps", {"low": (-1.0, 0.5), "middle": (0.0, 0.3), "high": (1.0, 0.5)})
    return out.groupBy("population").agg(F.count("*").alias("n"), F.avg("z").alias("mean_z"), F.avg("led_ps").alias("mean_ps"))


E15 = f"{_times_sql()}, d AS (SELECT (led1 - led2) / 1000 AS v FROM times WHERE led1 IS NOT NULL AND led2 IS NOT NULL), s AS (SELECT v, (v - avg(v) OVER ()) / stddev_samp(v) OVER () AS z FROM d), g AS (SELECT v, z, CASE WHEN abs(z + 1) <= 0.5 THEN 'low' WHEN abs(z) <= 0.3 THEN 'middle' WHEN abs(z - 1) <= 0.5 THEN 'high' END AS population FROM s) SELECT population, count(*) AS n, avg(z) AS mean_z, avg(v) AS mean_ps FROM g WHERE population IS NOT NULL GROUP BY 1"


def e15_mean_difference(spark, sf):
    return reports.mean_difference(M.pairs(spark, sf), [], "mv1", "mv2")


E15B = f"{_V}, e AS (SELECT unnest(range(0, len(mv1))) AS i, mv1, mv2 FROM pairs) SELECT i, count(mv1[i + 1] - mv2[i + 1]) AS n, avg(mv1[i + 1] - mv2[i + 1]) AS mean FROM e GROUP BY 1"


def e18_normalisation(spark, sf):
    return search.normalisation(M.pairs(spark, sf), ["mv1", "mv2"])


E18 = f"{_V}, e AS (SELECT unnest(range(0, len(mv))) AS i, mv FROM (SELECT mv1 AS mv FROM pairs UNION ALL SELECT mv2 FROM pairs)) SELECT i, avg(mv[i + 1]) AS mean, CASE WHEN stddev_pop(mv[i + 1]) > 1e-6 THEN stddev_pop(mv[i + 1]) ELSE 1.0 END AS std FROM e GROUP BY 1"


def e14_correlation_table(spark, sf):
    d = _asymmetries(spark, sf).join(b19_pair_deltas(spark, sf), "event_index").where("led_ps is not null").withColumn("run_id", F.lit("all"))
    return E.correlation_table(d, ["run_id"], ["delta_maximum", "asym_area_abs", "delta_time_max", "delta_average"], "led_ps").select("feature", "n", "pearson", "spearman", "slope", "intercept", "r2", "pearson_p", "pearson_q")


def d21_shift_test(spark, sf):
    d = M.pairs(spark, sf)
    n = d.count()
    return reports.shift_test(d, "event_index", "mv1", "mv2", n, reports.drawn_shifts(n, DRAWS, 17))


def d21_permutation_p(spark, sf):
    return reports.permutation_p(d21_shift_test(spark, sf))


_SHIFTS = f"s AS (SELECT 0 AS shift UNION ALL SELECT shift FROM (SELECT shift, min(k) AS k FROM (SELECT k, 1 + ('0x' || substr(sha256('17|' || k), 1, 8))::BIGINT % (SELECT count(*) - 1 FROM pairs) AS shift FROM (SELECT unnest(range(100000)) AS k)) GROUP BY 1 ORDER BY k LIMIT {DRAWS}))"
D21 = f"{_V}, {_SHIFTS} SELECT shift, count(*) AS n, avg(list_cosine_similarity(a.mv1, b.mv2)) AS similarity FROM pairs a, s JOIN pairs b ON b.event_index = (a.event_index + shift) % (SELECT count(*) FROM pairs) GROUP BY 1"


D21B = f"WITH t AS ({D21}), m AS (SELECT similarity AS matched FROM t WHERE shift = 0) SELECT any_value(matched) AS matched, avg(similarity) AS null_mean, any_value(matched) - avg(similarity) AS gain, (1 + count(*) FILTER (WHERE similarity >= matched)) / (1 + count(*)) AS p FROM t, m WHERE shift <> 0"


def d21_similarity_distribution(spark, sf):
    d = M.pairs(spark, sf)
    return reports.similarity_distribution(d, "event_index", "mv1", "mv2", d.count(), 20, 17)


_NUMBER = "('0x' || substr(md5(concat_ws('|', '17', {})), 1, 7))::BIGINT"
D21C = _V.replace("WITH ", "WITH RECURSIVE ", 1) + f""", n AS (SELECT count(*) AS n FROM pairs),
w AS (SELECT unnest(range(1, 21)) AS draw, event_index AS i, event_index::BIGINT AS x, 0 AS t FROM pairs
  UNION ALL SELECT draw, i, CASE WHEN {_NUMBER.format("draw, r, greatest(x, mirror)")} % 2 = 0 THEN mirror ELSE x END, t + 1
  FROM (SELECT *, (({_NUMBER.format("draw, r")} - x) % n + n) % n AS mirror FROM (SELECT draw, i, t, n, CASE WHEN t < 16 THEN t ELSE 31 - t END AS r, CASE WHEN t = 16 THEN (x + 1) % n ELSE x END AS x FROM w, n WHERE t < 32))),
c AS (SELECT draw, i, x AS j FROM w WHERE t = 32 UNION ALL SELECT 0, event_index, event_index FROM pairs),
s AS (SELECT CASE WHEN draw = 0 THEN 'matched' ELSE 'random' END AS kind, list_cosine_similarity(a.mv1, b.mv2) AS v FROM c JOIN pairs a ON a.event_index = c.i JOIN pairs b ON b.event_index = c.j)
SELECT kind, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, median(v) AS median, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.99) AS p99 FROM s GROUP BY 1"""


def f2_representative(spark, sf):
    d = M.pairs(spark, sf).select(F.lit("all").alias("run_id"), "event_index", ((F.array_max("mv1") + F.array_max("mv2")) / 2).alias("amplitude_mv"))
    return reports.representative(d, ["run_id"], "amplitude_mv", "event_index")


F2 = f"{_V}, a AS (SELECT event_index, (list_max(mv1) + list_max(mv2)) / 2 AS amplitude_mv FROM pairs) SELECT 'all' AS run_id, event_index, amplitude_mv FROM a ORDER BY abs(amplitude_mv - (SELECT median(amplitude_mv) FROM a)), event_index LIMIT 1"


def f3_regional_importance(spark, sf):
    p = reports.mean_difference(M.pairs(spark, sf), [], "mv1", "mv2").select(F.lit("all").alias("run_id"), ((F.col("i") - 16) * 0.1).alias("t"), F.col("mean").alias("v"))
    return reports.regional_importance(p, ["run_id"], "t", "v", -1.63, 4.77, 0.4)


F3 = E15B.replace("SELECT i, count", ", p AS (SELECT i, count").replace("FROM e GROUP BY 1", "FROM e GROUP BY 1), q AS (SELECT (i - 16) * 0.1 AS t, abs(mean) / (SELECT max(abs(mean)) FROM p) AS v FROM p) SELECT 'all' AS run_id, least(floor((t + 1.63) / 0.4), 15)::INTEGER AS bin, avg(v) AS importance FROM q WHERE t BETWEEN -1.63 AND 4.77 GROUP BY 2")


def h3_adaptive_threshold(spark, sf):
    """All events, each trace after a sample of 0, so that it rises through every threshold under its maximum."""
    d = M.pairs(spark, sf).select("event_index", *(F.concat(F.array(F.lit(0.0)), c).alias(c) for c in ("mv1", "mv2")))
    return search.adaptive_threshold(d, "mv1", "mv2", "event_index", 3, 20.0, 150.0, STEP_PS)[1]


def h6_pair_regression(spark, sf):
    d = M.pairs(spark, sf).join(b19_pair_deltas(spark, sf), "event_index").where("led_ps is not null")
    x = W.subsample(search.antisymmetric(F.col("mv1"), F.col("mv2")), 8)
    return search.insensitive_fit(d.select(x.alias("x"), "led_ps"), [], "x", "led_ps", 0.01, 20.0).select(F.size("weights").alias("p"), "objective", "n")


def h10_attribution(spark, sf):
    w = F.transform(F.col("mv1"), lambda x, i: (i % 5 - 2).cast("double"))
    return search.attribution(M.pairs(spark, sf).withColumn("w", w), [], ["mv1", "mv2"], "w")


H10 = f"{_V}, e AS (SELECT unnest(range(0, len(mv))) AS i, mv FROM (SELECT mv1 AS mv FROM pairs UNION ALL SELECT mv2 FROM pairs)), m AS (SELECT i, avg(abs(mv[i + 1] * (i % 5 - 2))) AS m FROM e GROUP BY 1) SELECT i, m / (SELECT max(m) FROM m) AS importance FROM m"


def c5_photopeak(spark, sf):
    d = M.detectors(spark, sf).select(F.concat(F.lit("d"), F.col("detector").cast("string")).alias("channel"), F.array_max("mv").alias("amplitude_mv"))
    return fits.photopeak(d, ["channel"], "amplitude_mv", bin_mv=10.0, quantile=0.2, half_width=60.0)


def c6_cut_flow(spark, sf):
    f = W.basic_features(F.col("mv"), 10, 150.0)
    d = M.detectors(spark, sf).select("detector", *(c.alias(k) for k, c in f.items()))
    return selection.cut_flow(d, ["detector"], {"amplitude": F.col("amplitude_mv") > 250, "trigger": F.col("trigger_index").between(1, 50), "noise": F.col("noise_mv") < 130})


C6 = f"WITH f AS ({B3}) SELECT vec_id % 2 + 1 AS detector, count(*) AS total, count(*) FILTER (WHERE amplitude_mv > 250) AS amplitude, count(*) FILTER (WHERE amplitude_mv > 250 AND trigger_index BETWEEN 1 AND 50) AS trigger, count(*) FILTER (WHERE amplitude_mv > 250 AND trigger_index BETWEEN 1 AND 50 AND noise_mv < 130) AS noise, count(*) FILTER (WHERE amplitude_mv > 250 AND trigger_index BETWEEN 1 AND 50 AND noise_mv < 130) AS selected, count(*) FILTER (WHERE NOT (amplitude_mv > 250 AND trigger_index BETWEEN 1 AND 50 AND noise_mv < 130)) AS rejected FROM f GROUP BY 1"


def c8_mismatch_filter(spark, sf):
    d = b19_pair_deltas(spark, sf).where("led_ps is not null and cfd_ps is not null").withColumn("file_id", F.lit(0))
    return selection.mismatch_filter(d, ["file_id"], ["led_ps", "cfd_ps"], 2.0).drop("file_id")


C8 = f"""{_times_sql()}, d AS (SELECT event_index, (led1 - led2) / 1000 AS led_ps, (cfd1 - cfd2) / 1000 AS cfd_ps FROM times WHERE led1 - led2 IS NOT NULL AND cfd1 - cfd2 IS NOT NULL),
a AS (SELECT median(led_ps) AS c FROM d), b AS (SELECT c, 1.4826 * median(abs(led_ps - c)) AS s FROM d, a GROUP BY c), e AS (SELECT d.* FROM d, b WHERE abs(led_ps - c) <= 2 * s),
f AS (SELECT median(cfd_ps) AS c FROM e), g AS (SELECT c, 1.4826 * median(abs(cfd_ps - c)) AS s FROM e, f GROUP BY c) SELECT e.* FROM e, g WHERE abs(cfd_ps - c) <= 2 * s"""

SETTINGS = X.ChannelSettings(1e-10, -1.6e-9, 10, 80.0, 1, 80.0, 0.5, 20, 40, 3, 5)


def b11_channel_extraction(spark, sf):
    c = X.channel(F.col("mv"), SETTINGS)
    return M.detectors(spark, sf).select("vec_id", c.alias("c")).select("vec_id", "c.valid", "c.amplitude_mv", "c.led_fs", "c.cfd_fs", "c.anchor_fs", F.size("c.window").alias("n"))


def _events(spark, sf):
    return X.event(M.pairs(spark, sf), ("mv1", "mv2"), SETTINGS, ("mv2", "mv1"), SETTINGS)


def b12_event_extraction(spark, sf):
    return _events(spark, sf).select("event_index", "led1_fs", "led2_fs", "cfd1_fs", "cfd2_fs", "valid")


def b14_same_edge_times(spark, sf):
    y = F.col("mv")
    t = X.same_edge_times(y, [60.0, 80.0, 100.0], W.first_crossing(y, 80.0), 80.0)
    return M.detectors(spark, sf).where(W.first_crossing(y, 80.0).isNotNull()).select("vec_id", F.posexplode(t).alias("k", "at"))


def b18_mode_view(spark, sf):
    return X.mode_view(_events(spark, sf), "e2t").select("event_index", "mode", "led1_fs", "led2_fs", F.size("window1").alias("n1"), F.size("window2").alias("n2"))


def h4_apply_selection(spark, sf):
    v = X.mode_view(_events(spark, sf), "energy")
    out = X.apply_selection(v, (F.col("led1_fs") + 150_000, F.col("led2_fs") - 150_000), 1e5)
    return out.select("event_index", "led1_fs", "anchor1_fs", "anchor2_fs", F.size(F.filter("window1", lambda x: x.isNull())).alias("outside1"))


def h5_threshold_study(spark, sf):
    d = M.pairs(spark, sf).select((F.col("event_index") % 2).alias("file_id"), "event_index", W.led_grid(F.col("mv1"), LEVELS[:3]).alias("a"), W.led_grid(F.col("mv2"), LEVELS[:3]).alias("b"))
    return search.threshold_study(d, ["file_id"], "event_index", "a", "b", 0.3, 0.3, 17, STEP_PS)


def h8_refit_evaluation(spark, sf):
    d = M.pairs(spark, sf).join(b19_pair_deltas(spark, sf), "event_index").where("led_ps is not null")
    d = splits.holdout(d.withColumn("file_id", F.lit(0)), ["file_id"], "event_index", 0.2, 17)
    d = splits.folds(d.where("split = 'development'"), ["file_id"], "event_index", 5, 17).unionByName(d.where("split = 'blind'").withColumn("fold", F.lit(None).cast("int")))
    x = W.subsample(search.antisymmetric(F.col("mv1"), F.col("mv2")), 8)
    d = d.select("event_index", "fold", (F.col("split") == "development").alias("dev"), x.alias("x"), "led_ps")
    out = search.final_evaluation(d, "x", "led_ps", "fold", 5, F.col("dev"), 0.01, [5.0, 20.0, 80.0])
    both = out.select("split", F.lit("led").alias("model"), F.col("led_ps").alias("r"), "epsilon").unionByName(out.select("split", F.lit("corrected").alias("model"), F.col("residual").alias("r"), "epsilon"))
    return E.residual_metrics(both, ["split", "model", "epsilon"], "r")


def h7_threshold_regression(spark, sf):
    x = W.threshold_differences(F.col("mv1"), F.col("mv2"), LEVELS[:3], STEP_PS)
    d = M.pairs(spark, sf).select("event_index", x.alias("x")).join(b19_pair_deltas(spark, sf).where("led_ps is not null"), "event_index")
    out = search.threshold_regression(d.withColumn("k", F.lit(1)), ["k"], "x", "led_ps", F.col("event_index") % 5 > 0, 1.0, 10.0)
    return E.residual_metrics(out.withColumn("split", F.when(F.col("event_index") % 5 > 0, "train").otherwise("test")), ["split"], "residual")


_N = "b2_millivolt:B2 b3_basic_features:B3 b4_crop:B4 b5_led_grid:B5 b6_first_crossing:B6 b7_cfd_grid:B7 b8_timing_bundle:B8 b9_reference:B9 b10_anchored_window:B10 b13_low_pass: b15_realigned:B15 b16_relative_slice:B16 b17_concatenated:B17 b19_pair_deltas:B19 b20_factored_target:B20 b21_threshold_differences:B21 b22_pair_swap:B22 b23_shape_features:B23 b24_asymmetric_features:B24 b25_similarity:B25 b26_centred_components:B26 e4_grid_scan: e5_threshold_metrics:E5 e14_correlation_table: e15_error_populations:E15 e15_mean_difference:E15B e18_normalisation:E18 d21_shift_test:D21 d21_permutation_p:D21B d21_similarity_distribution:D21C f2_representative:F2 f3_regional_importance:F3 h3_adaptive_threshold: h6_pair_regression: h10_attribution:H10 b11_channel_extraction: b12_event_extraction: b14_same_edge_times: b18_mode_view: h4_apply_selection: h5_threshold_study: h7_threshold_regression: h8_refit_evaluation: c5_photopeak: c6_cut_flow:C6 c8_mismatch_filter:C8"
QUERIES = {n: (globals()[n], globals()[s] if s else None) for n, s in (x.split(":") for x in _N.split())}
