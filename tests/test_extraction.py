"""Channel and event extraction against hand-made pulses: edges of the trace, missing crossings, alignment, level times."""

import math

import numpy as np
import pytest
from conftest import same
from pyspark.sql import functions as F

from chronofit.functions import extraction as X
from chronofit.functions import waveform as W
from chronofit.operators import search

S = X.ChannelSettings(step_s=1e-10, start_s=0.0, baseline=5, trigger_mv=20.0, led_mv=30.0, cfd_fraction=0.5, crop_before=10, crop_after=20, window_before=3, window_after=6)


def pulse(center, height=100.0, n=80, width=4.0):
    return [height * math.exp(-0.5 * ((i - center) / width) ** 2) for i in range(n)]


def frame(spark, *traces):
    return spark.createDataFrame([(i, t) for i, t in enumerate(traces)], "event_index int, y array<double>")


def fields(df, *names):
    return [tuple(r) for r in df.orderBy("event_index").select(*names).collect()]


def test_channel_reads_closed_form_times(spark):
    d = frame(spark, pulse(40), pulse(2), [0.0] * 80, None, [], pulse(40, 25.0), [float("nan")] + pulse(9)[1:], pulse(82))
    c = d.select("event_index", X.channel(F.col("y"), S).alias("c"))
    valid = [r[0] for r in fields(c, "c.valid")]
    assert valid == [True, False, False, False, False, False, False, False]
    led, cfd, peak, trigger = fields(c, "c.led_fs", "c.cfd_fs", "c.peak_index", "c.trigger_index")[0]
    assert led == pytest.approx((40 - 4 * math.sqrt(-2 * math.log(0.3))) * 1e5, abs=4e3)
    assert cfd == pytest.approx((40 - 4 * math.sqrt(-2 * math.log(0.5))) * 1e5, abs=4e3)
    assert peak == 40 and trigger == 33
    window, anchor = fields(c, "c.window", "c.anchor_fs")[0]
    assert len(window) == 10 and anchor == round(led / 1e5) * 100_000
    assert np.allclose(window, np.array(pulse(40))[anchor // 100_000 - 3 : anchor // 100_000 + 7], rtol=1e-6)
    assert fields(c, "c.window")[2][0] is None and fields(c, "c.amplitude_mv")[4][0] is None


def test_event_view_and_shift(spark):
    d = spark.createDataFrame([(0, pulse(40), pulse(42), pulse(38), pulse(39)), (1, pulse(40), pulse(42), [0.0] * 80, pulse(39))], "event_index int, e1 array<double>, e2 array<double>, t1 array<double>, t2 array<double>")
    e = X.event(d, ("e1", "e2"), S, ("t1", "t2"), S)
    assert [r[0] for r in fields(e, "valid")] == [True, False]
    own = X.event(d, ("e1", "e2"), S)
    assert [r[0] for r in fields(own, "valid")] == [True, True]
    v = X.mode_view(e, "e2t")
    led1, led2, a1 = fields(v, "led1_fs", "led2_fs", "anchor1_fs")[0]
    assert led2 - led1 == pytest.approx(1e5, abs=2e3)
    assert fields(v, "window1")[0][0][3] == pytest.approx(pulse(40)[a1 // 100_000], rel=1e-5)
    moved = X.apply_selection(v, (F.col("led1_fs") + 200_000, F.col("led2_fs")), 1e5)
    assert fields(moved, "anchor1_fs")[0][0] == a1 + 200_000 and fields(moved, "window1")[0][0][:8] == fields(v, "window1")[0][0][2:]
    assert X.shift_support(v, (F.col("led1_fs") + 200_000, F.col("led2_fs")), 1e5, (1, 1)).first().ok is False
    with pytest.raises(ValueError, match="no timing"):
        X.mode_view(own, "timing")
    with pytest.raises(ValueError, match="unknown"):
        X.mode_view(own, "sideways")


def test_same_edge_times(spark):
    y = [0.0, 5.0, 1.0, 4.0, 8.0, 10.0, 3.0, 9.0]
    d = frame(spark, y).select("event_index", X.same_edge_times(F.col("y"), [2.0, 6.0, 9.0], F.lit(3.5), 6.0).alias("t"))
    assert fields(d, "t")[0][0] == [pytest.approx(2 + 1 / 3), 3.5, 4.5]


def test_threshold_regression_and_study(spark):
    g = np.random.default_rng(3)
    x = g.normal(50, 20, size=(200, 3))
    y = x @ [0.5, -1.0, 0.2] + 7
    rows = [("k", i, [*map(float, a)] if i else [None, 1.0, 2.0], float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    d = spark.createDataFrame(rows, "k string, i int, x array<double>, y double")
    out = search.threshold_regression(d, ["k"], "x", "y", F.col("i") % 4 > 0, 100.0, 0.1, 12)
    assert out.count() == 199 and out.agg(F.max(F.abs("residual"))).first()[0] < 1.0
    t = spark.createDataFrame([("f", i, [0.0, 0.0], [float(g.normal(0, 9)), float(g.normal(0, 1))]) for i in range(120)], "f string, i int, a array<double>, b array<double>")
    r = search.threshold_study(t, ["f"], "i", "a", "b", 0.3, 0.3, 1, 1.0).first()
    assert r.parameter == 1 and r.oracle_parameter == 1 and 1 < r.blind_ctr_ps < 4


def test_millivolt_query_scales_in_single_precision(spark, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from chronofit.plans import wave_queries as V

    # in double precision, some of these products fall just under a whole number that single precision rounds them to
    x = (np.arange(-3000, 3000) / 1000).astype(np.float32).reshape(-1, 50)
    pq.write_table(pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    same(V.b2_millivolt(spark, str(tmp_path)), c.execute(V.B2).fetchdf())


def test_a_trace_is_prepared_once_for_its_crossings(spark):
    d = spark.createDataFrame([([0.0, 2.0, 1.0, 4.0, 3.0],), ([1.0],), (None,), ([2.0, 2.0, 5.0],)], "y array<double>")
    at = W.last_crossing_before_peak(F.col("y"), 0.5 * F.array_max("y"))
    q = d.select(at.alias("at"), W.led_grid(F.col("y"), [1.0, 3.0]).alias("led"))
    assert [tuple(r) for r in q.collect()] == [(2 + 1 / 3, [0.5, 2 + 2 / 3]), (None, [None, None]), (None, [None, None]), (1 + 0.5 / 3, [None, 1 + 1 / 3])]
    # the peak was looked for anew at every sample, and for every mention of the cut trace
    assert d.select(at.alias("at"))._jdf.queryExecution().analyzed().toString().count("array_position(") == 1
