"""Raw files written by hand: headers, records, sidecars, traces, tables, and the errors that bad ones give."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofit.functions import timing as T
from chronofit.functions import waveform as W
from chronofit.sources import files, runs, tables, traces


def run_file(mode=0x32, measurement=0x03, run=4512, events=((7, [(0, 1, 1, 100, 0), (0, 1, 0, 130, 30)]), (8, [])), minor=2):
    out = bytes([3, minor, 0, 0, 0]) + struct.pack("<HHHBBfffQ", 1, run, mode, measurement, 0, 3.125, 3.125, 12.5, 0)
    for stamp, hits in events:
        stream = mode == 0x22
        body = b"".join(struct.pack("<BBB" + ("Q" if stream else "I") + "H", *h) for h in hits)
        head = struct.pack("<QH", stamp, len(hits)) if stream else struct.pack("<QQH", stamp, stamp + 1, len(hits))
        out += struct.pack("<H", 2 + len(head) + len(body)) + head + body
    return out


def trace_file(n=8002, shift=0.0, count=None, interval=2.5e-12):
    out = bytearray(357 + 2 * n)
    struct.pack_into("<i", out, 127, n if count is None else count)
    struct.pack_into("<ff", out, 167, 0.00025, 0.0)
    struct.pack_into("<fd", out, 187, interval, -10e-9)
    i = np.arange(n)
    out[357:] = np.rint(1200 * np.exp(-0.5 * ((i - 2500 - shift) / 40) ** 2)).astype("<i2").tobytes()
    return bytes(out)


def put(folder, name, content):
    p = folder / name
    p.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(p)


def test_hits(spark, tmp_path):
    a, b = put(tmp_path, "Run4512.dat", run_file()), put(tmp_path, "Run4513.dat", run_file(mode=0x22, run=4513))
    got = runs.read_hits(spark, [a, b]).orderBy("run_id", "seq").collect()
    assert [(r.run_id, r.event_index, r.timestamp_lsb, r.trigger_id, r.edge, r.toa_lsb, r.tot_lsb) for r in got] == [
        ("Run4512", 0, 7, 8, 1, 100, 0), ("Run4512", 0, 7, 8, 0, 130, 30), ("Run4513", 0, 7, 0, 1, 100, 0), ("Run4513", 0, 7, 0, 0, 130, 30),
    ]
    h = runs.read_run_headers(spark, [a]).first()
    assert (h.run_id, h.acquisition_mode, h.toa_lsb_ps) == ("Run4512", "TRG_MATCHING", 3.125)


@pytest.mark.parametrize("bad", [run_file()[:-1], run_file()[:20], run_file(minor=1), run_file(mode=0x33), run_file(measurement=0x02), run_file() + b"\x05\x00"])
def test_bad_run_files_fail(spark, tmp_path, bad):
    with pytest.raises(Exception):
        runs.read_hits(spark, put(tmp_path, "Run1.dat", bad)).collect()


def test_discovery_and_info(spark, tmp_path):
    put(tmp_path, "Run4512.dat", b"x")
    info = put(tmp_path, "Run4512_Info.txt", "DiscrThreshold 5\nDiscrThreshold 6.5\nDiscrThreshold[0][1] 20\nDiscrThreshold[1][3] 99\nDiscrThreshold[0][5] 20\nacquisitionmode trigger_matching\n")
    r = runs.discover_runs(spark, str(tmp_path)).first()
    assert (r.run_id, r.voltage) == ("Run4512", 45) and r.info_path.endswith("Run4512_Info.txt")
    i = runs.run_info(spark, info).first()
    assert (i.acquisition_mode, i.energy_threshold_mv, i.timing_threshold_mv, i.consistent) == ("TRG_MATCHING", 20.0, 6.5, True)
    odd = put(tmp_path, "odd_Info.txt", "DiscrThreshold 5\nDiscrThreshold[0][1] 7\nAcquisitionMode STREAMING\n")
    assert not runs.run_info(spark, odd, strict=False).first().consistent
    with pytest.raises(Exception, match="inconsistent"):
        runs.run_info(spark, odd).collect()
    with pytest.raises(Exception, match="no default"):
        runs.run_info(spark, put(tmp_path, "x_Info.txt", "AcquisitionMode STREAMING\n")).collect()
    put(tmp_path, "Run4600.dat", b"x")
    with pytest.raises(Exception, match="info file"):
        runs.discover_runs(spark, str(tmp_path)).collect()


def test_traces_and_events(spark, tmp_path):
    for c in (1, 2, 3, 4):
        for k in (3, 5, 9):
            put(tmp_path, f"C{c}_wave{k:05d}.trc", trace_file(400 if k == 5 and c == 2 else 8002, 20 * c, count=8002))
    put(tmp_path, "C7_wave00001.trc", b"x")
    put(tmp_path, "notes.txt", "x")
    files = traces.trace_files(spark, str(tmp_path))
    assert files.count() == 12
    events, pairing = traces.pair_events(files)
    assert pairing == "id" and events.count() == 3
    t = traces.read_traces(spark, str(tmp_path))
    assert t.where("error is not null").count() == 1
    e = traces.assemble(events, t)
    assert [(r.event_index, r.event_id) for r in e.orderBy("event_index").collect()] == [(0, 3), (1, 9)]
    s = traces.conversion_summary(files, events, e, pairing, "run").first()
    assert (s.files1, s.paired, s.written, s.invalid) == (3, 3, 2, 1)
    assert [r.event_id for r in traces.assemble(events, t, 1, 2).collect()] == [9]
    mv = e.select("event_index", T.millivolt(F.col("ch1.samples"), F.col("ch1.gain").cast("double"), F.col("ch1.offset").cast("double")).alias("mv"))
    at = mv.select(W.first_crossing(F.col("mv"), 150.0)).first()[0]
    assert at == pytest.approx(2520 - 40 * np.sqrt(2 * np.log(2)), abs=0.6)


def test_rank_pairing(spark):
    rows = [(f"/d/C{c}_{k}.trc",) for c in (1, 2, 3, 4) for k in ((1, 2, 3) if c < 4 else (7, 8))]
    files = traces.file_names(spark.createDataFrame(rows, "path string"))
    events, pairing = traces.pair_events(files)
    assert pairing == "rank" and [(r.event_id) for r in events.orderBy("order").collect()] == [0, 1]
    twice = traces.file_names(spark.createDataFrame([*rows, ("/e/C1_1.trc",)], "path string"))
    with pytest.raises(Exception, match="twice"):
        traces.pair_by_id(twice).collect()
    with pytest.raises(ValueError):
        traces.pair_events(files.where("channel < 4"))


def test_tables(spark, tmp_path):
    d = spark.createDataFrame([(1, float("nan")), (2, 3.0), (3, float("inf"))], "k int, v double")
    tables.write_table(d, ["k", "v"], str(tmp_path / "t"))
    assert [r.v for r in spark.read.parquet(str(tmp_path / "t")).orderBy("k").collect()] == [None, 3.0, None]
    with pytest.raises(ValueError, match="extra w"):
        tables.checked_union([d, d.withColumn("w", F.lit(1))])
    got = tables.scan_events(spark, str(tmp_path / "t"), ["k"], {"bias": None, "v": 0.0}, 2)
    assert got.columns == ["k", "bias", "v"] and got.count() == 2
    with pytest.raises(ValueError, match="missing columns: z"):
        tables.scan_events(spark, str(tmp_path / "t"), ["z"])
    m = tables.prepared(d.withColumn("file_id", F.col("k") % 2), d.where("k < 3"), ["k"], str(tmp_path / "p")).orderBy("file_id").collect()
    assert [(r.file_id, r.n) for r in m] == [(0, 1), (1, 1)]


def many_hits(spark, g, runs_=(7, 8, 9), events=300):
    rows = []
    for run in runs_:
        seq = 0
        for event in range(events):
            for _ in range(g.integers(0, 6) if event else 3):
                rows.append((run, event, 1000 + event, 2000 + event, int(g.integers(0, 4)), int(g.integers(0, 64)), int(g.integers(0, 2)), int(g.integers(0, 1 << 30)), int(g.integers(0, 1 << 15)), seq))
                seq += 1
    return rows, spark.createDataFrame(rows, "run_number int, event long, timestamp_lsb long, trigger_id long, board int, channel int, edge int, toa_lsb long, tot_lsb long, seq long").repartition(4)


@pytest.mark.parametrize("mode", ["STREAMING", "TRG_MATCHING"])
def test_hits_in_parts_are_those_of_the_whole_file(spark, tmp_path, mode):
    rows, df = many_hits(spark, np.random.default_rng(1))
    runs.write_hits(df, str(tmp_path / "out"), mode)
    order = {}
    for r in rows:  # events without hits have no record here
        order.setdefault((r[0], r[1]), len([k for k in order if k[0] == r[0]]))
    want = sorted((f"Run{r[0]}", order[r[:2]], r[9], r[2], r[3] if mode == "TRG_MATCHING" else 0, *r[4:9]) for r in rows)
    for split in (100, 1000, 1 << 27):
        got = runs.read_hits(spark, str(tmp_path / "out"), split=split)
        assert sorted(map(tuple, got.collect())) == want
        some = got.where("run_id = 'Run8' and board in (1, 3)")
        assert sorted(map(tuple, some.collect())) == [x for x in want if x[0] == "Run8" and x[5] in (1, 3)]
    with pytest.raises(Exception, match="doesn't fit"):
        runs.write_hits(spark.range(8000).selectExpr("3 run_number", "1L event", "1L timestamp_lsb", "1L trigger_id", "0 board", "1 channel", "1 edge", "id toa_lsb", "1L tot_lsb", "id seq"), str(tmp_path / "no"), mode)


def test_bad_parts_and_error_rows(spark, tmp_path):
    _, df = many_hits(spark, np.random.default_rng(2), (5, 6), 200)
    runs.write_hits(df, str(tmp_path))
    good = (tmp_path / "Run5.dat").read_bytes()
    for name, content in (("cut", good[:-3]), ("hole", good[:900] + b"\xff" * 400 + good[1300:])):
        put(tmp_path, "Run5.dat", content)
        for split in (500, 1 << 27):
            with pytest.raises(Exception):
                runs.read_hits(spark, str(tmp_path), split=split).collect()
            got = runs.read_hits(spark, str(tmp_path), split=split, errors="row")
            bad = got.where("error is not null").collect()
            assert bad and all(r.path.endswith("Run5.dat") and r.run_id is None for r in bad), name
            assert got.where("run_id = 'Run6'").count() == df.where("run_number = 6").count()


def test_hits_after_a_gap_are_left_out_of_error_rows(spark, tmp_path):
    _, df = many_hits(spark, np.random.default_rng(2), (5,), 200)
    runs.write_hits(df, str(tmp_path))
    want = {(r.event_index, r.seq): r.toa_lsb for r in runs.read_hits(spark, str(tmp_path)).collect()}
    good = (tmp_path / "Run5.dat").read_bytes()
    put(tmp_path, "Run5.dat", good[:900] + b"\xff" * 400 + good[1300:])
    got = runs.read_hits(spark, str(tmp_path), split=500, errors="row").collect()
    hits = [r for r in got if r.error is None]
    # the last record before the gap may reach into it
    assert len(hits) < len(got) and 0 < len(hits) < len(want) / 2
    assert all(want[r.event_index, r.seq] == r.toa_lsb for r in hits if r.seq < len(hits) - 20)


def test_a_file_over_two_gigabytes_is_planned_in_parts(tmp_path):
    path = tmp_path / "Run1.dat"
    with open(path, "wb") as f:
        f.write(run_file())
        f.truncate(3 << 30)  # a sparse file
    reader = runs._HitReader({"paths": f'["{path}"]'})
    parts = reader.partitions()
    assert len(parts) == 24 and parts[0].start == 0 and parts[-1].end == 3 << 30 and all(a.end == b.start for a, b in zip(parts, parts[1:], strict=False))


def test_the_first_record_is_found_from_any_byte(spark, tmp_path):
    _, df = many_hits(spark, np.random.default_rng(3), (4,), 150)
    runs.write_hits(df, str(tmp_path))
    content = (tmp_path / "Run4.dat").read_bytes()
    head, hit = runs.layouts(runs.read_header(content))
    import io

    window = lambda: files.Window(io.BytesIO(content), len(content), 4096)
    starts = [runs.HEADER_BYTES] + [end for end, *_ in runs.walk(window(), runs.HEADER_BYTES, len(content), head, hit)]
    data = window()
    for at in range(runs.HEADER_BYTES, len(content), 7):
        assert runs.first_record(data, at, head, hit) == next(s for s in starts if s >= at)
