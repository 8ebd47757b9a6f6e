"""Queries that write raw files from the given tables to the shared folder, find them, and read them back, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofit.operators.lineage import shared_folder
from chronofit.sources import runs, tables, traces

from . import mappings as M

#: Runs in these files: 4000, a hundred for each board, and the week; an event is an hour of a run.
_RUN, _HOUR, _WEEK = 4000, 3600, 604800


def _written(spark, sf) -> str:
    """The folder with a raw file for each run of the hits and, beside it, its text sidecar."""
    folder = shared_folder(spark, "runs")
    h = M.hits(spark, sf).where("toa_lsb >= 0").select(
        (_RUN + 100 * F.col("board") + F.floor(F.col("toa_lsb") / _WEEK) % 100).cast("int").alias("run_number"), F.floor(F.col("toa_lsb") / _HOUR).alias("event"), "board", "channel", "edge", "toa_lsb", "tot_lsb", "seq",
    )
    h = h.select("*", F.col("event").alias("timestamp_lsb"), F.lit(0).alias("trigger_id"))
    runs.write_hits(h, folder)
    return folder


def a3_raw_hits(spark, sf):
    return runs.read_hits(spark, _written(spark, sf), split=1 << 16).select("run_id", "event_index", "seq", "timestamp_lsb", "board", "channel", "edge", "toa_lsb", "tot_lsb")


_H = f"""{M.HITS_SQL}, h AS (SELECT {_RUN} + 100 * board + (toa_lsb // {_WEEK}) % 100 AS run_number, toa_lsb // {_HOUR} AS event, * FROM hits WHERE toa_lsb >= 0)"""
A3 = f"""WITH {_H} SELECT concat('Run', run_number) AS run_id, dense_rank() OVER (PARTITION BY run_number ORDER BY event) - 1 AS event_index, row_number() OVER (PARTITION BY run_number ORDER BY event, seq) - 1 AS seq,
  event AS timestamp_lsb, board, channel, edge, toa_lsb, coalesce(tot_lsb, 0) % 65536 AS tot_lsb FROM h"""


def a3_pushed_hits(spark, sf):
    """Board and run conditions reach the source."""
    return runs.read_hits(spark, _written(spark, sf), split=1 << 16).where("board = 2 and run_id in ('Run4200', 'Run4201', 'Run4207')").groupBy("run_id", "channel").agg(F.count("*").alias("n"), F.sum("toa_lsb").alias("times"), F.max("seq").alias("last"))


A3B = f"SELECT run_id, channel, count(*) AS n, sum(toa_lsb) AS times, max(seq) AS last FROM ({A3}) WHERE board = 2 AND run_id IN ('Run4200', 'Run4201', 'Run4207') GROUP BY 1, 2"


def a1_discovered_runs(spark, sf):
    """Run discovery and sidecars (A1, A2) with the files' headers, joined by run."""
    folder = _written(spark, sf)
    numbers = runs.read_run_headers(spark, f"{folder}/*.dat").select("run_id", F.regexp_extract("run_id", r"(\d+)", 1).cast("int").alias("n"))
    runs.write_run_info(numbers.select(F.col("n").alias("run_number"), (F.col("n") % 7 + 3.5).alias("default_mv"), (F.col("n") % 3 + 20.0).alias("energy_mv"), F.lit("STREAMING").alias("mode")), folder)
    found = runs.discover_runs(spark, folder)
    info = runs.run_info(spark, f"{folder}/*_Info.txt").withColumn("name", F.substring_index("path", "/", -1))
    heads = runs.read_run_headers(spark, f"{folder}/*.dat").select("run_id", F.col("acquisition_mode").alias("header_mode"), "measurement_mode", F.col("toa_lsb_ps").cast("double").alias("toa_lsb_ps"))
    both = found.withColumn("name", F.substring_index("info_path", "/", -1)).join(info.drop("path"), "name").join(heads, "run_id")
    return both.select("run_id", F.col("run_number").cast("int").alias("run_number"), "voltage", "acquisition_mode", "header_mode", "measurement_mode", "toa_lsb_ps", "energy_threshold_mv", "timing_threshold_mv", "consistent")


A1 = f"""WITH {_H}, n AS (SELECT DISTINCT run_number AS n FROM h) SELECT concat('Run', n) AS run_id, CAST(n AS INTEGER) AS run_number, CAST(n // 100 AS INTEGER) AS voltage, 'STREAMING' AS acquisition_mode, 'STREAMING' AS header_mode, 3 AS measurement_mode, 3.125::DOUBLE AS toa_lsb_ps,
  (n % 3 + 20)::DOUBLE AS energy_threshold_mv, (n % 7 + 3.5)::DOUBLE AS timing_threshold_mv, true AS consistent FROM n"""

#: One trace in so many declares more samples than it has.
_BAD = 37


def _trace_folder(spark, sf) -> str:
    """The folder with four channels' trace files of every group of four vectors."""
    folder = shared_folder(spark, "traces")
    e = spark.read.parquet(f"{sf}/embeddings.parquet").where("embedding is not null")
    samples = F.transform("embedding", lambda x: F.rint(x.cast("double") * 1000).cast("smallint"))
    d = e.select((F.col("vec_id") % 4 + 1).alias("channel"), F.floor(F.col("vec_id") / 4).alias("file_id"), samples.alias("samples"), "vec_id")
    d = d.withColumn("sample_count", F.size("samples") + F.when(F.col("vec_id") % _BAD == 5, 9).otherwise(0))
    traces.write_traces(d.select("*", F.lit(0.001).alias("gain"), F.lit(0.25).alias("offset"), F.lit(2.5e-12).alias("interval_s"), (F.col("vec_id") * 1e-9).alias("start_s")), folder)
    return folder


def _converted(spark, sf):
    folder = _trace_folder(spark, sf)
    files = traces.trace_files(spark, folder)
    events, pairing = traces.pair_events(files)
    return files, events, pairing, folder


def a9_trace_events(spark, sf):
    """Traces written, found, paired (A8) and assembled (A9), with every channel's calibrated sum."""
    _, events, _, folder = _converted(spark, sf)
    out = traces.assemble(events, traces.read_traces(spark, folder), skip=3)
    total = lambda c: F.aggregate(f"ch{c}.samples", F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select("event_index", "event_id", *(total(c).alias(f"sum{c}") for c in traces.CHANNELS), F.col("ch1.sample_count").alias("samples"), F.col("ch4.start_s").alias("start_s"))


_T = f"""t AS (SELECT vec_id, vec_id // 4 AS file_id, vec_id % 4 + 1 AS channel, len(embedding) AS n, vec_id % {_BAD} = 5 AS bad, list_sum(list_transform(embedding, lambda x: CAST(round_even(x::DOUBLE * 1000, 0) AS BIGINT))) AS total FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT file_id, row_number() OVER (ORDER BY file_id) AS k, bool_or(bad) AS bad FROM t GROUP BY 1 HAVING count(*) = 4)"""
A9 = f"""WITH {_T}, g AS (SELECT file_id, row_number() OVER (ORDER BY file_id) - 1 AS event_index FROM p WHERE k > 3 AND NOT bad)
SELECT event_index, file_id AS event_id, {", ".join(f"CAST(max(total) FILTER (WHERE channel = {c}) AS BIGINT) AS sum{c}" for c in (1, 2, 3, 4))}, CAST(max(n) FILTER (WHERE channel = 1) AS INTEGER) AS samples, max(vec_id * 1e-9) FILTER (WHERE channel = 4) AS start_s
FROM g JOIN t USING (file_id) GROUP BY 1, 2"""


def a10_conversion_summary(spark, sf):
    """Counts of a conversion, from headers and lengths alone."""
    files, events, pairing, folder = _converted(spark, sf)
    heads = traces.read_traces(spark, folder, samples=False).withColumn("samples", F.lit(None).cast("array<smallint>"))
    return traces.conversion_summary(files, events, traces.assemble(events, heads), pairing, "all")


A10 = f"""WITH {_T}, c AS (SELECT {", ".join(f"count(*) FILTER (WHERE channel = {c}) AS files{c}" for c in (1, 2, 3, 4))} FROM t)
SELECT 1 AS format_version, 'all' AS run_name, 'id' AS pairing, c.*, (SELECT count(*) FROM p) AS paired, (SELECT count(*) FROM p WHERE NOT bad) AS written, (SELECT count(*) FROM p WHERE bad) AS invalid FROM c"""

def a13_table_round_trip(spark, sf):
    """A table written as Parquet and as CSV, non-finite values as null, and read back from both."""
    d = M.measurements(spark, sf).withColumn("ratio", F.col("duration_a") / F.when(F.col("duration_b") != 0, F.col("duration_b").cast("double")).otherwise(float("nan")))
    fields, out = ["event_index", "run_id", "duration_a", "ratio"], None
    for kind in ("parquet", "csv"):
        path = shared_folder(spark, kind)
        tables.write_table(d, fields, path, kind)
        reader = spark.read.schema("event_index long, run_id string, duration_a long, ratio double")
        back = (reader.parquet(path) if kind == "parquet" else reader.option("header", True).csv(path)).withColumn("kind", F.lit(kind))
        out = back if out is None else out.unionByName(back)
    return out


A13 = f"WITH {M.MEASUREMENTS_SQL} SELECT event_index, run_id, duration_a, duration_a / nullif(duration_b, 0)::DOUBLE AS ratio, kind FROM m, (VALUES ('parquet'), ('csv')) AS k(kind)"


def a15_prepared_events(spark, sf):
    """All columns of the selected events in a folder for each run, and what the manifest says of them."""
    d = M.measurements(spark, sf)
    path = shared_folder(spark, "prepared")
    manifest = tables.prepared(d, d.where("alignment_a % 3 = 0"), ["run_id", "event_index"], path, "run_id").withColumnRenamed("n", "listed")
    back = spark.read.parquet(path).groupBy("run_id").agg(F.count("*").alias("n"), F.sum("event_index").alias("ids"), F.sum("timing_lsb").alias("timing"))
    return back.join(manifest, "run_id").select("run_id", "n", "listed", "ids", "timing", F.array_join("columns", ",").alias("columns"))


A15 = f"WITH {M.MEASUREMENTS_SQL} SELECT run_id, count(*) AS n, count(*) AS listed, sum(event_index) AS ids, sum(timing_lsb) AS timing, 'event_index,run_id,duration_a,duration_b,timing_lsb,alignment_a,alignment_b' AS columns FROM m WHERE (run_id, event_index) IN (SELECT (run_id, event_index) FROM m WHERE alignment_a % 3 = 0) GROUP BY 1"

QUERIES = {
    "a13_table_round_trip": (a13_table_round_trip, A13), "a15_prepared_events": (a15_prepared_events, A15),
    "a1_discovered_runs": (a1_discovered_runs, A1), "a3_raw_hits": (a3_raw_hits, A3), "a3_pushed_hits": (a3_pushed_hits, A3B),
    "a9_trace_events": (a9_trace_events, A9), "a10_conversion_summary": (a10_conversion_summary, A10),
}
