"""Oscilloscope trace files: ingest, four-channel event assembly by id or rank, slicing and accounting."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import opened

# Byte offsets of the trace format, and the greatest number of samples that is read.
COUNT_AT, GAIN_AT, OFFSET_AT, INTERVAL_AT, START_AT, SAMPLES_AT = 127, 167, 171, 187, 191, 357
MOST_SAMPLES = 10_000_000
CHANNELS = (1, 2, 3, 4)
#: Share of the shortest channel's files that must have an id in all channels for pairing by id.
COVERAGE = 0.80


def decode(head: bytes, length: int) -> tuple:
    """count, gain, offset, interval, start and None of a file's first bytes and its length, or nulls and what is wrong."""

    def at(place: int, kind: str):
        return np.frombuffer(head, kind, 1, place)[0].item() if len(head) >= place + np.dtype(kind).itemsize else None

    bad = lambda why: (None, None, None, None, None, why)
    count = at(COUNT_AT, "<i4")
    if count is None:
        return bad("no sample count")
    if not 1 < count <= MOST_SAMPLES:
        return bad(f"sample count {count}")
    fields = (at(GAIN_AT, "<f4"), at(OFFSET_AT, "<f4"), at(INTERVAL_AT, "<f4"), at(START_AT, "<f8"))
    if None in fields:
        return bad("no calibration")
    if not np.isfinite(fields).all() or fields[2] <= 0:
        return bad("bad calibration")
    if length < SAMPLES_AT + 2 * count:
        return bad("fewer samples than declared")
    return (count, *fields, None)


def file_names(df: DataFrame, path: str = "path") -> DataFrame:
    """Add channel (1 to 4) and file_id from names C<channel>...<digits>.trc; other files are left out."""
    stem = F.regexp_extract(F.substring_index(path, "/", -1), r"(?i)^(c\d+.*)\.trc$", 1)
    out = df.withColumn("_stem", stem).withColumn("channel", F.regexp_extract("_stem", r"(?i)^c(\d+)", 1).try_cast("int")).withColumn("file_id", F.regexp_extract("_stem", r"(\d+)$", 1).try_cast("long"))
    return out.where((F.length("_stem") >= 3) & F.col("channel").between(1, 4) & F.col("file_id").isNotNull()).drop("_stem")


def trace_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """path, channel, file_id of the trace files below a folder; contents aren't read."""
    return file_names(spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT][rR][cC]").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path"))


#: Bytes of samples that a task hands on together, about; one trace has at most twice MOST_SAMPLES.
BATCH_BYTES = 16 << 20
_FIELDS = (("path", pa.string()), ("channel", pa.int32()), ("file_id", pa.int64()), ("sample_count", pa.int32()), ("gain", pa.float32()), ("offset", pa.float32()), ("interval_s", pa.float32()), ("start_s", pa.float64()))
_SCHEMA = "path string, channel int, file_id long, sample_count int, gain float, offset float, interval_s float, start_s double"


def read_traces(spark: SparkSession, paths: list[str] | str, samples: bool = True) -> DataFrame:
    """A row for each trace file: path, channel, file_id, calibration, samples and error, which is null for a good file.

    Tasks open the files themselves. Without `samples` that column is left out and only the first bytes of a file are
    read; its length says whether it holds what it declares. With it, traces are handed on in batches of bounded size.
    """

    def run(batches):
        held, size = [], 0

        def out():
            names, kinds = zip(*_FIELDS, *([("samples", pa.list_(pa.int16()))] if samples else []), ("error", pa.string()), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=list(names))

        for b in batches:
            for path, channel, file_id, length in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                fs, at = opened(path)
                with fs.open_input_file(at) as f:
                    *found, error = decode(f.read(SAMPLES_AT), length)
                    trace = None
                    if samples and error is None:
                        f.seek(SAMPLES_AT)
                        trace = np.frombuffer(f.read(2 * found[0]), "<i2")
                        size += trace.nbytes
                held.append((path, channel, file_id, *found, *([trace] if samples else []), error))
                if size >= BATCH_BYTES or len(held) >= 4096:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    files = file_names(spark.read.format("binaryFile").load(paths).select("path", "length")).select("path", "channel", "file_id", "length")
    return files.mapInArrow(run, _SCHEMA + (", samples array<smallint>" if samples else "") + ", error string")


def write_traces(df: DataFrame, folder: str) -> None:
    """Write C<channel>_trace<file_id>.trc of rows: channel, file_id, sample_count, gain, offset, interval_s, start_s, samples."""

    def run(frames):
        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        for pdf in frames:
            for r in pdf.itertuples():
                head = bytearray(SAMPLES_AT)
                for place, kind, x in ((COUNT_AT, "<i4", r.sample_count), (GAIN_AT, "<f4", r.gain), (OFFSET_AT, "<f4", r.offset), (INTERVAL_AT, "<f4", r.interval_s), (START_AT, "<f8", r.start_s)):
                    cell = np.array([x], kind).tobytes()
                    head[place : place + len(cell)] = cell
                with fs.open_output_stream(f"{root}/C{r.channel}_trace{r.file_id:09d}.trc") as out:
                    out.write(bytes(head) + np.asarray(r.samples, "<i2").tobytes())
            yield pd.DataFrame({"files": [len(pdf)]})

    df.select("channel", "file_id", "sample_count", "gain", "offset", "interval_s", "start_s", "samples").mapInPandas(run, "files long").agg(F.sum("files")).collect()


def _wide(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(*(F.max(F.when(F.col("channel") == c, F.struct("file_id", "path"))).alias(f"c{c}") for c in CHANNELS)).dropna(subset=[f"c{c}" for c in CHANNELS])


def pair_by_id(files: DataFrame) -> DataFrame:
    """event_id and four paths of every id that all channels have; an id that a channel has twice fails the query."""
    twice = F.count("*").over(Window.partitionBy("channel", "file_id"))
    checked = files.withColumn("file_id", F.when(twice > 1, F.raise_error(F.format_string("channel %d has file %d twice", "channel", "file_id")).cast("long")).otherwise(F.col("file_id")))
    w = _wide(checked, "file_id")
    return w.select(F.col("file_id").alias("event_id"), F.col("file_id").alias("order"), *(F.col(f"c{c}.path").alias(f"path{c}") for c in CHANNELS))


def pair_by_rank(files: DataFrame) -> DataFrame:
    """The k-th files of all channels, by id, then path, as event k; event_id is their id where all agree, else k."""
    k = F.row_number().over(Window.partitionBy("channel").orderBy("file_id", "path")) - 1
    w = _wide(files.withColumn("order", k), "order")
    same = F.lit(True)
    for c in CHANNELS[1:]:
        same &= F.col(f"c{c}.file_id") == F.col("c1.file_id")
    return w.select(F.when(same, F.col("c1.file_id")).otherwise(F.col("order")).cast("long").alias("event_id"), F.col("order").cast("long").alias("order"), *(F.col(f"c{c}.path").alias(f"path{c}") for c in CHANNELS))


def pair_events(files: DataFrame, pairing: str = "auto") -> tuple[DataFrame, str]:
    """Events and the pairing used: id, rank, or auto, which takes ids where enough of them are common to all channels."""
    if pairing not in ("auto", "id", "rank"):
        raise ValueError("pairing is auto, id or rank")
    counts = {r["channel"]: r["n"] for r in files.groupBy("channel").agg(F.count("*").alias("n")).collect()}
    lack = [c for c in CHANNELS if not counts.get(c)]
    if lack:
        raise ValueError(f"no trace files of channels {lack}")
    if pairing == "auto":
        common = files.groupBy("file_id").agg(F.countDistinct("channel").alias("n")).where("n = 4").count()
        pairing = "id" if common and common / min(counts.values()) >= COVERAGE else "rank"
    out = pair_by_id(files) if pairing == "id" else pair_by_rank(files)
    if out.isEmpty():
        raise ValueError("no event has all four channels")
    return out, pairing


def assemble(events: DataFrame, traces: DataFrame, skip: int = 0, most: int | None = None) -> DataFrame:
    """Events of good traces, after skipping some and keeping at most `most`: event_index from 0, event_id, and per channel calibration and samples.

    An event with any bad trace is dropped whole. The cut is over the order of all paired events.
    """
    w = Window.orderBy("order")
    cut = events.select("event_id", "order", *(f"path{c}" for c in CHANNELS)).withColumn("_k", F.row_number().over(w) - 1).where(F.col("_k") >= skip)
    cut = cut.where(F.col("_k") < skip + most) if most is not None else cut
    long = cut.select("event_id", "order", F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(f"path{c}").alias("path")) for c in CHANNELS))).alias("x")).select("event_id", "order", "x.*")
    # events are numbered on narrow rows; the samples are joined afterwards and never pass a sort of all events
    good = long.join(traces.select("path", "error"), "path").groupBy("event_id", "order").agg(F.count_if(F.col("error").isNull()).alias("good")).where("good = 4")
    index = good.withColumn("event_index", F.row_number().over(w) - 1).select("event_id", "order", "event_index")
    body = F.struct("file_id", "sample_count", "gain", "offset", "interval_s", "start_s", "samples")
    full = long.join(index, ["event_id", "order"]).join(traces.drop("channel"), "path")
    return full.groupBy("event_index", "event_id").agg(*(F.max_by(F.when(F.col("channel") == c, body), F.when(F.col("channel") == c, 1)).alias(f"ch{c}") for c in CHANNELS))


def conversion_summary(files: DataFrame, events: DataFrame, written: DataFrame, pairing: str, run_name: str) -> DataFrame:
    """One row: run name, pairing, files of each channel, paired, written and invalid events."""
    n = files.agg(*(F.count_if(F.col("channel") == c).alias(f"files{c}") for c in CHANNELS))
    p, w = events.agg(F.count("*").alias("paired")), written.agg(F.count("*").alias("written"))
    return n.join(p).join(w).select(F.lit(1).alias("format_version"), F.lit(run_name).alias("run_name"), F.lit(pairing).alias("pairing"), *(f"files{c}" for c in CHANNELS), "paired", "written", (F.col("paired") - F.col("written")).alias("invalid"))
