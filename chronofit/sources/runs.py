"""Raw run files: discovery, text sidecars, and the ingest of length-prefixed edge records into tables."""

from __future__ import annotations

import itertools
import json
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Window_
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .files import Window, listed, opened

# Fixed values of the run files' format.
HEADER_BYTES = 33
MODES = {0x32: "TRG_MATCHING", 0x22: "STREAMING"}
MODE_NAMES = {"TRG_MATCHING": "TRG_MATCHING", "TRIGGER_MATCHING": "TRG_MATCHING", "STREAMING": "STREAMING"}
LEAD_ONLY, LEAD_TRAIL, MEASUREMENTS = 0x01, 0x03, (0x01, 0x03, 0x05, 0x09)
HEADER = np.dtype([("major", "u1"), ("minor", "u1"), ("skip", "V3"), ("board_version", "<u2"), ("run", "<u2"), ("mode", "<u2"), ("measurement", "u1"), ("unit", "u1"), ("toa_lsb_ps", "<f4"), ("tot_lsb_ps", "<f4"), ("timestamp_lsb_ps", "<f4"), ("start_ms", "<u8")])
RUN_PATTERN = r"(?i)Run[_-]?(\d+)"
DEFAULT_PATTERN = r"(?i)^\s*DiscrThreshold\s+([-+]?\d+(?:\.\d+)?)\b"
CHANNEL_PATTERN = r"(?i)^\s*DiscrThreshold\s*\[\s*(\d+)\s*\]\s*\[\s*(\d+)\s*\]\s+([-+]?\d+(?:\.\d+)?)\b"
MODE_PATTERN = r"(?i)^\s*AcquisitionMode\s+([A-Za-z0-9_]+)\b"


def _files(spark: SparkSession, folder: str, pattern: str, recursive: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)


def discover_runs(spark: SparkSession, folder: str, pattern: str = "*.dat", recursive: bool = False) -> DataFrame:
    """run_id, run_number, voltage, data_path, info_path of every raw file; only paths are read.

    The voltage is the run number's first two digits. A name without a run number, a number of fewer than two
    digits, a repeated run and a file without exactly one `<run>_Info.txt` beside it fail the query.
    """
    name, parent = F.substring_index("path", "/", -1), F.regexp_replace("path", "/[^/]*$", "")
    number = F.regexp_extract("name", RUN_PATTERN, 1)
    data = _files(spark, folder, pattern, recursive).select("path", name.alias("name"), parent.alias("parent")).where(~F.lower("name").like("%\\_info.txt"))
    data = data.select("path", "parent", F.when(number == "", F.raise_error(F.concat(F.lit("no run number in "), "name")).cast("string")).otherwise(number).alias("run_number"))
    info = _files(spark, folder, "*_[iI][nN][fF][oO].[tT][xX][tT]", recursive).select("path", name.alias("name"), parent.alias("parent"))
    info = info.groupBy("parent", F.lower("name").alias("want")).agg(F.count("*").alias("n"), F.min("path").alias("info_path"))
    both = data.withColumn("want", F.concat(F.lit("run"), "run_number", F.lit("_info.txt"))).join(info, ["parent", "want"], "left")
    per = both.groupBy("run_number").agg(F.count("*").alias("copies"), F.min("path").alias("data_path"), F.min("info_path").alias("info_path"), F.max(F.coalesce("n", F.lit(0))).alias("n"))
    fault = (
        F.when(F.col("copies") > 1, F.concat(F.lit("several files of run "), "run_number"))
        .when(F.col("n") != 1, F.concat(F.lit("not exactly one info file of run "), "run_number"))
        .when(F.length("run_number") < 2, F.concat(F.lit("fewer than two digits: "), "run_number"))
    )
    ok = F.when(fault.isNotNull(), F.raise_error(fault).cast("string")).otherwise(F.concat(F.lit("Run"), "run_number"))
    return per.select(ok.alias("run_id"), "run_number", F.substring("run_number", 1, 2).cast("int").alias("voltage"), "data_path", "info_path")


def run_info(spark: SparkSession, paths: list[str] | str, strict: bool = True, channels: tuple[int, int, int, int] = (1, 3, 5, 7)) -> DataFrame:
    """path, acquisition_mode, energy_threshold_mv, timing_threshold_mv of text sidecars.

    The last default threshold and mode count, and the last override of each channel of board 0. Energy is channel 1
    (5 must agree), timing is channel 3 (7 must agree): otherwise the query fails if strict, and `consistent` is false.
    A file without a default threshold or a known mode fails.
    """
    lines = spark.read.format("binaryFile").load(paths).select("path", F.posexplode(F.split(F.decode("content", "utf-8"), "\r?\n")).alias("no", "line"))
    pick = lambda p, g: F.nullif(F.regexp_extract("line", p, g), F.lit(""))
    channel = pick(CHANNEL_PATTERN, 3)
    own = channel.isNotNull() & (pick(CHANNEL_PATTERN, 1).cast("int") == 0)
    last = lambda v, when: F.max_by(F.when(when, v), F.when(when, F.col("no")))
    default, mode = pick(DEFAULT_PATTERN, 1).cast("double"), F.upper(pick(MODE_PATTERN, 1))
    names = F.create_map(*(F.lit(x) for kv in MODE_NAMES.items() for x in kv))
    g = lines.groupBy("path").agg(
        last(default, default.isNotNull()).alias("default"), last(mode, mode.isNotNull()).alias("raw_mode"),
        *(last(channel.cast("double"), own & (pick(CHANNEL_PATTERN, 2).cast("int") == c)).alias(f"c{c}") for c in channels),
    )
    g = g.select("path", "default", F.try_element_at(names, F.coalesce("raw_mode", F.lit(""))).alias("acquisition_mode"), *(F.coalesce(f"c{c}", "default").alias(f"c{c}") for c in channels))
    a, b, c, d = (F.col(f"c{x}") for x in channels)
    same = (F.abs(a - c) <= 1e-12) & (F.abs(b - d) <= 1e-12)
    fault = F.when(F.col("default").isNull(), "no default threshold in ").when(F.col("acquisition_mode").isNull(), "no known acquisition mode in ").when(F.lit(strict) & ~same, "inconsistent thresholds in ")
    checked = F.when(fault.isNotNull(), F.raise_error(F.concat(fault, "path")).cast("string")).otherwise(F.col("acquisition_mode"))
    return g.select("path", checked.alias("acquisition_mode"), a.alias("energy_threshold_mv"), b.alias("timing_threshold_mv"), same.alias("consistent"))


def read_header(content: bytes) -> dict:
    """Checked header fields of one run file."""
    if len(content) < HEADER_BYTES:
        raise ValueError("the header is cut off")
    h = np.frombuffer(content[:HEADER_BYTES], HEADER)[0]
    if h["major"] != 3 or h["minor"] < 2:
        raise ValueError(f"format {h['major']}.{h['minor']}; 3.2 or a later 3 is needed")
    if int(h["mode"]) not in MODES or int(h["measurement"]) not in MEASUREMENTS:
        raise ValueError(f"mode {int(h['mode']):#x} or measurement {int(h['measurement']):#x} is unknown")
    if h["unit"] != 0:
        raise ValueError("times must be whole LSB")
    for name in ("toa_lsb_ps", "timestamp_lsb_ps", *(["tot_lsb_ps"] if h["measurement"] == LEAD_TRAIL else [])):
        if not (np.isfinite(h[name]) and h[name] > 0):
            raise ValueError(f"{name} is {h[name]}")
    return {n: h[n].item() for n in HEADER.names if n != "skip"}


def layouts(header: dict) -> tuple[np.dtype, np.dtype]:
    """Record layouts of an event's head and of a hit."""
    streaming = MODES[header["mode"]] == "STREAMING"
    head = [("size", "<u2"), ("timestamp", "<u8"), *([] if streaming else [("trigger", "<u8")]), ("n", "<u2")]
    tot = header["measurement"] == LEAD_TRAIL if streaming else header["measurement"] != LEAD_ONLY
    return np.dtype(head), np.dtype([("board", "u1"), ("channel", "u1"), ("edge", "u1"), ("toa", "<u8" if streaming else "<u4"), *([("tot", "<u2")] if tot else [])])


def walk(data: Window, start: int, end: int, head: np.dtype, hit: np.dtype):
    """(end, timestamp, trigger, hits) of the records that begin at start or later and before end.

    A size that doesn't add up or a cut-off record fails.
    """
    triggered = "trigger" in head.names
    fields = struct.Struct("<HQQH" if triggered else "<HQH")
    at = start
    while at < end:
        top = data.take(at, head.itemsize)
        if len(top) < head.itemsize:
            raise ValueError(f"the record at byte {at} is cut off")
        size, stamp, *trigger, n = fields.unpack(top)
        if size != head.itemsize + n * hit.itemsize:
            raise ValueError(f"the record at byte {at}: {size} bytes can't hold {n} hits")
        body = data.take(at + head.itemsize, size - head.itemsize)
        if len(body) < size - head.itemsize:
            raise ValueError(f"the record at byte {at} is cut off")
        at += size
        yield at, stamp, trigger[0] if triggered else 0, np.frombuffer(bytes(body), hit)


#: Bytes of a run file that a task reads, about, and records that must follow each other where a task looks for its first one.
SPLIT, CHAIN = 128 << 20, 64


def first_record(data: Window, at: int, head: np.dtype, hit: np.dtype) -> int:
    """Where the first record at a place or later begins: from there on, records follow each other up to the file's end or CHAIN of them.

    A record is at most 65,535 bytes long, so one begins within so many. Whether the place is right is checked again
    against the end of the part before.
    """
    block = np.frombuffer(bytes(data.take(at, (1 << 16) + head.itemsize)), np.uint8)
    n = max(0, len(block) - head.itemsize + 1)
    word = lambda k: block[k : k + n].astype(np.int64) | block[k + 1 : k + 1 + n].astype(np.int64) << 8
    fits = word(0) == head.itemsize + word(head.itemsize - 2) * hit.itemsize
    for offset in np.flatnonzero(fits).tolist():
        place = at + offset
        for _ in range(CHAIN):
            top = data.take(place, head.itemsize)
            if len(top) < head.itemsize:
                break
            size, count = int.from_bytes(top[:2], "little"), int.from_bytes(top[-2:], "little")
            if size != head.itemsize + count * hit.itemsize or place + size > data.size:
                place = -1
                break
            place += size
            if place == data.size:
                break
        if place >= 0 and (place == data.size or place - at > 0 and len(data.take(place, head.itemsize)) == head.itemsize):
            return at + offset
    return data.size


_HITS = "path string, part int, run_id string, event_index long, seq long, timestamp_lsb long, trigger_id long, board int, channel int, edge int, toa_lsb long, tot_lsb long, error string"
_PARTS = "path string, part int, run_id string, start long, stop long, events long, hits long, error string"


@dataclass
class _Part(InputPartition):
    path: str | None
    size: int
    no: int
    start: int
    end: int


class _HitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.counting = options.get("counting", "false") == "true"
        self.as_rows = options.get("errors", "fail") == "row"
        self.split = int(options.get("split", SPLIT))
        self.wanted: dict[str, frozenset] = {}

    def pushFilters(self, filters):
        """Equality and IN on run_id and board are decided before hits are decoded or handed on; the rest stays with Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            values = frozenset([f.value]) if isinstance(f, EqualTo) else frozenset(f.value) if isinstance(f, In) else None
            if not self.counting and name in ("run_id", "board") and values is not None and not self.as_rows:
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        for path, size in listed(self.paths, r"\.dat$"):
            cuts = [0, *range(self.split, max(size, 1), self.split), size]
            out += [_Part(path, size, k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b or not k]
        return out or [_Part(None, 0, 0, 0, 0)]

    def read(self, part: _Part):
        if part.path is None:
            return
        fs, at = opened(part.path)
        with fs.open_input_file(at) as f:
            try:
                data = Window(f, part.size)
                header = read_header(bytes(data.take(0, HEADER_BYTES)))
                run = f"Run{header['run']}"
                if run not in self.wanted.get("run_id", {run}):
                    return
                head, hit = layouts(header)
                start = HEADER_BYTES if part.no == 0 else first_record(data, part.start, head, hit)
                found = walk(data, start, max(part.end, HEADER_BYTES), head, hit)
                yield from (self.count if self.counting else self.decode)(part, run, start, found, hit)
            except ValueError as e:
                if not self.as_rows:
                    raise ValueError(f"{part.path}: {e}") from e
                names = (_PARTS if self.counting else _HITS).split(", ")
                known = {"path": part.path, "part": part.no, "error": str(e)}
                yield tuple(known.get(x.split()[0]) for x in names)

    def count(self, part: _Part, run: str, start: int, found, hit: np.dtype):
        events, hits, stop = 0, 0, start
        for stop, _, _, rows in found:  # noqa: B007
            events, hits = events + 1, hits + len(rows)
        yield part.path, part.no, run, start, stop, events, hits, None

    def decode(self, part: _Part, run: str, start: int, found, hit: np.dtype):
        boards, seq, index = self.wanted.get("board"), 0, 0
        while parts := list(itertools.islice(found, 4096)):
            rows, counts = np.concatenate([p[3] for p in parts]), [len(p[3]) for p in parts]
            if (rows["edge"] > 1).any():
                raise ValueError("an edge code that is neither 0 nor 1")
            if (rows["toa"].astype(np.uint64) >> np.uint64(63)).any():
                raise ValueError("a time of 2^63 or more")
            each = lambda x, c=counts: np.repeat(np.array(x, dtype=np.uint64), c).astype(np.int64)
            order, events = np.arange(seq, seq + len(rows)), each(range(index, index + len(parts)))
            stamps, triggers = each([p[1] for p in parts]), each([p[2] for p in parts])
            keep = np.isin(rows["board"], list(boards)) if boards is not None else np.ones(len(rows), bool)
            seq, index = seq + len(rows), index + len(parts)
            kept, n = rows[keep], int(keep.sum())
            tot = pa.array(kept["tot"].astype(np.int64)) if "tot" in hit.names else pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.path] * n, pa.string()), pa.array([part.no] * n, pa.int32()), pa.array([run] * n, pa.string()), *(pa.array(x[keep]) for x in (events, order, stamps, triggers)), *(pa.array(kept[c].astype(np.int32)) for c in ("board", "channel", "edge")), pa.array(kept["toa"].astype(np.int64)), tot, pa.nulls(n, pa.string())],
                names=[x.split()[0] for x in _HITS.split(", ")],
            )


class HitSource(DataSource):
    """Raw run files by byte ranges along their records. Options: paths (JSON list), split, errors (fail or row), counting."""

    @classmethod
    def name(cls) -> str:
        return "run_hits"

    def schema(self) -> str:
        return _PARTS if self.options.get("counting", "false") == "true" else _HITS

    def reader(self, schema) -> DataSourceReader:
        return _HitReader(self.options)


def read_hits(spark: SparkSession, paths: list[str] | str, split: int = SPLIT, errors: str = "fail") -> DataFrame:
    """One row for each hit of raw run files: run_id, event_index, seq, timestamp_lsb, trigger_id, board, channel, edge, toa_lsb, tot_lsb.

    tot_lsb is null where it isn't recorded. A file is read in parts of `split` bytes by tasks of their own. Each finds its
    first record itself; that every part begins where the one before it ended is checked, and event_index and seq are made
    up from the parts' counts. Conditions on run_id and board are pushed down. A bad file fails the query; with
    errors="row" it gives rows with nothing but its path and what is wrong, in the further columns path and error; of a
    file in parts, hits from its first bad part on are left out, as these can't be numbered.
    """
    spark.dataSource.register(HitSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    paths = [paths] if isinstance(paths, str) else list(paths)
    source = lambda counting: spark.read.format("run_hits").options(paths=json.dumps(paths), split=str(split), errors=errors, counting=str(counting).lower()).load()
    hits = source(False)
    extra = ["path", "error"] if errors == "row" else []
    if any(size > split for _, size in listed(paths, r"\.dat$")):
        w = Window_.partitionBy("path").orderBy("part")  # a row for each part
        parts = source(True).withColumn("_expected", F.lag("stop").over(w)).withColumn("_events", F.coalesce(F.sum("events").over(w) - F.col("events"), F.lit(0))).withColumn("_hits", F.coalesce(F.sum("hits").over(w) - F.col("hits"), F.lit(0)))
        apart = F.col("_expected").isNotNull() & (F.col("_expected") != F.col("start"))
        why = F.concat(F.lit("records don't join up in "), "path")
        if errors == "row":
            lost = F.min(F.when(F.coalesce(apart, F.lit(False)) | F.col("error").isNotNull(), F.col("part"))).over(Window_.partitionBy("path"))
            parts = parts.select("path", "part", "_events", "_hits", lost.alias("_lost"), F.when(apart, why).alias("_why"))
            told = hits.join(parts.drop("_why"), ["path", "part"]).where("error is not null or _lost is null or part < _lost")
            gaps = parts.where("_why is not null").select("path", "part", "_events", "_hits", F.col("_why").alias("error"))
            hits = told.drop("_lost").unionByName(gaps, allowMissingColumns=True)
        else:
            ok = F.when(apart, F.raise_error(why).cast("boolean")).otherwise(F.lit(True))
            hits = hits.join(parts.where(ok).select("path", "part", "_events", "_hits"), ["path", "part"])
        hits = hits.withColumns({"event_index": F.col("event_index") + F.col("_events"), "seq": F.col("seq") + F.col("_hits")})
    return hits.select("run_id", "event_index", "seq", "timestamp_lsb", "trigger_id", "board", "channel", "edge", "toa_lsb", "tot_lsb", *extra)


def write_hits(df: DataFrame, folder: str, mode: str = "STREAMING", measurement: int = LEAD_TRAIL, lsb_ps: float = 3.125) -> None:
    """Write hits (run_number, event, timestamp_lsb, trigger_id, board, channel, edge, toa_lsb, tot_lsb, seq) as a file for each run.

    Records go by event, hits by seq. A task writes its runs one after the other, as rows come, beside their final names, so a
    task that is run again does no harm. A run number above 65,535 or an event of over some 4,000 hits doesn't fit the format.
    """
    code = {v: k for k, v in MODES.items()}[mode]
    h = np.zeros(1, HEADER)
    h[["major", "minor", "board_version", "mode", "measurement", "toa_lsb_ps", "tot_lsb_ps", "timestamp_lsb_ps"]] = (3, 2, 1, code, measurement, lsb_ps, lsb_ps, lsb_ps)
    head, hit = layouts({"mode": code, "measurement": measurement})

    def run(frames):
        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        out, now, rest, done = None, None, None, 0

        def close():
            nonlocal rest
            flush(rest)
            rest = None
            out.close()
            fs.move(f"{root}/.Run{now}-{token}", f"{root}/Run{now}.dat")

        def flush(rows: pd.DataFrame | None):
            if rows is None:
                return
            for _, e in rows.groupby("event", sort=False):
                body = np.zeros(len(e), hit)
                for name, column in (("board", "board"), ("channel", "channel"), ("edge", "edge"), ("toa", "toa_lsb"), ("tot", "tot_lsb")):
                    if name in hit.names:
                        body[name] = e[column].fillna(0).to_numpy(np.int64)
                if head.itemsize + body.nbytes >= 1 << 16:
                    raise ValueError(f"an event of {len(e)} hits doesn't fit a record")
                top = np.zeros(1, head)
                top["size"], top["timestamp"], top["n"] = head.itemsize + body.nbytes, e.timestamp_lsb.iloc[0], len(e)
                if "trigger" in head.names:
                    top["trigger"] = e.trigger_id.iloc[0]
                out.write(top.tobytes() + body.tobytes())

        token = uuid.uuid4().hex
        for pdf in frames:
            for number, rows in pdf.groupby("run_number", sort=False):
                if number != now:
                    if out is not None:
                        close()
                        done += 1
                    now, first = number, h.copy()
                    if not 0 <= number < 1 << 16:
                        raise ValueError(f"run number {number}")
                    first["run"] = number
                    out = fs.open_output_stream(f"{root}/.Run{number}-{token}")
                    out.write(first.tobytes())
                rows = rows if rest is None else pd.concat([rest, rows])
                last = rows.event.iloc[-1]  # may go on in the next batch
                flush(rows[rows.event != last])
                rest = rows[rows.event == last]
        if out is not None:
            close()
            done += 1
        yield pd.DataFrame({"files": [done]})

    df.repartition("run_number").sortWithinPartitions("run_number", "event", "seq").mapInPandas(run, "files long").agg(F.sum("files")).collect()


def write_run_info(df: DataFrame, folder: str) -> None:
    """Write a `Run<number>_Info.txt` for each row: run_number, default_mv, energy_mv (both energy channels of board 0) and mode."""

    def run(frames):
        fs, root = opened(folder)
        for pdf in frames:
            for r in pdf.itertuples():
                lines = [f"DiscrThreshold {r.default_mv}", *(f"DiscrThreshold[0][{c}] {r.energy_mv}" for c in (1, 5)), f"AcquisitionMode {r.mode}"]
                with fs.open_output_stream(f"{root}/Run{r.run_number}_Info.txt") as out:
                    out.write("".join(f"{x}\n" for x in lines).encode())
            yield pd.DataFrame({"files": [len(pdf)]})

    df.select("run_number", "default_mv", "energy_mv", "mode").mapInPandas(run, "files long").agg(F.sum("files")).collect()


def read_run_headers(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path, run_id, acquisition_mode, measurement_mode and the LSB sizes of raw run files."""

    def run(batches):
        for b in batches:
            h = [read_header(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([f"Run{x['run']}" for x in h], pa.string()), pa.array([MODES[x["mode"]] for x in h], pa.string()), pa.array([x["measurement"] for x in h], pa.int32()), *(pa.array([x[c] for x in h], pa.float64()) for c in ("toa_lsb_ps", "tot_lsb_ps", "timestamp_lsb_ps"))],
                names=["path", "run_id", "acquisition_mode", "measurement_mode", "toa_lsb_ps", "tot_lsb_ps", "timestamp_lsb_ps"],
            )

    head = spark.read.format("binaryFile").load(paths).select("path", F.substring("content", 1, HEADER_BYTES).alias("content"))
    return head.mapInArrow(run, "path string, run_id string, acquisition_mode string, measurement_mode int, toa_lsb_ps double, tot_lsb_ps double, timestamp_lsb_ps double")
