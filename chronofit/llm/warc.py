"""WARC archives as a Spark data source: writing with revisit records, reading with planned partitions and pushed filters."""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)

from .common import Scratch, small_batches

#: Payloads of fewer bytes are never written as revisits.
LEAST_REVISIT = 100
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc-record")
_SCHEMA = "page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
#: Bytes of a member that are inflated to see its headers.
_HEAD = 8 << 10


def file_system(path: str):
    """pyarrow's file system for a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path)


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, size: int, date: str) -> bytes:
    """One record: an HTTP response with its payload, or a revisit that has none and names the response."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(_SPACE, str(i))}>"
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", _clean(url)))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if refers_to is not None:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", name(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    if page_id is not None:
        head.append(("X-Page", str(page_id)))
    head.append(("X-Payload-Length", str(size)))
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    if refers_to is None:
        block += payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member of one record, with the format's skip-lengths field: both lengths stand before the data."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    extra = b"sl" + struct.pack("<H", 8) + struct.pack("<II", 10 + 2 + 12 + len(body) + 8, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    """The file that a task has written, still under its attempt's name."""

    name: str | None
    records: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Write one file for each task; a retried task writes another, and only the committed one is published."""
        fs, root = file_system(self.path)
        name, n, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for b in iterator:
            for r in b.to_pylist():
                if out is None:
                    fs.create_dir(f"{root}/_attempts", recursive=True)
                    out = fs.open_output_stream(f"{root}/_attempts/{name}", compression=None)
                out.write(member(record(r["page_id"], r["url"], r["payload"] or b"", r["payload_digest"], r["refers_to"], r["payload_bytes"], self.date)))
                n += 1
        if out is None:
            return Written(None, 0)
        out.close()
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        for m in messages:
            if m and m.name:
                fs.move(f"{root}/_attempts/{m.name}", f"{root}/{m.name}")
        with fs.open_output_stream(f"{root}/_SUCCESS") as f:
            f.write(json.dumps({"records": sum(m.records for m in messages if m)}).encode())
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        if fs.get_file_info(f"{root}/_attempts").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/_attempts")


def headers(data: bytes) -> tuple[dict[str, str], int] | None:
    """WARC header fields by lower-cased name and where the block begins; None if the header isn't complete in data."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, end + 4


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and text.lstrip("-").isdigit() else None


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.payload = options.get("payload", "true") == "true"
        self.verify = options.get("verify", "false") == "true"
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters):
        """Equality and IN on the columns that the headers hold are decided from the headers; the rest stays with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in _NAMES[:-1]:
                self.wanted.append((f.attribute[0], frozenset([f.value])))
            elif isinstance(f, In) and len(f.attribute) == 1 and f.attribute[0] in _NAMES[:-1]:
                self.wanted.append((f.attribute[0], frozenset(f.value)))
            elif not (isinstance(f, IsNotNull) and f.attribute[0] in dict(self.wanted)):
                yield f

    def partitions(self) -> list[InputPartition]:
        """A partition for each archive file, the largest first."""
        fs, root = file_system(self.path)
        found = [x for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if x.path.endswith((".warc", ".warc.gz"))]
        return [InputPartition(x.path) for x in sorted(found, key=lambda x: (-x.size, x.path))] or [InputPartition(None)]

    def row(self, h: dict[str, str]) -> list:
        return [
            _number(h.get("x-page")), h.get("warc-type"), h.get("warc-target-uri"), _number(h.get("x-payload-length")),
            h.get("warc-payload-digest", "").removeprefix("sha256:") or None, _number(h.get("x-refers-to-page")),
        ]

    def take(self, h: dict[str, str]) -> list | None:
        row = self.row(h)
        if all(row[_NAMES.index(c)] in values for c, values in self.wanted):
            return row
        return None

    def finish(self, row: list, h: dict[str, str], block: bytes) -> tuple:
        body = block[: int(h.get("content-length", len(block)))]
        if h.get("content-type", "").startswith("application/http"):
            body = body[body.find(b"\r\n\r\n") + 4 :]
        if h.get("warc-type") == "revisit":
            body = None
        elif self.verify:
            if hashlib.sha256(body).hexdigest() != row[4] or len(body) != row[3]:
                raise ValueError(f"the payload of page {row[0]} differs from its record's header")
        return (*row, body if self.payload else None)

    def records(self, f, packed: bool) -> Iterator[tuple]:
        need = self.payload or self.verify
        while True:
            if packed:
                fixed = f.read(12)
                if len(fixed) < 12:
                    return
                extra = f.read(struct.unpack("<H", fixed[10:])[0]) if fixed[3] & 4 else b""
                if fixed[3] != 4 or extra[:2] != b"sl":
                    raise ValueError("a member without skip lengths; write archives by this source or unpack them")
                rest = struct.unpack("<I", extra[4:8])[0] - 12 - len(extra)
                head = f.read(min(rest, _HEAD))
                z = zlib.decompressobj(-15)
                data = z.decompress(head)
                while (got := headers(data)) is None and len(head) < rest:
                    more = f.read(min(rest - len(head), _HEAD))
                    head += more
                    data += z.decompress(more)
                h, at = got
                row = self.take(h)
                if row is None or not need:
                    f.seek(f.tell() + rest - len(head))
                else:
                    data += z.decompress(f.read(rest - len(head)))
            else:
                data = b""
                while (got := headers(data)) is None:
                    more = f.read(_HEAD)
                    if not more:
                        return
                    data += more
                h, at = got
                over = len(data) - at - int(h["content-length"]) - 4
                row = self.take(h)
                if over > 0 or row is None or not need:
                    f.seek(f.tell() - over)
                else:
                    data += f.read(-over)
            if row is not None:
                yield self.finish(row, h, data[at:]) if need else (*row, None)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        fs, _ = file_system(self.path)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)

        with fs.open_input_file(partition.value) as f:
            for r in self.records(f, partition.value.endswith(".gz")):
                rows.append(r)
                held += len(r[6] or b"") + 200
                if held > 8 << 20:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class WarcSource(DataSource):
    """format("warc"): options path; for reading payload (false leaves it null) and verify; for writing date.

    Reading plans a partition for each .warc or .warc.gz file. A record's headers are parsed first; where pushed
    filters rule it out, or its payload isn't wanted, the reader seeks past it without decoding it.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    small_batches(spark)


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Rows to write: the page, its payload's size and digest, and the page it revisits.

    Of equal payloads of `least` bytes or more, that with the least page id is the response and the others,
    null ids too, revisit it; rows that share this id are all responses. Null html is an empty payload.
    """
    c = lambda name: F.col(f"`{name}`")
    p = pages.select(c(id_col).cast("long").alias("page_id"), c(url_col).cast("string").alias("url"), F.coalesce(c(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    first = (
        p.where(F.col("payload_bytes") >= least).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("payload_digest", "first")
    )
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return p.join(first, "payload_digest", "left").select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", F.when(again, F.col("first")).alias("refers_to")
    )


def write(rows: DataFrame, path: str) -> None:
    """Write planned rows as archives under a folder that executors and driver share."""
    register(rows.sparkSession)
    rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to").write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("verify", str(verify).lower()).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages and read the archives back; each payload is checked against its header on the way."""
    spark = pages.sparkSession
    path = Scratch(spark, "warc").path("archive")
    write(planned(pages), path)
    return read(spark, path, payload=False, verify=True)
