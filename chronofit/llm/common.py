"""What the corpus operators share: scratch tables, bounded Arrow batches, components of a graph.

Every operator takes a DataFrame and the names of its id and text columns, reads only those
two, and returns its own columns, so further columns of the input, whatever their names,
neither get in the way nor travel through a shuffle.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that go to a Python worker at once. Texts can be very long, so this is far below Spark's own.
BATCH_ROWS = 512
#: Bytes that go to a Python worker at once, where Spark honours it.
BATCH_BYTES = 16 << 20


_local_dir: str | None = None


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, so that long texts don't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset."""
    global _local_dir
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _local_dir = found = _local_dir or "file://" + tempfile.mkdtemp(prefix="chronofit-")
    return found.rstrip("/")


_roots: list[tuple[SparkSession, str]] = []


def cleanup() -> None:
    """Delete all scratch folders made so far; results that haven't been written or collected can't be read afterwards.

    Runs at the end of the Python process, as results read their scratch tables until then.
    """
    while _roots:
        with contextlib.suppress(Exception):  # the session may be gone
            remove(*_roots.pop())


atexit.register(cleanup)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Tables written to the shared folder to cut lineage; drop() removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _roots.append((spark, self.root))

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str = "t", compression: str = "snappy") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def sweep(self) -> None:
        """Let Spark delete the shuffle files of what has been saved; it does so only when the JVM collects its handles."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path on whatever file system it is."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns as (id, text); rows stay as they are, nulls too."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def with_arrow(df: DataFrame, sources: list[str], fields: list[T.StructField], make) -> DataFrame:
    """df with the columns `fields`, which make(arrays of the source columns) gives for each batch.

    All other columns stay as they are and where they are; columns of the fields' names are replaced.
    """
    small_batches(df.sparkSession)
    names = {x.name for x in fields}
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *fields])
    kinds = {T.LongType(): pa.int64(), T.BinaryType(): pa.binary(), T.StringType(): pa.string(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_(), T.ArrayType(T.StringType()): pa.list_(pa.string())}
    n, made_kinds = len(kept), [kinds[x.dataType] for x in fields]

    def run(batches):
        for b in batches:
            made = make([b.column(n + i) for i in range(len(sources))])
            made = [m if isinstance(m, pa.Array) else pa.array(m, k) for m, k in zip(made, made_kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), *made], names=[x.name for x in schema.fields])

    frame = df.select(*(F.col(f"`{f.name}`") for f in kept), *(F.col(f"`{c}`").alias(f"_from{i}") for i, c in enumerate(sources)))
    return frame.mapInArrow(run, schema)


#: Bits of a bit_filter(): 8 MB, whatever the table's size.
FILTER_BITS = 1 << 26
_PART = 1 << 15


def bit_of(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(FILTER_BITS))


def bit_filter(values: DataFrame, at: Column | None = None) -> Broadcast:
    """The bit_of() of all values of a one-column table, or other places `at`, as bits of a numpy array, eight a byte.

    Rows whose bit isn't set can be left out before a join with `values`; the others still have to be joined.
    """
    at = bit_of(F.col(f"`{values.columns[0]}`")) if at is None else at
    parts = values.select(at.alias("at")).groupBy(F.floor(F.col("at") / _PART).alias("part")).agg(F.bitmap_construct_agg(F.col("at") % _PART).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts.collect():
        bits[r.part * _PART // 8 : (r.part + 1) * _PART // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return values.sparkSession.sparkContext.broadcast(bits)


def set_bits(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the places are set."""
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def with_bits(df: DataFrame, name: str, bits: Broadcast) -> DataFrame:
    """The rows of df whose value of the column `name` has its bit set, without a shuffle: the bits go out as a table of _PART bits a row."""
    parts = bits.value.view("<i8").reshape(-1, _PART // 64)
    lists = pa.FixedSizeListArray.from_arrays(pa.array(parts.ravel()), parts.shape[1]).cast(pa.list_(pa.int64()))
    at, part, words = fresh(df, "at", "part", "words")
    side = df.sparkSession.createDataFrame(pa.table({part: pa.array(np.arange(len(parts)), pa.int64()), words: lists}))
    placed = df.withColumn(at, bit_of(F.col(f"`{name}`")))
    word = F.get(F.col(words), (F.shiftright(F.col(at), 6) % parts.shape[1]).cast("int"))
    is_set = F.call_function("shiftrightunsigned", word, (F.col(at) % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    return placed.join(F.broadcast(side), F.floor(F.col(at) / _PART) == F.col(part)).where(is_set).drop(at, part, words)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (u, v): rows (node, comp), comp the smallest node of the component.

    Contraction with random priorities: in each round every node joins that of itself and its
    neighbours which has the least hash under the round's seed, and the edges between what is left are
    kept once. The nodes fall by a constant factor a round, so a path of n nodes takes O(log n) rounds,
    and a star one or two. Each round is cut by a written table. Self loops and null ends are left out.
    """
    live = scratch.save(
        edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges"
    )
    labels: DataFrame | None = None
    k = 0
    while not live.isEmpty():
        both = live.select("u", "v").union(live.select(F.col("v"), F.col("u")))
        rank = lambda c: F.xxhash64(F.lit(k), c)  # noqa: B023, E731
        step = scratch.save(
            both.groupBy("u")
            .agg(F.min(F.struct(rank(F.col("v")).alias("h"), F.col("v").alias("x"))).alias("best"))
            .select(
                F.col("u").alias("node"),
                F.when(F.struct(rank(F.col("u")).alias("h"), F.col("u").alias("x")) <= F.col("best"), F.col("u")).otherwise(F.col("best.x")).alias("comp"),
            ),
            "step",
        )
        a, b = step.select(F.col("node").alias("u"), F.col("comp").alias("a")), step.select(F.col("node").alias("v"), F.col("comp").alias("b"))
        rest = (
            live.join(a, "u").join(b, "v").where("a <> b")
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        )
        nxt = scratch.save(rest, "edges")
        if labels is None:
            new = step
        else:
            to = step.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
            new = scratch.save(labels.join(to, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
            scratch.drop(labels, step)
        scratch.drop(live)
        labels, live = new, nxt
        k += 1
    scratch.drop(live)
    if labels is None:
        return scratch.spark.createDataFrame([], "node long, comp long")
    least = labels.groupBy("comp").agg(F.min("node").alias("least"))
    return labels.join(least, "comp").select("node", F.col("least").alias("comp"))
