"""Cutting a plan at a table in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None
_written: list[tuple[SparkSession, str]] = []


def _shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local master without that setting takes a temporary folder."""
    global _local
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = _local = _local or "file://" + tempfile.mkdtemp(prefix="chronofit-")
    return where.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one; what is written there goes with forget()."""
    path = f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, computed once, written to the shared folder and read from there, so lost executors cost no more than reading it again.

    The table stays until the Python process ends or forget() is called, as results may read it until then.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget() -> None:
    """Delete all tables that cut() has written; results that haven't been written or collected can't be read afterwards."""
    while _written:
        spark, path = _written.pop()
        with contextlib.suppress(Exception):  # the session may be gone
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


atexit.register(forget)
