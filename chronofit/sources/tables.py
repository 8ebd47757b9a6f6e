"""Table sources and sinks: pruned event scans, schema-checked unions, plain tables with missing values as null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofit.operators.stats import finite


def scan_events(spark: SparkSession, path: str, columns: Sequence[str], optional: dict[str, object] | None = None, most: int | None = None, interval: str | None = None) -> DataFrame:
    """Only the asked columns of event files; a missing one is an error, a missing optional one its default.

    With `interval`, all rows must have one sampling interval to a relative 1e-9.
    """
    df = spark.read.parquet(path)
    lack = [c for c in columns if c not in df.columns]
    if lack:
        raise ValueError(f"missing columns: {', '.join(lack)}")
    out = df.select(*columns, *(F.col(c) if c in df.columns else F.lit(v).alias(c) for c, v in (optional or {}).items()))
    if interval:
        lo, hi = df.agg(F.min(interval), F.max(interval)).first()
        if lo is not None and abs(hi - lo) > 1e-9 * abs(hi):
            raise ValueError(f"sampling intervals differ: {lo} and {hi}")
    return out.limit(most) if most is not None else out


def checked_union(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of frames with the same column names and types; the error names what is missing, extra or changed."""
    want = {f.name: f.dataType.simpleString() for f in frames[0].schema.fields}
    out = frames[0]
    for k, df in enumerate(frames[1:], 1):
        have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        wrong = [f"missing {c}" for c in want.keys() - have.keys()] + [f"extra {c}" for c in have.keys() - want.keys()] + [f"changed {c}" for c in want.keys() & have.keys() if want[c] != have[c]]
        if wrong:
            raise ValueError(f"table {k}: {'; '.join(sorted(wrong))}")
        out = out.unionByName(df)
    return out


def plain(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The fields in order, non-finite floats as null."""
    kinds = dict(df.dtypes)
    return df.select(*(finite(F.col(c)).cast(kinds[c]).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in fields))


def write_table(df: DataFrame, fields: Sequence[str], path: str, kind: str = "parquet") -> None:
    """Write a fixed list of fields as zstd Parquet or as CSV with a header."""
    out = plain(df, fields).write.mode("overwrite")
    if kind == "parquet":
        out.option("compression", "zstd").parquet(path)
    else:
        out.option("header", True).csv(path)


def prepared(events: DataFrame, selected: DataFrame, keys: Sequence[str], path: str, file: str = "file_id") -> DataFrame:
    """Write all columns of the selected events, one folder for each file, and return the manifest: file, n, columns."""
    events.join(selected.select(*keys).distinct(), list(keys), "left_semi").write.mode("overwrite").partitionBy(file).parquet(path)
    back = events.sparkSession.read.parquet(path)
    return back.groupBy(file).agg(F.count("*").alias("n")).withColumn("columns", F.array(*(F.lit(c) for c in events.columns)))
