"""Deterministic splits: the order of a group is that of sha2(seed|id), so any engine gives the same rows the same role.

A row's place in that order is exact but never comes from sorting a whole group: hashes are spread evenly, so a group is cut
into ranges of hashes of about RANGE rows, each range is ranked on its own, and the counts of the ranges before are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group that are sorted together, about.
RANGE = 50_000


def shuffled(seed: int | str, row_id: str) -> Column:
    """A row's place in the shuffle, as text."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string")), 256)


def ranked(df: DataFrame, keys: Sequence[str], row_id: str, seed: int | str) -> DataFrame:
    """Add _n, the rows of the group, and _rank, the row's place from 1 in the order of its hash, then of row_id.

    Ids are to be mostly distinct, as rows of one id share a hash and so a range. Null keys are a group of their own.
    """
    d = df.withColumn("_group", F.struct(F.lit(0), *keys)).withColumn("_hash", shuffled(seed, row_id))
    d = d.join(d.groupBy("_group").agg(F.count("*").alias("_n")), "_group")
    ranges = F.greatest(F.lit(1), F.ceil(F.col("_n") / RANGE))
    place = F.coalesce(F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long"), F.lit(0))
    d = d.withColumn("_range", F.floor(place * ranges / float(1 << 32)).cast("long"))
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy("_group", "_range").agg(F.count("*").alias("_m")).select("_group", "_range", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_group", "_range").orderBy("_hash", row_id))
    return d.join(starts, ["_group", "_range"]).withColumn("_rank", F.col("_before") + own).drop("_group", "_range", "_hash", "_before")


def holdout(df: DataFrame, keys: Sequence[str], row_id: str, fraction: float, seed: int | str, held: str = "blind", rest: str = "development", least: int = 5, spare: int = 2) -> DataFrame:
    """Add split: the first round-half-even(n * fraction) rows of the shuffle, 1 at least and n - spare at most, are held.

    Groups of fewer than `least` rows have a null split.
    """
    k = F.greatest(F.lit(1), F.least(F.bround(F.col("_n") * fraction), F.col("_n") - spare))
    return ranked(df, keys, row_id, seed).withColumn("split", F.when(F.col("_n") >= least, F.when(F.col("_rank") <= k, held).otherwise(rest))).drop("_n", "_rank")


def folds(df: DataFrame, keys: Sequence[str], row_id: str, k: int, seed: int | str) -> DataFrame:
    """Add fold, 0 to k - 1, near-equal in size; the first n mod k folds have one row more."""
    at, size, more = F.col("_rank") - 1, F.floor(F.col("_n") / k), F.col("_n") % k
    longer = more * (size + 1)
    fold = F.when(at < longer, F.floor(at / (size + 1))).otherwise(more + F.floor((at - longer) / F.greatest(size, F.lit(1))))
    return ranked(df, keys, row_id, seed).withColumn("fold", fold.cast("int")).drop("_n", "_rank")


def fold_roles(df: DataFrame, k: int) -> DataFrame:
    """Each row once for every fold as outer: score in its own, train in the others."""
    out = df.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return out.withColumn("role", F.when(F.col("fold") == F.col("outer_fold"), "score").otherwise("train"))


def three_way(df: DataFrame, keys: Sequence[str], row_id: str, blind: float, validation: float, seed: int | str) -> DataFrame:
    """Add split: blind rows first, then of the rest validation rows, then train."""
    b = F.greatest(F.lit(1), F.least(F.bround(F.col("_n") * blind), F.col("_n") - 2))
    v = F.greatest(F.lit(1), F.least(F.bround((F.col("_n") - b) * validation), F.col("_n") - b - 1))
    split = F.when(F.col("_rank") <= b, "blind").when(F.col("_rank") <= b + v, "validation").otherwise("train")
    return ranked(df, keys, row_id, seed).withColumn("split", split).drop("_n", "_rank")
