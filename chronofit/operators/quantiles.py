"""Exact quantiles of many groups at once, in bounded memory.

The value of a rank is bracketed by counts: between the least and the greatest value that it can have, values are counted
in equal bins, the bin that holds the rank becomes the bracket, and so on until every bracket holds few different values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Bins of a pass, and different values that are sorted in the end.
BINS, FEW = 1024, 4096


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def counted(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """_group (a struct of the keys), v, w: the different finite values of each group with their counts."""
    d = df.select(F.struct(F.lit(0).alias("_"), *keys).alias("_group"), finite(value).alias("v")).where("v is not null")
    return d.groupBy("_group", "v").agg(F.count("*").alias("w"))


def quantiles(values: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """_group, n, q: the number of values and their quantiles, between neighbours linearly interpolated. values: _group, v, w.

    Nothing is approximate. Each pass reads values once and shuffles at most BINS rows for each rank and partition; a pass
    follows only where a bracket still holds more than FEW different values. One value, however frequent, is one row.
    """
    size = values.groupBy("_group").agg(F.sum("w").alias("n"), F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = lambda p: (F.col("n") - 1) * p
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(p)), F.ceil(place(p))) for p in fractions))))
    brackets = size.withColumn("rank", F.explode(ranks)).withColumn("below", F.lit(0).cast("long"))
    wide = (F.col("m") > FEW) & (F.col("lo") < F.col("hi"))
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    while not brackets.where(wide).isEmpty():
        length = F.col("hi") / 2 - F.col("lo") / 2  # halves, so that no difference overflows
        share = F.when(length > 0, (F.col("v") / 2 - F.col("lo") / 2) / length).otherwise((F.col("v") > F.col("lo")).cast("double"))
        bins = values.join(brackets.where(wide).drop("m"), "_group").where(inside)
        bins = bins.groupBy("_group", "n", "rank", "below", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin"))
        bins = bins.agg(F.sum("w").alias("k"), F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("k").over(Window.partitionBy("_group", "rank").orderBy("bin"))
        found = bins.withColumn("below", F.col("below") + upto - F.col("k")).where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("k")))
        brackets = cut(brackets.where(~wide).unionByName(found.drop("bin", "k")))
    # of each bracket, its few values and how many lie up to each
    upto = Window.partitionBy("_group", "rank").orderBy("v")
    rows = values.join(brackets.drop("m"), "_group").where(inside)
    at = rows.withColumn("_upto", F.col("below") + F.sum("w").over(upto)).where((F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("w") <= F.col("rank")))
    found = at.groupBy("_group", "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("_v"))

    def between(p: float) -> Column:
        low, high = F.col("_v")[F.floor(place(p))], F.col("_v")[F.ceil(place(p))]
        return F.when(low == high, low).otherwise((F.ceil(place(p)) - place(p)) * low + (place(p) - F.floor(place(p))) * high)

    return found.select("_group", "n", F.array(*map(between, fractions)).alias("q"))
