"""Steps whose cost once grew faster than their input, or gathered it in a few tasks."""

from pyspark.sql import functions as F

from chronofit.operators import reports, selection


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_alignment_filter_leaves_events_where_they_are(spark):
    """Few groups: events aren't shuffled by them."""
    d = spark.range(3_000_000).select(F.substring("id", -1, 1).isin("1", "2").cast("string").alias("k"), (F.col("id") % 101).alias("a"), (F.col("id") % 7).alias("b"), "id")
    out = selection.alignment_filter(d, ["k"], ["a", "b"], z=1.0, floor=0.0)
    assert "hashpartitioning" not in plan(out) and "BroadcastHashJoin" in plan(out)
    assert out.count() == d.where((F.abs(F.col("a") - 50) <= 1.4826 * 25) & (F.abs(F.col("b") - 3) <= 1.4826 * 2)).count()
    assert selection.alignment_filter(d.limit(5), ["k"], []).count() == 5


def test_partners_are_drawn_once(spark, monkeypatch):
    given = []
    plain = reports.pair_similarity
    monkeypatch.setattr(reports, "pair_similarity", lambda df, i, a, b, pairs: given.append(pairs) or plain(df, i, a, b, pairs))
    d = spark.createDataFrame([(i, [1.0, float(i)], [float(i), 2.0]) for i in range(12)], "e long, x array<double>, y array<double>")
    out = {r.kind: r.n for r in reports.similarity_distribution(d, "e", "x", "y", 12, 4, 3).collect()}
    assert out == {"matched": 12, "random": 48}
    assert "md5" not in plan(given[0])
    drawn = reports.random_pairs(d, "e", 12, 4, 3)
    assert drawn.where("i = j").isEmpty() and drawn.groupBy("draw").agg(F.countDistinct("j").alias("n")).where("n = 12").count() == 4
