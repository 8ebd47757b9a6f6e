"""Views of the driver's tables in the shapes that the operators take, in Spark and in SQL.

hits from events, waves from embeddings, measurements from lineitem, runs from supplier and nation, results from
orders and customer. Every mapping is a narrow projection or a join with a small dimension table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HITS_SQL = """hits AS (
  SELECT concat('r', user_id % 2) AS run_id, CAST(user_id % 4 AS INTEGER) AS board,
    CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'signup' THEN 5 WHEN 'purchase' THEN 7 ELSE 9 END AS channel,
    CAST(event_id % 2 AS INTEGER) AS edge, epoch_us(ts) // 1000000 - 1704067200 AS toa_lsb,
    CASE WHEN event_id % 2 = 0 THEN CAST(floor(value * 100) AS BIGINT) END AS tot_lsb,
    (user_id % 4) * 100 + (epoch_us(ts) // 1000000 - 1704067200) // 86400 AS event_index, event_id AS seq
  FROM events)"""

WAVES_SQL = """v AS (SELECT vec_id, vec_id // 2 AS event_index, vec_id % 2 + 1 AS detector, list_transform(embedding::DOUBLE[], lambda x: x * 1000) AS mv FROM embeddings WHERE embedding IS NOT NULL),
pairs AS (SELECT a.event_index, a.mv AS mv1, b.mv AS mv2 FROM v a JOIN v b ON a.event_index = b.event_index AND a.detector = 1 AND b.detector = 2)"""

MEASUREMENTS_SQL = """m AS (
  SELECT l_orderkey * 10 + l_linenumber AS event_index, l_returnflag || l_linestatus AS run_id,
    CAST(floor(l_quantity * l_tax * 1000) AS BIGINT) AS duration_a, CAST(floor(l_quantity * l_discount * 1000) AS BIGINT) AS duration_b,
    CAST(floor(l_extendedprice) AS BIGINT) AS timing_lsb, l_partkey % 997 AS alignment_a, l_suppkey % 97 AS alignment_b
  FROM lineitem)"""

RUNS_SQL = """runs AS (
  SELECT concat('Run', s_suppkey) AS run_id, s_suppkey AS run_number, 40 + n_regionkey AS voltage, 10.0 + 5 * (s_suppkey % 3) AS energy_threshold_mv,
    5.0 + (s_suppkey % 3) AS timing_threshold_mv, CASE WHEN s_suppkey % 2 = 0 THEN 'STREAMING' ELSE 'TRG_MATCHING' END AS acquisition_mode, s_acctbal AS ctr_ps
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

RESULTS_SQL = """results AS (
  SELECT c_nationkey AS file_id, o_orderpriority AS mode, c_mktsegment AS model, o_orderkey % 20 AS candidate, o_orderkey % 5 AS fold,
    o_totalprice / 1000 AS ctr_ps, o_orderkey AS row_id, 40 + c_nationkey % 5 AS voltage
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each edge: run_id, board, channel, edge (1 lead, 0 trail), toa_lsb, tot_lsb, event_index, seq."""
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    kind = F.col("event_type")
    channel = F.when(kind == "view", 1).when(kind == "click", 3).when(kind == "signup", 5).when(kind == "purchase", 7).otherwise(9)
    e = _table(spark, sf_dir, "events").withColumn("toa_lsb", seconds)
    return e.select(
        F.concat(F.lit("r"), (F.col("user_id") % 2).cast("string")).alias("run_id"), (F.col("user_id") % 4).cast("int").alias("board"), channel.alias("channel"),
        (F.col("event_id") % 2).cast("int").alias("edge"), "toa_lsb", F.when(F.col("event_id") % 2 == 0, F.floor(F.col("value") * 100)).alias("tot_lsb"),
        ((F.col("user_id") % 4) * 100 + F.floor(F.col("toa_lsb") / 86400)).cast("long").alias("event_index"), F.col("event_id").alias("seq"),
    )


def detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each trace: vec_id, event_index, detector (1 or 2), mv array<double>; sample i lies at (i - 16) * 100 ps."""
    e = _table(spark, sf_dir, "embeddings").where("embedding is not null")
    mv = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 1000)
    return e.select("vec_id", F.floor(F.col("vec_id") / 2).alias("event_index"), (F.col("vec_id") % 2 + 1).cast("int").alias("detector"), mv.alias("mv"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each event with both traces: event_index, mv1, mv2."""
    d = detectors(spark, sf_dir)
    return d.groupBy("event_index").agg(F.max(F.when(F.col("detector") == 1, F.col("mv"))).alias("mv1"), F.max(F.when(F.col("detector") == 2, F.col("mv"))).alias("mv2")).where("mv1 is not null and mv2 is not null")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each event: run_id, event_index, durations, timing difference and alignments in LSB."""
    c = F.col
    whole = lambda x: F.floor(x).cast("long")
    return _table(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("event_index"), F.concat("l_returnflag", "l_linestatus").alias("run_id"),
        whole(c("l_quantity") * c("l_tax") * 1000).alias("duration_a"), whole(c("l_quantity") * c("l_discount") * 1000).alias("duration_b"),
        whole(c("l_extendedprice")).alias("timing_lsb"), (c("l_partkey") % 997).alias("alignment_a"), (c("l_suppkey") % 97).alias("alignment_b"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each run: run_id, run_number, voltage, thresholds, acquisition_mode, ctr_ps."""
    k = F.col("s_suppkey")
    return _table(spark, sf_dir, "supplier").join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("Run"), k.cast("string")).alias("run_id"), k.alias("run_number"), (40 + F.col("n_regionkey")).alias("voltage"),
        (10.0 + 5 * (k % 3)).alias("energy_threshold_mv"), (5.0 + k % 3).alias("timing_threshold_mv"),
        F.when(k % 2 == 0, "STREAMING").otherwise("TRG_MATCHING").alias("acquisition_mode"), F.col("s_acctbal").alias("ctr_ps"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each scored candidate: file_id, mode, model, candidate, fold, ctr_ps, row_id, voltage."""
    k = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("file_id"), F.col("o_orderpriority").alias("mode"), F.col("c_mktsegment").alias("model"), (k % 20).alias("candidate"), (k % 5).alias("fold"),
        (F.col("o_totalprice") / 1000).alias("ctr_ps"), k.alias("row_id"), (40 + F.col("c_nationkey") % 5).alias("voltage"),
    )
