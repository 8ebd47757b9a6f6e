"""All queries of the library outside the corpus operators, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import hit_queries, ingest_queries, more_queries, stat_queries, wave_queries


def _all() -> dict:
    return hit_queries.QUERIES | wave_queries.QUERIES | stat_queries.QUERIES | more_queries.QUERIES | ingest_queries.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hit_queries.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
