"""Registered queries and the SQL each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import build_queries, learning_queries, pit_queries, series_queries, source_queries

GROUPS = (pit_queries.QUERIES, series_queries.QUERIES, learning_queries.QUERIES, build_queries.QUERIES, source_queries.QUERIES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was knowable at the cutoff under the observed policy, one version of each key."""
    return pit_queries.observed_head(spark, sf_dir)


def queries() -> dict:
    return {name: run for group in GROUPS for name, (run, _) in group.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, (_, sql) in group.items() if sql}
