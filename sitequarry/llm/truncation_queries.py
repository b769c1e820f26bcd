"""Queries of problem 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitequarry.llm.truncation import features, hidden_limits, truncated, truncation_rates
from sitequarry.sources.tables import materialize, table


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return truncated(table(spark, root, "documents")).select("doc_id").distinct()


def p10_rates(spark: SparkSession, root: str) -> DataFrame:
    return truncation_rates(table(spark, root, "documents"))


def p10_limits(spark: SparkSession, root: str) -> DataFrame:
    return hidden_limits(materialize(features(table(spark, root, "documents"))))


QUERIES = {"p10_found": p10_found, "p10_rates": p10_rates, "p10_limits": p10_limits}
SQL: dict[str, str] = {}
