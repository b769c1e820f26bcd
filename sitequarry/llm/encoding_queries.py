"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitequarry.llm.encoding import garbled, restored
from sitequarry.sources.tables import table


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return garbled(table(spark, root, "crawled_pages")).select("field", "page_id").distinct()


def p4_restored(spark: SparkSession, root: str) -> DataFrame:
    return restored(table(spark, root, "crawled_pages"))


QUERIES = {"p4_found": p4_found, "p4_restored": p4_restored}
SQL: dict[str, str] = {}
