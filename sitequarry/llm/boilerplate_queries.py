"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitequarry.llm.boilerplate import body_text, boilerplate_lines
from sitequarry.sources.tables import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return boilerplate_lines(table(spark, root, "crawled_pages"), table(spark, root, "extracted_pages")).distinct()


def p1_body(spark: SparkSession, root: str) -> DataFrame:
    return body_text(table(spark, root, "crawled_pages"), table(spark, root, "extracted_pages"))


QUERIES = {"p1_found": p1_found, "p1_body": p1_body}
SQL: dict[str, str] = {}
