"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitequarry.llm.residue import residue_spans, without_residue
from sitequarry.sources.tables import table


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return residue_spans(table(spark, root, "crawled_pages")).select("field", "page_id").distinct()


def p7_rest(spark: SparkSession, root: str) -> DataFrame:
    return without_residue(table(spark, root, "crawled_pages"))


QUERIES = {"p7_found": p7_found, "p7_rest": p7_rest}
SQL: dict[str, str] = {}
