"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequarry.llm.packing import pack
from sitequarry.llm.rows import union_all
from sitequarry.sources.tables import table


def p8_pack(spark: SparkSession, root: str) -> DataFrame:
    return pack(table(spark, root, "documents"), table(spark, root, "containers"))


def p8_fill(spark: SparkSession, root: str) -> DataFrame:
    """Containers, the fewest that its blocks can do with, tokens and the share of capacity in use, a kind."""
    rows = p8_pack(spark, root).where("place = 1").withColumn("own", F.when(F.col("block") < 0, F.col("container_no")))
    block = rows.groupBy("container_kind", "capacity", "block", "own").agg(F.count("*").alias("n"), F.sum("fill").alias("fill"), F.first("least").alias("least"))
    out = block.groupBy("container_kind", "capacity").agg(F.sum("n").alias("containers"), F.sum("least").alias("least"), F.sum("fill").alias("tokens"))
    return out.withColumn("used", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))


def p8_faults(spark: SparkSession, root: str) -> DataFrame:
    """(fault, n): containers over their capacity or with a wrong fill, pieces missing or doubled, documents split that would fit. None is right."""
    rows = p8_pack(spark, root)
    bins = rows.groupBy("container_kind", "block", "container_no").agg(F.sum("tokens").alias("tokens"), F.max("fill").alias("fill"), F.max("capacity").alias("capacity"))
    docs = rows.groupBy("container_kind", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"), F.count_distinct("piece_no").alias("numbers"), F.max("capacity").alias("capacity"))
    parts = [
        bins.select(F.lit("over capacity").alias("fault"), (F.col("tokens") > F.col("capacity")).alias("bad")), bins.select(F.lit("wrong fill").alias("fault"), (F.col("tokens") != F.col("fill")).alias("bad")),
        docs.select(F.lit("pieces").alias("fault"), (F.col("pieces") != F.col("numbers")).alias("bad")), docs.select(F.lit("needless split").alias("fault"), (F.col("pieces") != F.ceil(F.col("tokens") / F.col("capacity"))).alias("bad")),
    ]
    return union_all(parts).groupBy("fault").agg(F.count_if("bad").alias("n"))


def p8_placed(spark: SparkSession, root: str) -> DataFrame:
    """(container_kind, doc_id, tokens, pieces): what was placed of each document."""
    rows = p8_pack(spark, root)
    return rows.groupBy("container_kind", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))


QUERIES = {"p8_pack": p8_pack, "p8_fill": p8_fill, "p8_faults": p8_faults, "p8_placed": p8_placed}
SQL = {
    "p8_faults": "SELECT unnest(['over capacity', 'wrong fill', 'pieces', 'needless split']) fault, 0 n",
    "p8_placed": r"""WITH t AS (SELECT doc_id, coalesce(n_tokens, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+'))) n FROM documents)
SELECT container_kind, doc_id, n tokens, CAST(ceil(n / capacity_tokens) AS BIGINT) pieces FROM t, containers WHERE n > 0""",
}
