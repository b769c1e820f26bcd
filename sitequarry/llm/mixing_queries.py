"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequarry.llm.mixing import budgets, mix, shares, sized
from sitequarry.llm.rows import union_all
from sitequarry.sources.tables import table


def p9_mix(spark: SparkSession, root: str) -> DataFrame:
    return mix(table(spark, root, "documents"), table(spark, root, "mix_targets"))


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return shares(p9_mix(spark, root), table(spark, root, "mix_targets"))


def p9_budgets(spark: SparkSession, root: str) -> DataFrame:
    """Tokens that each source of a mix has and is to give, in complete epochs and the rest."""
    rows = budgets(sized(table(spark, root, "documents")), table(spark, root, "mix_targets"))
    return rows.select("mix_id", "source", *[F.col(c).cast("long").alias(c) for c in ("have", "budget", "epochs", "rest")])


def p9_faults(spark: SparkSession, root: str) -> DataFrame:
    """(fault, n): documents used too often or twice, of another source than said, sources that miss their budget by more than their longest document. None is right."""
    chosen, docs, targets = p9_mix(spark, root), table(spark, root, "documents"), table(spark, root, "mix_targets")
    most = targets.groupBy("mix_id", "source").agg(F.max("max_repeats").alias("max_repeats"))
    rows = chosen.join(most, ["mix_id", "source"]).join(docs.select("doc_id", F.col("source").alias("own")), "doc_id")
    twice = chosen.groupBy("mix_id", "source", "doc_id").count()
    given = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("given"))
    longest = sized(docs).groupBy("source").agg(F.max("tokens").alias("longest"))
    off = p9_budgets(spark, root).join(given, ["mix_id", "source"], "left").join(longest, "source")
    parts = [
        rows.select(F.lit("too often").alias("fault"), (F.col("repeats") > F.col("max_repeats")).alias("bad")), rows.select(F.lit("other source").alias("fault"), (F.col("own") != F.col("source")).alias("bad")),
        twice.select(F.lit("twice").alias("fault"), (F.col("count") > 1).alias("bad")), off.select(F.lit("off budget").alias("fault"), (F.abs(F.coalesce("given", F.lit(0)) - F.col("budget")) > F.col("longest")).alias("bad")),
    ]
    return union_all(parts).groupBy("fault").agg(F.count_if("bad").alias("n"))


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares, "p9_budgets": p9_budgets, "p9_faults": p9_faults}
SQL = {
    "p9_faults": "SELECT unnest(['too often', 'other source', 'twice', 'off budget']) fault, 0 n",
    "p9_budgets": r"""WITH t AS (SELECT source, coalesce(n_tokens, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+'))) n FROM documents WHERE source IS NOT NULL),
h AS (SELECT source, sum(n) have FROM t GROUP BY 1 HAVING sum(n) > 0),
b AS (SELECT mix_id, source, have, max_repeats, CAST(target_share AS DOUBLE) / sum(target_share) OVER (PARTITION BY mix_id) share FROM mix_targets JOIN h USING (source)),
s AS (SELECT *, min(CAST(have AS DOUBLE) * max_repeats / share) OVER (PARTITION BY mix_id) * share q FROM b)
SELECT mix_id, source, CAST(have AS BIGINT) have, CAST(floor(q + 1e-6) AS BIGINT) budget, CAST(floor(floor(q + 1e-6) / have) AS BIGINT) epochs, CAST(floor(q + 1e-6) - floor(floor(q + 1e-6) / have) * have AS BIGINT) rest FROM s""",
}
