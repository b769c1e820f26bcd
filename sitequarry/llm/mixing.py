"""Mixing sources to target weights: weighted sampling without replacement after complete epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.llm.tokens import document_tokens
from sitequarry.sources.tables import materialize

#: Key ranges of a (mix, source): prefix sums run over their sums; only the range that holds the limit is sorted.
RANGES = 4096
#: mix_targets rows may be broadcast up to this number; beyond it they are joined by a shuffle.
MOST_TARGETS = 10_000


def quality(text: Column, tokens: Column) -> Column:
    """Weight in (0, 1]: share of letters and spaces in the text, less for very short documents; 0.5 without a text."""
    letters = F.length(F.regexp_replace(text, r"(?U)[^\p{L}\s]", "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.coalesce(letters * F.least(F.lit(1.0), (tokens + 16) / 128), F.lit(0.5)), F.lit(0.01))


def sized(documents: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, weight) of the documents that have tokens."""
    rows = documents.withColumn("tokens", document_tokens(F.col("n_tokens"), F.col("text")))
    return rows.select("doc_id", "source", "tokens", quality(F.col("text"), F.col("tokens")).alias("weight")).where("tokens > 0 AND doc_id IS NOT NULL")


def budgets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a (mix_id, source) that has documents: epochs, rest (tokens to sample beyond them) and totals.

    A mix's size is the greatest at which every source present can fill its share within ``max_repeats``. Sources
    without documents are left out and the other shares grow in proportion. Rows without a positive share or
    repeat are ignored; several rows of one source add their shares and take the smallest repeat.
    """
    have = rows.groupBy("source").agg(F.sum("tokens").alias("have"))
    wanted = targets.where("target_share > 0 AND max_repeats > 0 AND mix_id IS NOT NULL").groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    both = wanted.join(have, "source")
    mix = Window.partitionBy("mix_id")
    share = F.col("target_share") / F.sum("target_share").over(mix)
    both = both.withColumn("share", share)
    both = both.withColumn("size", F.min(F.col("have") * F.col("max_repeats") / F.col("share")).over(mix))
    both = both.withColumn("budget", F.floor(F.col("size") * F.col("share") + 1e-6))
    both = both.withColumn("epochs", F.floor(F.col("budget") / F.col("have")))
    return both.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("have"))


def mix(documents: DataFrame, targets: DataFrame, seed: int = 20260) -> DataFrame:
    """(mix_id, source, doc_id, tokens, repeats): the chosen documents.

    Each source first gives its complete epochs, then a weighted sample without replacement: a document's key is
    -ln(u) / weight with u from a hash of seed, mix and doc_id; documents are taken by rising key until the rest of
    the budget is reached (one is taken if at least half of it fits). Keys are cut into RANGES ranges whose sums give
    the prefix sums; only the range holding the limit is sorted, so no task sees a whole source. No document is
    used more than ``max_repeats`` times. Documents of null source can't be named by a mix. Empty tables give no rows.
    """
    rows = materialize(sized(documents))
    plan = materialize(budgets(rows, targets))
    small = F.broadcast(plan) if plan.count() <= MOST_TARGETS else plan
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix_id", "doc_id"), 11) + F.lit(0.5)) / F.lit(float(2**53))
    key = -F.log(u) / F.col("weight")
    keyed = rows.join(small.select("mix_id", "source", "epochs", "rest"), "source").withColumn("key", key)
    keyed = keyed.withColumn("range", F.floor(F.col("key") / (F.col("key") + 1) * RANGES).cast("int"))
    sums = keyed.where("rest > 0").groupBy("mix_id", "source", "rest", "range").agg(F.sum("tokens").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("mix_id", "source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = sums.withColumn("before", before).where("before < rest AND before + sum >= rest").select("mix_id", "source", F.col("range").alias("edge"), "before")
    # one row a (mix, source), as in plan
    edge = F.broadcast(edge) if plan.count() <= MOST_TARGETS else edge
    marked = keyed.join(edge, ["mix_id", "source"], "left")
    at_edge = marked.where("range = edge")
    running = F.sum("tokens").over(Window.partitionBy("mix_id", "source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    taken = at_edge.withColumn("start", F.col("before") + F.coalesce(running, F.lit(0)))
    taken = taken.withColumn("extra", (F.col("start") + F.col("tokens") / 2 <= F.col("rest")).cast("int"))
    others = marked.where("edge IS NULL OR range != edge").withColumn("extra", F.coalesce((F.col("range") < F.col("edge")).cast("int"), F.lit(0)))
    columns = ["mix_id", "source", "doc_id", "tokens", (F.col("epochs") + F.col("extra")).cast("int").alias("repeats")]
    return others.select(*columns).unionByName(taken.select(*columns)).where("repeats > 0")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, actual_share, deviation, tokens, documents, most_repeats) of every target; zeros for sources without documents.

    ``deviation`` is the actual less the target share: a source without documents leaves its share to the others.
    """
    got = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    wanted = targets.groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"))
    both = wanted.join(got, ["mix_id", "source"], "left").fillna(0, ["tokens", "documents", "most_repeats"])
    total = F.sum("tokens").over(Window.partitionBy("mix_id"))
    actual = F.when(total > 0, F.col("tokens") / total).otherwise(0.0)
    return both.select("mix_id", "source", "target_share", F.round(actual, 9).alias("actual_share"), F.round(actual - F.col("target_share"), 9).alias("deviation"), "tokens", "documents", "most_repeats")
