"""Joins and lookups that keep working when one key holds a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.sources.tables import materialize


def attach(facts: DataFrame, lookup: DataFrame, keys: list[str], rows: str, total: int, hot_share: float = 1 / 256) -> DataFrame:
    """Inner join of ``facts`` with ``lookup`` (one row a key), safe against hot keys.

    ``lookup[rows]`` is the number of fact rows of the key and ``total`` the number of all fact rows.
    A key is hot when it has at least ``hot_share`` of them, so there are at most ``1 / hot_share`` hot
    keys whatever the input: only these are broadcast. All other keys are joined by a shuffle, in
    which no key has more than that share. Null keys match null keys. ``lookup[rows]`` stays in the result.
    """
    least = max(total * hot_share, 1.0)
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    other = lookup.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    hot, cold = other.where(F.col(rows) >= least), other.where(F.col(rows) < least)
    flags = hot.select(*names.values(), F.lit(True).alias("_hot"))
    marked = facts.join(F.broadcast(flags), same, "left").drop(*names.values())
    from_hot = marked.where("_hot").drop("_hot").join(F.broadcast(hot), same).drop(*names.values())
    from_cold = marked.where("_hot IS NULL").drop("_hot").join(cold, same).drop(*names.values())
    return from_hot.unionByName(from_cold)


def neighbour(rows: DataFrame, group: list[str], order: list[str], bucket: Column, value: list[str], prefix: str = "prev_") -> DataFrame:
    """``lag(value)`` in ``group`` by ``order``, without one task for a whole group.

    ``bucket`` must not fall when ``order`` rises. A window runs in each (group, bucket); the first
    row of a bucket takes the last row of the preceding non-empty bucket, found over one row a bucket.
    The first row of a group gets nulls.
    """
    rows = rows.withColumn("_bucket", bucket)
    inner = Window.partitionBy(*group, "_bucket").orderBy(*order)
    packed = F.struct(*value)
    lagged = rows.withColumn("_lag", F.lag(packed).over(inner)).withColumn("_no", F.row_number().over(inner))
    last = rows.groupBy(*group, "_bucket").agg(F.max_by(packed, F.struct(*order)).alias("_last"))
    outer = Window.partitionBy(*group).orderBy("_bucket")
    carry = last.select(*group, "_bucket", F.lag("_last").over(outer).alias("_carry"), F.lit(1).alias("_no"))
    joined = lagged.join(carry, [*group, "_bucket", "_no"], "left")
    picked = F.when(F.col("_no") == 1, F.col("_carry")).otherwise(F.col("_lag"))
    return joined.select(*[c for c in rows.columns if c != "_bucket"], *[picked[v].alias(prefix + v) for v in value])


#: Slots of :func:`sieve`.
SLOTS = 1 << 21


def sieve(rows: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts without a shuffle of them: those whose key may be among ``wanted`` (one column), and those whose key is not.

    The wanted keys are reduced to the slots of a hash, of which there are at most SLOTS whatever the input; only these
    are broadcast. The first part holds all wanted rows and a few others, so a join with the wanted keys must follow,
    but it shuffles these only. With many more wanted keys than slots all rows are in the first part, which is slower,
    not wrong. A null key is in the second part.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")
    name = wanted.columns[0]
    slots = materialize(wanted.where(F.col(name).isNotNull()).select(slot(F.col(name)).alias("_slot")).distinct()).withColumn("_in", F.lit(True))
    marked = rows.withColumn("_slot", F.when(F.col(key).isNotNull(), slot(F.col(key)))).join(F.broadcast(slots), "_slot", "left").drop("_slot")
    return marked.where("_in").drop("_in"), marked.where("_in IS NULL").drop("_in")


def newest_rows(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """One row a ``key``, the one with the greatest ``order`` (ties: any of the equal rows); rows with a null key are left out.

    Where few keys come more than once only their rows are shuffled whole, see :func:`sieve`; of the others just the keys.
    """
    rows = rows.where(F.col(key).isNotNull())
    repeated = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    doubtful, sure = sieve(rows, key, repeated)
    names = [c for c in rows.columns if c != key]
    best = doubtful.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("_r")).select(key, "_r.*")
    return sure.select(key, *names).unionByName(best)
