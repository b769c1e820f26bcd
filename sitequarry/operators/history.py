"""Snapshot hashes, text diffs, latest and retained snapshots, site upserts and monitoring views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.functions.text import js_trim
from sitequarry.operators.snapshots import snapshot_changes


def snapshot_hash(pages: Column) -> Column:
    """Fingerprint of an array of pages: independent of their order, 16 hex digits; of none that of the empty text."""
    parts = F.sort_array(F.transform(pages, lambda p: F.concat(F.coalesce(p["url"], F.lit("")), F.lit(":"), F.coalesce(p["content_hash"], F.lit("")))))
    return F.substring(F.sha2(F.array_join(parts, "\u0000"), 256), 1, 16)


def latest_deliveries(snapshots: DataFrame) -> DataFrame:
    """One row a snapshot_id: the delivery loaded last."""
    columns = [c for c in snapshots.columns if c != "snapshot_id"]
    best = F.max_by(F.struct(*columns), F.struct(F.coalesce("loaded_at", F.timestamp_micros(F.lit(-(2**55)))), F.xxhash64("pages")))
    return snapshots.where("snapshot_id IS NOT NULL").groupBy("snapshot_id").agg(best.alias("s")).select("snapshot_id", "s.*")


def latest_snapshots(snapshots: DataFrame, columns: list[str]) -> DataFrame:
    """(site_id, snapshot_id, created_at, columns) of each site's newest snapshot: one aggregation with partial maxima."""
    best = F.max_by(F.struct("snapshot_id", "created_at", *columns), F.struct("created_at", "snapshot_id"))
    return snapshots.where("site_id IS NOT NULL AND created_at IS NOT NULL").groupBy("site_id").agg(best.alias("s")).select("site_id", "s.*")


def newest(rows: DataFrame, group: list[str], order: list[str], most: int) -> DataFrame:
    """The ``most`` newest rows a group with their ``rank``; each task drops the rest before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= most)


def newest_overall(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The ``most`` newest rows of all (retention): a top-k, no global sort."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(most)


def diff_text(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, change, no, line): trimmed non-empty lines only in one of both texts, in order of first occurrence. Null counts as empty."""
    lines = lambda c: F.array_distinct(F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "\n"), js_trim), lambda x: x != ""))
    part = lambda a, b, kind: F.transform(F.array_except(lines(a), lines(b)), lambda x, i: F.struct(F.lit(kind).alias("change"), (i + 1).alias("no"), x.alias("line")))
    return pairs.select(key, F.explode(F.concat(part(after, before, "added"), part(before, after, "removed"))).alias("x")).select(key, "x.*")


def upsert_sites(sites: DataFrame, incoming: DataFrame) -> DataFrame:
    """Sites by url: new ones are added whole, known ones take name and options only."""
    old, new = sites.alias("o"), incoming.alias("n")
    both = old.join(new, F.col("o.url") == F.col("n.url"), "full_outer")
    taken = {"site_name"}
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in taken else F.when(F.col("o.url").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    return both.select(*[pick(c).alias(c) for c in sites.columns])


def mark_checked(sites: DataFrame, checked: DataFrame) -> DataFrame:
    """Sites with ``last_checked_at`` raised to that of ``checked`` (site_id, checked_at)."""
    both = sites.join(checked.groupBy("site_id").agg(F.max("checked_at").alias("checked_at")), "site_id", "left")
    return both.withColumn("last_checked_at", F.greatest("last_checked_at", "checked_at")).drop("checked_at")


def delete_sites(sites: DataFrame, snapshots: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the sites in ``gone`` (site_id)."""
    return sites.join(gone, "site_id", "left_anti"), snapshots.join(gone, "site_id", "left_anti")


def due_sites(sites: DataFrame) -> DataFrame:
    """Monitored sites in the order of a sweep: never checked ones first, then those checked longest ago."""
    return sites.where("monitoring").orderBy(F.asc_nulls_first("last_checked_at"), "site_id")


def site_status(sites: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row a site with its latest snapshot's time, page count and change count; nulls or zeros without one."""
    slim = snapshots.select("site_id", "snapshot_id", "created_at", F.greatest(F.size("pages"), F.lit(0)).alias("pages"), F.greatest(F.size("changes"), F.lit(0)).alias("changes"))
    last = latest_snapshots(slim, ["pages", "changes"]).select("site_id", F.col("created_at").alias("last_snapshot_at"), "pages", "changes")
    return sites.select("site_id", "site_name", "monitoring").join(last, "site_id", "left").fillna(0, ["pages", "changes"])


def rebuilt_snapshots(snapshots: DataFrame) -> DataFrame:
    """(site_id, snapshot_id, snapshot_hash, added, removed, changed_pages, changed): what a snapshot should say about its predecessor.

    ``changed`` is true for a site's first snapshot and where anything differs.
    """
    current = latest_deliveries(snapshots).where("pages IS NOT NULL AND site_id IS NOT NULL AND created_at IS NOT NULL")
    counts = snapshot_changes(snapshots).groupBy("snapshot_id").agg(*[F.count_if(F.col("change_type") == k).alias(n) for k, n in (("added", "added"), ("removed", "removed"), ("changed", "changed_pages"))])
    first = current.groupBy("site_id").agg(F.min_by("snapshot_id", F.struct("created_at", "snapshot_id")).alias("first_id"))
    rows = current.select("site_id", "snapshot_id", snapshot_hash(F.col("pages")).alias("snapshot_hash")).join(counts, "snapshot_id", "left").fillna(0, ["added", "removed", "changed_pages"])
    rows = rows.join(first, "site_id")
    return rows.withColumn("changed", (F.col("snapshot_id") == F.col("first_id")) | (F.col("added") + F.col("removed") + F.col("changed_pages") > 0)).drop("first_id")
