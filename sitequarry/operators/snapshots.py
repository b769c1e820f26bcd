"""What changed between consecutive full snapshots: Merkle digests over hash ranges of the keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.operators.skew import neighbour
from sitequarry.sources.tables import materialize

#: Children of each node of the tree, a power of two, and its levels below the root.
FANOUT_BITS, LEVELS = 2, 3


def current_snapshots(snapshots: DataFrame) -> DataFrame:
    """One row a snapshot_id: the delivery with the latest ``loaded_at``; failed ones (null pages) left out.

    Deliveries that tie in ``loaded_at`` are told apart by a digest of their pages. Rows without snapshot_id,
    site_id or created_at can't be placed in a sequence and are left out. An empty array is a snapshot.
    """
    rows = snapshots.select("snapshot_id", "site_id", "created_at", "loaded_at", "pages")
    rows = rows.where("snapshot_id IS NOT NULL AND site_id IS NOT NULL AND created_at IS NOT NULL")
    rank = F.struct(F.coalesce("loaded_at", F.timestamp_micros(F.lit(-(2**55)))), F.xxhash64("pages"))
    picked = rows.groupBy("snapshot_id").agg(F.max_by(F.struct("site_id", "created_at", "pages"), rank).alias("s"))
    return picked.select("snapshot_id", "s.*").where("pages IS NOT NULL")


def _entries(pages: Column) -> Column:
    """One entry a url, its last one, ordered by hash of the url; entries without url are left out."""
    known = F.filter(pages, lambda p: p.isNotNull() & p["url"].isNotNull())
    as_entry = lambda p, i: F.struct(
        F.xxhash64(p["url"]).alias("h"), p["url"].alias("url"), (-i).alias("i"),
        F.lower(p["content_hash"]).alias("content_hash"), p["title"].alias("title"), p["description"].alias("description"),
    )
    ordered = F.sort_array(F.transform(known, as_entry))
    # after the sort by (h, url, -i) the first of a run of equal urls is the url's last entry
    with_before = F.zip_with(ordered, F.concat(F.array(F.lit(None).cast("string")), F.transform(ordered, lambda e: e["url"])), lambda e, before: F.struct(e.alias("e"), before.alias("before")))
    return F.transform(F.filter(with_before, lambda x: x["e"].isNotNull() & (x["before"].isNull() | (x["before"] != x["e"]["url"]))), lambda x: x["e"])


def _range(h: Column, level: int) -> Column:
    """Hash range of a key at a level: its top bits."""
    return F.shiftrightunsigned(h, 64 - FANOUT_BITS * level).cast("int")


def _leaf_digests(entries: Column) -> Column:
    """Digest of each leaf: entries are split level by level, so that an entry is looked at FANOUT times a level."""
    children = F.sequence(F.lit(0), F.lit(2**FANOUT_BITS - 1))
    state = lambda e: F.struct(F.xxhash64(e["url"], e["content_hash"], e["title"], e["description"]).alias("s"), _range(e["h"], LEVELS).alias("r"))

    def split(part: Column, level: int) -> Column:
        if level > LEVELS:
            return F.array(F.when(F.size(part) == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.transform(part, lambda t: t["s"]))))
        shift = FANOUT_BITS * (LEVELS - level)
        child = lambda k: F.filter(part, lambda t: F.shiftright(t["r"], shift).bitwiseAND(F.lit(2**FANOUT_BITS - 1)) == k)
        return F.flatten(F.transform(children, lambda k: split(child(k), level + 1)))

    return split(F.transform(entries, state), 1)


def merkle(current: DataFrame) -> DataFrame:
    """Replaces ``pages`` by ``entries`` and adds the digests ``leaves``, ``nodes`` and ``root``, all within the row.

    A leaf digests the states (url, hash, title, description) of the entries in its hash range, a node its
    leaves, the root all nodes. No row leaves its task.
    """
    width = 2**FANOUT_BITS
    rows = current.withColumn("entries", _entries(F.col("pages"))).drop("pages").withColumn("leaves", _leaf_digests(F.col("entries")))
    nodes = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda n: F.xxhash64(F.slice(F.col("leaves"), n * (width ** (LEVELS - 1)) + 1, width ** (LEVELS - 1))))
    return rows.withColumn("nodes", nodes).withColumn("root", F.xxhash64("nodes"))


def _differing_leaves() -> Column:
    """Leaves whose digests differ, found below nodes whose digests differ."""
    below = 2 ** (FANOUT_BITS * (LEVELS - 1))
    nodes = F.filter(F.sequence(F.lit(0), F.lit(2**FANOUT_BITS - 1)), lambda n: F.get("nodes", n) != F.get("prev_nodes", n))
    spread = F.flatten(F.transform(nodes, lambda n: F.sequence(n * below, n * below + below - 1)))
    return F.filter(spread, lambda k: F.get("leaves", k) != F.get("prev_leaves", k))


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """Records added, removed or changed between consecutive snapshots of a site.

    Columns: site_id, snapshot_id (the later one), prev_snapshot_id, url, change_type, title, detail.

    Digests are compared top-down: roots, then nodes, then leaves; only entries of leaves whose digests
    differ are exploded, shuffled and matched. Snapshots follow each other by (created_at, snapshot_id); a
    site's first one yields nothing. A url in both is changed when the hashes differ other than in case; if
    either is null, when title or description differ (null-safe). Within a snapshot a url's last entry counts.
    Empty tables give empty results; other columns of the input are ignored.
    """
    trees = materialize(merkle(current_snapshots(snapshots)))
    light = trees.select("snapshot_id", "site_id", "created_at", "root", "nodes", "leaves")
    month = F.date_format("created_at", "yyyyMM").cast("int")
    pairs = neighbour(light, ["site_id"], ["created_at", "snapshot_id"], month, ["snapshot_id", "root", "nodes", "leaves"])
    pairs = pairs.where("prev_snapshot_id IS NOT NULL AND root != prev_root")
    pairs = pairs.select("snapshot_id", "prev_snapshot_id", _differing_leaves().alias("ranges"))
    pairs = materialize(pairs)

    # a snapshot is the later one of at most one pair and the earlier one of at most one pair
    roles = pairs.select("snapshot_id", F.struct(F.col("snapshot_id").alias("later"), "ranges", F.lit(True).alias("after")).alias("role")).unionByName(
        pairs.select(F.col("prev_snapshot_id").alias("snapshot_id"), F.struct(F.col("snapshot_id").alias("later"), "ranges", F.lit(False).alias("after")).alias("role"))
    )
    sides = trees.select("snapshot_id", "site_id", "entries").join(roles, "snapshot_id")
    kept = F.filter("entries", lambda e: F.array_contains(F.col("role.ranges"), _range(e["h"], LEVELS)))
    rows = sides.select("site_id", "snapshot_id", F.col("role.later").alias("later"), F.col("role.after").alias("after"), F.explode(kept).alias("e"))
    rows = rows.select("site_id", "snapshot_id", "later", "after", "e.url", F.struct("e.content_hash", "e.title", "e.description").alias("e"))
    side = lambda which: F.first(F.when(F.col("after") == F.lit(which), F.col("e")), ignorenulls=True)
    both = rows.groupBy("later", "url").agg(
        F.first("site_id").alias("site_id"), side(True).alias("new"), side(False).alias("old"),
        F.max(F.when(~F.col("after"), F.col("snapshot_id"))).alias("prev_seen"),
    )
    differs = lambda f: ~F.col(f"new.{f}").eqNullSafe(F.col(f"old.{f}"))
    by_hash = F.col("new.content_hash") != F.col("old.content_hash")
    changed = F.coalesce(by_hash, differs("title") | differs("description"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(changed, "changed")
    title_of = lambda side: F.coalesce(F.col(f"{side}.title"), F.lit(""))
    detail = F.when(kind == "changed", F.when(differs("title"), F.concat(F.lit('Title: "'), title_of("old"), F.lit('" → "'), title_of("new"), F.lit('"'))).when(differs("description"), "Description updated").otherwise("Content updated"))
    found = both.select("site_id", F.col("later").alias("snapshot_id"), "url", kind.alias("change_type"), F.coalesce("new.title", "old.title").alias("title"), detail.alias("detail"))
    return found.where("change_type IS NOT NULL").join(pairs.select("snapshot_id", "prev_snapshot_id"), "snapshot_id")
