"""Queries over snapshot history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitequarry.operators.snapshots import snapshot_changes
from sitequarry.sources.tables import table


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return snapshot_changes(table(spark, root, "snapshots")).select("snapshot_id", "url", "change_type").distinct()


def p3_changes(spark: SparkSession, root: str) -> DataFrame:
    return snapshot_changes(table(spark, root, "snapshots"))


_PAIRS = """
WITH d AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY loaded_at DESC) rn FROM snapshots),
s AS (SELECT * FROM d WHERE rn = 1 AND pages IS NOT NULL),
p AS (SELECT snapshot_id, lag(snapshot_id) OVER (PARTITION BY site_id ORDER BY created_at, snapshot_id) prev_id FROM s),
e0 AS (SELECT snapshot_id, unnest(pages) pg, generate_subscripts(pages, 1) i FROM s),
e AS (SELECT snapshot_id, pg.url url, pg.title title, pg.description description, lower(pg.content_hash) h,
      row_number() OVER (PARTITION BY snapshot_id, pg.url ORDER BY i DESC) rn FROM e0 WHERE pg.url IS NOT NULL),
n AS (SELECT p.snapshot_id, p.prev_id, e.* EXCLUDE (snapshot_id, rn) FROM p JOIN e ON e.snapshot_id = p.snapshot_id AND e.rn = 1 WHERE prev_id IS NOT NULL),
o AS (SELECT p.snapshot_id, p.prev_id, e.* EXCLUDE (snapshot_id, rn) FROM p JOIN e ON e.snapshot_id = p.prev_id AND e.rn = 1),
j AS (SELECT coalesce(n.snapshot_id, o.snapshot_id) snapshot_id, coalesce(n.prev_id, o.prev_id) prev_snapshot_id, coalesce(n.url, o.url) url,
      n.title nt, o.title ot, n.description nd, o.description od, n.h nh, o.h oh, n.url nu, o.url ou
      FROM n FULL JOIN o ON n.snapshot_id = o.snapshot_id AND n.url = o.url),
c AS (SELECT *, CASE WHEN ou IS NULL THEN 'added' WHEN nu IS NULL THEN 'removed'
      WHEN coalesce(nh <> oh, nt IS DISTINCT FROM ot OR nd IS DISTINCT FROM od) THEN 'changed' END change_type FROM j)
"""

QUERIES = {"p3_found": p3_found, "p3_changes": p3_changes}
SQL = {
    "p3_found": _PAIRS + "SELECT snapshot_id, url, change_type FROM c WHERE change_type IS NOT NULL",
    "p3_changes": _PAIRS
    + """SELECT c.snapshot_id, prev_snapshot_id, (SELECT any_value(site_id) FROM s WHERE s.snapshot_id = c.snapshot_id) site_id, url, change_type,
    coalesce(nt, ot) title,
    CASE WHEN change_type = 'changed' THEN CASE WHEN nt IS DISTINCT FROM ot THEN 'Title: "' || coalesce(ot, '') || '" → "' || coalesce(nt, '') || '"'
    WHEN nd IS DISTINCT FROM od THEN 'Description updated' ELSE 'Content updated' END END detail
    FROM c WHERE change_type IS NOT NULL""",
}
