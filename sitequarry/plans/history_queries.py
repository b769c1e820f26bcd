"""Snapshot history, sites, jobs and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequarry.operators import history, validate
from sitequarry.operators.progress import progress
from sitequarry.operators.skew import neighbour
from sitequarry.plans.snapshot_queries import _PAIRS
from sitequarry.sources.tables import table
from sitequarry.streaming.refresh import crawl_rate_stream, latest_snapshot_stream


def _snapshots(spark: SparkSession, root: str) -> DataFrame:
    return history.latest_deliveries(table(spark, root, "snapshots")).where("pages IS NOT NULL")


def snapshot_hashes(spark: SparkSession, root: str) -> DataFrame:
    return _snapshots(spark, root).select("snapshot_id", history.snapshot_hash(F.col("pages")).alias("snapshot_hash"))


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame:
    rows = _snapshots(spark, root).select("site_id", "snapshot_id", "created_at", F.size("pages").cast("long").alias("pages"))
    return history.latest_snapshots(rows, ["pages"])


def top_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """The 3 newest snapshots of each site: a top-k report."""
    return history.newest(_snapshots(spark, root).select("site_id", "snapshot_id", "created_at"), ["site_id"], ["created_at", "snapshot_id"], 3)


def diff_text(spark: SparkSession, root: str) -> DataFrame:
    """Lines of each index file that its site's preceding one lacks, and the reverse."""
    rows = _snapshots(spark, root).select("site_id", "snapshot_id", "created_at", "llms_txt")
    pairs = neighbour(rows, ["site_id"], ["created_at", "snapshot_id"], F.date_format("created_at", "yyyyMM").cast("int"), ["snapshot_id", "llms_txt"])
    return history.diff_text(pairs.where("prev_snapshot_id IS NOT NULL"), "snapshot_id", "prev_llms_txt", "llms_txt")


def rebuilt_snapshots(spark: SparkSession, root: str) -> DataFrame:
    return history.rebuilt_snapshots(table(spark, root, "snapshots"))


def upsert_sites(spark: SparkSession, root: str) -> DataFrame:
    """Sites after an upsert of all sites under new names, those checked never under new urls."""
    sites = table(spark, root, "sites")
    url = F.when(F.col("last_checked_at").isNull(), F.concat("url", F.lit("new/"))).otherwise(F.col("url"))
    incoming = sites.select(F.concat(F.lit("new-"), "site_id").alias("site_id"), url.alias("url"), F.concat("site_name", F.lit(" II")).alias("site_name"), (~F.col("monitoring")).alias("monitoring"), "created_at", "last_checked_at")
    return history.upsert_sites(sites, incoming)


def checked_sites(spark: SparkSession, root: str) -> DataFrame:
    jobs = table(spark, root, "job_summaries").where("status = 'done'").select("site_id", F.col("updated_at").alias("checked_at"))
    return history.mark_checked(table(spark, root, "sites"), jobs).select("site_id", "last_checked_at")


def delete_cascade(spark: SparkSession, root: str) -> DataFrame:
    """Snapshots left after sites that aren't monitored are deleted."""
    sites = table(spark, root, "sites")
    _, left = history.delete_sites(sites, _snapshots(spark, root).select("site_id", "snapshot_id"), sites.where("NOT monitoring").select("site_id"))
    return left


def due_sites(spark: SparkSession, root: str) -> DataFrame:
    return history.due_sites(table(spark, root, "sites")).select("site_id", "last_checked_at")


def site_status(spark: SparkSession, root: str) -> DataFrame:
    out = history.site_status(table(spark, root, "sites"), _snapshots(spark, root))
    return out.withColumns({"pages": F.col("pages").cast("long"), "changes": F.col("changes").cast("long")})


def retained_jobs(spark: SparkSession, root: str) -> DataFrame:
    """The 50 newest jobs: retention."""
    return history.newest_overall(table(spark, root, "job_summaries").select("job_id", "updated_at"), ["updated_at", "job_id"], 50)


def job_progress(spark: SparkSession, root: str) -> DataFrame:
    return progress(table(spark, root, "job_summaries"))


def validate_snapshots(spark: SparkSession, root: str) -> DataFrame:
    files = _snapshots(spark, root).select("snapshot_id", "llms_txt")
    return validate.verdicts(files, "snapshot_id", "llms_txt")


def validate_documents(spark: SparkSession, root: str) -> DataFrame:
    """Issues of all documents read as index files."""
    files = table(spark, root, "documents").select("doc_id", "text")
    return validate.issues(validate.lines(files, "doc_id", "text"), files, "doc_id", "text")


def index_links(spark: SparkSession, root: str) -> DataFrame:
    """Links of all stored index files under their sections."""
    files = _snapshots(spark, root).select("snapshot_id", "llms_txt")
    return validate.sections(validate.lines(files, "snapshot_id", "llms_txt"), "snapshot_id")


def latest_snapshot_streamed(spark: SparkSession, root: str) -> DataFrame:
    return latest_snapshot_stream(spark, root).withColumn("pages", F.col("pages").cast("long"))


def crawl_rate_streamed(spark: SparkSession, root: str) -> DataFrame:
    return crawl_rate_stream(spark, root)


_S = "WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY loaded_at DESC) rn FROM snapshots) WHERE rn = 1 AND pages IS NOT NULL) "
_TRIM = r"regexp_replace({}, '^[\s\x{00A0}\x{FEFF}]+|[\s\x{00A0}\x{FEFF}]+$', '', 'g')"
_LINES = (
    lambda source, key, text: rf"""WITH f AS ({source}),
l0 AS (SELECT {key}, unnest(string_split_regex({text}, '\r?\n')) raw, generate_subscripts(string_split_regex({text}, '\r?\n'), 1) AS no FROM f WHERE {text} IS NOT NULL),
l1 AS (SELECT {key}, no, {_TRIM.replace("{}", "raw")} line FROM l0),
l2 AS (SELECT *, line LIKE '# %' h1, line LIKE '## %' h2 FROM l1 WHERE line <> ''),
l3 AS (SELECT *, coalesce(bool_or(h1) OVER w, false) titled FROM l2 WINDOW w AS (PARTITION BY {key} ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l4 AS (SELECT *, titled AND h2 AS sec FROM l3),
l5 AS (SELECT *, coalesce(count(*) FILTER (sec) OVER w, 0) secs FROM l4 WINDOW w AS (PARTITION BY {key} ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l6 AS (SELECT *, titled AND NOT h1 AND NOT h2 AND NOT regexp_matches(line, '^#{{3,}}\s') AND line NOT LIKE '>%' AND secs = 0 AS det FROM l5),
l7 AS (SELECT *, coalesce(count(*) FILTER (det) OVER w, 0) dets FROM l6 WINDOW w AS (PARTITION BY {key} ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, CASE WHEN h1 AND titled THEN 'second' WHEN h1 THEN 'title' WHEN NOT titled THEN 'before' WHEN h2 THEN 'section' WHEN regexp_matches(line, '^#{{3,}}\s') THEN 'deep'
  WHEN line LIKE '>%' THEN CASE WHEN secs > 0 OR dets > 0 THEN 'late' ELSE 'summary' END
  WHEN secs > 0 THEN CASE WHEN regexp_matches(line, '^-\s+\[([^\]]+)\]\(([^)\s]+)\)\s*(?::\s*(.*))?$') THEN 'link' WHEN line LIKE '-%' THEN 'bad' ELSE 'free' END ELSE 'detail' END AS role,
  regexp_extract(line, '^-\s+\[([^\]]+)\]\(([^)\s]+)\)', 2) AS url FROM l7),
u AS (SELECT *, CASE WHEN role = 'link' THEN row_number() OVER (PARTITION BY {key}, role, url ORDER BY no) END nth FROM r),
i AS (SELECT {key}, CASE WHEN role IN ('second', 'before', 'bad') THEN 'error' ELSE 'warning' END AS level, CAST(no AS INTEGER) AS line, CASE role WHEN 'second' THEN 'Only one H1 title is allowed' WHEN 'before' THEN 'Content appears before the H1 title'
    WHEN 'deep' THEN 'Headings deeper than H2 are not part of the format' WHEN 'late' THEN 'The blockquote summary should directly follow the title'
    WHEN 'bad' THEN 'List item must look like `- [title](url): optional notes`' ELSE 'Free text inside a section is ignored by parsers' END AS message FROM u WHERE role IN ('second', 'before', 'deep', 'late', 'bad', 'free')
  UNION ALL SELECT {key}, 'warning', CAST(no AS INTEGER), 'Duplicate link: ' || url FROM u WHERE nth > 1
  UNION ALL SELECT {key}, 'warning', CAST(no AS INTEGER), 'Link should be absolute: ' || url FROM u WHERE role = 'link' AND NOT regexp_matches(url, '^(?i)https?://') AND url NOT LIKE '/%'
  UNION ALL SELECT {key}, 'error', NULL, 'Missing required H1 title' FROM f WHERE {text} IS NOT NULL AND {key} NOT IN (SELECT {key} FROM u WHERE role = 'title')
  UNION ALL SELECT {key}, 'warning', NULL, 'No blockquote summary; agents rely on it for context' FROM f WHERE {text} IS NOT NULL AND {key} NOT IN (SELECT {key} FROM u WHERE role IN ('summary', 'late'))
  UNION ALL SELECT {key}, 'warning', NULL, 'No link sections found' FROM f WHERE {text} IS NOT NULL AND {key} NOT IN (SELECT {key} FROM u WHERE role = 'link'))
"""
)
_TIMES = {
    "latest_snapshot": ["created_at"], "top_snapshots": ["created_at"], "upsert_sites": ["created_at", "last_checked_at"], "checked_sites": ["last_checked_at"], "due_sites": ["last_checked_at"],
    "site_status": ["last_snapshot_at"], "retained_jobs": ["updated_at"], "latest_snapshot_streamed": ["created_at"], "crawl_rate_streamed": ["window_start"],
}


def _with_text_times(query: Callable[[SparkSession, str], DataFrame], columns: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with its times as text in UTC, so that results compare whatever the reader's time zone."""
    return lambda spark, root: query(spark, root).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


QUERIES = {
    "snapshot_hashes": snapshot_hashes, "latest_snapshot": latest_snapshot, "top_snapshots": top_snapshots, "diff_text": diff_text, "rebuilt_snapshots": rebuilt_snapshots, "upsert_sites": upsert_sites,
    "checked_sites": checked_sites, "delete_cascade": delete_cascade, "due_sites": due_sites, "site_status": site_status, "retained_jobs": retained_jobs, "job_progress": job_progress,
    "validate_snapshots": validate_snapshots, "validate_documents": validate_documents, "index_links": index_links, "latest_snapshot_streamed": latest_snapshot_streamed, "crawl_rate_streamed": crawl_rate_streamed,
}
_LATEST = _S + "SELECT site_id, snapshot_id, created_at, len(pages) pages FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY created_at DESC, snapshot_id DESC) r FROM s) WHERE r = 1"
_SPLIT = "list_distinct(list_filter(list_transform(string_split(coalesce(__T__, ''), E'\\n'), lambda x: " + _TRIM.replace("{}", "x") + "), lambda x: x <> ''))"
_HASH = "substr(sha256(coalesce((SELECT string_agg(coalesce(x.url, '') || ':' || coalesce(x.content_hash, ''), chr(0) ORDER BY coalesce(x.url, '') || ':' || coalesce(x.content_hash, '')) FROM (SELECT unnest(pages) x)), '')), 1, 16)"
SQL = {
    "rebuilt_snapshots": _PAIRS
    + f", k AS (SELECT snapshot_id, count(*) FILTER (change_type = 'added') added, count(*) FILTER (change_type = 'removed') removed, count(*) FILTER (change_type = 'changed') changed_pages FROM c WHERE change_type IS NOT NULL GROUP BY 1) "
    f"SELECT s.site_id, s.snapshot_id, {_HASH} snapshot_hash, coalesce(added, 0) added, coalesce(removed, 0) removed, coalesce(changed_pages, 0) changed_pages, prev_id IS NULL OR k.snapshot_id IS NOT NULL changed FROM s JOIN p USING (snapshot_id) LEFT JOIN k USING (snapshot_id)",
    "snapshot_hashes": _S + f"SELECT snapshot_id, {_HASH} snapshot_hash FROM s",
    "latest_snapshot": _LATEST,
    "top_snapshots": _S + "SELECT site_id, snapshot_id, created_at, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY created_at DESC, snapshot_id DESC) r FROM s) WHERE r <= 3",
    "diff_text": _S
    + ", p AS (SELECT snapshot_id, llms_txt a, lag(llms_txt) OVER w b, lag(snapshot_id) OVER w pid FROM s WINDOW w AS (PARTITION BY site_id ORDER BY created_at, snapshot_id)), "
    + "t AS (SELECT snapshot_id, unnest(string_split(coalesce(a, ''), E'\\n')) x, generate_subscripts(string_split(coalesce(a, ''), E'\\n'), 1) i, 'added' c FROM p WHERE pid IS NOT NULL UNION ALL SELECT snapshot_id, unnest(string_split(coalesce(b, ''), E'\\n')), generate_subscripts(string_split(coalesce(b, ''), E'\\n'), 1), 'removed' FROM p WHERE pid IS NOT NULL), "
    + f"d AS (SELECT snapshot_id, c, {_TRIM.replace('{}', 'x')} AS line, min(i) i FROM t GROUP BY ALL HAVING {_TRIM.replace('{}', 'x')} <> ''), "
    + "e AS (SELECT d.* FROM d WHERE NOT EXISTS (FROM d o WHERE o.snapshot_id = d.snapshot_id AND o.line = d.line AND o.c <> d.c)) SELECT snapshot_id, c AS change, CAST(row_number() OVER (PARTITION BY snapshot_id, c ORDER BY i) AS INTEGER) AS no, line FROM e",
    "upsert_sites": "WITH n AS (SELECT 'new-' || site_id site_id, CASE WHEN last_checked_at IS NULL THEN url || 'new/' ELSE url END url, site_name || ' II' site_name, NOT monitoring monitoring, created_at, last_checked_at FROM sites) "
    "SELECT CASE WHEN o.url IS NOT NULL THEN o.site_id ELSE n.site_id END site_id, coalesce(o.url, n.url) url, coalesce(n.site_name, o.site_name) site_name, CASE WHEN o.url IS NOT NULL THEN o.monitoring ELSE n.monitoring END monitoring, "
    "CASE WHEN o.url IS NOT NULL THEN o.created_at ELSE n.created_at END created_at, CASE WHEN o.url IS NOT NULL THEN o.last_checked_at ELSE n.last_checked_at END last_checked_at FROM sites o FULL JOIN n ON o.url = n.url",
    "checked_sites": "SELECT s.site_id, greatest(s.last_checked_at, max(j.updated_at)) last_checked_at FROM sites s LEFT JOIN job_summaries j ON j.site_id = s.site_id AND j.status = 'done' GROUP BY s.site_id, s.last_checked_at",
    "delete_cascade": _S + "SELECT site_id, snapshot_id FROM s WHERE site_id NOT IN (SELECT site_id FROM sites WHERE NOT monitoring)",
    "due_sites": "SELECT site_id, last_checked_at FROM sites WHERE monitoring ORDER BY last_checked_at NULLS FIRST, site_id",
    "site_status": _S + ", l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY created_at DESC, snapshot_id DESC) r FROM s) WHERE r = 1) SELECT t.site_id, site_name, monitoring, l.created_at last_snapshot_at, coalesce(len(pages), 0) pages, coalesce(len(changes), 0) changes FROM sites t LEFT JOIN l USING (site_id)",
    "retained_jobs": "SELECT job_id, updated_at FROM job_summaries ORDER BY updated_at DESC, job_id DESC LIMIT 50",
    "job_progress": "WITH a AS (SELECT *, coalesce(status = 'running' AND heartbeat.beat_at > updated_at, false) live FROM job_summaries), b AS (SELECT job_id, status, target, CASE WHEN live THEN greatest(fetched, heartbeat.fetched) ELSE fetched END fetched, CASE WHEN live THEN heartbeat.queued ELSE queued END queued FROM a) "
    "SELECT *, CAST(CASE WHEN status = 'done' THEN 100 ELSE least(99, floor(fetched / CAST(greatest(least(target, fetched + queued), 1) AS DOUBLE) * 100 + 0.5)) END AS INTEGER) percent FROM b",
    "validate_snapshots": _LINES(_S + "SELECT snapshot_id, llms_txt FROM s", "snapshot_id", "llms_txt")
    + r""", k AS (SELECT snapshot_id, count(*) FILTER (level = 'error') errors, count(*) FILTER (level = 'warning') warnings FROM i GROUP BY ALL),
  m AS (SELECT snapshot_id, max(CASE WHEN role = 'title' THEN trim(substr(line, 3)) END) title, string_agg(CASE WHEN role IN ('summary', 'late') THEN trim(regexp_replace(line, '^>\s?', '')) END, ' ' ORDER BY no) summary, count(*) FILTER (role = 'section') sections, count(*) FILTER (role = 'link') links FROM u GROUP BY ALL)
  SELECT f.snapshot_id, coalesce(errors, 0) = 0 valid, coalesce(errors, 0) errors, coalesce(warnings, 0) warnings, title, CASE WHEN title IS NOT NULL THEN nullif(summary, '') END summary, coalesce(sections, 0) sections, coalesce(links, 0) links
  FROM f LEFT JOIN k USING (snapshot_id) LEFT JOIN m USING (snapshot_id) WHERE llms_txt IS NOT NULL""",
    "validate_documents": _LINES("SELECT doc_id, text FROM documents", "doc_id", "text") + "SELECT * FROM i",
    "index_links": _LINES(_S + "SELECT snapshot_id, llms_txt FROM s", "snapshot_id", "llms_txt")
    + r""", a AS (SELECT *, count(*) FILTER (role = 'section') OVER w section_no, max(CASE WHEN role = 'section' THEN no END) OVER w AS sec_no FROM u WHERE role IN ('section', 'link') WINDOW w AS (PARTITION BY snapshot_id ORDER BY no))
  SELECT a.snapshot_id, a.section_no, trim(substr(h.line, 4)) AS section, row_number() OVER (PARTITION BY a.snapshot_id, a.section_no ORDER BY a.no) link_no, trim(regexp_extract(a.line, '^-\s+\[([^\]]+)\]', 1)) title, a.url,
  nullif(trim(regexp_extract(a.line, '^-\s+\[[^\]]+\]\([^)\s]+\)\s*(?::\s*(.*))?$', 1)), '') notes FROM a JOIN u h ON h.snapshot_id = a.snapshot_id AND h.no = a.sec_no WHERE a.role = 'link'""",
    "latest_snapshot_streamed": _LATEST,
    "crawl_rate_streamed": "SELECT time_bucket(INTERVAL 1 day, crawled_at) window_start, count(*) pages FROM crawled_pages WHERE crawled_at IS NOT NULL GROUP BY ALL",
}
for _name, _columns in _TIMES.items():
    QUERIES[_name] = _with_text_times(QUERIES[_name], _columns)
    SQL[_name] = "SELECT * REPLACE (" + ", ".join(f"strftime({c} AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS {c}" for c in _columns) + f") FROM ({SQL[_name]})"
