"""Jobs, requests and monitored sites, over transitions derived from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequarry.operators import jobs
from sitequarry.plans.history_queries import _S, _snapshots, _with_text_times
from sitequarry.plans.site_queries import audit_bots
from sitequarry.sources.tables import materialize, table



def _now() -> Column:
    return F.to_timestamp(F.lit("2030-01-02 03:04:05"))


def _requests(spark: SparkSession, root: str) -> DataFrame:
    """A request for every site: some with numbers out of bounds, fractions, gaps and broken addresses."""
    n = F.substring("site_id", 6, 20).cast("long")
    url = F.when(n % 11 == 0, "x").when(n % 13 == 0, "ftp://a.example/").otherwise(F.col("url"))
    pages = F.when(n % 7 == 0, 501.0).when(n % 7 == 1, 2.5).when(n % 7 == 2, None).otherwise((n % 500 + 1).cast("double"))
    depth = F.when(n % 5 == 0, 0.0).when(n % 5 == 1, None).otherwise((n % 6 + 1).cast("double"))
    return table(spark, root, "sites").select(F.concat(F.lit("new-"), "site_id").alias("job_id"), url.alias("url"), pages.alias("max_pages"), depth.alias("max_depth"), F.when(n % 2 == 0, True).alias("scope_to_path"), F.lit(None).cast("boolean").alias("respect_robots"), (n % 3 == 0).alias("include_full_text"), F.lit(False).alias("use_llm"))


def request_options(spark: SparkSession, root: str) -> DataFrame:
    return jobs.valid_options(_requests(spark, root)).drop("url", "entry_url")


def _jobs(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "job_summaries").withColumnRenamed("updated_at", "u")
    return rows.select("job_id", F.col("site_id").alias("url"), "status", "target", "fetched", "queued", "error", F.col("u").alias("created_at"), F.col("u").alias("updated_at"))


def started_jobs(spark: SparkSession, root: str) -> DataFrame:
    """All jobs after one was started for each valid request."""
    return jobs.start_jobs(_jobs(spark, root), jobs.valid_options(_requests(spark, root)).drop("entry_url"), _now()).drop("url")


def advanced_jobs(spark: SparkSession, root: str) -> DataFrame:
    """All jobs after a slice: every third ends, every seventh fails."""
    rows = _jobs(spark, root)
    k = F.length("job_id") + F.coalesce("target", F.lit(0))
    slices = rows.select("job_id", (F.coalesce("fetched", F.lit(0)) + 6).cast("int").alias("fetched"), F.lit(3).alias("queued"), (k % 3 == 0).alias("done"), F.when(k % 7 == 0, "time out").alias("error"))
    return jobs.advance_jobs(rows, slices, _now()).drop("url")


def kept_jobs(spark: SparkSession, root: str) -> DataFrame:
    """The 50 jobs that were created last: retention."""
    return jobs.retain_jobs(_jobs(spark, root)).select("job_id", "created_at")


def found_sites(spark: SparkSession, root: str) -> DataFrame:
    """Sites looked up by the addresses that monitored sites have, and by id."""
    sites = table(spark, root, "sites")
    by_url = jobs.find_sites(sites, sites.where("monitoring").select("url"), "url")
    return by_url.unionByName(jobs.find_sites(sites, sites.where("last_checked_at IS NULL").select("site_id"))).select("site_id", "url").distinct()


def listed_sites(spark: SparkSession, root: str) -> DataFrame:
    return jobs.list_sites(table(spark, root, "sites")).select("site_id", "created_at")


def switched_sites(spark: SparkSession, root: str) -> DataFrame:
    """Sites after monitoring was switched off for those never checked, on for the rest."""
    sites = table(spark, root, "sites")
    return jobs.set_monitoring(sites, sites.select("site_id", F.col("last_checked_at").isNotNull().alias("monitoring"))).select("site_id", "monitoring")


def _tracked(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """A result for every site: the newest snapshot's own hash in upper case for even sites, another one for the rest."""
    n = F.substring("site_id", 6, 20).cast("long")
    known = materialize(_snapshots(spark, root).select("snapshot_id", "site_id", "created_at", "content_hash"))
    last = known.groupBy("site_id").agg(F.max_by("content_hash", F.struct("created_at", "snapshot_id")).alias("content_hash"))
    sites = table(spark, root, "sites")
    results = sites.select("site_id").join(last, "site_id", "left").select("site_id", F.concat(F.lit("new-"), "site_id").alias("snapshot_id"), F.when(n % 2 == 0, F.upper("content_hash")).otherwise(F.lit("moved")).alias("content_hash"))
    return jobs.track(sites, known, results, _now())


def tracked_snapshots(spark: SparkSession, root: str) -> DataFrame:
    return _tracked(spark, root)[1].select("site_id", "snapshot_id")


def tracked_sites(spark: SparkSession, root: str) -> DataFrame:
    return _tracked(spark, root)[0].select("site_id", "last_checked_at")


def site_detail(spark: SparkSession, root: str) -> DataFrame:
    """Every site with its 20 newest snapshots: a top-k report."""
    out = jobs.site_detail(table(spark, root, "sites"), _snapshots(spark, root))
    return out.withColumns({"pages": F.col("pages").cast("long"), "rank": F.col("rank").cast("long")})


def bot_labels(spark: SparkSession, root: str) -> DataFrame:
    rows = audit_bots(spark, root)
    return rows.select("site_id", "bot", jobs.bot_label(F.col("robots_allowed"), F.col("status"), F.col("shrunk")).alias("label"))


_N = "CAST(substr(site_id, 6) AS BIGINT)"
_REQUESTS = f"""rq AS (SELECT 'new-' || site_id job_id, CASE WHEN n % 11 = 0 THEN 'x' WHEN n % 13 = 0 THEN 'ftp://a.example/' ELSE url END url, CASE n % 7 WHEN 0 THEN 501.0 WHEN 1 THEN 2.5 WHEN 2 THEN NULL ELSE n % 500 + 1 END p,
  CASE n % 5 WHEN 0 THEN 0.0 WHEN 1 THEN NULL ELSE n % 6 + 1 END d, CASE WHEN n % 2 = 0 THEN true END s, n % 3 = 0 f FROM (SELECT *, {_N} n FROM sites)),
er AS (SELECT *, CASE WHEN length(url) < 3 THEN 'url is too short' WHEN p <> floor(p) THEN 'max_pages must be a whole number' WHEN p > 500 THEN 'max_pages must be 1 to 500' WHEN d < 1 THEN 'max_depth must be 1 to 6' END error FROM rq),
ok AS (SELECT job_id, url, error, CAST(CASE WHEN error IS NULL THEN coalesce(p, 500) END AS INTEGER) max_pages, CAST(CASE WHEN error IS NULL THEN coalesce(d, 3) END AS INTEGER) max_depth, CASE WHEN error IS NULL THEN coalesce(s, false) END scope_to_path,
  CASE WHEN error IS NULL THEN true END respect_robots, CASE WHEN error IS NULL THEN f END include_full_text, CASE WHEN error IS NULL THEN false END use_llm FROM er)"""
_NOW_SQL = "TIMESTAMPTZ '2030-01-02 03:04:05+00'"
_LAST = _S.rstrip() + f", la AS (SELECT site_id, arg_max(content_hash, (created_at, snapshot_id)) h FROM s GROUP BY 1), nw AS (SELECT t.site_id, 'new-' || t.site_id snapshot_id FROM sites t LEFT JOIN la USING (site_id) WHERE la.site_id IS NULL OR {_N.replace('site_id', 't.site_id')} % 2 = 1 AND coalesce(lower(h), '') <> 'moved')"

QUERIES = {
    "request_options": request_options, "started_jobs": started_jobs, "advanced_jobs": advanced_jobs, "kept_jobs": kept_jobs, "found_sites": found_sites, "listed_sites": listed_sites, "switched_sites": switched_sites,
    "tracked_snapshots": tracked_snapshots, "tracked_sites": tracked_sites, "site_detail": site_detail, "bot_labels": bot_labels,
}
SQL = {
    "request_options": f"WITH {_REQUESTS} SELECT * EXCLUDE (url) FROM ok",
    "started_jobs": f"WITH {_REQUESTS} SELECT job_id, status, target, fetched, queued, error, updated_at created_at, updated_at FROM job_summaries UNION ALL SELECT job_id, 'running', max_pages, 0, 1, NULL, {_NOW_SQL}, {_NOW_SQL} FROM ok WHERE error IS NULL",
    "advanced_jobs": f"""WITH k AS (SELECT *, length(job_id) + coalesce(target, 0) k FROM job_summaries), r AS (SELECT *, status = 'running' AS run, status = 'running' AND k % 7 = 0 AS bad, k % 3 = 0 AS fin FROM k)
SELECT job_id, CASE WHEN bad THEN 'error' WHEN run AND fin THEN 'done' ELSE status END status, target, CASE WHEN run AND NOT bad THEN CAST(coalesce(fetched, 0) + 6 AS INTEGER) ELSE fetched END fetched, CASE WHEN run AND NOT bad THEN 3 ELSE queued END queued,
  CASE WHEN bad THEN 'time out' WHEN run THEN NULL ELSE error END error, updated_at created_at, CASE WHEN run THEN {_NOW_SQL} ELSE updated_at END updated_at FROM r""",
    "kept_jobs": "SELECT job_id, updated_at created_at FROM job_summaries ORDER BY updated_at DESC, job_id DESC LIMIT 50",
    "found_sites": "SELECT DISTINCT site_id, url FROM sites WHERE url IN (SELECT url FROM sites WHERE monitoring) OR last_checked_at IS NULL",
    "listed_sites": "SELECT site_id, created_at FROM sites ORDER BY created_at DESC, site_id",
    "switched_sites": "SELECT site_id, last_checked_at IS NOT NULL monitoring FROM sites",
    "tracked_snapshots": _LAST + " SELECT site_id, snapshot_id FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY created_at DESC, snapshot_id DESC) r FROM (SELECT site_id, snapshot_id, created_at FROM s UNION ALL SELECT site_id, snapshot_id, " + _NOW_SQL + " FROM nw)) WHERE r <= 50",
    "tracked_sites": f"SELECT site_id, {_NOW_SQL} last_checked_at FROM sites",
    "site_detail": _S.rstrip() + " SELECT t.site_id, site_name, r AS rank, snapshot_id, x.created_at created_at, pages FROM sites t LEFT JOIN (SELECT site_id, snapshot_id, created_at, len(pages) pages, row_number() OVER (PARTITION BY site_id ORDER BY created_at DESC, snapshot_id DESC) r FROM s) x ON x.site_id = t.site_id AND r <= 20",
}


def _bots_sql() -> str:
    from sitequarry.plans.site_queries import SQL as SITES

    return f"SELECT site_id, bot, CASE WHEN NOT robots_allowed THEN 'robots blocks' WHEN status IS NULL THEN 'policy only' WHEN status >= 400 THEN 'HTTP ' || status WHEN shrunk THEN 'thin response' ELSE 'ok' END AS label FROM ({SITES['audit_bots']})"


SQL["bot_labels"] = _bots_sql()
_TIMES = {"started_jobs": ["created_at", "updated_at"], "advanced_jobs": ["created_at", "updated_at"], "kept_jobs": ["created_at"], "listed_sites": ["created_at"], "tracked_sites": ["last_checked_at"], "site_detail": ["created_at"]}
for _name, _columns in _TIMES.items():
    QUERIES[_name] = _with_text_times(QUERIES[_name], _columns)
    SQL[_name] = "SELECT * REPLACE (" + ", ".join(f"strftime({c} AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS {c}" for c in _columns) + f") FROM ({SQL[_name]})"
