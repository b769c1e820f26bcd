"""Jobs and monitored sites as transitions of tables: requests, slices, tracking, retention and the views on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.functions.text import js_trim
from sitequarry.functions.urls import ensure_url, normalize_url
from sitequarry.operators.history import latest_snapshots, newest

#: Bounds and default of whole-number options, defaults of switches, and the least length of a request's URL.
NUMBERS = {"max_pages": (1, 500, 500), "max_depth": (1, 6, 3)}
SWITCHES = {"scope_to_path": False, "respect_robots": True, "include_full_text": False, "use_llm": True}
LEAST_URL = 3
#: Snapshots that a site keeps.
RETAINED = 50


def valid_options(requests: DataFrame) -> DataFrame:
    """``requests`` (url, NUMBERS and SWITCHES, all nullable) with defaults filled in, ``entry_url`` and ``error``.

    ``error`` is null for a valid request, else what is wrong first: the url (too short or no http(s) address), then a
    number that is no whole one or out of its bounds. Numbers may be given as doubles.
    """
    length = F.coalesce(F.length("url"), F.lit(0))
    rows = requests.withColumn("entry_url", normalize_url(ensure_url(F.col("url"))))
    checks = [(length < LEAST_URL, "url is too short"), (F.col("entry_url").isNull(), "url is no web address")]
    for name, (least, most, _) in NUMBERS.items():
        value = F.col(name)
        checks += [(value != F.floor(value), f"{name} must be a whole number"), ((value < least) | (value > most) | F.isnan(value.cast("double")), f"{name} must be {least} to {most}")]
    error = F.coalesce(*[F.when(wrong, message) for wrong, message in checks])
    filled = {n: F.coalesce(n, F.lit(d)).cast("int") for n, (_, _, d) in NUMBERS.items()} | {n: F.coalesce(n, F.lit(d)) for n, d in SWITCHES.items()}
    return rows.withColumn("error", error).withColumns({n: F.when(F.col("error").isNull(), c) for n, c in filled.items()}).withColumn("entry_url", F.when(F.col("error").isNull(), F.col("entry_url")))


def start_jobs(jobs: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """``jobs`` and one running job for each valid request (job_id, url, max_pages) whose id is new; of repeated ids the first by url counts.

    ``jobs``: job_id, url, status, target, fetched, queued, error, created_at, updated_at. A job begins with its entry queued.
    """
    fresh = requests.where("error IS NULL AND job_id IS NOT NULL").groupBy("job_id").agg(F.min(F.struct("url", "max_pages")).alias("r")).join(jobs, "job_id", "left_anti")
    made = {"url": F.col("r.url"), "status": F.lit("running"), "target": F.col("r.max_pages"), "fetched": F.lit(0), "queued": F.lit(1), "error": F.lit(None).cast("string"), "created_at": now, "updated_at": now}
    return jobs.unionByName(fresh.select("job_id", *[c.alias(n) for n, c in made.items()]))


def update_jobs(jobs: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """``jobs`` with the columns that ``changes`` (job_id, ...) has, null ones too, and a new ``updated_at``; unknown ids change nothing."""
    names = [c for c in changes.columns if c != "job_id"]
    both = jobs.join(changes.select(F.col("job_id").alias("_id"), F.struct(*names).alias("_new")), F.col("job_id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    return both.select(*[F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.when(hit, now).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in jobs.columns])


def advance_jobs(jobs: DataFrame, slices: DataFrame, now: Column) -> DataFrame:
    """``jobs`` after one slice each (job_id, fetched, queued, done, error): only running jobs move.

    A slice with an error ends its job as ``error`` and keeps the counts; a finished one ends it as ``done``.
    """
    running = jobs.where("status = 'running'").select("job_id", F.col("fetched").alias("_fetched"), F.col("queued").alias("_queued"))
    moved = slices.join(running, "job_id")
    failed = F.col("error").isNotNull()
    status = F.when(failed, "error").when(F.col("done"), "done").otherwise("running")
    moved = moved.select("job_id", status.alias("status"), F.when(failed, F.col("_fetched")).otherwise(F.col("fetched")).alias("fetched"), F.when(failed, F.col("_queued")).otherwise(F.col("queued")).alias("queued"), "error")
    return update_jobs(jobs, moved, now)


def retain_jobs(jobs: DataFrame, most: int = 50) -> DataFrame:
    """The ``most`` jobs that were created last: a top-k, no global sort; ties by job_id, the greater first."""
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(most)


def find_sites(sites: DataFrame, wanted: DataFrame, by: str = "site_id") -> DataFrame:
    """Sites named in ``wanted`` (one column, ``by``: site_id or url); each comes once."""
    return sites.join(wanted.select(by).distinct(), by, "left_semi")


def list_sites(sites: DataFrame) -> DataFrame:
    """All sites, those created last first."""
    return sites.orderBy(F.desc_nulls_last("created_at"), "site_id")


def set_monitoring(sites: DataFrame, changes: DataFrame) -> DataFrame:
    """``sites`` with ``monitoring`` as in ``changes`` (site_id, monitoring); a null switch changes nothing."""
    new = changes.where("monitoring IS NOT NULL").groupBy("site_id").agg(F.max("monitoring").alias("_on"))
    return sites.join(new, "site_id", "left").withColumn("monitoring", F.coalesce("_on", "monitoring")).select(*sites.columns)


def add_snapshots(snapshots: DataFrame, fresh: DataFrame, retained: int = RETAINED) -> DataFrame:
    """``snapshots`` and the ``fresh`` ones, each site's newest ``retained``; an id that is known stays as it is."""
    new = fresh.join(snapshots.select("snapshot_id"), "snapshot_id", "left_anti")
    return newest(snapshots.unionByName(new.select(*snapshots.columns)), ["site_id"], ["created_at", "snapshot_id"], retained).drop("rank")


def track(sites: DataFrame, snapshots: DataFrame, results: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Sites and snapshots after fresh results (site_id, snapshot_id, content_hash): a snapshot is added where a site has none or its hash differs.

    Every site with a result is marked as checked. ``snapshots``: snapshot_id, site_id, created_at, content_hash. Hashes
    differ other than in letter case. Results of unknown sites are dropped; of several of one site the greatest id counts.
    """
    one = results.groupBy("site_id").agg(F.max(F.struct("snapshot_id", "content_hash")).alias("r")).select("site_id", "r.*").join(sites.select("site_id"), "site_id", "left_semi")
    last = latest_snapshots(snapshots, ["content_hash"]).select("site_id", F.col("snapshot_id").alias("_last"), F.lower("content_hash").alias("_hash"))
    moved = one.join(last, "site_id", "left").where(F.col("_last").isNull() | ~F.col("_hash").eqNullSafe(F.lower("content_hash")))
    added = add_snapshots(snapshots, moved.select("snapshot_id", "site_id", now.alias("created_at"), "content_hash"))
    checked = sites.join(one.select("site_id", F.lit(True).alias("_hit")), "site_id", "left")
    return checked.withColumn("last_checked_at", F.when(F.col("_hit"), now).otherwise(F.col("last_checked_at"))).select(*sites.columns), added


def site_detail(sites: DataFrame, snapshots: DataFrame, most: int = 20) -> DataFrame:
    """(site_id, site_name, rank, snapshot_id, created_at, pages): each site with its newest snapshots; one row with nulls without any."""
    slim = snapshots.select("site_id", "snapshot_id", "created_at", F.greatest(F.size("pages"), F.lit(0)).alias("pages"))
    return sites.select("site_id", "site_name").join(newest(slim, ["site_id"], ["created_at", "snapshot_id"], most), "site_id", "left")


def bot_label(robots_allowed: Column, status: Column, shrunk: Column) -> Column:
    """What keeps a crawler out, in words; the first that holds."""
    return F.when(~robots_allowed, "robots blocks").when(status.isNull(), "policy only").when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string"))).when(shrunk, "thin response").otherwise("ok")


def blank(text: Column) -> Column:
    """Whether a text to be validated is missing or blank."""
    return F.coalesce(js_trim(text) == "", F.lit(True))
