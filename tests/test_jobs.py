"""Jobs and tracked sites: nulls, repeats, empty tables, and the order of what is wrong."""

from datetime import datetime

from pyspark.sql import functions as F

from sitequarry.operators import jobs
from sitequarry.operators.skew import newest_rows, sieve

T = datetime(2026, 1, 1)
NOW = datetime(2026, 2, 1)
JOBS = "job_id string, url string, status string, target int, fetched int, queued int, error string, created_at timestamp, updated_at timestamp"


def test_options(spark):
    rows = [("acme.com", None, None), ("ab", 1.0, 1.0), (None, 5.0, 2.0), ("https://a.com", 0.0, 7.0), ("https://a.com", 2.5, 1.0), ("https://a.com", 500.0, 6.0), ("http://[bad", 1.0, 1.0)]
    table = spark.createDataFrame([(i, *r, None, None, True, None) for i, r in enumerate(rows)], "id int, url string, max_pages double, max_depth double, scope_to_path boolean, respect_robots boolean, include_full_text boolean, use_llm boolean")
    got = {r.id: r for r in jobs.valid_options(table).collect()}
    assert (got[0].error, got[0].entry_url, got[0].max_pages, got[0].max_depth, got[0].respect_robots, got[0].scope_to_path, got[0].include_full_text) == (None, "https://acme.com/", 500, 3, True, False, True)
    assert [got[i].error for i in range(1, 7)] == ["url is too short", "url is too short", "max_pages must be 1 to 500", "max_pages must be a whole number", None, "url is no web address"]
    assert got[3].max_pages is None and got[5].max_pages == 500


def test_transitions(spark):
    table = spark.createDataFrame([("a", "u", "running", 9, 1, 2, None, T, T), ("b", "u", "done", 9, 9, 0, None, T, T), ("c", "u", "running", 9, 4, 5, None, T, T)], JOBS)
    slices = spark.createDataFrame([("a", 9, 0, True, None), ("b", 1, 1, False, "late"), ("c", 8, 8, True, "boom"), ("x", 1, 1, True, None)], "job_id string, fetched int, queued int, done boolean, error string")
    got = {r.job_id: (r.status, r.fetched, r.queued, r.error, r.updated_at == NOW) for r in jobs.advance_jobs(table, slices, F.lit(NOW)).collect()}
    assert got == {"a": ("done", 9, 0, None, True), "b": ("done", 9, 0, None, False), "c": ("error", 4, 5, "boom", True)}
    asked = spark.createDataFrame([("a", "v", 3, None), ("n", "w", 3, None), ("n", "v", 4, None), ("e", "v", 4, "bad"), (None, "v", 4, None)], "job_id string, url string, max_pages int, error string")
    started = {r.job_id: (r.url, r.target, r.status) for r in jobs.start_jobs(table, asked, F.lit(NOW)).collect()}
    assert len(started) == 4 and started["n"] == ("v", 4, "running") and started["a"] == ("u", 9, "running")
    assert jobs.advance_jobs(table.where("false"), slices, F.lit(NOW)).count() == 0 and jobs.retain_jobs(table, 2).count() == 2


def test_tracking(spark):
    sites = spark.createDataFrame([("s", None), ("t", T), ("u", T)], "site_id string, last_checked_at timestamp")
    known = spark.createDataFrame([("1", "s", T, "AA"), ("2", "t", T, "bb")], "snapshot_id string, site_id string, created_at timestamp, content_hash string")
    results = spark.createDataFrame([("s", "3", "aa"), ("t", "4", None), ("u", "5", "x"), ("gone", "6", "x")], "site_id string, snapshot_id string, content_hash string")
    checked, snapshots = jobs.track(sites, known, results, F.lit(NOW))
    assert {r.snapshot_id for r in snapshots.collect()} == {"1", "2", "4", "5"} and all(r.last_checked_at == NOW for r in checked.collect())
    assert {r.snapshot_id for r in jobs.add_snapshots(known, results.withColumn("created_at", F.lit(NOW)).where("site_id = 't'"), 1).collect()} == {"1", "4"}


def test_sieve_and_newest_rows(spark):
    rows = spark.createDataFrame([(i, i % 7, f"v{i}") for i in range(50)] + [(3, 99, "new"), (None, 1, "null")], "id long, day int, v string")
    hit, rest = sieve(rows, "id", spark.createDataFrame([(3,), (None,), (1000,)], "k long"))
    assert {r.v for r in hit.collect()} >= {"v3", "new"} and "null" in {r.v for r in rest.collect()} and hit.count() + rest.count() == 52
    got = {r.id: r.v for r in newest_rows(rows, "id", F.col("day")).collect()}
    assert len(got) == 50 and got[3] == "new" and newest_rows(rows.where("false"), "id", F.col("day")).count() == 0
