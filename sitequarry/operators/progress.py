"""Job progress from summaries and heartbeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_heartbeats(beats: DataFrame) -> DataFrame:
    """One row a job: its newest heartbeat (an upsert over appended rows)."""
    return beats.groupBy("job_id").agg(F.max_by(F.struct("fetched", "queued", "beat_at"), "beat_at").alias("heartbeat"))


def progress(jobs: DataFrame) -> DataFrame:
    """(job_id, status, fetched, queued, target, percent) of jobs with a nullable heartbeat.

    A heartbeat is live if the job runs and it is newer than the job's update. Percent is 100 only when done, else at most 99
    of the smaller of target and what is known.
    """
    live = F.coalesce((F.col("status") == "running") & (F.col("heartbeat.beat_at") > F.col("updated_at")), F.lit(False))
    fetched = F.when(live, F.greatest("fetched", "heartbeat.fetched")).otherwise(F.col("fetched"))
    queued = F.when(live, F.col("heartbeat.queued")).otherwise(F.col("queued"))
    rows = jobs.select("job_id", "status", "target", fetched.alias("fetched"), queued.alias("queued"))
    ceiling = F.greatest(F.least(F.col("target"), F.col("fetched") + F.col("queued")), F.lit(1))
    percent = F.when(F.col("status") == "done", 100).otherwise(F.least(F.lit(99), F.floor(F.col("fetched") / ceiling * 100 + 0.5)))
    return rows.withColumn("percent", percent.cast("int"))
