"""Structured Streaming: the newest snapshot of each site, and windowed counts of arriving pages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequarry.sources.tables import shared_dir


def _stream(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table's files as a stream: what is there first, then whatever arrives."""
    schema = spark.read.parquet(f"{root}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{root}/{name}.parquet*")


def latest_snapshot_stream(spark: SparkSession, root: str) -> DataFrame:
    """(site_id, snapshot_id, created_at, pages, changed) of each site's newest snapshot, kept up to date batch by batch.

    A batch is reduced to one row a site before it meets the state table; the state is a written table with a new version
    a batch, so a batch that runs twice gives the same result and a lost executor loses nothing.
    """
    folder = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    slim = ["site_id", "snapshot_id", "created_at", "loaded_at", F.size("pages").alias("pages"), "content_hash"]
    source = _stream(spark, root, "snapshots").where("pages IS NOT NULL AND site_id IS NOT NULL AND created_at IS NOT NULL").select(*slim)
    best = F.max_by(F.struct("snapshot_id", "created_at", "loaded_at", "pages", "content_hash"), F.struct("created_at", "snapshot_id", "loaded_at"))

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = batch.groupBy("site_id").agg(best.alias("s")).select("site_id", "s.*")
        if number > 0:
            rows = rows.unionByName(session.read.parquet(f"{folder}/state/{number - 1}")).groupBy("site_id").agg(best.alias("s")).select("site_id", "s.*")
        rows.write.mode("overwrite").parquet(f"{folder}/state/{number}")

    query = source.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    last = (query.lastProgress or {}).get("batchId", 0)
    return spark.read.parquet(f"{folder}/state/{last}").drop("loaded_at", "content_hash")


def crawl_rate_stream(spark: SparkSession, root: str, window: str = "1 day", late: str = "3650 days") -> DataFrame:
    """(window_start, pages): pages crawled a window of event time; rows later than the watermark are dropped.

    State is one count a window. The default watermark keeps all deliveries, some of which are days late.
    """
    folder = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    rows = _stream(spark, root, "crawled_pages").select("page_id", "crawled_at").where("crawled_at IS NOT NULL")
    counts = rows.withWatermark("crawled_at", late).groupBy(F.window("crawled_at", window)).agg(F.count("*").alias("pages"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.col("window.start").alias("window_start"), "pages").write.mode("overwrite").parquet(f"{folder}/out/{number}")

    query = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    last = (query.lastProgress or {}).get("batchId", 0)
    return spark.read.parquet(f"{folder}/out/{last}")
