"""Duplicates hidden by formatting: an incremental ledger of canonical page addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.operators.skew import attach
from sitequarry.sources.tables import materialize

#: Prefixes of parameter names that only track a visitor (compared in lower case).
TRACKING = r"^(utm_|fbclid|gclid|mc_[ce]id|ref|source|hsa_)"

#: Ledger partitions: a batch touches only the buckets its keys fall into.
BUCKETS = 64


def _decoded(part: Column) -> Column:
    """Percent-escapes resolved as UTF-8, lower case. A plus stays a plus; stray % signs stay; escapes that are no UTF-8 stay."""
    safe = F.regexp_replace(F.regexp_replace(part, r"%(?![0-9a-fA-F]{2})", "%25"), r"\+", "%2B")
    plain = F.try_url_decode(safe)
    return F.lower(F.when(part.contains("%") & plain.isNotNull() & ~plain.contains("�"), plain).otherwise(part))


def address_key(address: Column) -> Column:
    """Canonical key of a page address; null for null and blank ones.

    Letter case, surrounding white space, percent-escapes, a leading ``www.``, the scheme's default port, doubled
    and trailing slashes, the fragment, tracking parameters and the order of parameters don't matter. A missing
    scheme means https; http and https differ.
    """
    text = F.regexp_replace(address, r"^[\s ﻿]+|[\s ﻿]+$", "")
    bare = F.regexp_replace(text, r"(?s)#.*$", "")
    scheme = F.when(bare.rlike(r"(?i)^http:"), "http").when(bare.rlike(r"(?i)^(https:|[^:/?]*[/?.]|[^:/?]*:\d|[^:/?]*$|//)"), "https").otherwise(F.lower(F.regexp_extract(bare, r"^([^:]*):", 1)))
    rest = F.regexp_replace(bare, r"(?i)^(https?:)?/*", "")
    head = F.regexp_extract(rest, r"(?s)^([^?]*)", 1)
    query = F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1)
    where = _decoded(head)
    host = F.regexp_replace(F.regexp_extract(where, r"(?s)^([^/]*)", 1), r"^www\.", "")
    host = F.when(scheme == "http", F.regexp_replace(host, r":80$", "")).otherwise(F.regexp_replace(host, r":443$", ""))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(where, r"(?s)^[^/]*(.*)$", 1), "/+", "/"), "/$", "")
    parameters = F.sort_array(F.filter(F.transform(F.split(query, "&"), lambda p: _decoded(p)), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(query == "", "").otherwise(F.concat_ws("", F.transform(parameters, lambda p: F.concat(F.lit("\u0001"), p))))
    return F.when(text != "", F.concat(scheme, F.lit("://"), host, path, tail))


def batch_counts(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Counts of one batch: (field, key_hash, bucket, copies, first_page_id) from rows (field, page_id, key_hash)."""
    counted = rows.groupBy("field", "key_hash").agg(F.count("*").alias("copies"), F.min("page_id").alias("first_page_id"))
    return counted.withColumn("bucket", F.pmod(F.xxhash64("key_hash"), F.lit(buckets)).cast("int"))


def merge(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """The ledger after a batch: full outer join on the matching buckets, counts added, the earliest representative kept.

    Buckets the batch doesn't touch pass through unread by the join (at most BUCKETS of them are listed).
    """
    touched = F.broadcast(batch.select("bucket").distinct())
    old = ledger.join(touched, "bucket", "left_semi").withColumnsRenamed({"copies": "c0", "first_page_id": "f0"})
    rest = ledger.join(touched, "bucket", "left_anti")
    both = old.join(batch, ["bucket", "field", "key_hash"], "full_outer")
    merged = both.select(
        "field", "key_hash", "bucket",
        (F.coalesce("c0", F.lit(0)) + F.coalesce("copies", F.lit(0))).alias("copies"),
        F.least("f0", "first_page_id").alias("first_page_id"),
    )
    return rest.select(*merged.columns).unionByName(merged)


def address_rows(crawled: DataFrame, extracted: DataFrame) -> DataFrame:
    """(field, page_id, key_hash) of every page address; a page_id delivered twice with one address appears once.

    Keys are compared by their 128 leading bits of SHA-256. Null and blank addresses and null page_ids are left out.
    """
    urls = crawled.select(F.lit("url").alias("field"), "page_id", F.col("url").alias("address"))
    canonicals = extracted.select(F.lit("canonical").alias("field"), "page_id", F.col("canonical").alias("address"))
    rows = urls.unionByName(canonicals).where("page_id IS NOT NULL AND address IS NOT NULL")
    rows = rows.withColumn("key", address_key(F.col("address"))).where("key IS NOT NULL")
    return rows.select("field", "page_id", F.unhex(F.substring(F.sha2("key", 256), 1, 32)).alias("key_hash")).distinct()


def build_ledger(rows: DataFrame, batches: int = 4, buckets: int = BUCKETS) -> DataFrame:
    """Ledger over all rows, fed batch by batch in order of page_id ranges, as deliveries would feed it.

    Batch limits come from the smallest and greatest page_id; each batch is aggregated before it is joined.
    """
    low, high = rows.agg(F.min("page_id"), F.max("page_id")).first()
    if low is None:
        return batch_counts(rows, buckets).select("field", "key_hash", "bucket", "copies", "first_page_id")
    step = (high - low) // batches + 1
    ledger = None
    for k in range(batches):
        part = rows.where((F.col("page_id") >= low + k * step) & (F.col("page_id") < low + (k + 1) * step))
        counts = batch_counts(part, buckets).select("field", "key_hash", "bucket", "copies", "first_page_id")
        ledger = counts if ledger is None else merge(ledger, counts)
        ledger = materialize(ledger)
    return ledger


def duplicates(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """(field, first_page_id, page_id, copies) of every page but the first of its group of equal addresses."""
    groups = ledger.where("copies > 1").select("field", "key_hash", "first_page_id", "copies")
    return attach(rows, groups, ["field", "key_hash"], "copies", rows.count()).where("page_id != first_page_id").select("field", "first_page_id", "page_id", "copies")
