"""Sitemaps: text and XML forms, entities, gzip, and the walk over index files."""

from __future__ import annotations

import gzip
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sitequarry.functions.urls import is_likely_page, is_same_site, resolve_url
from sitequarry.sources.tables import materialize

#: Where sitemaps are looked for, besides those a robots file names.
PATHS = ["sitemap.xml", "sitemap_index.xml", "sitemap-index.xml", "sitemap/sitemap.xml", "wp-sitemap.xml", "sitemap.txt"]
#: A walk takes BATCH sitemaps of a site at a time, as long as it has seen fewer than MOST_SITEMAPS.
MOST_SITEMAPS, BATCH = 25, 5


def decode_xml(value: Column) -> Column:
    """CDATA unwrapped, then the five entities, the ampersand last; trimmed."""
    steps = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
    bare = F.regexp_replace(value, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    return F.trim(reduce(lambda v, s: F.replace(v, F.lit(s[0]), F.lit(s[1])), steps, bare))


@F.pandas_udf(StringType())
def gunzip(content: pd.Series) -> pd.Series:
    """Text of a gzip body; null for what is none."""

    def read(raw: bytes | None) -> str | None:
        try:
            return gzip.decompress(raw).decode("utf-8", "replace") if raw else None
        except (OSError, EOFError):
            return None

    return content.map(read).astype(object)


def entries(bodies: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, pos, url, lastmod, priority): pages or child sitemaps of bodies (keys, base, body), in order.

    A body that doesn't start with ``<`` is a list of URLs. Blocks are found as tolerantly as possible: broken XML
    around them does no harm. URLs that don't normalise are left out. Null bodies have none.
    """
    rows = bodies.where("body IS NOT NULL").select(*keys, "base", F.regexp_replace("body", r"^[\s﻿]+|[\s﻿]+$", "").alias("body"))
    xml = F.startswith("body", F.lit("<"))
    within = lambda tag, block: F.trim(F.regexp_extract(block, rf"(?is)<{tag}>(.*?)</{tag}>", 1))
    text = F.transform(F.split("body", r"\r?\n"), lambda x: F.struct(F.trim(x).alias("loc"), F.lit("").alias("lastmod"), F.lit("").alias("priority")))
    blocks = F.transform(
        F.regexp_extract_all("body", F.lit(r"(?is)<(?:url|sitemap)\b.*?</(?:url|sitemap)>"), F.lit(0)),
        lambda b: F.struct(decode_xml(within("loc", b)).alias("loc"), within("lastmod", b).alias("lastmod"), within("priority", b).alias("priority")),
    )
    kind = F.when(xml & F.col("body").rlike(r"(?i)<sitemapindex[\s>]"), "sitemap").otherwise("page")
    rows = rows.select(*keys, "base", xml.alias("xml"), kind.alias("kind"), F.posexplode(F.when(xml, blocks).otherwise(text)).alias("pos", "e"))
    rows = rows.where("NOT xml OR e.loc != ''").withColumn("loc", F.when(F.col("e.loc") == "", F.col("base")).otherwise(F.col("e.loc")))
    rows = rows.withColumn("url", resolve_url("loc", "base")).where("url IS NOT NULL")
    page = F.col("kind") == "page"
    return rows.select(*keys, "kind", "pos", "url", F.when(page, F.nullif("e.lastmod", F.lit(""))).alias("lastmod"), F.when(page, F.expr("try_cast(nullif(e.priority, '') AS double)")).alias("priority"))


def seeds(origins: DataFrame, hints: DataFrame) -> DataFrame:
    """(site_id, origin, pos, sitemap): where a walk begins. Those a robots file names, in its order, then the usual places; repeats count once.

    ``origins`` is (site_id, origin), an origin without a slash at its end; ``hints`` (site_id, no, sitemap).
    """
    usual = origins.select("site_id", "origin", F.posexplode(F.array(*[F.concat("origin", F.lit(f"/{p}")) for p in PATHS])).alias("pos", "sitemap")).withColumn("pos", F.col("pos") + 10**6)
    named = origins.join(hints.select("site_id", F.col("no").alias("pos"), "sitemap"), "site_id").select("site_id", "origin", "pos", "sitemap")
    return named.unionByName(usual).groupBy("site_id", "origin", "sitemap").agg(F.min("pos").cast("long").alias("pos"))


def read_bodies(files: DataFrame) -> DataFrame:
    """(sitemap, body) of fetched files (sitemap, status, content): names that end in .gz are unpacked, failed ones have no body."""
    packed = F.col("sitemap").endswith(".gz")
    body = F.when(packed, gunzip(F.when(packed, F.col("content")))).otherwise(F.decode("content", "UTF-8"))
    return files.where("status < 400").select("sitemap", body.alias("body"))


def collect(seeds: DataFrame, bodies: DataFrame, limit: int) -> DataFrame:
    """(site_id, pos, url): the first ``limit`` page URLs of each site's sitemaps.

    ``seeds`` is (site_id, origin, pos, sitemap), ``bodies`` (sitemap, body). Every site has a queue: a round takes its
    next BATCH sitemaps, those seen before without effect, and adds the children of the same site at the end. A site
    is done when its queue is empty, MOST_SITEMAPS were seen or ``limit`` pages found. Pages must be of the site and
    look like pages; of equal URLs the first counts. All sites advance in the same round, each round is written.
    """
    parsed = materialize(entries(bodies.select("sitemap", F.col("sitemap").alias("base"), "body"), ["sitemap"]))
    first = ["site_id", "origin"]
    queue = materialize(seeds.select(*first, "sitemap", F.struct(F.lit(-1).alias("round"), F.col("pos").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("at")))
    seen = materialize(queue.select("site_id", "sitemap").where("false"))
    pages = materialize(queue.select("site_id", F.lit("").alias("url"), "at").where("false"))
    number = 0
    while not queue.isEmpty():
        ranked = queue.withColumn("no", F.row_number().over(Window.partitionBy("site_id").orderBy("at", "sitemap")))
        taken = ranked.where(F.col("no") <= BATCH).groupBy(*first, "sitemap").agg(F.min("no").cast("long").alias("no")).join(seen, ["site_id", "sitemap"], "left_anti")
        taken = materialize(taken)
        at = F.struct(F.lit(number).alias("round"), F.col("no").alias("a"), F.col("pos").cast("long").alias("b")).alias("at")
        rows = materialize(taken.join(parsed, "sitemap").where(is_same_site(F.col("url"), F.col("origin"))).select(*first, "kind", "url", at))
        seen = materialize(seen.unionByName(taken.select("site_id", "sitemap")))
        good = rows.where("kind = 'page'").where(is_likely_page(F.col("url"))).select("site_id", "url", "at")
        pages = materialize(pages.unionByName(good).groupBy("site_id", "url").agg(F.min("at").alias("at")))
        full = seen.groupBy("site_id").count().where(F.col("count") >= MOST_SITEMAPS).select("site_id")
        full = full.unionByName(pages.groupBy("site_id").count().where(F.col("count") >= limit).select("site_id")).distinct()
        rest = ranked.where(F.col("no") > BATCH).drop("no").unionByName(rows.where("kind = 'sitemap'").select(*first, F.col("url").alias("sitemap"), "at"))
        queue = materialize(rest.join(full, "site_id", "left_anti"))
        number += 1
    order = Window.partitionBy("site_id").orderBy("at", "url")
    return pages.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit).select("site_id", "pos", "url")
