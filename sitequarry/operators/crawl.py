"""Crawl of a table of fetched pages: breadth-first levels, inbound links, navigation, outcomes and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.functions.urls import in_scope, is_likely_page, is_same_site
from sitequarry.operators.skew import attach
from sitequarry.sources.tables import materialize

#: Body size that a fetch is cut to.
BODY_CAP = 3_000_000


def capped_body(fetches: DataFrame) -> DataFrame:
    """Bodies of fetches: empty where the status isn't 2xx or the declared length is over the cap, else cut to it."""
    ok = (F.col("status") >= 200) & (F.col("status") < 300) & (F.coalesce("content_length", F.lit(0)) <= BODY_CAP)
    return fetches.withColumn("body", F.when(ok, F.substring("body", 1, BODY_CAP)).otherwise(""))


def outcomes(fetches: DataFrame) -> DataFrame:
    """Adds ``outcome``: failed, skipped or page, by the gates in their order.

    Columns used: status, content_type, final_url, requested_url, entry_url, scope_to_path, noindex. Of several
    fetches that end on one URL the first by ``seq`` is the page.
    """
    first = F.row_number().over(Window.partitionBy("site_id", "final_url").orderBy("seq")) > 1
    html = F.coalesce(F.col("content_type").contains("html"), F.lit(False))
    outcome = (
        F.when(F.coalesce(F.col("status"), F.lit(599)) >= 400, "failed").when(~html, "failed")
        .when(~in_scope(F.col("final_url"), F.col("entry_url"), F.coalesce("scope_to_path", F.lit(False))), "skipped")
        .when(first, "skipped").when(F.coalesce("noindex", F.lit(False)), "skipped").otherwise("page")
    )
    return fetches.withColumn("outcome", outcome)


def edges(pages: DataFrame) -> DataFrame:
    """(site_id, from_url, pos, to_url) of pages (site_id, url, links): distinct links of the same site that look like pages."""
    rows = pages.select("site_id", "url", F.posexplode(F.array_distinct(F.coalesce("links", F.array().cast("array<string>")))).alias("pos", "to_url"))
    kept = rows.where(F.col("to_url").isNotNull() & is_same_site(F.col("to_url"), F.col("url")) & is_likely_page(F.col("to_url")))
    return kept.select("site_id", F.col("url").alias("from_url"), "pos", "to_url")


def nav_targets(pages: DataFrame) -> DataFrame:
    """(site_id, url): distinct targets of navigation links of the same site."""
    rows = pages.select("site_id", "url", F.explode("nav_links").alias("to_url"))
    return rows.where(is_same_site(F.col("to_url"), F.col("url"))).select("site_id", F.col("to_url").alias("url")).distinct()


def inbound(links: DataFrame) -> DataFrame:
    """(site_id, url, inbound_links): number of pages that link to a URL, itself included; counts are aggregated before the shuffle."""
    return links.groupBy("site_id", F.col("to_url").alias("url")).agg(F.count("*").alias("inbound_links"))


def scoped(links: DataFrame, entries: DataFrame, column: str) -> DataFrame:
    """Rows whose URL in ``column`` is in the scope of their site's entry; ``entries`` is (site_id, entry_url, scope_to_path)."""
    counts = links.groupBy("site_id").agg(F.count("*").alias("_rows"))
    known = materialize(entries.select("site_id", "entry_url", F.coalesce("scope_to_path", F.lit(False)).alias("_to_path")).join(counts, "site_id"))
    total = known.agg(F.sum("_rows")).first()[0] or 0
    return attach(links, known, ["site_id"], "_rows", total).where(in_scope(F.col(column), F.col("entry_url"), F.col("_to_path"))).select(*links.columns)


def crawl(entries: DataFrame, sitemap: DataFrame, fetched: DataFrame, links: DataFrame, max_depth: int = 3, max_pages: int = 500, denied: DataFrame | None = None) -> DataFrame:
    """(site_id, url, depth, seq): pages that a breadth-first crawl stores, in its order.

    ``entries`` is (site_id, entry_url) at depth 0, ``sitemap`` (site_id, url, pos) at depth 1 before links, ``links`` as
    from :func:`edges`, ``denied`` (site_id, url) what robots files keep out. ``fetched`` is (site_id, url) of pages, or
    with ``outcome`` all that can be asked for; only those with outcome ``page`` are stored and have their links followed.

    A URL is visited at its first occurrence in the order (depth, sitemap before links, seq of the linking page, link
    position). A site ends with its ``max_pages``-th page, or when 3 * ``max_pages`` URLs were visited. A queue that is
    first in, first out never lowers its depth, so levels give the same order. Each level is a few joins by (site, url)
    and is written; there are at most ``max_depth`` of them.
    """
    outcome = F.col("outcome") if "outcome" in fetched.columns else F.lit("page")
    known = fetched.groupBy("site_id", "url").agg(F.max((outcome == "page").cast("int")).alias("stored"))
    if denied is not None:
        known = known.join(denied.select("site_id", "url"), ["site_id", "url"], "left_anti")
    known = materialize(known)
    at = lambda k, a, b: F.struct(F.lit(k).alias("k"), a.cast("long").alias("a"), b.cast("long").alias("b")).alias("at")
    found = entries.select("site_id", F.col("entry_url").alias("url"), at(0, F.lit(0), F.lit(0)))
    visited = None
    for depth in range(max_depth + 1):
        fresh = found.groupBy("site_id", "url").agg(F.min("at").alias("at")).join(known, ["site_id", "url"])
        if visited is not None:
            before = visited.groupBy("site_id").agg(F.count("*").alias("v"), F.sum("stored").alias("p"))
            fresh = fresh.join(visited, ["site_id", "url"], "left_anti").join(before, "site_id", "left")
        else:
            fresh = fresh.withColumns({"v": F.lit(0).cast("long"), "p": F.lit(0).cast("long")})
        # a site's queue is cut to its budget by each task before a window sums over what is left
        own = Window.partitionBy("site_id").orderBy("at", "url")
        cut = fresh.withColumn("no", F.row_number().over(own)).where(F.col("no") <= 3 * max_pages)
        pages = F.coalesce("p", F.lit(0)) + F.sum("stored").over(own)
        cut = cut.withColumn("pages", pages).where((F.coalesce("v", F.lit(0)) + F.col("no") <= 3 * max_pages) & (F.col("pages") - F.col("stored") < max_pages))
        level = materialize(cut.select("site_id", "url", "stored", F.lit(depth).alias("depth"), F.col("pages").cast("long").alias("seq")))
        visited = level if visited is None else materialize(visited.unionByName(level))
        if level.isEmpty() or depth == max_depth:
            break
        out = links.join(level.where("stored = 1").select("site_id", F.col("url").alias("from_url"), "seq"), ["site_id", "from_url"])
        found = out.select("site_id", F.col("to_url").alias("url"), at(1, F.col("seq"), F.col("pos")))
        if depth == 0:
            found = found.unionByName(sitemap.select("site_id", "url", at(0, F.lit(0), F.col("pos"))))
    return visited.where("stored = 1").select("site_id", "url", "depth", "seq")


def finish(visited: DataFrame, links: DataFrame, nav: DataFrame, used_sitemap: DataFrame) -> DataFrame:
    """Visited pages with inbound_links, in_nav and from_sitemap.

    Only links of visited pages count. ``from_sitemap`` is a test of depth: 1 in a site that has a sitemap (``used_sitemap``: site_id).
    """
    own = links.join(visited.select("site_id", F.col("url").alias("from_url")), ["site_id", "from_url"], "left_semi")
    rows = visited.join(inbound(own), ["site_id", "url"], "left").fillna(0, ["inbound_links"])
    rows = rows.join(nav.withColumn("in_nav", F.lit(True)), ["site_id", "url"], "left").fillna(False, ["in_nav"])
    rows = rows.join(used_sitemap.select("site_id").distinct().withColumn("mapped", F.lit(True)), "site_id", "left")
    return rows.withColumn("from_sitemap", F.coalesce("mapped", F.lit(False)) & (F.col("depth") == 1)).drop("mapped")


def statistics(rows: DataFrame) -> DataFrame:
    """(site_id, fetched, failed, skipped, sitemap_urls, discovered_via) from rows with outcome, in_sitemap and via_link."""
    flag = lambda c: F.coalesce(F.max(F.col(c).cast("int")), F.lit(0)) == 1
    out = rows.groupBy("site_id").agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("page", "fetched"), ("failed", "failed"), ("skipped", "skipped"))], F.count_if(F.col("in_sitemap")).alias("sitemap_urls"), flag("in_sitemap").alias("s"), flag("via_link").alias("l"))
    via = F.when(F.col("s") & F.col("l"), "sitemap+links").when(F.col("s"), "sitemap").otherwise("links")
    return out.withColumn("discovered_via", via).drop("s", "l")


def page_rows(pages: DataFrame, full_text: bool = False, most: int = 20_000) -> DataFrame:
    """The stored form of extracted pages: text only where it is asked for, cut to ``most`` characters."""
    return pages.withColumn("text", F.substring("text", 1, most) if full_text else F.lit(None).cast("string"))
