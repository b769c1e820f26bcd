"""Audit of a site's readiness for AI crawlers: nine weighted checks, a score and a grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Crawlers, and whether they fetch pages themselves.
BOTS = {"GPTBot": True, "OAI-SearchBot": True, "ChatGPT-User": True, "ClaudeBot": True, "PerplexityBot": True, "Google-Extended": False}
THIN_WORDS, SHORT_DESCRIPTION, SHRUNK = 120, 50, 0.6


def bot_access(probes: DataFrame) -> DataFrame:
    """Adds ``blocked`` and ``shrunk`` to probes (site_id, bot, robots_allowed, status, body_length, baseline_length).

    A fetch that failed isn't blocked; bots that don't fetch have neither status nor a shrunk body.
    """
    fetches = F.col("bot").isin([b for b, f in BOTS.items() if f])
    rows = probes.withColumn("status", F.when(fetches, F.col("status")))
    blocked = ~F.coalesce("robots_allowed", F.lit(True)) | (F.coalesce("status", F.lit(200)) >= 400)
    shrunk = (F.col("baseline_length") > 0) & (F.col("status") < 400) & (F.col("body_length") < F.col("baseline_length") * SHRUNK)
    return rows.withColumns({"blocked": blocked, "shrunk": F.coalesce(shrunk, F.lit(False))})


def page_counts(pages: DataFrame) -> DataFrame:
    """(site_id, pages, described, thin, markdown, duplicates) in one aggregation; null hashes don't duplicate each other."""
    return pages.groupBy("site_id").agg(
        F.count("*").alias("pages"), F.count_if(F.length("description") >= SHORT_DESCRIPTION).alias("described"), F.count_if(F.col("word_count") < THIN_WORDS).alias("thin"),
        F.count_if(F.coalesce(F.col("markdown_url"), F.lit("")) != "").alias("markdown"), (F.count("content_hash") - F.count_distinct("content_hash")).alias("duplicates"),
    )


def existing_files(files: DataFrame, verdicts: DataFrame, pages: DataFrame) -> DataFrame:
    """(site_id, present, valid, stale_links, missing_pages) of files (site_id, body), their verdicts (site_id, valid) and the pages (site_id, url).

    A file is present if its first character is a hash. Links and pages are compared without one slash at the end.
    """
    present = F.coalesce(F.col("body").rlike(r"^\s*#"), F.lit(False))
    own = files.select("site_id", present.alias("present"), "body")
    bare = lambda c: F.regexp_replace(c, "/$", "")
    linked = own.where("present").select("site_id", F.explode(F.regexp_extract_all("body", F.lit(r"\]\((https?://[^)\s]+)\)"), F.lit(1))).alias("u")).select("site_id", bare(F.col("u")).alias("u")).distinct()
    crawled = pages.select("site_id", bare(F.col("url")).alias("u")).distinct()
    stale = linked.join(crawled, ["site_id", "u"], "left_anti").groupBy("site_id").agg(F.count("*").alias("stale_links"))
    missing = crawled.join(linked, ["site_id", "u"], "left_anti").groupBy("site_id").agg(F.count("*").alias("missing_pages"))
    every = pages.groupBy("site_id").agg(F.count("*").alias("all_pages"))
    rows = every.join(own.select("site_id", "present"), "site_id", "left").join(verdicts.select("site_id", "valid"), "site_id", "left").join(stale, "site_id", "left").join(missing, "site_id", "left")
    there = F.coalesce("present", F.lit(False))
    return rows.select("site_id", there.alias("present"), (there & F.coalesce("valid", F.lit(False))).alias("valid"), F.when(there, F.coalesce("stale_links", F.lit(0))).otherwise(0).cast("long").alias("stale_links"), F.when(there, F.coalesce("missing_pages", F.lit(0))).otherwise(F.col("all_pages")).cast("long").alias("missing_pages"))


def ratio_status(ratio: Column) -> Column:
    return F.when(ratio >= 0.9, "pass").when(ratio >= 0.6, "warn").otherwise("fail")


def checks(sites: DataFrame, counts: DataFrame, bots: DataFrame, existing: DataFrame) -> DataFrame:
    """(site_id, check_no, id, weight, status, detail) of every site: nine rows each.

    ``sites`` is (site_id, robots_body, sitemap_urls); ``counts``, ``bots`` and ``existing`` come from the functions above.
    """
    names = lambda flag: F.array_join(F.array_sort(F.collect_set(F.when(F.col(flag), F.col("bot")))), ", ")
    by_site = bots.groupBy("site_id").agg(F.count_if("blocked").alias("blocked"), F.count_if("shrunk").alias("shrunk"), names("blocked").alias("blocked_names"), names("shrunk").alias("shrunk_names"))
    rows = sites.select("site_id", "robots_body", "sitemap_urls").join(counts, "site_id", "left").join(by_site, "site_id", "left").join(existing, "site_id", "left")
    rows = rows.fillna(0, ["pages", "described", "thin", "markdown", "duplicates", "blocked", "shrunk", "sitemap_urls", "stale_links", "missing_pages"]).fillna(False, ["present", "valid"])
    c, total = F.col, F.greatest(F.col("pages"), F.lit(1))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    number = lambda n: c(n).cast("string")
    covered, current = c("sitemap_urls") >= c("pages"), (c("stale_links") == 0) & (c("missing_pages") == 0)
    table = [
        ("bot-access", 25, F.when(c("blocked") == 0, "pass").otherwise("fail"), F.when(c("blocked") == 0, "no crawler is blocked").otherwise(text("blocked: ", c("blocked_names")))),
        ("bot-parity", 10, F.when(c("shrunk") == 0, "pass").otherwise("warn"), F.when(c("shrunk") == 0, "crawlers get the whole page").otherwise(text("smaller page for: ", c("shrunk_names")))),
        ("robots", 5, F.when(F.coalesce(c("robots_body"), F.lit("")) != "", "pass").otherwise("warn"), F.lit("robots file")),
        ("sitemap", 15, F.when(covered, "pass").when(c("sitemap_urls") > 0, "warn").otherwise("fail"), text(number("sitemap_urls"), " of ", number("pages"), " pages listed")),
        ("descriptions", 20, ratio_status(c("described") / total), text(number("described"), " of ", number("pages"), " pages described")),
        ("thin-content", 15, ratio_status(1 - c("thin") / total), text(number("thin"), " of ", number("pages"), " pages thin")),
        ("duplicates", 5, F.when(c("duplicates") == 0, "pass").otherwise("warn"), text(number("duplicates"), " pages repeat others")),
        ("llms-txt", 5, F.when(c("present") & c("valid") & current, "pass").otherwise("warn"), F.when(~c("present"), "no file").when(~c("valid"), "file not valid").otherwise(text(number("stale_links"), " stale, ", number("missing_pages"), " missing"))),
        ("markdown", 5, F.when(c("markdown") > 0, "pass").otherwise("warn"), text(number("markdown"), " Markdown versions")),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("check_no"), F.lit(n).alias("id"), F.lit(w).alias("weight"), s.alias("status"), d.alias("detail")) for i, (n, w, s, d) in enumerate(table, 1)]))
    return rows.select("site_id", each.alias("x")).select("site_id", "x.*")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 45, "D").otherwise("F")


def report(rows: DataFrame) -> DataFrame:
    """(site_id, score, grade): earned weight over all weight, a warning earning half, rounded half up."""
    earned = F.sum(F.col("weight") * F.when(F.col("status") == "pass", 1.0).when(F.col("status") == "warn", 0.5).otherwise(0.0))
    score = F.floor(earned / F.greatest(F.sum("weight"), F.lit(1)) * 100 + 0.5).cast("int")
    return rows.groupBy("site_id").agg(score.alias("score")).withColumn("grade", grade(F.col("score")))
