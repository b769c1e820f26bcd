"""Robots, sitemaps, HTML extraction, crawl, audit, model plans and retrieval evaluation, over inputs derived from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitequarry.functions.html import extract_pages
from sitequarry.functions.urls import host
from sitequarry.operators import audit, crawl, document, history, plan, robots, sitemap, validate
from sitequarry.plans.views import LINKED, PAGES_SQL, entries, pages
from sitequarry.sources.tables import materialize, table

_NUMBER = "CAST(substring(site_id, 6) AS BIGINT)"


def _number() -> Column:
    return F.substring("site_id", 6, 20).cast("long")


def robots_bodies(spark: SparkSession, root: str) -> DataFrame:
    """(site_id, body): a robots file for two of three sites, with groups, wildcards, anchors, delays and sitemaps."""
    n = _number()
    body = F.concat(
        F.lit("# rules\nUser-agent: *\nDisallow: /legal\nAllow: /legal/terms$\nCrawl-delay: "), (n % 4).cast("string"), F.lit("\n\nUser-agent: GPTBot\nSitemap: "), F.rtrim("url"), F.lit("sitemap.xml\nUser-agent: ClaudeBot\nDisallow: /*/docs # all\nAllow: /en/docs\nDisallow: /*?page=\n"),
        F.when(n % 2 == 0, "User-agent: PerplexityBot\nDisallow: /\n").otherwise("User-agent: PerplexityBot\nDisallow:\n"), F.lit("no colon here\n"),
    )
    return table(spark, root, "sites").where(n % 3 != 2).select("site_id", body.alias("body"))


def robots_rules(spark: SparkSession, root: str) -> DataFrame:
    return robots.rules(robots.directives(robots_bodies(spark, root))).select("site_id", "agent", F.col("rule_no").cast("long").alias("rule_no"), "allow", "pattern")


def robots_delays(spark: SparkSession, root: str) -> DataFrame:
    return robots.delays(robots.directives(robots_bodies(spark, root)))


def robots_sitemaps(spark: SparkSession, root: str) -> DataFrame:
    return robots.sitemap_hints(robots.directives(robots_bodies(spark, root))).select("site_id", "sitemap")


def _tokens(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b,) for b in audit.BOTS], "token string")


def robots_access(spark: SparkSession, root: str) -> DataFrame:
    """Pages an agent may not fetch."""
    found = robots.access(pages(spark, root, []).select("site_id", "url"), robots.directives(robots_bodies(spark, root)), _tokens(spark))
    return found.where("NOT allowed").select("site_id", "url", "agent")


def sitemap_bodies(spark: SparkSession, root: str) -> DataFrame:
    """(sitemap, site_id, body): an index a site, that names an XML file and a text file."""
    origin = F.concat(F.lit("https://"), host(F.col("entry_url")), F.lit("/"))
    rows = entries(spark, root).select("site_id", origin.alias("o"))
    urls = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(F.lit("<url><loc> <![CDATA["), "o", F.lit("docs/p"), i.cast("string"), F.lit("/?a=1&amp;b="), i.cast("string"), F.lit("]]></loc><lastmod>2026-01-0"), i.cast("string"), F.lit("</lastmod><priority>0."), i.cast("string"), F.lit("</priority></url>\n"))), "")
    index = F.concat(F.lit('<?xml version="1.0"?>\n<sitemapindex><sitemap><loc>'), "o", F.lit("one.xml</loc></sitemap><sitemap><loc>"), "o", F.lit("two.txt</loc></sitemap></sitemapindex>"))
    text = F.concat("o", F.lit("guides/a\n  "), "o", F.lit("docs/p1?b=1&a=1\n\nhttps://other.example/x\n"), "o", F.lit("logo.png"))
    each = F.explode(F.array(F.struct(F.concat("o", F.lit("sitemap.xml")).alias("sitemap"), index.alias("body")), F.struct(F.concat("o", F.lit("one.xml")).alias("sitemap"), F.concat(F.lit("<urlset>"), urls, F.lit("</urlset>")).alias("body")), F.struct(F.concat("o", F.lit("two.txt")).alias("sitemap"), text.alias("body"))))
    return rows.select("site_id", "o", each.alias("x")).select("site_id", "o", "x.sitemap", "x.body")


def sitemap_entries(spark: SparkSession, root: str) -> DataFrame:
    rows = sitemap_bodies(spark, root).select("site_id", "sitemap", F.col("sitemap").alias("base"), "body")
    return sitemap.entries(rows, ["site_id", "sitemap"]).select("site_id", "sitemap", "kind", F.col("pos").cast("long").alias("pos"), "url", "lastmod", "priority")


def sitemap_pages(spark: SparkSession, root: str) -> DataFrame:
    """Pages that a walk finds from the sitemaps that robots files name and from the usual places, through indexes."""
    bodies = materialize(sitemap_bodies(spark, root))
    origins = bodies.select("site_id", F.regexp_replace("o", "/$", "").alias("origin")).distinct()
    hints = robots.sitemap_hints(robots.directives(robots_bodies(spark, root)))
    return sitemap.collect(sitemap.seeds(origins, hints), bodies.select("sitemap", "body"), 2000).select("site_id", F.col("pos").cast("long").alias("pos"), "url")


def html_pages(spark: SparkSession, root: str) -> DataFrame:
    """(page_id, url, html): documents made of the pages' own fields, with head, navigation, main part and footer."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    rows = pages(spark, root, ["title", "description", "text"])
    html = F.concat(
        F.lit('<!doctype html><html lang="en-GB"><head><title>'), safe(F.col("title")), F.lit(" | Site</title>"), F.when(F.col("description") != "", F.concat(F.lit('<meta name="description" content="'), F.replace(safe(F.col("description")), F.lit('"'), F.lit("&quot;")), F.lit('">'))).otherwise(""),
        F.when(F.col("seq") % 17 == 0, '<meta name="robots" content="NOINDEX">').otherwise(""), F.lit('<link rel="canonical" href="./?utm_source=x"><script>var a = "</p>";</script></head><body><nav><a href="/docs/">Docs</a> <a href="#top">Top</a> <a href="mailto:a@b.c">Mail</a></nav><main><h1>'),
        safe(F.col("title")), F.lit("</h1> <p>"), F.replace(safe(F.col("text")), F.lit("\n"), F.lit("\n<p>")), F.lit('<a href="../next?b=2&amp;a=1">next</a></main><footer>&copy; <a href="//other.example/x">other</a></footer></body></html>'),
    )
    return rows.select(F.col("seq").alias("page_id"), "url", html.alias("html"))


def html_extract(spark: SparkSession, root: str) -> DataFrame:
    return extract_pages(html_pages(spark, root))


def html_fields(spark: SparkSession, root: str) -> DataFrame:
    """The fields of extracted pages that plain SQL can derive as well."""
    return html_extract(spark, root).select("page_id", "noindex", "page_lang", F.size("nav_links").cast("long").alias("nav_links"))


def _links(spark: SparkSession, root: str) -> DataFrame:
    own = pages(spark, root, []).select(F.col("seq").alias("page_id"), "site_id", "url")
    listed = table(spark, root, "extracted_pages").select("page_id", "links", "nav_links")
    return own.join(listed, "page_id")


def crawl_pages(spark: SparkSession, root: str) -> DataFrame:
    """Pages that a crawl of each site reaches along its links, in its order."""
    known = materialize(pages(spark, root, []).select("site_id", "url"))
    none = known.select("site_id", "url", F.lit(0).alias("pos")).where("false")
    return crawl.crawl(entries(spark, root), none, known, materialize(crawl.edges(_links(spark, root))))


def crawl_depths(spark: SparkSession, root: str) -> DataFrame:
    return crawl_pages(spark, root).select("site_id", "url", "depth")


def crawl_finished(spark: SparkSession, root: str) -> DataFrame:
    rows = materialize(_links(spark, root))
    done = crawl.finish(materialize(crawl_pages(spark, root)), crawl.edges(rows), crawl.nav_targets(rows), table(spark, root, "sites").where("monitoring"))
    return done.drop("seq")


def inbound_counts(spark: SparkSession, root: str) -> DataFrame:
    return crawl.inbound(crawl.edges(_links(spark, root)))


def _probes(spark: SparkSession, root: str) -> DataFrame:
    """(site_id, bot, status, body_length, baseline_length): deterministic answers to each crawler."""
    sites = table(spark, root, "sites").select("site_id", _number().alias("n"))
    each = sites.select("site_id", "n", F.posexplode(F.array(*[F.lit(b) for b in audit.BOTS])).alias("k", "bot"))
    return each.select("site_id", "bot", F.when((F.col("n") + F.col("k")) % 11 == 0, 403).when((F.col("n") + F.col("k")) % 13 == 0, None).otherwise(200).alias("status"), (F.lit(1000) - F.col("k") * (F.col("n") % 7) * 20).alias("body_length"), F.lit(1000).alias("baseline_length"))


def audit_bots(spark: SparkSession, root: str) -> DataFrame:
    rules = robots.access(entries(spark, root).select("site_id", F.col("entry_url").alias("url")), robots.directives(robots_bodies(spark, root)), _tokens(spark))
    names = spark.createDataFrame([(b, b.lower()) for b in audit.BOTS], "bot string, agent string")
    probes = _probes(spark, root).join(F.broadcast(names), "bot").join(rules.select("site_id", "agent", F.col("allowed").alias("robots_allowed")), ["site_id", "agent"], "left")
    return audit.bot_access(probes).select("site_id", "bot", F.coalesce("robots_allowed", F.lit(True)).alias("robots_allowed"), "status", "blocked", "shrunk")


def audit_counts(spark: SparkSession, root: str) -> DataFrame:
    return audit.page_counts(pages(spark, root, ["description", "word_count", "markdown_url", "content_hash"]))


def audit_existing(spark: SparkSession, root: str) -> DataFrame:
    """Each site's newest index file against its pages."""
    snapshots = history.latest_deliveries(table(spark, root, "snapshots")).where("pages IS NOT NULL").select("site_id", "snapshot_id", "created_at", "llms_txt")
    files = materialize(history.latest_snapshots(snapshots, ["llms_txt"]).select("site_id", F.col("llms_txt").alias("body")))
    return audit.existing_files(files, validate.verdicts(files, "site_id", "body"), pages(spark, root, []).select("site_id", "url"))


def audit_checks(spark: SparkSession, root: str) -> DataFrame:
    sites = table(spark, root, "sites").select("site_id", (_number() % 5 * 40).cast("int").alias("sitemap_urls")).join(robots_bodies(spark, root).withColumnRenamed("body", "robots_body"), "site_id", "left")
    return audit.checks(sites, audit_counts(spark, root), audit_bots(spark, root), audit_existing(spark, root))


def audit_report(spark: SparkSession, root: str) -> DataFrame:
    return audit.report(audit_checks(spark, root))


def _documents(spark: SparkSession, root: str) -> DataFrame:
    return materialize(document.documents(pages(spark, root, [*LINKED, "lead"]), entries(spark, root)))


def plan_apply(spark: SparkSession, root: str) -> DataFrame:
    """Indexes after model plans with repeated, missing and out-of-range ids; every fourth site has a broken plan."""
    docs = _documents(spark, root)
    links = materialize(plan.candidates(docs, pages(spark, root, ["markdown_url"])))
    n = _number()
    raw = F.when(n % 4 == 3, '{"sections": [').otherwise(F.concat(F.lit('{"title": " Planned ", "sections": [{"name": "Start", "items": [{"id": 2, "title": "Second"}, {"id": "1"}, {"id": 2}, {"id": 999}]}, {"name": " ", "items": [{"id": 0}]}, {"name": "optional", "items": [{"id": '), (n % 3 + 3).cast("string"), F.lit(', "notes": "kept"}]}, {"name": "Rest", "items": [{"title": "Null id"}]}]}')))
    outputs = table(spark, root, "sites").select("site_id", raw.alias("raw_json"))
    heads = docs.select("site_id", F.col("title").alias("name"), "summary").distinct()
    return plan.apply_plan(links, heads, docs, outputs)


def _evaluation(spark: SparkSession, root: str) -> DataFrame:
    docs = _documents(spark, root).where("url IS NOT NULL")
    index = materialize(plan.candidates(docs, pages(spark, root, ["markdown_url"])).select("site_id", "id", "link_title", "url"))
    sizes = index.groupBy("site_id").agg(F.count("*").alias("links")).where("links >= 3")
    n = _number()
    asked = F.lit('{"questions": [{"id": 0, "question": "a"}, {"id": 1, "question": " b "}, {"id": 1, "question": "again"}, {"id": 7.5, "question": "x"}, {"id": "2", "question": "c"}, {"id": -1, "question": "y"}]}')
    said = F.concat(F.lit('{"answers": [{"question": 0, "id": 0}, {"question": 1, "id": '), (n % 3).cast("string"), F.lit('}, {"question": 2, "id": 100000}, {"question": 0, "id": '), (n % 2).cast("string"), F.lit("}]}"))
    sites = table(spark, root, "sites")
    return plan.evaluation(index, plan.questions(sites.select("site_id", asked.alias("raw_json")), sizes), plan.answers(sites.select("site_id", said.alias("raw_json")), sizes))


def eval_accuracy(spark: SparkSession, root: str) -> DataFrame:
    return plan.accuracy(_evaluation(spark, root))


def eval_ambiguous(spark: SparkSession, root: str) -> DataFrame:
    return plan.ambiguous(_evaluation(spark, root))


#: Budget of the registered crawl: small enough that it binds on the tables at hand.
CRAWL_PAGES = 25


def _fetches(spark: SparkSession, root: str) -> DataFrame:
    """Fetches made of the crawled pages: some fail, redirect, aren't HTML or aren't to be indexed."""
    rows = pages(spark, root, ["from_sitemap", "inbound_links"]).join(entries(spark, root).select("site_id", "entry_url"), "site_id")
    fetches = rows.select(
        "site_id", "seq", "entry_url", F.col("url").alias("requested_url"), F.when(F.col("seq") % 23 == 0, F.col("entry_url")).when(F.col("seq") % 29 == 0, "https://elsewhere.example/").otherwise(F.col("url")).alias("final_url"),
        F.when(F.col("seq") % 19 == 0, 404).otherwise(200).alias("status"), F.when(F.col("seq") % 31 == 0, "application/json").otherwise("text/html; charset=utf-8").alias("content_type"), F.lit(False).alias("scope_to_path"), (F.col("seq") % 37 == 0).alias("noindex"),
        F.col("from_sitemap").alias("in_sitemap"), (F.coalesce("inbound_links", F.lit(0)) > 0).alias("via_link"),
    )
    return fetches


def crawl_statistics(spark: SparkSession, root: str) -> DataFrame:
    """Outcomes of fetches made of the crawled pages, and their statistics."""
    return crawl.statistics(crawl.outcomes(_fetches(spark, root)))


def crawl_inputs(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """What :func:`site_crawl` reads: entries, sitemap URLs in scope, outcomes of fetches, links in scope, and what robots files deny."""
    start = entries(spark, root).select("site_id", "entry_url", F.lit(False).alias("scope_to_path"))
    fetched = materialize(crawl.outcomes(_fetches(spark, root)).select("site_id", F.col("requested_url").alias("url"), "seq", "in_sitemap", "outcome"))
    own = Window.partitionBy("site_id").orderBy("seq")
    listed = fetched.where("in_sitemap").withColumn("pos", F.row_number().over(own)).where(F.col("pos") <= 4 * CRAWL_PAGES).select("site_id", "url", "pos")
    access = robots.access(fetched.select("site_id", "url"), robots.directives(robots_bodies(spark, root)), spark.createDataFrame([("SiteQuarry/1.0",)], "token string"))
    links = crawl.edges(_links(spark, root))
    # only pages of this collection can be fetched; the entry is one of them
    first = start.join(fetched.groupBy("site_id").agg(F.min_by("url", "seq").alias("url")), "site_id").select("site_id", F.coalesce("url", "entry_url").alias("entry_url"))
    return {
        "entries": first, "sitemap": crawl.scoped(listed, start, "url"), "fetched": fetched.select("site_id", "url", "outcome"),
        "links": materialize(crawl.scoped(links, start, "to_url")), "denied": materialize(access.where("NOT allowed").select("site_id", "url")),
    }


def site_crawl(spark: SparkSession, root: str) -> DataFrame:
    """The whole crawl: robots, scope, sitemap and links, gates of fetches, page budget and cap of visits."""
    return crawl.crawl(**crawl_inputs(spark, root), max_depth=3, max_pages=CRAWL_PAGES)


QUERIES = {
    "robots_rules": robots_rules, "robots_delays": robots_delays, "robots_sitemaps": robots_sitemaps, "robots_access": robots_access, "sitemap_entries": sitemap_entries, "sitemap_pages": sitemap_pages,
    "html_extract": html_extract, "html_fields": html_fields, "crawl_pages": crawl_pages, "crawl_depths": crawl_depths, "crawl_finished": crawl_finished, "crawl_statistics": crawl_statistics, "site_crawl": site_crawl, "inbound_counts": inbound_counts,
    "audit_bots": audit_bots, "audit_counts": audit_counts, "audit_existing": audit_existing, "audit_checks": audit_checks, "audit_report": audit_report, "plan_apply": plan_apply, "eval_accuracy": eval_accuracy, "eval_ambiguous": eval_ambiguous,
}

_ROBOTS = r"""
rb AS (SELECT site_id, E'# rules\nUser-agent: *\nDisallow: /legal\nAllow: /legal/terms$\nCrawl-delay: ' || (n % 4) || E'\n\nUser-agent: GPTBot\nSitemap: ' || rtrim(url) || E'sitemap.xml\nUser-agent: ClaudeBot\nDisallow: /*/docs # all\nAllow: /en/docs\nDisallow: /*?page=\n' ||
  CASE WHEN n % 2 = 0 THEN E'User-agent: PerplexityBot\nDisallow: /\n' ELSE E'User-agent: PerplexityBot\nDisallow:\n' END || E'no colon here\n' body FROM (SELECT *, CAST(substr(site_id, 6) AS BIGINT) n FROM sites) WHERE n % 3 <> 2),
r0 AS (SELECT site_id, unnest(string_split(body, E'\n')) raw, generate_subscripts(string_split(body, E'\n'), 1) - 1 AS no FROM rb),
r1 AS (SELECT *, trim(regexp_replace(raw, '#.*$', '')) line FROM r0),
r2 AS (SELECT site_id, no, lower(trim(string_split(line, ':')[1])) AS field, trim(regexp_replace(line, '^[^:]*:', '')) AS val FROM r1 WHERE contains(line, ':')),
r3 AS (SELECT *, field = 'user-agent' AND coalesce(lag(field) OVER (PARTITION BY site_id ORDER BY no), '') <> 'user-agent' starts FROM r2 WHERE field <> 'sitemap'),
r4 AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY site_id ORDER BY no) g FROM r3),
ag AS (SELECT DISTINCT site_id, g, lower(val) agent FROM r4 WHERE field = 'user-agent'),
ru AS (SELECT site_id, agent, no AS rule_no, field = 'allow' AS allow, val AS pattern FROM r4 JOIN ag USING (site_id, g) WHERE field = 'allow' OR (field = 'disallow' AND val <> '')),
"""
_ACCESS = r"""
tk AS (SELECT unnest(['gptbot', 'oai-searchbot', 'chatgpt-user', 'claudebot', 'perplexitybot', 'google-extended']) token),
ur AS (SELECT *, CASE WHEN EXISTS (FROM ag WHERE ag.site_id = x.site_id AND agent = token) THEN token WHEN EXISTS (FROM ag WHERE ag.site_id = x.site_id AND agent = '*') THEN '*' END use, regexp_replace(url, '^https?://[^/?#]*', '') pq FROM (__URLS__) x, tk),
hi AS (SELECT ur.site_id, url, token, allow, length(replace(pattern, '*', '')) len FROM ur JOIN ru ON ru.site_id = ur.site_id AND ru.agent = ur.use
  WHERE regexp_matches(pq, '^' || replace(regexp_replace(regexp_replace(pattern, '\$$', ''), '([.+?^${}()|\[\]\\])', '\\\1', 'g'), '*', '.*') || CASE WHEN pattern LIKE '%$' THEN '$' ELSE '' END)),
de AS (SELECT site_id, url, token FROM hi GROUP BY ALL HAVING NOT arg_max(allow, len * 2 + CAST(allow AS INT)))
"""
_EDGES = (
    r"""
, ex AS (SELECT pg.site_id, pg.url AS from_url, unnest(links) AS to_url FROM pg JOIN extracted_pages e ON e.page_id = pg.seq),
hs AS (SELECT DISTINCT site_id, from_url, to_url FROM ex WHERE regexp_extract(to_url, '^https?://(?:www\.)?([^/?#:]*)', 1) = regexp_extract(from_url, '^https?://(?:www\.)?([^/?#:]*)', 1)
  AND NOT regexp_matches(lower(regexp_extract(to_url, '^https?://[^/?#]*([^?#]*)', 1)), '\.(png|jpg|jpeg|gif|svg|webp|avif|ico|bmp|css|js|mjs|map|json|xml|rss|atom|pdf|zip|gz|tar|dmg|exe|pkg|woff|woff2|ttf|mp4|webm|mp3|wav|mov|csv|txt)$'))
"""
)
_COUNTS = "ac AS (SELECT site_id, count(*) pages, count(*) FILTER (length(description) >= 50) described, count(*) FILTER (word_count < 120) thin, count(*) FILTER (coalesce(markdown_url, '') <> '') markdown, count(content_hash) - count(DISTINCT content_hash) duplicates FROM pg GROUP BY site_id)"
_WITH_PAGES = PAGES_SQL.rstrip()
SQL = {
    "robots_rules": "WITH " + _ROBOTS.rstrip().rstrip(",") + " SELECT * FROM ru",
    "robots_delays": "WITH " + _ROBOTS + "dl AS (SELECT site_id, agent, arg_max(TRY_CAST(val AS DOUBLE), no) s FROM r4 JOIN ag USING (site_id, g) WHERE field = 'crawl-delay' AND TRY_CAST(val AS DOUBLE) IS NOT NULL GROUP BY ALL) SELECT site_id, agent, least(s * 1000, 2000) delay_ms FROM dl",
    "robots_sitemaps": "WITH " + _ROBOTS.rstrip().rstrip(",") + " SELECT site_id, val AS sitemap FROM r2 WHERE field = 'sitemap'",
    "robots_access": _WITH_PAGES + "," + _ROBOTS + _ACCESS.replace("__URLS__", "SELECT site_id, url FROM pg") + "SELECT site_id, url, token AS agent FROM de",
    "html_fields": _WITH_PAGES + " SELECT seq page_id, seq % 17 = 0 AS noindex, 'en' page_lang, 2 nav_links FROM pg",
    "crawl_depths": _WITH_PAGES.replace("WITH cp", "WITH RECURSIVE cp", 1)
    + _EDGES
    + ", bf AS (SELECT site_id, entry_url url, 0 AS depth FROM en WHERE (site_id, entry_url) IN (SELECT (site_id, url) FROM pg) UNION SELECT hs.site_id, hs.to_url, bf.depth + 1 FROM bf JOIN hs ON hs.site_id = bf.site_id AND hs.from_url = bf.url JOIN pg ON pg.site_id = hs.site_id AND pg.url = hs.to_url WHERE bf.depth < 3) SELECT site_id, url, min(depth) AS depth FROM bf GROUP BY ALL",
    "inbound_counts": _WITH_PAGES + _EDGES + " SELECT site_id, to_url url, count(*) inbound_links FROM hs GROUP BY ALL",
    "audit_counts": _WITH_PAGES + ", " + _COUNTS + " SELECT * FROM ac",
    "audit_bots": _WITH_PAGES
    + ","
    + _ROBOTS
    + _ACCESS.replace("__URLS__", "SELECT site_id, entry_url url FROM en")
    + """, pb AS (SELECT site_id, n, unnest(['GPTBot', 'OAI-SearchBot', 'ChatGPT-User', 'ClaudeBot', 'PerplexityBot', 'Google-Extended']) bot, unnest(range(6)) k FROM (SELECT site_id, CAST(substr(site_id, 6) AS BIGINT) n FROM sites)),
    st2 AS (SELECT *, CASE WHEN bot = 'Google-Extended' THEN NULL WHEN (n + k) % 11 = 0 THEN 403 WHEN (n + k) % 13 = 0 THEN NULL ELSE 200 END status, 1000 - k * (n % 7) * 20 len, NOT EXISTS (FROM de WHERE de.site_id = pb.site_id AND token = lower(bot)) ok FROM pb)
    SELECT site_id, bot, ok robots_allowed, CAST(status AS INTEGER) status, NOT ok OR coalesce(status, 200) >= 400 blocked, coalesce(status < 400 AND len < 600, false) shrunk FROM st2""",
}

_MAPS = r"""
o AS (SELECT site_id, 'https://' || nhost || '/' o FROM norm_st),
u4 AS (SELECT site_id, o, unnest(range(1, 5)) i FROM o),
sm AS (SELECT site_id, o || 'sitemap.xml' sitemap, 'sitemap' kind, p AS pos, o || f url, NULL lastmod, NULL priority FROM o, (VALUES (0, 'one.xml'), (1, 'two.txt')) v(p, f)
  UNION ALL SELECT site_id, o || 'one.xml', 'page', i - 1, o || 'docs/p' || i || '?a=1&b=' || i, '2026-01-0' || i, CAST('0.' || i AS DOUBLE) FROM u4
  UNION ALL SELECT site_id, o || 'two.txt', 'page', p, CASE f WHEN 'base' THEN o || 'two.txt' WHEN 'x' THEN 'https://other.example/x' ELSE o || f END, NULL, NULL FROM o, (VALUES (0, 'guides/a'), (1, 'docs/p1?a=1&b=1'), (2, 'base'), (3, 'x'), (4, 'logo.png')) v(p, f))
"""
_LAST_FILE = """
ls AS (SELECT site_id, snapshot_id, llms_txt body FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY created_at DESC, snapshot_id DESC) r FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY loaded_at DESC) q FROM snapshots) WHERE q = 1 AND pages IS NOT NULL)) WHERE r = 1)
"""
_EXISTING = (
    _LAST_FILE.rstrip()
    + r""",
pz AS (SELECT site_id, coalesce(regexp_matches(body, '^\s*#'), false) present, body FROM ls),
lk AS (SELECT DISTINCT site_id, regexp_replace(u, '/$', '') u FROM (SELECT site_id, unnest(regexp_extract_all(body, '\]\((https?://[^)\s]+)\)', 1)) u FROM pz WHERE present)),
cr AS (SELECT DISTINCT site_id, regexp_replace(url, '/$', '') u FROM pg),
sl AS (SELECT site_id, count(*) n FROM (SELECT * FROM lk EXCEPT SELECT * FROM cr) GROUP BY 1),
mi AS (SELECT site_id, count(*) n FROM (SELECT * FROM cr EXCEPT SELECT * FROM lk) GROUP BY 1),
vl AS (__VALID__),
xf AS (SELECT a.site_id, coalesce(present, false) present, coalesce(present, false) AND coalesce(valid, false) valid, CASE WHEN coalesce(present, false) THEN coalesce(sl.n, 0) ELSE 0 END stale_links, CASE WHEN coalesce(present, false) THEN coalesce(mi.n, 0) ELSE a.n END missing_pages
  FROM (SELECT site_id, count(*) n FROM pg GROUP BY 1) a LEFT JOIN pz USING (site_id) LEFT JOIN vl USING (site_id) LEFT JOIN sl USING (site_id) LEFT JOIN mi USING (site_id))
"""
)


def _valid_sql() -> str:
    """Validity of the newest files, by the SQL of the validation queries."""
    from sitequarry.plans.history_queries import _LINES

    lines = _LINES("SELECT site_id, body FROM ls", "site_id", "body")
    return lines.replace("WITH f AS", "WITH f AS", 1) + " SELECT f.site_id, NOT EXISTS (FROM i WHERE i.site_id = f.site_id AND level = 'error') valid FROM f WHERE body IS NOT NULL"


_AUDIT = (
    SQL["audit_bots"].rsplit("SELECT site_id, bot, ok", 1)[0].rstrip()
    + ", bo AS (SELECT site_id, bot, NOT ok OR coalesce(status, 200) >= 400 blocked, coalesce(status < 400 AND len < 600, false) shrunk FROM st2), "
    + _COUNTS
    + ","
    + _EXISTING.replace("__VALID__", _valid_sql()).rstrip()
    + r""",
bs AS (SELECT site_id, count(*) FILTER (blocked) blocked, count(*) FILTER (shrunk) shrunk, coalesce(string_agg(CASE WHEN blocked THEN bot END, ', ' ORDER BY bot), '') bn, coalesce(string_agg(CASE WHEN shrunk THEN bot END, ', ' ORDER BY bot), '') sn FROM bo GROUP BY 1),
al AS (SELECT s.site_id, rb.body robots_body, CAST(substr(s.site_id, 6) AS BIGINT) % 5 * 40 sitemap_urls, coalesce(pages, 0) pages, coalesce(described, 0) described, coalesce(thin, 0) thin, coalesce(markdown, 0) markdown, coalesce(duplicates, 0) duplicates,
  coalesce(blocked, 0) blocked, coalesce(shrunk, 0) shrunk, bn, sn, coalesce(present, false) present, coalesce(valid, false) valid, coalesce(stale_links, 0) stale_links, coalesce(missing_pages, 0) missing_pages
  FROM sites s LEFT JOIN rb USING (site_id) LEFT JOIN ac USING (site_id) LEFT JOIN bs USING (site_id) LEFT JOIN xf USING (site_id)),
ch AS (SELECT site_id, 1 AS check_no, 'bot-access' id, 25 weight, CASE WHEN blocked = 0 THEN 'pass' ELSE 'fail' END status, CASE WHEN blocked = 0 THEN 'no crawler is blocked' ELSE 'blocked: ' || bn END detail FROM al
  UNION ALL SELECT site_id, 2, 'bot-parity', 10, CASE WHEN shrunk = 0 THEN 'pass' ELSE 'warn' END, CASE WHEN shrunk = 0 THEN 'crawlers get the whole page' ELSE 'smaller page for: ' || sn END FROM al
  UNION ALL SELECT site_id, 3, 'robots', 5, CASE WHEN coalesce(robots_body, '') <> '' THEN 'pass' ELSE 'warn' END, 'robots file' FROM al
  UNION ALL SELECT site_id, 4, 'sitemap', 15, CASE WHEN sitemap_urls >= pages THEN 'pass' WHEN sitemap_urls > 0 THEN 'warn' ELSE 'fail' END, sitemap_urls || ' of ' || pages || ' pages listed' FROM al
  UNION ALL SELECT site_id, 5, 'descriptions', 20, CASE WHEN CAST(described AS DOUBLE) / greatest(pages, 1) >= 0.9 THEN 'pass' WHEN CAST(described AS DOUBLE) / greatest(pages, 1) >= 0.6 THEN 'warn' ELSE 'fail' END, described || ' of ' || pages || ' pages described' FROM al
  UNION ALL SELECT site_id, 6, 'thin-content', 15, CASE WHEN 1 - CAST(thin AS DOUBLE) / greatest(pages, 1) >= 0.9 THEN 'pass' WHEN 1 - CAST(thin AS DOUBLE) / greatest(pages, 1) >= 0.6 THEN 'warn' ELSE 'fail' END, thin || ' of ' || pages || ' pages thin' FROM al
  UNION ALL SELECT site_id, 7, 'duplicates', 5, CASE WHEN duplicates = 0 THEN 'pass' ELSE 'warn' END, duplicates || ' pages repeat others' FROM al
  UNION ALL SELECT site_id, 8, 'llms-txt', 5, CASE WHEN present AND valid AND stale_links = 0 AND missing_pages = 0 THEN 'pass' ELSE 'warn' END, CASE WHEN NOT present THEN 'no file' WHEN NOT valid THEN 'file not valid' ELSE stale_links || ' stale, ' || missing_pages || ' missing' END FROM al
  UNION ALL SELECT site_id, 9, 'markdown', 5, CASE WHEN markdown > 0 THEN 'pass' ELSE 'warn' END, markdown || ' Markdown versions' FROM al)
"""
)
SQL |= {
    "sitemap_entries": _WITH_PAGES + "," + _MAPS + "SELECT site_id, sitemap, kind, CAST(pos AS BIGINT) pos, url, lastmod, priority FROM sm",
    "sitemap_pages": _WITH_PAGES + "," + _MAPS + "SELECT site_id, CAST(row_number() OVER (PARTITION BY site_id ORDER BY q) AS BIGINT) pos, url FROM (SELECT site_id, url, min(CASE WHEN sitemap LIKE '%one.xml' THEN 0 ELSE 100 END + pos) q FROM sm WHERE kind = 'page' AND url NOT LIKE '%.png' AND url NOT LIKE '%.txt' AND url NOT LIKE 'https://other.%' GROUP BY ALL)",
    "audit_existing": _WITH_PAGES + "," + _EXISTING.replace("__VALID__", _valid_sql()) + "SELECT * FROM xf",
    "audit_checks": _AUDIT + "SELECT * FROM ch",
    "audit_report": _AUDIT + ", sc AS (SELECT site_id, CAST(floor(sum(weight * CASE status WHEN 'pass' THEN 1.0 WHEN 'warn' THEN 0.5 ELSE 0 END) / CAST(sum(weight) AS DOUBLE) * 100 + 0.5) AS INTEGER) score FROM ch GROUP BY 1) SELECT site_id, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 45 THEN 'D' ELSE 'F' END grade FROM sc",
    "crawl_finished": SQL["crawl_depths"].rsplit(" SELECT site_id, url, min(depth)", 1)[0]
    + r""", vi AS (SELECT site_id, url, min(depth) AS depth FROM bf GROUP BY ALL),
  ib AS (SELECT hs.site_id, to_url url, count(*) n FROM hs JOIN vi ON vi.site_id = hs.site_id AND vi.url = hs.from_url GROUP BY ALL),
  nv AS (SELECT DISTINCT site_id, u url FROM (SELECT pg.site_id, pg.url f, unnest(nav_links) u FROM pg JOIN extracted_pages e ON e.page_id = pg.seq) WHERE regexp_extract(u, '^https?://(?:www\.)?([^/?#:]*)', 1) = regexp_extract(f, '^https?://(?:www\.)?([^/?#:]*)', 1))
  SELECT vi.site_id, vi.url, depth, coalesce(ib.n, 0) inbound_links, nv.url IS NOT NULL in_nav, depth = 1 AND vi.site_id IN (SELECT site_id FROM sites WHERE monitoring) from_sitemap FROM vi LEFT JOIN ib USING (site_id, url) LEFT JOIN nv USING (site_id, url)""",
    "crawl_statistics": _WITH_PAGES
    + r""", ft AS (SELECT pg.site_id, seq, CASE WHEN seq % 23 = 0 THEN entry_url WHEN seq % 29 = 0 THEN 'https://elsewhere.example/' ELSE url END fin, CASE WHEN seq % 19 = 0 THEN 404 ELSE 200 END stt, seq % 31 <> 0 html, seq % 37 = 0 noi, from_sitemap, coalesce(inbound_links, 0) > 0 vl, entry_url FROM pg JOIN en USING (site_id)),
  oc AS (SELECT *, CASE WHEN stt >= 400 OR NOT html THEN 'failed' WHEN regexp_extract(fin, '^https?://([^/]*)', 1) <> regexp_extract(entry_url, '^https?://([^/]*)', 1) THEN 'skipped' WHEN row_number() OVER (PARTITION BY site_id, fin ORDER BY seq) > 1 OR noi THEN 'skipped' ELSE 'page' END oc FROM ft)
  SELECT site_id, count(*) FILTER (oc = 'page') fetched, count(*) FILTER (oc = 'failed') failed, count(*) FILTER (oc = 'skipped') skipped, count(*) FILTER (from_sitemap) sitemap_urls, CASE WHEN bool_or(from_sitemap) AND bool_or(vl) THEN 'sitemap+links' WHEN bool_or(from_sitemap) THEN 'sitemap' ELSE 'links' END discovered_via FROM oc GROUP BY 1""",
}


def _evaluation_sql() -> dict[str, str]:
    """Questions 0, 1 and 2 expect links 0, 1 and 2; the third goes unanswered."""
    from sitequarry.plans.page_queries import _HEADS, _RENDER, _links_sql

    docs = _links_sql(25, 120) + _HEADS + _RENDER.split(",\nln AS")[0]
    index = docs + ", ix AS (SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY section_pos, link_pos) - 1 AS id, lt, url, CAST(substr(site_id, 6) AS BIGINT) n FROM dc WHERE url IS NOT NULL), sz AS (SELECT site_id, n FROM ix GROUP BY ALL HAVING count(*) >= 3)"
    picked = ", pk AS (SELECT site_id, n, 0 AS position, 0 AS want, n % 2 AS got FROM sz UNION ALL SELECT site_id, n, 1, 1, n % 3 FROM sz)"
    return {
        "eval_accuracy": index + " SELECT site_id, CAST(floor((CAST(n % 2 = 0 AS INT) + CAST(n % 3 = 1 AS INT)) / 3.0 * 100 + 0.5) AS INTEGER) accuracy, 3 questions FROM sz",
        "eval_ambiguous": index + picked + " SELECT pk.site_id, pk.position AS position, ix.url, (SELECT arg_min(lt, id) FROM ix z WHERE z.site_id = ix.site_id AND z.url = ix.url) chosen_title FROM pk JOIN ix ON ix.site_id = pk.site_id AND ix.id = pk.got WHERE want <> got",
    }


SQL |= _evaluation_sql()
