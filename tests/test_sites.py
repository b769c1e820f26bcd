import gzip
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sitequarry.operators import audit, crawl, plan, robots, sitemap
from sitequarry.operators.progress import latest_heartbeats, progress

ROBOTS = """User-agent: *
Disallow: /private
Allow: /private/ok
Crawl-delay: 1.5
Sitemap: https://acme.com/a.xml

user-agent: GPTBot
Sitemap: https://acme.com/b.xml
User-agent: ClaudeBot  # both
Disallow: /
Allow: /*.md$

User-agent: Empty
Disallow:
no colon
"""


def lines(spark, body):
    return robots.directives(spark.createDataFrame([("s", body)], "site_id string, body string"))


def allowed(spark, body, agent, url):
    urls, agents = spark.createDataFrame([("s", url)], "site_id string, url string"), spark.createDataFrame([(agent,)], "token string")
    return robots.access(urls, lines(spark, body), agents).first().allowed


def test_robots_groups_and_rules(spark):
    assert not allowed(spark, ROBOTS, "Other/1.0", "https://acme.com/private/x")
    assert allowed(spark, ROBOTS, "Other/1.0", "https://acme.com/private/ok?a=1")
    assert not allowed(spark, ROBOTS, "gptbot", "https://acme.com/docs")
    assert not allowed(spark, ROBOTS, "ClaudeBot", "https://acme.com/docs")
    assert allowed(spark, ROBOTS, "ClaudeBot", "https://acme.com/docs.md")
    assert not allowed(spark, ROBOTS, "ClaudeBot", "https://acme.com/docs.md?x=1")
    assert allowed(spark, ROBOTS, "Empty", "https://acme.com/private")
    assert allowed(spark, None, "GPTBot", "https://acme.com/") and allowed(spark, "", "GPTBot", "https://acme.com/")
    assert allowed(spark, "Disallow: /", "GPTBot", "https://acme.com/"), "rules before any agent don't count"
    assert allowed(spark, "User-agent: *\nDisallow: /a\nAllow: /a", "x", "https://acme.com/a"), "allow wins ties"
    assert not allowed(spark, "User-agent: *\nDisallow: /a(b", "x", "https://acme.com/a(bc"), "all else is literal"


def test_robots_hints_and_delays(spark):
    found = lines(spark, ROBOTS)
    assert [r.sitemap for r in robots.sitemap_hints(found).orderBy("no").collect()] == ["https://acme.com/a.xml", "https://acme.com/b.xml"]
    assert [r.delay_ms for r in robots.delays(found).collect()] == [1500.0]
    late = robots.delays(lines(spark, "User-agent: a\nCrawl-delay: 60\nCrawl-delay: x\nUser-agent: b\nCrawl-delay: 9\nCrawl-delay: 1")).collect()
    assert {r.agent: r.delay_ms for r in late} == {"a": 2000.0, "b": 1000.0}


def entries(spark, body, base="https://acme.com/map.xml"):
    return sitemap.entries(spark.createDataFrame([(1, base, body)], "id int, base string, body string"), ["id"]).orderBy("pos").collect()


def test_sitemaps(spark):
    got = entries(spark, "<urlset><url><loc> https://www.acme.com/a/ </loc><lastmod>2026-01-02</lastmod><priority>0.8</priority></url><url><loc><![CDATA[https://acme.com/b?x=1&amp;y=2]]></loc><priority>high</priority></url><url><loc></loc></url>")
    assert [(r.kind, r.url, r.lastmod, r.priority) for r in got] == [("page", "https://acme.com/a", "2026-01-02", 0.8), ("page", "https://acme.com/b?x=1&y=2", None, None)]
    got = entries(spark, "<?xml?>\n<sitemapindex xmlns='x'><sitemap><loc>/one.xml</loc></sitemap></sitemapindex>")
    assert [(r.kind, r.url) for r in got] == [("sitemap", "https://acme.com/one.xml")]
    got = entries(spark, "https://acme.com/x\n\nmailto:a@b.c\n/y")
    assert [r.url for r in got] == ["https://acme.com/x", "https://acme.com/map.xml", "https://acme.com/y"]
    assert entries(spark, None) == []


def test_gzip_bodies(spark):
    rows = spark.createDataFrame([(bytearray(gzip.compress("<a/>é".encode())),), (bytearray(b"nope"),), (None,)], "b binary")
    assert [r[0] for r in rows.select(sitemap.gunzip("b")).collect()] == ["<a/>é", None, None]


def test_sitemap_walk(spark):
    bodies = [("https://a.com/i.xml", "<sitemapindex><sitemap><loc>https://a.com/1.xml</loc></sitemap><sitemap><loc>https://a.com/i.xml</loc></sitemap></sitemapindex>"), ("https://a.com/1.xml", "<urlset><url><loc>https://a.com/p</loc></url><url><loc>https://a.com/x.png</loc></url><url><loc>https://b.com/q</loc></url><url><loc>https://a.com/p/</loc></url><url><loc>https://a.com/r</loc></url></urlset>")]
    seeds = spark.createDataFrame([("s", "https://a.com/", 0, "https://a.com/i.xml"), ("s", "https://a.com/", 1, "https://a.com/none.xml")], "site_id string, origin string, pos int, sitemap string")
    got = sitemap.collect(seeds, spark.createDataFrame(bodies, "sitemap string, body string"), 2).orderBy("pos").collect()
    assert [r.url for r in got] == ["https://a.com/p", "https://a.com/r"]


def test_sitemap_walk_by_batches(spark):
    """Off-site children are left, packed files read, repeats use up their place in a batch, and a site ends after the batch with its 25th sitemap."""
    index = lambda urls: "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"
    page = lambda n: f"<urlset><url><loc>https://a.com/p{n}</loc></url></urlset>"
    files = [("https://a.com/robots-map.xml", 200, index([f"https://a.com/c{i}.xml" for i in range(40)] + ["https://b.com/off.xml"]).encode()), ("https://b.com/off.xml", 200, page("off").encode())]
    files += [(f"https://a.com/c{i}.xml", 200, page(i).encode()) for i in range(40)] + [("https://a.com/sitemap.txt", 404, b"https://a.com/never"), ("https://c.com/m.xml.gz", 200, gzip.compress(b"https://c.com/z"))]
    bodies = sitemap.read_bodies(spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in files], "sitemap string, status int, content binary"))
    origins = spark.createDataFrame([("s", "https://a.com"), ("t", "https://c.com")], "site_id string, origin string")
    hints = spark.createDataFrame([("s", 3, "https://a.com/robots-map.xml"), ("s", 9, "https://a.com/sitemap.xml"), ("t", 0, "https://c.com/m.xml.gz")], "site_id string, no int, sitemap string")
    seeds = sitemap.seeds(origins, hints)
    assert [r.sitemap for r in seeds.where("site_id = 's'").orderBy("pos").limit(3).collect()] == ["https://a.com/robots-map.xml", "https://a.com/sitemap.xml", "https://a.com/sitemap_index.xml"]
    got = sitemap.collect(seeds, bodies, 100).collect()
    # 7 places to begin with, then 18 of the 40 children: batches of 5 end at 25 seen
    assert sorted((r.pos, r.url) for r in got if r.site_id == "s") == [(i + 1, f"https://a.com/p{i}") for i in range(18)]
    assert [r.url for r in got if r.site_id == "t"] == ["https://c.com/z"]
    assert sitemap.collect(seeds, bodies, 4).where("site_id = 's'").count() == 4
    assert sitemap.collect(seeds.where("false"), bodies, 4).count() == 0


def queue_crawl(entries, listed, outcome, links, denied, max_depth, max_pages):
    """First in, first out, one URL at a time."""
    stored = []
    for site, entry in entries:
        queue, visited, pages = [(entry, 0)] + [(u, 1) for u in listed.get(site, [])], set(), []
        while queue and len(pages) < max_pages and len(visited) < 3 * max_pages:
            url, depth = queue.pop(0)
            if url in visited or (site, url) in denied or (site, url) not in outcome:
                continue
            visited.add(url)
            if outcome[site, url] != "page":
                continue
            pages.append(url)
            stored.append((site, url, depth, len(pages)))
            queue += [(u, depth + 1) for u in links.get((site, url), []) if depth + 1 <= max_depth]
    return stored


@pytest.mark.parametrize("seed", range(3))
def test_crawl_equals_a_queue(spark, seed):
    rng = random.Random(seed)
    urls = [f"https://a.com/{i}" for i in range(60)]
    sites = ["s", "t", "empty"]
    outcome = {(s, u): rng.choice(["page", "page", "page", "failed", "skipped"]) for s in sites for u in urls} | {(s, urls[0]): "page" for s in sites}
    links = {(s, u): [rng.choice(urls) for _ in range(4)] for s in sites for u in urls}
    denied, listed = {(s, rng.choice(urls[1:])) for s in sites for _ in range(5)}, {"s": [rng.choice(urls) for _ in range(6)]}
    edges = [(s, u, k, v) for (s, u), vs in links.items() for k, v in enumerate(vs)]
    for most in (4, 12, 500):
        want = queue_crawl([(s, urls[0]) for s in sites], listed, outcome, links, denied, 3, most)
        got = crawl.crawl(
            spark.createDataFrame([(s, urls[0]) for s in sites], "site_id string, entry_url string"), spark.createDataFrame([("s", u, k) for k, u in enumerate(listed["s"])], "site_id string, url string, pos int"),
            spark.createDataFrame([(s, u, o) for (s, u), o in outcome.items()], "site_id string, url string, outcome string"), spark.createDataFrame(edges, "site_id string, from_url string, pos int, to_url string"),
            3, most, spark.createDataFrame(sorted(denied), "site_id string, url string"),
        )
        assert sorted(map(tuple, got.collect())) == sorted(want)


def graph(spark, links):
    urls = sorted({u for f, ts in links.items() for u in (f, *ts)})
    pages = spark.createDataFrame([("s", f"https://a.com/{u}") for u in urls if u != "gone"], "site_id string, url string")
    rows = spark.createDataFrame([("s", f"https://a.com/{f}", [f"https://a.com/{t}" for t in ts] + ["https://b.com/", "https://a.com/i.png"]) for f, ts in links.items()], "site_id string, url string, links array<string>")
    return pages, crawl.edges(rows)


def test_crawl_order_cycles_and_budget(spark):
    pages, links = graph(spark, {"": ["b", "a", "b", ""], "a": ["c", "gone"], "b": ["d", "a"], "c": ["e"], "d": ["c"], "e": ["f"], "map": ["z"]})
    start = spark.createDataFrame([("s", "https://a.com/")], "site_id string, entry_url string")
    plan_map = spark.createDataFrame([("s", "https://a.com/map", 0), ("s", "https://a.com/", 1)], "site_id string, url string, pos int")
    got = crawl.crawl(start, plan_map, pages, links, max_depth=3).orderBy("seq").collect()
    assert [(r.url[14:], r.depth) for r in got] == [("", 0), ("map", 1), ("b", 1), ("a", 1), ("z", 2), ("d", 2), ("c", 2), ("e", 3)]
    assert [r.seq for r in got] == list(range(1, 9))
    few = crawl.crawl(start, plan_map.where("false"), pages, links, max_depth=3, max_pages=4)
    assert [r.url[14:] for r in few.orderBy("seq").collect()] == ["", "b", "a", "d"]


def test_inbound_and_flags(spark):
    pages, links = graph(spark, {"": ["a", ""], "a": ["b"], "x": ["a"]})
    visited = spark.createDataFrame([("s", "https://a.com/", 0, 1), ("s", "https://a.com/a", 1, 2), ("s", "https://a.com/b", 2, 3)], "site_id string, url string, depth int, seq long")
    nav = spark.createDataFrame([("s", "https://a.com/b")], "site_id string, url string")
    got = {r.url[14:]: r for r in crawl.finish(visited, links, nav, spark.createDataFrame([("s",)], "site_id string")).collect()}
    assert (got[""].inbound_links, got["a"].inbound_links, got["b"].inbound_links) == (1, 1, 1), "self-links count, pages not visited don't"
    assert got["b"].in_nav and not got["a"].in_nav and got["a"].from_sitemap and not got["b"].from_sitemap


def test_fetch_outcomes(spark):
    rows = [(1, "https://a.com/x", 200, "text/html", False), (2, "https://a.com/x", 200, "text/html", False), (3, "https://a.com/y", 404, "text/html", False), (4, "https://a.com/z", 200, "image/png", False), (5, "https://b.com/", 200, "text/html", False), (6, "https://a.com/n", 200, "text/html", True), (7, None, None, None, None)]
    fetches = spark.createDataFrame([("s", *r[:1], "https://a.com/", False, *r[1:]) for r in rows], "site_id string, seq int, entry_url string, scope_to_path boolean, final_url string, status int, content_type string, noindex boolean")
    assert [r.outcome for r in crawl.outcomes(fetches).orderBy("seq").collect()] == ["page", "skipped", "failed", "failed", "skipped", "skipped", "failed"]
    bodies = spark.createDataFrame([(200, 5, "hello"), (500, 5, "oops"), (200, 4_000_000, "big"), (200, None, "x" * 3_000_010)], "status int, content_length int, body string")
    assert [len(r.body) for r in crawl.capped_body(bodies).collect()] == [5, 0, 0, 3_000_000]


def test_audit(spark):
    weights = spark.createDataFrame([("s", 50, "pass"), ("s", 30, "warn"), ("s", 20, "fail")], "site_id string, weight int, status string")
    got = audit.report(weights).first()
    assert (got.score, got.grade) == (65, "C")
    grades = spark.createDataFrame([(s,) for s in (95, 90, 75, 60, 45, 44)], "s int").select(audit.grade(F.col("s"))).collect()
    assert [g[0] for g in grades] == ["A", "A", "B", "C", "D", "F"]
    probes = spark.createDataFrame([("s", "GPTBot", True, 200, 599, 1000), ("s", "ClaudeBot", False, 200, 1000, 1000), ("s", "PerplexityBot", True, None, None, 1000), ("s", "Google-Extended", True, 403, 1, 1000)], "site_id string, bot string, robots_allowed boolean, status int, body_length int, baseline_length int")
    bots = {r.bot: (r.blocked, r.shrunk) for r in audit.bot_access(probes).collect()}
    assert bots == {"GPTBot": (False, True), "ClaudeBot": (True, False), "PerplexityBot": (False, False), "Google-Extended": (False, False)}
    pages = spark.createDataFrame([("s", "https://a.com/x", "d" * 50, 120, "m", "h"), ("s", "https://a.com/y/", "d", 10, None, "h"), ("s", "https://a.com/z", None, 500, "", None)], "site_id string, url string, description string, word_count int, markdown_url string, content_hash string")
    counts = audit.page_counts(pages).first()
    assert (counts.pages, counts.described, counts.thin, counts.markdown, counts.duplicates) == (3, 1, 1, 1, 1)
    files = spark.createDataFrame([("s", " # A\n[x](https://a.com/x/) [q](https://a.com/q) [r](/rel)")], "site_id string, body string")
    verdict = spark.createDataFrame([("s", True)], "site_id string, valid boolean")
    existing = audit.existing_files(files, verdict, pages)
    row = existing.first()
    assert (row.present, row.valid, row.stale_links, row.missing_pages) == (True, True, 1, 2)
    absent = audit.existing_files(files.withColumn("body", F.lit("text")), verdict, pages).first()
    assert (absent.present, absent.missing_pages) == (False, 3)
    sites = spark.createDataFrame([("s", "User-agent: *", 2), ("empty", None, 0)], "site_id string, robots_body string, sitemap_urls int")
    got = {(r.site_id, r.id): r.status for r in audit.checks(sites, audit.page_counts(pages), audit.bot_access(probes), existing).collect()}
    assert len(got) == 18
    assert [got["s", i] for i in ("bot-access", "bot-parity", "robots", "sitemap", "descriptions", "thin-content", "duplicates", "llms-txt", "markdown")] == ["fail", "warn", "pass", "warn", "fail", "warn", "warn", "warn", "pass"]
    assert [got["empty", i] for i in ("sitemap", "thin-content", "descriptions", "robots")] == ["pass", "pass", "fail", "warn"]


def plan_inputs(spark, n=4):
    links = spark.createDataFrame([("s", i, f"L{i}", f"https://a.com/{i}", f"n{i}", "docs") for i in range(n)], "site_id string, id int, link_title string, url string, notes string, kind string")
    heads = spark.createDataFrame([("s", "Acme", "sum")], "site_id string, name string, summary string")
    docs = links.select("site_id", F.lit("Acme").alias("title"), F.lit("sum").alias("summary"), F.lit(1).alias("section_pos"), F.lit("Docs").alias("section"), (F.col("id") + 1).alias("link_pos"), "link_title", "url", "notes")
    return links, heads, docs


def applied(spark, raw, n=4):
    links, heads, docs = plan_inputs(spark, n)
    rows = plan.apply_plan(links, heads, docs, spark.createDataFrame([("s", raw)], "site_id string, raw_json string")).orderBy("section_pos", "link_pos").collect()
    return rows[0].title, [(r.section, r.link_title, r.notes) for r in rows]


def test_model_plans(spark):
    title, rows = applied(spark, '{"title": " New ", "sections": [{"name": "Optional", "items": [{"id": 1, "title": "One"}]}, {"name": "A", "items": [{"id": "2", "notes": "n"}, {"id": 1}, {"id": null}, {"id": 77}, {"id": "x"}]}, {"name": " ", "items": [{"id": 3}]}]}')
    assert title == "New"
    assert rows == [("A", "L2", "n"), ("A", "L0", "n0"), ("Optional", "One", "n1"), ("Optional", "L3", "n3")]
    for raw in (None, "", "{", '{"sections": []}', '{"sections": [{"name": "A", "items": [{"id": 9}]}]}'):
        assert applied(spark, raw)[1] == [("Docs", f"L{i}", f"n{i}") for i in range(4)]
    assert len(applied(spark, '{"sections": [{"name": "A", "items": [{"id": 0}]}]}', 40)[1]) == 26


def test_retrieval_scores(spark):
    index = spark.createDataFrame([("s", i, f"L{i}", f"https://a.com/{i % 3}") for i in range(4)], "site_id string, id int, link_title string, url string")
    sizes = spark.createDataFrame([("s", 4)], "site_id string, links long")
    one = lambda raw: spark.createDataFrame([("s", raw)], "site_id string, raw_json string")
    asked = plan.questions(one('{"questions": [{"id": 2, "question": " q "}, {"id": 2, "question": "again"}, {"id": 4, "question": "far"}, {"id": 1.5, "question": "half"}, {"id": 0, "question": " "}, {"id": "1", "question": "text id"}, {"question": "zero"}]}'), sizes)
    assert [(r.position, r.id, r.question) for r in asked.orderBy("position").collect()] == [(0, 2, "q"), (1, 1, "text id"), (2, 0, "zero")]
    given = plan.answers(one('{"answers": [{"question": 0, "id": 3}, {"question": 0, "id": 2}, {"question": 1, "id": 0}, {"question": 2, "id": 9}]}'), sizes)
    rows = plan.evaluation(index, asked, given)
    assert [r.correct for r in rows.orderBy("position").collect()] == [True, False, False]
    assert plan.accuracy(rows).first().accuracy == 33
    assert [(r.position, r.url, r.chosen_title) for r in plan.ambiguous(rows).collect()] == [(1, "https://a.com/0", "L0")]
    assert plan.questions(one("nonsense"), sizes).count() == 0 and plan.answers(one(None), sizes).count() == 0


def test_progress(spark):
    at = datetime(2026, 1, 1)
    beat = lambda s, f=90, q=10: (f, q, datetime(2026, 1, 1, 0, 0, s) if s >= 0 else datetime(2025, 12, 31))
    rows = [("fresh", "running", 500, 60, 900, at, beat(10)), ("stale", "running", 500, 60, 900, at, beat(-1)), ("none", "running", 500, 60, 900, at, None), ("done", "done", 500, 60, 0, at, beat(10)), ("full", "running", 50, 60, 0, at, None), ("zero", "running", 500, 0, 0, at, None)]
    got = {r.job_id: (r.fetched, r.queued, r.percent) for r in progress(spark.createDataFrame(rows, "job_id string, status string, target int, fetched int, queued int, updated_at timestamp, heartbeat struct<fetched:int,queued:int,beat_at:timestamp>")).collect()}
    assert got == {"fresh": (90, 10, 90), "stale": (60, 900, 12), "none": (60, 900, 12), "done": (60, 0, 100), "full": (60, 0, 99), "zero": (0, 0, 0)}
    beats = spark.createDataFrame([("j", 1, 2, at), ("j", 3, 4, datetime(2026, 1, 2))], "job_id string, fetched int, queued int, beat_at timestamp")
    assert latest_heartbeats(beats).first().heartbeat.fetched == 3
