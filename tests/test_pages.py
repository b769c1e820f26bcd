from pyspark.sql import functions as F

from sitequarry.operators.document import documents, render
from sitequarry.operators.pages import classify, highlights, rank, scored
from sitequarry.operators.sections import sections
from sitequarry.operators.validate import issues, lines, sections as file_sections, verdicts

SCHEMA = "site_id string, seq long, url string, path string, kind string, title string, description string, depth int, inbound_links int, in_nav boolean, from_sitemap boolean, word_count int, markdown_url string, text string"


def page(seq, path, kind="other", site="s", title=None, description="", markdown=None, **more):
    base = {"depth": 1, "inbound_links": 0, "in_nav": False, "from_sitemap": False, "word_count": 0, "text": "body"} | more
    return (site, seq, f"https://acme.com{path}", path, kind, title or f"T{seq}", description, base["depth"], base["inbound_links"], base["in_nav"], base["from_sitemap"], base["word_count"], markdown, base["text"])


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def entries(spark, site="s"):
    return spark.createDataFrame([(site, "https://acme.com/", "Acme")], "site_id string, entry_url string, site_name string")


def test_kinds(spark):
    want = {"/": "home", "/docs/a": "docs", "/x/API-Reference/y": "api", "/how-to/b": "guide", "/blog/docs": "docs", "/pricing": "product", "/case-studies/z": "company", "/faq": "support", "/privacy": "legal", "/whatever": "other", "/apis": "other"}
    rows = spark.createDataFrame([("https://acme.com" + p,) for p in want], "url string")
    assert [r[0] for r in rows.select(classify(F.col("url"))).collect()] == list(want.values())


def test_scores_and_ranks(spark):
    rows = frame(spark, [page(1, "/legal", "legal"), page(2, "/docs", "docs", in_nav=True, inbound_links=20, word_count=9000, description="d", markdown="https://acme.com/docs.md", from_sitemap=True), page(3, "/docs/b", "docs"), page(4, "/docs/a", "docs"), page(5, "/a/b/c/d/e", "other"), page(6, "/tag/x", "other")])
    got = {r.seq: r.score for r in scored(rows).collect()}
    assert got[2] == 40 - 8 + 30 + 18 + 6 + 10 + 8 + 6
    assert got[5] == 10 - 8 - 6 and got[6] == 10 - 8 - 20
    order = [r.seq for r in rank(rows).orderBy("rank").collect()]
    assert order[:3] == [2, 3, 4], "equal scores keep crawl order"
    assert [r.seq for r in highlights(rows, 2).orderBy("rank").collect()] == [2, 3]


def test_budgets_overflow_and_optional(spark):
    for n, kept, optional in ((24, 24, 0), (25, 25, 0), (26, 25, 1)):
        got = sections(frame(spark, [page(i, f"/docs/{i}", "docs") for i in range(n)]), entries(spark)).groupBy("section").count().collect()
        assert {r[0]: r[1] for r in got} == {"Documentation": kept} | ({"Optional": optional} if optional else {})
    kinds = ["docs", "api", "guide", "product", "company"]
    for total, want in ((119, 119), (120, 120), (121, 120)):
        rows = [page(i, f"/{kinds[i % 5]}/{i}", kinds[i % 5]) for i in range(total)]
        links = sections(frame(spark, rows), entries(spark))
        assert links.count() == want
        assert links.groupBy("section").count().agg(F.max("count")).first()[0] <= 25


def test_fold_order_and_entry(spark):
    rows = [page(0, "/", "home"), page(1, "/zeta/a"), page(2, "/zeta/b"), page(3, "/alpha/a"), page(4, "/alpha/b"), page(5, "/lone/a"), page(6, "/blog/x", "blog"), page(7, "/privacy", "legal"), page(8, "/docs/q", "docs"), page(9, "/docs/q2", "docs", markdown="https://acme.com/docs/q")]
    got = sections(frame(spark, rows), entries(spark)).orderBy("section_pos", "link_pos").collect()
    assert list(dict.fromkeys(r.section for r in got)) == ["Documentation", "Blog & Updates", "Alpha", "Zeta", "Other Pages", "Optional"]
    assert [r.title for r in got if r.section == "Documentation"] == ["T9"], "of equal targets the best ranked is kept"
    assert all(r.title != "T0" for r in got)


def test_rendered_files_are_valid(spark):
    rows = [page(0, "/", "home", title="Welcome | Acme", description="# Best\nwidgets"), page(1, "/docs/a", "docs", title="Using [it] | Acme", description="- notes"), page(2, "/docs/é", "docs", title="E"), page(3, "/blog/p", "blog")]
    text = render(documents(frame(spark, rows), entries(spark))).first().llms_txt
    assert text.startswith("# Acme\n\n> \\# Best widgets\n\n## Documentation\n\n- [Using it](https://acme.com/docs/a): \\- notes\n")
    assert "https://acme.com/docs/%C3%A9" in text and text.endswith("\n") and "Welcome" not in text
    found = verdicts(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").first()
    assert found.valid and found.links == 3 and found.title == "Acme"


def test_sites_without_pages(spark):
    text = render(documents(frame(spark, []), entries(spark))).first().llms_txt
    assert text == "# Acme\n"


GOOD = "# Acme\n\n> Sum\n\ndetail\n\n## Docs\n\n- [A](https://a.com/a): note\n- [B](/b)\n"


def check(spark, text):
    files = spark.createDataFrame([(1, text)], "id int, t string")
    found = issues(lines(files, "id", "t"), files, "id", "t").collect()
    return sorted((r.level, r.line or 0, r.message.split(":")[0]) for r in found)


def test_validation(spark):
    assert check(spark, GOOD) == [] and check(spark, "﻿" + GOOD.replace("\n", "\r\n")) == []
    assert ("error", 0, "Missing required H1 title") in check(spark, "## Docs\n- [a](https://a.com)")
    bad = check(spark, "# T\n> s\n## D\n- [a](https://a.com)\n- broken\nfree\n- [a2](https://a.com)\n- [r](rel)\n### deep\n> late\n# two")
    assert bad == sorted([("error", 5, "List item must look like `- [title](url)"), ("warning", 6, "Free text inside a section is ignored by parsers"), ("warning", 7, "Duplicate link"), ("warning", 8, "Link should be absolute"), ("warning", 9, "Headings deeper than H2 are not part of the format"), ("warning", 10, "The blockquote summary should directly follow the title"), ("error", 11, "Only one H1 title is allowed")])
    assert check(spark, "") == [("error", 0, "Missing required H1 title"), ("warning", 0, "No blockquote summary; agents rely on it for context"), ("warning", 0, "No link sections found")]
    assert check(spark, None) == []


def test_parsed_documents(spark):
    files = spark.createDataFrame([(1, GOOD + "## More\n\n- [C](/c)\n- [A again](https://a.com/a)\n"), (2, None)], "id int, t string")
    got = [(r.section_no, r.section, r.link_no, r.title, r.url, r.notes) for r in file_sections(lines(files, "id", "t"), "id").orderBy("section_no", "link_no").collect()]
    assert got == [(1, "Docs", 1, "A", "https://a.com/a", "note"), (1, "Docs", 2, "B", "/b", None), (2, "More", 1, "C", "/c", None), (2, "More", 2, "A again", "https://a.com/a", None)]
    row = verdicts(files, "id", "t").first()
    assert (row.valid, row.errors, row.warnings, row.title, row.summary, row.sections, row.links) == (True, 0, 1, "Acme", "Sum", 2, 4)
