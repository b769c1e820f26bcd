from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitequarry.functions import urls
from sitequarry.functions.urls import normalize


def test_normal_form():
    assert normalize("https://WWW.Acme.com/Docs/?utm_source=x&b=2&a=1#top") == "https://acme.com/Docs?a=1&b=2"
    assert normalize("https://acme.com") == "https://acme.com/"
    assert normalize("http://acme.com:80/a//") == "http://acme.com/a"
    assert normalize("https://acme.com:444/?flag&x=%20") == "https://acme.com:444/?flag=&x=+"
    assert normalize("https://acme.com/?reference=1&Source_id=2&hsa_a=3&keep=4") == "https://acme.com/?keep=4"
    assert normalize("https://u:p@acme.com/a/../b/./c/%2e%2E/d") == "https://acme.com/b/d"
    assert normalize("https://acme.com/é b|^") == "https://acme.com/%C3%A9%20b|^"
    assert normalize("https:\\\\acme.com\\a") == "https://acme.com/a"


def test_what_is_no_page_address():
    for bad in (None, "mailto:a@b.c", "javascript:void(0)", "ftp://acme.com/", "https://", "https://a b/", "https://acme.com:99999/", "/relative"):
        assert normalize(bad) is None


def test_references_resolve_against_the_page():
    base = "https://acme.com/docs/start?x=1"
    assert normalize("next", base) == "https://acme.com/docs/next"
    assert normalize("../up/", base) == "https://acme.com/up"
    assert normalize("//other.com/a", base) == "https://other.com/a"
    assert normalize("?y=2", base) == "https://acme.com/docs/start?y=2"
    assert normalize("", base) == "https://acme.com/docs/start?x=1"
    assert normalize("/root", base) == "https://acme.com/root"


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40), st.text(alphabet="abc/?&=.%2e#é +", max_size=30))
def test_normal_form_is_a_fixed_point(host, rest):
    once = normalize("https://" + (host or "h") + "/" + rest)
    if once is not None:
        assert normalize(once) == once or "www." in once


def test_columns(spark):
    rows = spark.createDataFrame(
        [("https://acme.com/", "https://acme.com/docs/"), ("https://acme.com/docs/quick_start-guide.html", "https://acme.com/docs/"), ("https://acme.com/docs-old/a.PDF", "https://acme.com/docs/"), ("https://www.other.com/x", "https://acme.com/"), (None, "https://acme.com/")],
        "url string, entry string",
    )
    u = F.col("url")
    got = rows.select(urls.title_from_path(u), urls.is_likely_page(u), urls.is_same_site(u, F.col("entry")), urls.in_scope(u, F.col("entry"), F.lit(True)), urls.base_path(u)).collect()
    assert [r[0] for r in got[:4]] == ["Home", "Quick Start Guide", "A", "X"]
    assert [r[1] for r in got[:4]] == [True, True, False, True]
    assert [r[2] for r in got] == [True, True, True, False, False]
    assert [r[3] for r in got[:4]] == [False, True, True, False]
    assert [r[4] for r in got[:4]] == ["/", "/docs", "/docs-old", "/x/"]


def test_link_header(spark):
    rows = spark.createDataFrame([('<a.css>; rel=preload, </p.md>; rel="alternate"; type="text/markdown"',), ("<x>; rel=alternate",), (None,)], "h string")
    assert [r[0] for r in rows.select(urls.markdown_from_header(F.col("h"))).collect()] == ["/p.md", None, None]
