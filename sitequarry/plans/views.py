"""Views over the tables that several queries share, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequarry.functions.text import normalize_whitespace
from sitequarry.functions.urls import ensure_url, normalize_url, path
from sitequarry.operators.pages import classify
from sitequarry.operators.skew import newest_rows
from sitequarry.sources.tables import table

#: Columns that ranking and grouping need, and those that documents need besides.
RANKED = ["depth", "from_sitemap", "inbound_links", "in_nav", "word_count", "markdown_url", "description"]
LINKED = [*RANKED, "title"]
#: Characters of a text that can matter to a summary.
LEAD = 600


def pages(spark: SparkSession, root: str, columns: list[str] | None = None) -> DataFrame:
    """Crawled pages in the stored form: normalised url, path, kind and ``columns``, one row a (site_id, url); ``seq`` is the page_id.

    Only the columns asked for are read and shuffled. ``lead`` is the beginning of the text with its white space
    normalised, cut at the scan: summaries need no more, and whole texts then never travel.
    """
    columns = LINKED if columns is None else columns
    own = [F.substring(normalize_whitespace(F.col("text")), 1, LEAD).alias("lead") if c == "lead" else F.col(c) for c in columns]
    raw = table(spark, root, "crawled_pages").where("page_id IS NOT NULL AND url IS NOT NULL").select("page_id", "loaded_at", "site_id", "url", *own)
    once = newest_rows(raw, "page_id", F.col("loaded_at")).drop("loaded_at").withColumnRenamed("page_id", "seq")
    normal = once.withColumn("url", normalize_url(ensure_url(F.col("url")))).where("url IS NOT NULL")
    first = normal.groupBy("site_id", "url").agg(F.min_by(F.struct("seq", *columns), "seq").alias("r")).select("site_id", "url", "r.*")
    return first.withColumns({"path": path(F.col("url")), "kind": classify(F.col("url"))})


def entries(spark: SparkSession, root: str) -> DataFrame:
    """(site_id, entry_url, site_name) of every site."""
    return table(spark, root, "sites").select("site_id", normalize_url(ensure_url(F.col("url"))).alias("entry_url"), "site_name")


def norm_sql(source: str, keep: str) -> str:
    """CTE text ``norm_<source>``: rows of ``source`` with ``nurl``, ``nhost`` and ``npath`` of its column url."""
    return rf"""
{source}_1 AS (SELECT *, regexp_replace(CASE WHEN regexp_matches(trim(url, E' \t\n\r'), '^(?i)https?://') THEN trim(url, E' \t\n\r') ELSE 'https://' || trim(url, E' \t\n\r') END, '#.*$', '') u1 FROM {source}),
{source}_2 AS (SELECT *, lower(regexp_extract(u1, '^([A-Za-z]+):', 1)) sch, regexp_replace(u1, '^[A-Za-z]+:/*', '') rest FROM {source}_1),
{source}_3 AS (SELECT *, lower(regexp_extract(rest, '^[^/?]*')) h0, array_to_string(list_transform(string_split(regexp_extract(rest, '^[^/?]*([^?]*)', 1), ''), lambda c: CASE WHEN ord(c) < 128 THEN c ELSE url_encode(c) END), '') p0, regexp_extract(rest, '^[^?]*\?(.*)$', 1) q0 FROM {source}_2),
{source}_4 AS (SELECT *, regexp_replace(regexp_replace(h0, CASE sch WHEN 'http' THEN ':80$' ELSE ':443$' END, ''), '^www\.', '') nhost,
  CASE WHEN regexp_replace(p0, '/+$', '') = '' THEN '/' ELSE regexp_replace(p0, '/+$', '') END npath,
  array_to_string(list_sort(list_filter(string_split(q0, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?i)(utm_|fbclid|gclid|mc_[ce]id|ref|source|hsa_)'))), '&') nq FROM {source}_3),
norm_{source} AS (SELECT {keep}, sch || '://' || nhost || npath || CASE WHEN nq <> '' THEN '?' || nq ELSE '' END nurl, nhost, npath FROM {source}_4)"""


def kind_sql(path_column: str) -> str:
    from sitequarry.operators.pages import KINDS

    parts = f"list_filter(string_split(lower({path_column}), '/'), lambda s: s <> '')"
    rules = " ".join(f"WHEN len(list_filter({parts}, lambda s: regexp_full_match(s, '{w}'))) > 0 THEN '{k}'" for k, w in KINDS.items())
    return f"CASE WHEN len({parts}) = 0 THEN 'home' {rules} ELSE 'other' END"


PAGES_SQL = (
    "WITH cp AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY loaded_at DESC) rn FROM crawled_pages) WHERE rn = 1),"
    + norm_sql("cp", "page_id seq, site_id, title, description, depth, from_sitemap, inbound_links, in_nav, word_count, markdown_url, content_hash, text")
    + f""",
pg AS (SELECT * EXCLUDE (rn, nurl, npath), nurl url, npath path, {kind_sql("npath")} kind FROM
  (SELECT *, row_number() OVER (PARTITION BY site_id, nurl ORDER BY seq) rn FROM norm_cp) WHERE rn = 1),
st AS (SELECT * FROM sites),"""
    + norm_sql("st", "site_id, site_name")
    + """,
en AS (SELECT site_id, nurl entry_url, site_name FROM norm_st)
"""
)

SCORE_SQL = r"""CAST(CASE kind WHEN 'home' THEN 100 WHEN 'docs' THEN 40 WHEN 'api' THEN 38 WHEN 'guide' THEN 34 WHEN 'product' THEN 26 WHEN 'support' THEN 16 WHEN 'company' THEN 14
  WHEN 'blog' THEN 12 WHEN 'legal' THEN 2 ELSE 10 END AS DOUBLE) - depth * 8 + least(inbound_links, 12) * CAST(2.5 AS DOUBLE) + CASE WHEN in_nav THEN 18 ELSE 0 END + CASE WHEN from_sitemap THEN 6 ELSE 0 END
  + CASE WHEN markdown_url <> '' THEN 10 ELSE 0 END + CASE WHEN description <> '' THEN 8 ELSE 0 END + least(CAST(word_count AS DOUBLE) / 300, 6)
  - CASE WHEN regexp_matches(path, '/(page|tag|category|author)/') THEN 20 ELSE 0 END - CASE WHEN len(list_filter(string_split(path, '/'), lambda s: s <> '')) > 4 THEN 6 ELSE 0 END"""


def label_sql(text: str) -> str:
    words = rf"regexp_replace(regexp_replace({text}, '(?i)\.[a-z]+$', ''), '[-_]+', ' ', 'g')"
    return f"array_to_string(list_transform(string_split({words}, ''), lambda c, i: CASE WHEN regexp_matches(c, '^[A-Za-z0-9_]$') AND (i = 1 OR NOT regexp_matches(string_split({words}, '')[i - 1], '^[A-Za-z0-9_]$')) THEN upper(c) ELSE c END), '')"
