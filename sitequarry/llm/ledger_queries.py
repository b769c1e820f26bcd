"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequarry.llm.ledger import address_rows, build_ledger, duplicates
from sitequarry.sources.tables import materialize, table


def _rows(spark: SparkSession, root: str) -> DataFrame:
    return materialize(address_rows(table(spark, root, "crawled_pages"), table(spark, root, "extracted_pages")))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    rows = _rows(spark, root)
    return duplicates(rows, build_ledger(rows)).select("field", "first_page_id", "page_id").distinct()


def p6_pages(spark: SparkSession, root: str) -> DataFrame:
    """One row a page address with its number of copies and its earliest page."""
    return build_ledger(_rows(spark, root)).select("field", "first_page_id", F.col("copies").cast("long").alias("copies"))


_KEYS = r"""
WITH a AS (SELECT DISTINCT 'url' field, page_id, url address FROM crawled_pages UNION SELECT DISTINCT 'canonical', page_id, canonical FROM extracted_pages),
b AS (SELECT field, page_id, regexp_replace(trim(address, E' \t\n\r '), '#.*$', '', 's') u FROM a WHERE address IS NOT NULL AND trim(address) <> ''),
c AS (SELECT *, CASE WHEN regexp_matches(u, '^(?i)http:') THEN 'http' ELSE 'https' END scheme, regexp_replace(u, '^(?i)(https?:)?/*', '') rest FROM b),
d AS (SELECT *, lower(url_decode(regexp_extract(rest, '^[^?]*'))) w, regexp_extract(rest, '^[^?]*\?(.*)$', 1, 's') q FROM c),
e AS (SELECT *, regexp_replace(regexp_extract(w, '^[^/]*'), '^www\.', '') h0, regexp_replace(regexp_replace(regexp_replace(w, '^[^/]*', ''), '/+', '/', 'g'), '/$', '') p FROM d),
k AS (SELECT field, page_id, scheme || '://' || regexp_replace(h0, CASE scheme WHEN 'http' THEN ':80$' ELSE ':443$' END, '') || p || '?' ||
  array_to_string(list_sort(list_filter(list_transform(string_split(q, '&'), lambda x: lower(url_decode(x))), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_|fbclid|gclid|mc_[ce]id|ref|source|hsa_)'))), '&') AS key FROM e),
u AS (SELECT DISTINCT field, page_id, key FROM k),
g AS (SELECT field, key, min(page_id) first_page_id, count(*) copies FROM u GROUP BY field, key)
"""

QUERIES = {"p6_found": p6_found, "p6_pages": p6_pages}
SQL = {
    "p6_found": _KEYS + "SELECT DISTINCT field, first_page_id, page_id FROM u JOIN g USING (field, key) WHERE page_id <> first_page_id",
    "p6_pages": _KEYS + "SELECT field, first_page_id, copies FROM g",
}
