"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitequarry.llm.repeats import repeated_lines, without_repeats
from sitequarry.sources.tables import table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return repeated_lines(table(spark, root, "crawled_pages")).distinct()


def p2_clean(spark: SparkSession, root: str) -> DataFrame:
    return without_repeats(table(spark, root, "crawled_pages"))


_LINES = r"""
WITH d AS (SELECT page_id, any_value(site_id) site_id, any_value(text) text, any_value(description) description FROM crawled_pages GROUP BY page_id),
f AS (SELECT page_id, site_id, 'text' field, text v FROM d WHERE text <> '' UNION ALL SELECT page_id, site_id, 'description', description FROM d WHERE description <> ''),
n AS (SELECT site_id, field, count(*) n FROM f GROUP BY ALL),
l0 AS (SELECT page_id, site_id, field, unnest(string_split(v, E'\n')) line, generate_subscripts(string_split(v, E'\n'), 1) line_no FROM f),
l AS (SELECT *, trim(regexp_replace(lower(line), '[^\pL\pN]|[0-9]', ' ', 'g')) k0 FROM l0),
k AS (SELECT page_id, site_id, field, line, line_no, trim(regexp_replace(k0, ' +', ' ', 'g')) k FROM l),
r AS (SELECT site_id, field, k, count(DISTINCT page_id) c FROM k WHERE k <> '' GROUP BY ALL),
x AS (SELECT site_id, field, k FROM r JOIN n USING (site_id, field) WHERE c >= 8 AND c >= 0.05 * n)
"""

QUERIES = {"p2_found": p2_found, "p2_clean": p2_clean}
SQL = {
    "p2_found": _LINES + "SELECT field, page_id, CAST(line_no AS BIGINT) line_no FROM k JOIN x USING (site_id, field, k)",
    "p2_clean": _LINES
    + r""", m AS (SELECT k.*, x.k IS NOT NULL bad FROM k LEFT JOIN x USING (site_id, field, k)),
  c AS (SELECT page_id, field, coalesce(string_agg(line, E'\n' ORDER BY line_no) FILTER (NOT bad), '') v FROM m GROUP BY ALL)
  SELECT d.page_id, d.site_id, coalesce(t.v, d.text) text, coalesce(e.v, d.description) description FROM d
  LEFT JOIN c t ON t.page_id = d.page_id AND t.field = 'text' LEFT JOIN c e ON e.page_id = d.page_id AND e.field = 'description'""",
}
