"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitequarry.llm.near_duplicates import NearDuplicates
from sitequarry.sources.tables import table


def _near(spark: SparkSession, root: str) -> NearDuplicates:
    return NearDuplicates(table(spark, root, "crawled_pages").select("page_id", "loaded_at", "title", "text"), words=3, threshold=0.6, least_words=40)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return _near(spark, root).page_pairs().distinct()


def p5_groups(spark: SparkSession, root: str) -> DataFrame:
    return _near(spark, root).groups()


def p5_class_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Similar pairs of class representatives, copies not expanded."""
    return _near(spark, root).pairs


QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups, "p5_class_pairs": p5_class_pairs}
_PAIRS = r"""
d AS (SELECT page_id, any_value(title) title, any_value(text) text FROM crawled_pages GROUP BY page_id),
w AS (SELECT page_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || text), '[\pL\pN]+') w FROM d WHERE text IS NOT NULL AND len(regexp_extract_all(text, '[\pL\pN]+')) >= 40),
s AS (SELECT DISTINCT page_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) s FROM w),
n AS (SELECT page_id, count(*) n, md5(string_agg(s, '|' ORDER BY s)) k FROM s GROUP BY page_id),
p AS (SELECT a.page_id a, b.page_id b, count(*) c FROM s a JOIN s b ON a.s = b.s AND a.page_id < b.page_id GROUP BY ALL),
f AS (SELECT a, b, c / (x.n + y.n - c) similarity FROM p JOIN n x ON x.page_id = a JOIN n y ON y.page_id = b WHERE c >= 0.6 * (x.n + y.n - c))"""
SQL = {
    "p5_found": f"WITH {_PAIRS} SELECT a page_id_a, b page_id_b FROM f",
    "p5_groups": f"""
WITH RECURSIVE {_PAIRS},
e AS (SELECT a, b FROM f UNION ALL SELECT b, a FROM f),
r AS (SELECT page_id id, page_id g FROM n UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.id),
o AS (SELECT a, count(*) links FROM e GROUP BY a)
SELECT n.page_id, min(n.page_id) OVER (PARTITION BY n.k) class_id, m.group_id, coalesce(o.links, 0) links
FROM n JOIN (SELECT id, min(g) group_id FROM r GROUP BY id) m ON m.id = n.page_id LEFT JOIN o ON o.a = n.page_id""",
    "p5_class_pairs": f"WITH {_PAIRS}, l AS (SELECT min(page_id) page_id FROM n GROUP BY k) SELECT a, b, similarity FROM f JOIN l x ON x.page_id = a JOIN l y ON y.page_id = b",
}
