"""All queries of the subpackage on the smallest tables, and exact ones against brute force."""

import os
import re
from collections import Counter, defaultdict

import pandas as pd
import pytest

import __spark_entry__
from sitequarry.llm.registry import MODULES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
NAMES = [n for m in MODULES for n in m.QUERIES]
COLUMNS = {
    "p1_found": ["record_set", "page_id", "line_no"], "p2_found": ["field", "page_id", "line_no"], "p4_found": ["field", "page_id"], "p5_found": ["page_id_a", "page_id_b"],
    "p6_found": ["field", "first_page_id", "page_id"], "p7_found": ["field", "page_id"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", NAMES)
def test_query_runs(spark, name):
    rows = __spark_entry__.queries()[name](spark, SMALL)
    if name in COLUMNS:
        assert rows.columns == COLUMNS[name]
        frame = rows.toPandas()
        assert len(frame) and not frame.duplicated().any() and not frame.isna().any().any()
    else:
        rows.write.format("noop").mode("overwrite").save()


def pages():
    return pd.read_parquet(f"{SMALL}/crawled_pages.parquet").drop_duplicates("page_id")


def test_similar_pairs_equal_brute_force(spark):
    word, sets = re.compile(r"[^\W_]+"), {}
    for page, title, text in pages()[["page_id", "title", "text"]].itertuples(index=False):
        if text and len(word.findall(text)) >= 40:
            w = word.findall(f"{title or ''} {text}".lower())
            sets[page] = set(zip(w, w[1:], w[2:], strict=False))
    ids = sorted(sets)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    got = {tuple(r) for r in __spark_entry__.queries()["p5_found"](spark, SMALL).collect()}
    assert got == want


def test_repeated_lines_equal_brute_force(spark):
    def key(line):
        return " ".join(re.sub(r"[0-9]|[^\w]|_", " ", line.lower()).split())

    want = set()
    for field in ("text", "description"):
        by_site = defaultdict(dict)
        for page, site, value in pages()[["page_id", "site_id", field]].itertuples(index=False):
            if value:
                by_site[site][page] = [key(x) for x in value.split("\n")]
        for rows in by_site.values():
            seen = Counter(k for lines in rows.values() for k in set(lines) if k)
            for page, lines in rows.items():
                want |= {(field, page, i) for i, k in enumerate(lines, 1) if seen[k] >= 8 and seen[k] >= 0.05 * len(rows)}
    got = {tuple(r) for r in __spark_entry__.queries()["p2_found"](spark, SMALL).collect()}
    assert got == want
