"""Lines repeated across one site's documents: likelihood-ratio excess over other sites, with false-discovery control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.functions.text import line_key
from sitequarry.llm.rows import one_per_page, union_all
from sitequarry.operators.skew import attach
from sitequarry.sources.tables import materialize

#: A line is repeated in a site when it occurs in so many distinct pages and in this share of the site's non-empty ones.
LEAST_PAGES, LEAST_SHARE = 8, 0.05
#: False-discovery rate of the likelihood-ratio tests.
FDR = 0.1
#: Prior of the outside frequency: so many pages in which the line occurs this often.
PRIOR_PAGES, PRIOR_HITS = 1000.0, 0.5

FIELDS = ("text", "description")


def line_hashes(value: Column) -> Column:
    """Array with the 64-bit hash of each line's key by position; null for lines that are empty after normalising."""
    keys = F.transform(F.split(value, "\n"), line_key)
    return F.transform(keys, lambda k: F.when(k != "", F.xxhash64(k)))


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, site_id, field, hashes) of each non-empty value, one row a page and field.

    Texts are turned into hashes before anything is shuffled.
    """
    rows = pages.select("page_id", "site_id", "loaded_at", *[line_hashes(F.col(f)).alias(f) for f in FIELDS], *[(F.coalesce(F.col(f), F.lit("")) != "").alias(f"has_{f}") for f in FIELDS])
    once = one_per_page(rows, ["site_id", *FIELDS, *[f"has_{f}" for f in FIELDS]])
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("hashes"), F.col(f"has_{f}").alias("has")) for f in FIELDS])
    return once.select("page_id", "site_id", F.explode(fields).alias("f")).select("page_id", "site_id", "f.*").where("has").drop("has")


def line_statistics(lines: DataFrame) -> DataFrame:
    """Candidate lines with their counts and log-likelihood ratio: one row a (site_id, field, hash) with enough pages.

    ``k`` of ``n`` pages of the site have the line. Outside frequencies are taken over the sites in which the line
    is rare (below LEAST_SHARE): a line that templates of many sites share would otherwise hide itself. With the
    prior added, ``outside_k`` of ``outside_n`` pages have it there, and ``g`` is the G statistic of the two
    proportions, 0 where the site's is not the greater.
    """
    sizes = lines.groupBy("site_id", "field").agg(F.count("*").alias("n"))
    hits = lines.select("site_id", "field", F.explode(F.array_distinct(F.filter("hashes", lambda h: h.isNotNull()))).alias("hash"))
    counts = materialize(hits.groupBy("site_id", "field", "hash").agg(F.count("*").alias("k")))
    # a site has about as many lines as it has pages: hot sites are those of many pages
    total, near = lines.count(), F.col("k") >= LEAST_SHARE * F.col("n")
    candidates = attach(counts.where(F.col("k") >= LEAST_PAGES), sizes, ["site_id", "field"], "n", total).where(near)
    # a site that has the line on a single page counts outside like any other
    same = counts.join(candidates.select("field", "hash").distinct(), ["field", "hash"], "left_semi")
    seen = attach(same, sizes, ["site_id", "field"], "n", total)
    totals = seen.groupBy("field", "hash").agg(
        F.sum(F.when(near, F.col("n")).otherwise(0)).alias("near_n"), F.sum(F.when(near, 0).otherwise(F.col("k"))).alias("rare_k")
    )
    all_pages = sizes.groupBy("field").agg(F.sum("n").alias("all_n"))
    joined = candidates.join(totals, ["field", "hash"]).join(F.broadcast(all_pages), "field")  # all_pages: one row a field
    joined = joined.withColumns({"outside_k": F.col("rare_k") + PRIOR_HITS, "outside_n": F.col("all_n") - F.col("near_n") + PRIOR_PAGES})
    k, n, k0, n0 = (F.col(c).cast("double") for c in ("k", "n", "outside_k", "outside_n"))
    both = (k + k0) / (n + n0)
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    g = 2 * (term(k, n * both) + term(n - k, n * (1 - both)) + term(k0, n0 * both) + term(n0 - k0, n0 * (1 - both)))
    return joined.withColumn("g", F.when(k / n > k0 / n0, F.greatest(g, F.lit(0.0))).otherwise(0.0))


def chi2_tail(g: Column) -> Column:
    """Upper tail of the chi-squared distribution with one degree of freedom: erfc(sqrt(g / 2)), by a rational fit (7 digits)."""
    x = F.sqrt(g / 2)
    t = 1 / (1 + 0.5 * x)
    # Coefficients of the published Chebyshev fit of erfc.
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(c[-1])
    for a in reversed(c[:-1]):
        poly = poly * t + a
    return F.least(F.lit(1.0), t * F.exp(poly - x * x))


def excess_lines(lines: DataFrame) -> DataFrame:
    """Lines in significant excess: Benjamini-Hochberg over all candidates of all sites.

    The ranks come from a histogram of p-values (a bin is a thousandth of a decade, 330,000 bins at most, so the
    window over them is bounded); a bin's p is its upper edge, so the rate is never exceeded.
    """
    tested = materialize(line_statistics(lines).withColumn("p", F.greatest(chi2_tail(F.col("g")), F.lit(1e-300))))
    tested = tested.withColumn("bin", F.floor(-F.log10("p") * 1000).cast("int"))
    bins = tested.groupBy("bin").agg(F.count("*").alias("m"))
    bins = materialize(bins)
    total = bins.agg(F.sum("m")).first()[0] or 0
    ranked = bins.withColumn("rank", F.sum("m").over(Window.orderBy(F.desc("bin"))))
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / 1000) * total <= FDR * F.col("rank"))
    least = passed.agg(F.min("bin")).first()[0]
    # two numbers come to the driver: how many tests there are, and the bin from which on they are significant
    return tested.where(F.col("bin") >= least if least is not None else F.lit(False)).drop("bin")


def excess_by_site(lines: DataFrame, excess: DataFrame) -> DataFrame:
    """(site_id, field, n, repeated): a site's excess lines in one array.

    As each is in LEAST_SHARE of the pages, there are at most (lines a page) / LEAST_SHARE of them.
    """
    return excess.groupBy("site_id", "field").agg(F.max("n").alias("n"), F.collect_list("hash").alias("repeated"))


def repeated_lines(pages: DataFrame) -> DataFrame:
    """(field, page_id, line_no) of every line in excess in its site.

    Pages without site_id form one site. Null and empty values don't count. A page_id delivered twice counts once.
    Empty tables give no rows.
    """
    lines = materialize(page_lines(pages))
    sites = excess_by_site(lines, excess_lines(lines))
    marked = attach(lines, sites, ["site_id", "field"], "n", lines.count())
    at = F.posexplode("hashes").alias("at", "hash")
    return marked.select("field", "page_id", "repeated", at).where(F.array_contains("repeated", F.col("hash"))).select("field", "page_id", (F.col("at") + 1).cast("long").alias("line_no"))


def without_repeats(pages: DataFrame) -> DataFrame:
    """(page_id, site_id, text, description): each page without its site's excess lines, the others in their order.

    A value all of whose lines are in excess becomes empty; null stays null.
    """
    lines = materialize(page_lines(pages))
    excess = materialize(excess_by_site(lines, excess_lines(lines)))
    sizes = lines.select("page_id", "site_id").distinct().groupBy("site_id").agg(F.count("*").alias("rows"))
    by_site = excess.groupBy(F.col("site_id").alias("s")).agg(*[F.first(F.when(F.col("field") == f, F.col("repeated")), ignorenulls=True).alias(f"repeated_{f}") for f in FIELDS])
    lists = sizes.join(by_site, F.col("site_id").eqNullSafe(F.col("s")), "left").drop("s")
    once = one_per_page(pages.select("page_id", "site_id", "loaded_at", *FIELDS), ["site_id", *FIELDS])
    lone = once.where(~F.coalesce(*[F.nullif(F.col(f), F.lit("")) for f in FIELDS], F.lit("")).rlike(r"\S"))
    kept = attach(once.where(F.coalesce(*[F.nullif(F.col(f), F.lit("")) for f in FIELDS], F.lit("")).rlike(r"\S")), lists, ["site_id"], "rows", lines.count())

    def clean(field: str) -> Column:
        found = F.coalesce(F.col(f"repeated_{field}"), F.array().cast("array<bigint>"))
        pairs = F.arrays_zip(F.split(field, "\n").alias("line"), line_hashes(F.col(field)).alias("hash"))
        rest = F.filter(pairs, lambda x: x["hash"].isNull() | ~F.array_contains(found, x["hash"]))
        return F.array_join(F.transform(rest, lambda x: x["line"]), "\n")

    columns = lambda rows, change: rows.select("page_id", "site_id", *[(F.when(F.col(f).isNotNull(), clean(f)) if change else F.col(f)).alias(f) for f in FIELDS])
    return union_all([columns(kept, True), columns(lone, False)])
