"""Sections of a site's index: buckets, budgets and the Optional section."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.functions.urls import label, segments, title_from_path
from sitequarry.operators.pages import scored
from sitequarry.sources.tables import materialize

#: Sections of the kinds, in their order.
SECTIONS = {
    "home": "Overview", "docs": "Documentation", "api": "API Reference", "guide": "Guides & Tutorials", "product": "Product",
    "company": "Company", "support": "Support", "blog": "Blog & Updates", "other": "Other Pages", "legal": "Optional",
}
#: Links a section and links a file.
PER_SECTION, PER_FILE = 25, 120


def bucket_name() -> Column:
    first = F.get(segments(F.col("url")), F.lit(0))
    named = reduce(lambda a, kv: a.when(F.col("kind") == kv[0], kv[1]), [kv for kv in SECTIONS.items() if kv[0] != "other"], F.when(F.lit(False), ""))
    return named.otherwise(F.when(F.coalesce(first, F.lit("")) == "", SECTIONS["other"]).otherwise(label(first)))


def link_candidates(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """Pages with target and bucket; the entry page left out, of equal targets the best ranked kept.

    ``entries`` has (site_id, entry_url), normalised, one row a site. URLs of pages are normal, too.
    """
    target = F.coalesce("markdown_url", "url")
    rows = scored(pages).withColumn("target", target).join(entries.select("site_id", "entry_url"), "site_id", "left")
    rows = rows.where(F.coalesce((F.col("url") != F.col("entry_url")) & (F.col("target") != F.col("entry_url")), F.lit(True)))
    keep = ["url", "kind", "title", "description", "score", "seq"]
    best = rows.groupBy("site_id", "target").agg(F.max_by(F.struct(*keep), F.struct("score", -F.col("seq"))).alias("p"))
    return best.select("site_id", "target", "p.*").withColumn("bucket", bucket_name())


def sections(pages: DataFrame, entries: DataFrame, per_section: int = PER_SECTION, per_file: int = PER_FILE) -> DataFrame:
    """(site_id, section_pos, section, link_pos, title, url, notes): the links of each site's index.

    Buckets of one page named after a path are folded into Other Pages, behind its own pages. Sections stand in
    the fixed order, path-named ones (by name) after the blog. A section keeps its ``per_section`` best pages,
    the file ``per_file`` links over the sections in order; legal pages, overflow and cut pages compete by score for
    the Optional section, ties in the order in which they fell out.

    No window sees a whole site: first each bucket is cut to the rows that can still matter (per section, file and
    Optional together), which each task does before the shuffle.
    """
    # written once: sizes, ranks and both ends of the budget read it
    rows = materialize(link_candidates(pages, entries))
    reach = 2 * per_section + per_file
    fixed = list(SECTIONS.values())
    sizes = rows.groupBy("site_id", "bucket").agg(F.count("*").alias("bucket_n"))
    lone = sizes.where((F.col("bucket_n") == 1) & ~F.col("bucket").isin(fixed)).select("site_id", "bucket", F.lit(True).alias("folded"))
    rows = rows.join(lone, ["site_id", "bucket"], "left").withColumn("folded", F.coalesce("folded", F.lit(False)))
    rows = rows.withColumn("section", F.when(F.col("folded"), SECTIONS["other"]).otherwise(F.col("bucket")))
    order = ["folded", F.desc("score"), "seq"]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("site_id", "section").orderBy(*order))).where(F.col("rank") <= reach)
    optional = F.col("section") == SECTIONS["legal"]
    names = {n: i for i, n in enumerate(fixed)}
    index = reduce(lambda a, kv: a.when(F.col("section") == kv[0], kv[1]), names.items(), F.when(F.lit(False), 0)).otherwise(names["Other Pages"])
    place = F.struct(index.alias("i"), (F.col("section") == "Other Pages").alias("o"), F.lower("section").alias("l"), F.col("section").alias("n"))
    rows = rows.withColumn("place", place)
    in_budget = Window.partitionBy("site_id").orderBy("place", "rank")
    kept = rows.where(~optional & (F.col("rank") <= per_section)).withColumn("no", F.row_number().over(in_budget))
    chosen = kept.where(F.col("no") <= per_file)
    # the order in which pages fell out: legal ones, then section by section the overflow and the pages cut by the budget
    fell = (
        rows.where(optional).withColumn("fell", F.struct(F.lit(0).alias("a"), F.col("place").alias("b"), F.lit(0).alias("c"), F.col("rank").alias("d")))
        .unionByName(rows.where(~optional & (F.col("rank") > per_section)).withColumn("fell", F.struct(F.lit(1).alias("a"), F.col("place").alias("b"), F.lit(0).alias("c"), F.col("rank").alias("d"))))
        .unionByName(kept.where(F.col("no") > per_file).drop("no").withColumn("fell", F.struct(F.lit(1).alias("a"), F.col("place").alias("b"), F.lit(1).alias("c"), F.col("rank").alias("d"))))
    )
    used = chosen.groupBy("site_id").agg(F.count("*").alias("used"))
    last = fell.withColumn("no", F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("score"), "fell"))).where(F.col("no") <= per_section)
    last = last.join(used, "site_id", "left").where(F.col("no") <= F.lit(per_file) - F.coalesce("used", F.lit(0)))
    title = F.when(F.coalesce(F.col("title"), F.lit("")) == "", title_from_path(F.col("url"))).otherwise(F.col("title"))
    shape = ["site_id", "place", F.col("section"), F.col("link_pos"), title.alias("title"), F.col("target").alias("url"), F.nullif(F.col("description"), F.lit("")).alias("notes")]
    end = F.struct(F.lit(99).alias("i"), F.lit(True).alias("o"), F.lit("").alias("l"), F.lit("").alias("n"))
    both = chosen.withColumn("link_pos", F.col("rank")).select(*shape).unionByName(last.withColumns({"link_pos": F.col("no"), "section": F.lit("Optional"), "place": end}).select(*shape))
    # at most per_file links a site are left
    dense = F.dense_rank().over(Window.partitionBy("site_id").orderBy("place"))
    within = F.row_number().over(Window.partitionBy("site_id", "place").orderBy("link_pos"))
    return both.select("site_id", dense.alias("section_pos"), "section", within.alias("link_pos"), "title", "url", "notes")
