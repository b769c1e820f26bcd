"""Page classification, scores and ranks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.functions.urls import segments

#: Path segments of each kind of page, tried in this order.
KINDS = {
    "api": r"api|api-reference|reference|sdk|endpoints|openapi|graphql",
    "docs": r"docs?|documentation|manual|handbook|developers?|dev|learn",
    "guide": r"guides?|tutorials?|how-?tos?|getting-?started|quick-?start|recipes|cookbook|examples?",
    "blog": r"blog|news|posts?|articles?|changelog|releases?|updates?|press|newsroom",
    "product": r"products?|features?|solutions?|platform|pricing|plans|use-?cases?|integrations?",
    "company": r"about|about-us|company|team|careers?|jobs|customers?|case-study|case-studies|partners?|investors?",
    "support": r"support|help|faqs?|contact|community|status|troubleshooting",
    "legal": r"legal|privacy|terms|tos|cookies?|security|compliance|gdpr|dpa|licen[cs]e",
}
#: What a kind is worth.
WEIGHTS = {"home": 100, "docs": 40, "api": 38, "guide": 34, "product": 26, "support": 16, "company": 14, "blog": 12, "other": 10, "legal": 2}


def _matcher(words: str) -> Callable[[Column], Column]:
    return lambda segment: segment.rlike(f"^(?:{words})$")


def classify(url: Column) -> Column:
    """Kind of a page by the first rule that any segment of its path satisfies; ``home`` without segments."""
    parts = F.transform(segments(url), F.lower)
    chain = F.when(F.size(parts) == 0, "home")
    for kind, words in KINDS.items():
        chain = chain.when(F.size(F.filter(parts, _matcher(words))) > 0, kind)
    return chain.otherwise("other")


def score() -> Column:
    """Score of a page from kind, depth, inbound_links, in_nav, from_sitemap, markdown_url, description, word_count, path and url.

    Missing numbers count as 0 and missing flags as false.
    """
    weight = reduce(lambda a, kv: a.when(F.col("kind") == kv[0], float(kv[1])), WEIGHTS.items(), F.when(F.lit(False), 0.0)).otherwise(10.0)
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    bonus = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    return (
        weight - number("depth") * 8 + F.least(number("inbound_links"), F.lit(12.0)) * 2.5 + bonus(F.col("in_nav"), 18.0) + bonus(F.col("from_sitemap"), 6.0)
        + bonus(F.col("markdown_url") != "", 10.0) + bonus(F.col("description") != "", 8.0) + F.least(number("word_count") / 300, F.lit(6.0))
        - bonus(F.col("path").rlike(r"/(page|tag|category|author)/"), 20.0) - bonus(F.size(segments(F.col("url"))) > 4, 6.0)
    )


def scored(pages: DataFrame) -> DataFrame:
    return pages.withColumn("score", score())


def rank(pages: DataFrame, most: int | None = None) -> DataFrame:
    """Adds ``rank`` in the site by falling score, then ``seq``; with ``most`` only the first so many.

    With ``most``, each task drops rows beyond it before the shuffle, so that no site is gathered whole.
    """
    ranked = scored(pages).withColumn("rank", F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("score"), "seq")))
    return ranked.where(F.col("rank") <= most) if most else ranked


def highlights(pages: DataFrame, count: int) -> DataFrame:
    """The first ``count`` pages of each site that have a positive score."""
    return rank(scored(pages).where("score > 0").drop("score"), count)
