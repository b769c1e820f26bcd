"""Site profile, index document and its Markdown text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.functions.text import first_sentences, normalize_whitespace
from sitequarry.functions.urls import host
from sitequarry.operators.sections import sections

_SEPARATED = r"\s+[|\-–—\\/·:]\s+"


def brand(title: Column, site_host: Column) -> Column:
    """The part of a title that equals the host's first label, else the whole title; null for null and empty."""
    parts = F.filter(F.split(title, _SEPARATED), lambda p: p != "")
    domain = F.lower(F.get(F.split(site_host, r"\."), F.lit(0)))
    named = F.get(F.filter(parts, lambda p: F.regexp_replace(F.lower(p), r"\s+", "") == domain), F.lit(0))
    return F.nullif(F.when(F.size(parts) < 2, title).otherwise(F.coalesce(named, title)), F.lit(""))


def profiles(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """(site_id, base_url, name, summary): one row a site of ``entries`` (site_id, entry_url, site_name).

    The entry page is the one of that URL, else the site's first (smallest ``seq``); sites without pages have an empty summary.
    Where the description is empty the summary is made of ``lead``, the beginning of the text, or of ``text`` itself.
    """
    body = "lead" if "lead" in pages.columns else "text"
    pages = pages.withColumn("text", F.col(body)) if body in pages.columns else pages.withColumn("text", F.lit(None).cast("string"))
    first = pages.join(entries.select("site_id", "entry_url"), "site_id")
    chosen = first.groupBy("site_id").agg(F.min_by(F.struct("title", "description", "text"), F.struct(F.col("url") != F.col("entry_url"), "seq")).alias("p"))
    rows = entries.join(chosen, "site_id", "left")
    where = host(F.col("entry_url"))
    name = F.coalesce(F.nullif("site_name", F.lit("")), brand(F.col("p.title"), where), where)
    name = F.coalesce(F.nullif(F.substring(normalize_whitespace(name), 1, 80), F.lit("")), where)
    source = F.coalesce(F.nullif("p.description", F.lit("")), F.col("p.text"), F.lit(""))
    return rows.select("site_id", F.col("entry_url").alias("base_url"), name.alias("name"), first_sentences(source, 260).alias("summary"))


def strip_brand(title: Column, name: Column) -> Column:
    """Without a separator and the brand at the end (any case); the title itself where nothing would be left."""
    # the pattern is a column: brand and title are compared in lower case, no expression is built from data
    low, tail = F.lower(F.rtrim(title)), F.lower(name)
    rest = F.substring(title, F.lit(1), F.length(low) - F.length(tail))
    bare = F.regexp_replace(rest, r"\s*[|\-–—\\/·:]\s*$", "")
    hit = (F.length(name) > 0) & F.endswith(low, tail) & (F.length(bare) < F.length(rest)) & rest.rlike(r"[|\-–—\\/·:]\s*$")
    return F.when(hit & (F.trim(bare) != ""), F.trim(bare)).otherwise(title)


def documents(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """(site_id, title, summary, section_pos, section, link_pos, link_title, url, notes): links with their site's head; one row without link for sites that have none."""
    heads = profiles(pages, entries)
    links = sections(pages, entries).withColumnRenamed("title", "link_title")
    both = heads.join(links, "site_id", "left")
    notes = F.when(F.col("notes") != F.col("summary"), F.col("notes"))
    return both.select("site_id", F.col("name").alias("title"), "summary", "section_pos", "section", "link_pos", strip_brand(F.col("link_title"), F.col("name")).alias("link_title"), "url", notes.alias("notes"))


def escape_inline(text: Column) -> Column:
    return F.regexp_replace(normalize_whitespace(text), r"^([#>\-*])", r"\\$1")


def escape_link_text(text: Column) -> Column:
    return F.translate(normalize_whitespace(text), "[]", "")


def encode_uri(url: Column) -> Column:
    """Percent-encodes what encodeURI does; percent signs are encoded again."""
    chars = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(r"^[A-Za-z0-9;,/?:@&=+$\-_.!~*'()#]?$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")))
    return F.array_join(chars, "")


def render(rows: DataFrame) -> DataFrame:
    """(site_id, llms_txt) of :func:`documents` rows: a site has at most as many rows as a file has links."""
    link = F.concat(F.lit("- ["), escape_link_text(F.col("link_title")), F.lit("]("), encode_uri(F.col("url")), F.lit(")"), F.coalesce(F.concat(F.lit(": "), escape_inline(F.col("notes"))), F.lit("")))
    first = F.col("link_pos") == 1
    line = F.concat(F.when(first, F.concat(F.lit("\n\n## "), escape_inline(F.col("section")), F.lit("\n\n"))).otherwise("\n"), link)
    ordered = F.array_sort(F.collect_list(F.when(F.col("url").isNotNull(), F.struct("section_pos", "link_pos", line.alias("line")))))
    head = F.concat(F.lit("# "), escape_inline(F.col("title")), F.when(F.col("summary") != "", F.concat(F.lit("\n\n> "), escape_inline(F.col("summary")))).otherwise(""))
    return rows.groupBy("site_id", "title", "summary").agg(ordered.alias("lines")).select("site_id", F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), ""), F.lit("\n")).alias("llms_txt"))


def render_full(index: DataFrame, pages: DataFrame) -> DataFrame:
    """(site_id, part, chunk): the index (part 0) and each page's text in crawl order (part 1, 2, ...); joined by line breaks they are the full file.

    Parts stay rows: a site's whole text is never one value. Write them with ``sortWithinPartitions("site_id", "part")``.
    """
    chunk = F.concat(F.lit("# "), escape_inline(F.coalesce("title", F.lit(""))), F.lit("\n\nSource: "), "url", F.lit("\n\n"), "text", F.lit("\n\n---"))
    texts = pages.where("text IS NOT NULL AND text != ''").select("site_id", (F.col("seq") + 1).cast("long").alias("part"), chunk.alias("chunk"))
    return index.select("site_id", F.lit(0).cast("long").alias("part"), F.col("llms_txt").alias("chunk")).unionByName(texts)
