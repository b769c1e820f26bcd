"""Validation of index files, line by line and as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.functions.binding import let
from sitequarry.functions.text import js_trim

LINK = r"^-\s+\[([^\]]+)\]\(([^)\s]+)\)\s*(?::\s*(.*))?$"


_ERRORS, _WARNINGS = ("second title", "before title", "bad item"), ("deep heading", "late summary", "free text")


def _parsed(source: Column) -> Column:
    """All non-blank lines of a file with their role, within the row: a file is one value, no line leaves its task.

    A role follows from the line and from where the first title, the first section after it and the first detail stand, so
    that no state is carried from line to line.
    """
    lines = F.split(F.regexp_replace(source, "^\ufeff", ""), r"\r?\n")
    numbered = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).cast("int").alias("no"), js_trim(x).alias("line"))), lambda x: x["line"] != "")
    first = lambda rows, test: F.coalesce(F.get(F.filter(rows, test), F.lit(0))["no"], F.lit(2**31 - 1))
    deep = r"^#{3,}\s"

    def with_title(rows: Column) -> Column:
        return let(first(rows, lambda x: x["line"].startswith("# ")), lambda t: with_section(rows, t))

    def with_section(rows: Column, t: Column) -> Column:
        return let(first(rows, lambda x: (x["no"] > t) & x["line"].startswith("## ")), lambda s: with_detail(rows, t, s))

    def with_detail(rows: Column, t: Column, s: Column) -> Column:
        plain = lambda x: (x["no"] > t) & (x["no"] < s) & ~x["line"].startswith("# ") & ~x["line"].rlike(deep) & ~x["line"].startswith(">")
        return let(first(rows, plain), lambda d: F.transform(rows, lambda x: made(x, t, s, d)))

    def made(x: Column, t: Column, s: Column, d: Column) -> Column:
        line, no = x["line"], x["no"]
        inside = no > s
        role = (
            F.when(no < t, "before title").when(no == t, "title").when(line.startswith("# "), "second title").when(line.startswith("## "), "section").when(line.rlike(deep), "deep heading")
            .when(line.startswith(">"), F.when(inside | (no > d), "late summary").otherwise("summary"))
            .when(inside, F.when(line.rlike(LINK), "link").when(line.startswith("-"), "bad item").otherwise("free text")).otherwise("detail")
        )
        return let(role, lambda r: fields(x, r))

    def fields(x: Column, role: Column) -> Column:
        line = x["line"]
        part = lambda k: F.when(role == "link", F.trim(F.regexp_extract(line, LINK, k)))
        words = F.when(role == "title", F.trim(F.substr(line, F.lit(3)))).when(role == "section", F.trim(F.substr(line, F.lit(4)))).when(role.isin("summary", "late summary"), F.trim(F.regexp_replace(line, r"^>\s?", ""))).otherwise(line)
        return F.struct(x["no"].alias("no"), role.alias("role"), part(1).alias("title"), part(2).alias("url"), F.nullif(part(3), F.lit("")).alias("notes"), words.alias("text"))

    return let(numbered, with_title)


def lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, no, role, title, url, notes, text, repeated) of every non-blank line; ``repeated`` marks a link whose url the file has before."""
    rows = files.where(F.col(text).isNotNull())

    def marked(x: Column) -> Column:
        urls = F.transform(x, lambda e: F.coalesce(e["url"], F.lit("")))
        return let(urls, lambda u: F.transform(x, lambda e, i: F.struct(e.alias("x"), (e["url"].isNotNull() & (F.array_position(u, e["url"]) <= i)).alias("repeated"))))

    return rows.select(key, F.explode(let(_parsed(F.col(text)), marked)).alias("e")).select(key, "e.x.*", F.coalesce("e.repeated", F.lit(False)).alias("repeated"))


def sections(parsed: DataFrame, key: str) -> DataFrame:
    """(key, section_no, section, link_no, title, url, notes): the links of each file under their sections, from rows of :func:`lines`."""
    own = Window.partitionBy(key).orderBy("no")
    rows = parsed.where("role IN ('section', 'link')").withColumn("section_no", F.sum((F.col("role") == "section").cast("int")).over(own))
    rows = rows.withColumn("section", F.last(F.when(F.col("role") == "section", F.col("text")), ignorenulls=True).over(own))
    links = rows.where("role = 'link'")
    return links.select(key, "section_no", "section", F.row_number().over(Window.partitionBy(key, "section_no").orderBy("no")).alias("link_no"), "title", "url", "notes")


_LINE_ISSUES = {
    "second title": ("error", "Only one H1 title is allowed"),
    "before title": ("error", "Content appears before the H1 title"),
    "deep heading": ("warning", "Headings deeper than H2 are not part of the format"),
    "late summary": ("warning", "The blockquote summary should directly follow the title"),
    "bad item": ("error", "List item must look like `- [title](url): optional notes`"),
    "free text": ("warning", "Free text inside a section is ignored by parsers"),
}


def issues(parsed: DataFrame, files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, level, line, message) of every issue; issues of the whole file have no line. Null files have none."""
    one = lambda level, message: F.struct(F.lit(level).alias("level"), message.alias("message"))
    found = F.when(F.lit(False), F.array(one("", F.lit(""))))
    for role, (level, message) in _LINE_ISSUES.items():
        found = found.when(F.col("role") == role, F.array(one(level, F.lit(message))))
    relative = ~F.col("url").rlike(r"(?i)^https?://") & ~F.col("url").startswith("/")
    of_link = F.filter(F.array(F.when(F.col("repeated"), one("warning", F.concat(F.lit("Duplicate link: "), "url"))), F.when(relative, one("warning", F.concat(F.lit("Link should be absolute: "), "url")))), lambda x: x.isNotNull())
    by_line = parsed.select(key, F.col("no").alias("line"), F.explode(found.when(F.col("role") == "link", of_link)).alias("i")).select(key, "i.level", "line", "i.message")
    has = lambda *roles: F.coalesce(F.max(F.col("role").isin(*roles).cast("int")), F.lit(0))
    whole = files.where(F.col(text).isNotNull()).select(key).join(parsed, key, "left").groupBy(key).agg(has("title").alias("t"), has("summary", "late summary").alias("s"), has("link").alias("l"))
    missing = F.filter(
        F.array(
            F.when(F.col("t") == 0, one("error", F.lit("Missing required H1 title"))),
            F.when(F.col("s") == 0, one("warning", F.lit("No blockquote summary; agents rely on it for context"))),
            F.when(F.col("l") == 0, one("warning", F.lit("No link sections found"))),
        ), lambda x: x.isNotNull(),
    )
    return by_line.unionByName(whole.select(key, F.lit(None).cast("int").alias("line"), F.explode(missing).alias("i")).select(key, "i.level", "line", "i.message"))


def verdicts(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, valid, errors, warnings, title, summary, sections, links) of each file, all within its row; title and summary null without an H1.

    Null files have no row.
    """
    number = lambda x, test: F.size(F.filter(x, test))
    of = lambda *roles: lambda e: e["role"].isin(*roles)

    def judged(x: Column) -> Column:
        title = F.get(F.filter(x, of("title")), F.lit(0))["text"]
        summary = F.nullif(F.array_join(F.transform(F.filter(x, of("summary", "late summary")), lambda e: e["text"]), " "), F.lit(""))
        urls = F.transform(F.filter(x, of("link")), lambda e: e["url"])
        relative = F.size(F.filter(urls, lambda u: ~u.rlike(r"(?i)^https?://") & ~u.startswith("/")))
        errors = number(x, of(*_ERRORS)) + title.isNull().cast("int")
        warnings = number(x, of(*_WARNINGS)) + F.size(urls) - F.size(F.array_distinct(urls)) + relative + (number(x, of("summary", "late summary")) == 0).cast("int") + (F.size(urls) == 0).cast("int")
        return F.struct(
            (errors == 0).alias("valid"), errors.cast("long").alias("errors"), warnings.cast("long").alias("warnings"), title.alias("title"), F.when(title.isNotNull(), summary).alias("summary"),
            number(x, of("section")).cast("long").alias("sections"), F.size(urls).cast("long").alias("links"),
        )

    return files.where(F.col(text).isNotNull()).select(key, let(_parsed(F.col(text)), judged).alias("v")).select(key, "v.*")
