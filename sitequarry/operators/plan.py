"""Application of a model's plan to an index, and scoring of a model's retrieval answers. Model outputs are rows of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_CANDIDATES, MOST_LEFT = 120, 25
MOST_QUESTIONS = 8


def candidates(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(site_id, id, link_title, url, notes, kind): the first links of each index that are pages, numbered from 0. Of pages with one target the last counts."""
    links = documents.where("url IS NOT NULL")
    own = pages.select("site_id", F.coalesce("markdown_url", "url").alias("url"), "kind", "seq").groupBy("site_id", "url").agg(F.max_by("kind", "seq").alias("kind"))
    rows = links.join(own, ["site_id", "url"])
    rows = rows.withColumn("id", F.row_number().over(Window.partitionBy("site_id").orderBy("section_pos", "link_pos")) - 1).where(F.col("id") < MOST_CANDIDATES)
    return rows.select("site_id", "id", "link_title", "url", "notes", "kind")


def apply_plan(links: DataFrame, heads: DataFrame, documents: DataFrame, outputs: DataFrame) -> DataFrame:
    """Index rows (site_id, title, summary, section_pos, section, link_pos, link_title, url, notes) after a model's plan.

    ``links`` are :func:`candidates`, ``heads`` (site_id, name, summary), ``documents`` the heuristic rows, ``outputs`` (site_id, raw_json).
    Sections need a name, items an id of a candidate not used before; titles and notes override where not blank. Candidates
    that the plan leaves out, at most MOST_LEFT, go to the Optional section, which comes last. A plan that places nothing, and
    any text that isn't JSON, leaves the heuristic document.
    """
    item = "array<struct<id:string,title:string,notes:string>>"
    plan = F.from_json("raw_json", f"struct<title:string,summary:string,sections:array<struct<name:string,items:{item}>>>")
    parsed = outputs.select("site_id", plan.alias("plan")).where("plan IS NOT NULL")
    sections = parsed.select("site_id", F.posexplode("plan.sections").alias("s_no", "s")).where(F.trim("s.name") != "")
    items = sections.select("site_id", "s_no", F.trim("s.name").alias("section"), F.posexplode("s.items").alias("i_no", "i"))
    number = F.when(F.col("i.id").isNull() | F.trim("i.id").isin("", "false"), 0.0).when(F.col("i.id") == "true", 1.0).otherwise(F.expr("try_cast(i.id AS double)"))
    items = items.withColumn("id", number).join(links.withColumnsRenamed({"notes": "own_notes"}), ["site_id", "id"])
    first = Window.partitionBy("site_id", "id").orderBy("s_no", "i_no")
    used = items.withColumn("n", F.row_number().over(first)).where("n = 1").select(
        "site_id", "s_no", "section", F.col("i_no").cast("long").alias("i_no"), "id", F.coalesce(F.nullif(F.trim("i.title"), F.lit("")), "link_title").alias("link_title"), "url", F.coalesce(F.nullif(F.trim("i.notes"), F.lit("")), "own_notes").alias("notes")
    )
    planned = used.select("site_id").distinct()
    left = links.join(planned, "site_id", "left_semi").join(used.select("site_id", "id"), ["site_id", "id"], "left_anti")
    left = left.withColumn("n", F.row_number().over(Window.partitionBy("site_id").orderBy("id"))).where(F.col("n") <= MOST_LEFT)
    optional = used.where(F.lower("section") == "optional").groupBy("site_id").agg(F.min(F.struct("s_no", "section")).alias("o"))
    rest = left.join(optional, "site_id", "left").select("site_id", F.coalesce("o.s_no", F.lit(1_000_000)).alias("s_no"), F.coalesce("o.section", F.lit("Optional")).alias("section"), (F.col("n") + 1_000_000).cast("long").alias("i_no"), "id", "link_title", "url", "notes")
    rows = used.unionByName(rest)
    place = F.struct((F.lower("section") == "optional").alias("last"), "s_no")
    rows = rows.withColumn("section_pos", F.dense_rank().over(Window.partitionBy("site_id").orderBy(place)))
    rows = rows.withColumn("link_pos", F.row_number().over(Window.partitionBy("site_id", "section_pos").orderBy("i_no")))
    over = parsed.select("site_id", F.nullif(F.trim("plan.title"), F.lit("")).alias("t"), F.nullif(F.trim("plan.summary"), F.lit("")).alias("u"))
    head = heads.join(over, "site_id", "left").select("site_id", F.coalesce("t", "name").alias("title"), F.coalesce("u", "summary").alias("summary"))
    made = rows.join(head, "site_id").select("site_id", "title", "summary", "section_pos", "section", "link_pos", "link_title", "url", "notes")
    return made.unionByName(documents.join(planned, "site_id", "left_anti").select(*made.columns))


def questions(outputs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(site_id, position, id, question): usable questions of model outputs (site_id, raw_json), the first MOST_QUESTIONS.

    Ids are whole numbers within the site's number of links (``sizes``: site_id, links), each used once; questions aren't blank.
    """
    raw = outputs.select("site_id", F.posexplode(F.from_json("raw_json", "struct<questions:array<struct<id:string,question:string>>>")["questions"]).alias("no", "q"))
    rows = raw.select("site_id", "no", F.expr("CASE WHEN q.id IS NULL OR trim(q.id) = '' THEN 0 ELSE try_cast(q.id AS double) END").alias("id"), F.trim("q.question").alias("question")).join(sizes, "site_id")
    rows = rows.where("id = floor(id) AND id >= 0 AND id < links AND question != ''")
    once = rows.withColumn("n", F.row_number().over(Window.partitionBy("site_id", "id").orderBy("no"))).where("n = 1")
    placed = once.withColumn("position", F.row_number().over(Window.partitionBy("site_id").orderBy("no")) - 1).where(F.col("position") < MOST_QUESTIONS)
    return placed.select("site_id", "position", F.col("id").cast("int").alias("id"), "question")


def answers(outputs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(site_id, position, chosen): the last usable answer to each question."""
    raw = outputs.select("site_id", F.posexplode(F.from_json("raw_json", "struct<answers:array<struct<question:string,id:string>>>")["answers"]).alias("no", "a"))
    number = lambda c: F.expr(f"CASE WHEN {c} IS NULL OR trim({c}) = '' THEN 0 ELSE try_cast({c} AS double) END")
    rows = raw.select("site_id", "no", number("a.question").alias("position"), number("a.id").alias("id")).join(sizes, "site_id")
    rows = rows.where("position = floor(position) AND id = floor(id) AND id >= 0 AND id < links")
    return rows.groupBy("site_id", F.col("position").cast("int").alias("position")).agg(F.max_by("id", "no").cast("int").alias("chosen"))


def evaluation(index: DataFrame, asked: DataFrame, given: DataFrame) -> DataFrame:
    """(site_id, position, question, expected_url, chosen_url, chosen_title, correct) of each question.

    ``index`` is (site_id, id, link_title, url); an unanswered question is wrong. The title is that of the first link with the url.
    """
    urls = index.groupBy("site_id", "url").agg(F.min_by("link_title", "id").alias("chosen_title"))
    rows = asked.join(given, ["site_id", "position"], "left").join(index.select("site_id", "id", F.col("url").alias("expected_url")), ["site_id", "id"])
    rows = rows.join(index.select("site_id", F.col("id").alias("chosen"), F.col("url").alias("chosen_url")), ["site_id", "chosen"], "left")
    rows = rows.join(urls.withColumnRenamed("url", "chosen_url"), ["site_id", "chosen_url"], "left")
    return rows.select("site_id", "position", "question", "expected_url", "chosen_url", "chosen_title", F.coalesce(F.col("chosen") == F.col("id"), F.lit(False)).alias("correct"))


def accuracy(rows: DataFrame) -> DataFrame:
    """(site_id, accuracy, questions): share of correct answers in per cent, rounded half up."""
    return rows.groupBy("site_id").agg(F.floor(F.count_if("correct") / F.count("*") * 100 + 0.5).cast("int").alias("accuracy"), F.count("*").alias("questions"))


def ambiguous(rows: DataFrame) -> DataFrame:
    """(site_id, position, url, title): links picked in place of the right one."""
    return rows.where("NOT correct AND chosen_url IS NOT NULL").select("site_id", "position", F.col("chosen_url").alias("url"), "chosen_title")
