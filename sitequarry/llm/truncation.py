"""Text cut off by field limits: lengths under several encodings expose hidden limits, endings decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.sources.tables import materialize

#: A length is a hidden limit of a source when its texts pile up there: by this many times over the neighbourhood's density, and by
#: this log-likelihood ratio (natural logarithm, Poisson), which small piles don't reach by chance however many lengths there are.
LEAST_LIFT, LEAST_EVIDENCE = 12.0, 9.0
#: Texts that are cut between words end up to so many units below the limit: these widths are tried, too, for some measures.
WINDOW, WINDOWED = 16, ("chars", "utf8_bytes")
#: Of the texts that have it, at least this share must end openly; else it is a length that texts happen to have.
LEAST_OPEN = 0.3
#: The neighbourhood: lengths within this share of the length.
NEIGHBOURHOOD = 0.05
#: A closing line of up to STYLE_CHARS characters is style when this share of all texts close with it, LEAST_STYLE of different
#: lengths at least, and less than half of them at a hidden limit.
STYLE_SHARE, LEAST_STYLE, STYLE_CHARS = 0.0005, 3, 60
#: A word seen this often in list items, and at most at this rate at their end, can't end one.
LEAST_SEEN, MOST_FINAL = 12, 0.002

#: Marks put where a text was cut, at the end of its last line.
MARK = r"(?i)(…|\.\.\.|\[(…|\.\.\.|truncated|cut|more)\]|\((…|\.\.\.|truncated|more|continued)\)|&hellip;|(read|show|view) more *[»>]*)$"
#: Such a mark on a line of its own; it is never style.
BARE_MARK = r"(?i)^\s*(\[(…|\.\.\.|truncated|cut|more)\]|\((…|\.\.\.|truncated|more)\)|&hellip;|(read|show|view) more *[»>]*)$"
_END = r"[.!?。！？։؟।]"
_CLOSE = r"[\"'”’»›)\]}*_`“]*"
_DATE = r"(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}|\p{L}+\.? \d{1,2}(st|nd|rd|th)?,? \d{4}|\d{1,2}\.? (de )?\p{L}+\.? (de )?\d{4})"
LIST = r"^\s*([-•*+]|\d+[.)]) +\S"


def measures(text: Column) -> dict[str, Column]:
    """Lengths of a text as different stores would count it, by name of the measure."""
    count = lambda *signs: sum((F.length(text) - F.length(F.replace(text, F.lit(s), F.lit(""))) for s in signs[1:]), F.length(text) - F.length(F.replace(text, F.lit(signs[0]), F.lit(""))))
    chars, octets, breaks = F.length(text), F.octet_length(text), count("\n")
    escaped = 4 * count("&") + 3 * count("<", ">") + 5 * count('"') + 4 * count("'")
    quoted = count('"', "\\", "\n", "\t", "\r")
    astral = chars - F.length(F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", ""))
    return {
        "chars": chars, "utf8_bytes": octets, "utf16_units": chars + astral, "html_chars": chars + escaped, "html_bytes": octets + escaped,
        "json_chars": chars + quoted, "json_bytes": octets + quoted, "crlf_chars": chars + breaks, "crlf_bytes": octets + breaks,
    }


def features(documents: DataFrame) -> DataFrame:
    """One light row a document: doc_id, source, its lengths, last line and what shape it ends in. Null and blank texts have none."""
    rows = documents.select("doc_id", "source", "text").where(r"text RLIKE '\\S'")
    lines = F.split(F.regexp_replace("text", r"[\r\n]+$", ""), r"\r?\n")
    rows = rows.withColumns({**measures(F.col("text")), "last": F.element_at(lines, -1), "n_lines": F.size(lines)})
    fences = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*(```|~~~)")))
    line = F.rtrim("last")
    marked = line.rlike(MARK)
    # an item with a link and notes: it needs an end of sentence if the document's other notes mostly have one
    noted = r"^\s*[-•*+] +\[[^\]]*\]\([^)\s]*\)\s*[:–—-]"
    ended = _END + _CLOSE + "$"
    others = F.filter(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: x.rlike(noted))
    proper = F.size(F.filter(others, lambda x: F.rtrim(x).rlike(ended)))
    unfinished_note = line.rlike(noted) & ~line.rlike(ended) & (line.rlike(r"\)\s*[:–—-]$") | ((F.size(others) > 0) & (2 * proper >= F.size(others))))
    shape = (
        F.when(fences % 2 == 1, "open fence")
        .when(line.rlike(r"^\s*(```|~~~)\s*$"), "closed")
        .when(marked, "mark")
        .when(line.rlike(r"^\s*(\*\s*){3,}$|^\s*(-\s*){3,}$|^\s*(_\s*){3,}$|^\s*={3,}$"), "closed")
        .when(line.rlike(r"^\s*\|"), F.when(line.rlike(r"\|$"), "closed").otherwise("prose"))
        .when(unfinished_note, "prose")
        .when(line.rlike(LIST), F.when(line.rlike(r"\]\([^)\s]*\)" + _CLOSE + r"([:\-–—] .*" + _END + _CLOSE + r")?$"), "closed").when(line.rlike(r"\[[^\]]*$|\]\([^)]*$"), "prose").otherwise("item"))
        .when(line.rlike(r"^\s*!?\[[^\]]+\]\(\S+\)$|^\s*<?https?://\S+>?$"), "closed")
        .when(line.rlike(r"^\s*(#[\p{L}\p{N}_-]+\s*)+$|^\s*#{1,6} \S"), "item")
        .when(line.rlike(r"^\s*[—–-]{1,2} ?\p{Lu}[\p{L}.'’-]*( \p{Lu}[\p{L}.'’-]*){1,3}$"), "item")
        .when(line.rlike(r"(?i)^\s*v(ersion )?\d+(\.\d+){2,}$"), "closed")
        .when((F.length(line) <= 60) & line.rlike(r"(^|[ :(])" + _DATE + r"\)?$"), "closed")
        .when(line.rlike(_END + _CLOSE + "$"), "ended")
        .otherwise("prose")
    )
    return rows.withColumns({"shape": shape, "cut_space": F.col("last").rlike(r"[ \t]$"), "digest": F.xxhash64("text")}).drop("text")


def _lengths(rows: DataFrame, keep: list[str], names: list[str] | None = None) -> DataFrame:
    """``keep`` and (measure, width, length) of every length of every row: exact ones, and windows of WINDOW in two phases."""
    names = names or list(measures(F.lit("")))
    one = lambda n, width, value: F.struct(F.lit(n).alias("measure"), F.lit(width).alias("width"), value.cast("long").alias("length"))
    window = lambda n, phase: ((F.col(n) + phase) / WINDOW).cast("long") * WINDOW - phase
    parts = [one(n, 1, F.col(n)) for n in names] + [one(f"{n}_window", WINDOW, window(n, phase)) for n in names if n in WINDOWED for phase in (0, WINDOW // 2)]
    return rows.select(*keep, F.explode(F.array(*parts)).alias("l")).select(*keep, "l.*")


def hidden_limits(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(source, measure, width, length, n, lift): lengths at which a source's texts pile up, from rows of :func:`features`.

    ``width`` is 1 for an exact length; else (measures named ..._window) texts pile up at ``length`` and the units after it. Counts are aggregated
    before they are shuffled. The neighbourhood's density is found by bins of its width, so a length is compared with
    its bin and both adjacent ones. Copies of a text count once.
    """
    names = names or list(measures(F.lit("")))
    once = rows.groupBy("source", "digest").agg(F.first("shape").alias("shape"), *[F.first(n).alias(n) for n in names])
    open_end = once.withColumn("open", F.col("shape").isin("open fence", "mark", "prose").cast("int"))
    counts = _lengths(open_end, ["source", "open"], names).groupBy("source", "measure", "width", "length").agg(F.count("*").alias("n"), F.sum("open").alias("open"))
    counts = materialize(counts)
    bin_of = F.floor(F.log(F.greatest(F.col("length"), F.lit(1))) / NEIGHBOURHOOD)
    peaks = counts.where((F.col("n") > 2) & (F.col("open") >= LEAST_OPEN * F.col("n"))).withColumn("bin", bin_of)
    around = counts.where("width = 1").withColumn("own", bin_of).select("source", "measure", "n", "length", F.explode(F.array("own", F.col("own") - 1, F.col("own") + 1)).alias("bin"))
    around = around.groupBy("source", "measure", "bin").agg(F.sum("n").alias("near_n"))
    width = F.exp((F.col("bin") + 2) * NEIGHBOURHOOD) - F.exp((F.col("bin") - 1) * NEIGHBOURHOOD)
    peaks = peaks.withColumn("exact", F.regexp_replace("measure", "_window$", ""))
    joined = peaks.join(around.withColumnRenamed("measure", "exact"), ["source", "exact", "bin"])
    expected = F.greatest((F.col("near_n") - F.col("n")) / width * F.col("width"), F.lit(0.2))
    lift, evidence = F.col("n") / expected, F.col("n") * F.log(F.col("n") / expected) - (F.col("n") - expected)
    return joined.withColumn("lift", lift).where((F.col("lift") >= LEAST_LIFT) & (evidence >= LEAST_EVIDENCE)).select("source", "measure", "width", "length", "n", "lift")


def final_word(line: Column) -> Column:
    """Last word of a line, lower case, digits as 0; empty when it ends in no word."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.rtrim(line), r"([\p{L}\p{N}_'’.-]+)[)\]}\"”’»]*$", 1)), r"\d", "0")


def word_ends(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(word, seen, final) over the structural lines of all documents, for the words in ``wanted``.

    ``seen`` counts a word's occurrences in list items, headings and signatures, ``final`` those at the line's end.
    """
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: x.rlike(LIST + r"|^\s*#{1,6} ?\S|^\s*[—–] ?\p{Lu}"))
    words = lambda x: F.transform(F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}_'’.-]+"), F.lit(0)), lambda w: F.regexp_replace(w, r"\d", "0"))
    inner = F.flatten(F.transform(lines, words))
    ends = F.transform(lines, final_word)
    both = documents.where("text IS NOT NULL").select(F.explode(F.concat(F.transform(inner, lambda w: F.struct(w.alias("word"), F.lit(0).alias("end"))), F.transform(ends, lambda w: F.struct(w.alias("word"), F.lit(1).alias("end"))))).alias("x"))
    counts = both.select("x.*").groupBy("word").agg(F.sum(1 - F.col("end")).alias("seen"), F.sum("end").alias("final"))
    return counts.join(wanted, "word", "left_semi")


def truncated(documents: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, reason, measure, length) of every truncated document.

    Lengths first: a text at a hidden limit of its source is truncated unless its end is whole (an ended sentence, or a
    proper list, table, code, link, signature or date line). ``measure`` and ``length`` name the limit. Elsewhere, as
    after a broken transfer, the end alone decides: an open code fence, a mark of cutting, prose without an end of
    sentence, or a list item, heading or signature whose last word can't end one. A closing line that many texts of
    different lengths share is style. Null and blank texts are not truncated. Rows with equal doc_id are judged each by
    their text.
    """
    rows = materialize(features(documents)) if rows is None else rows
    texts = rows.count()
    limits = hidden_limits(rows)
    candidates = rows.where("shape IN ('open fence', 'mark', 'item', 'prose')")
    keys = ["doc_id", "source", "digest"]
    at = _lengths(candidates, keys).join(limits, ["source", "measure", "width", "length"])
    at = at.groupBy("doc_id", "digest").agg(F.max_by(F.struct("measure", "width", "length"), F.struct(-F.col("width"), "n")).alias("limit"))
    same = [F.col("d").eqNullSafe(F.col("doc_id")), F.col("g") == F.col("digest")]
    candidates = candidates.select(*keys, "last", "shape", "chars", "cut_space").join(at.withColumnsRenamed({"doc_id": "d", "digest": "g"}), same, "left").drop("d", "g")
    closing = F.when(F.col("shape").isin("mark", "prose") & (F.length("last") <= STYLE_CHARS) & ~F.rtrim("last").rlike(BARE_MARK), F.trim("last"))
    # rows without a key get one of their own, so that no task gathers them
    own = F.concat(F.lit("\0"), F.xxhash64(*keys).cast("string"))
    candidates = materialize(candidates.withColumns({"word": F.when(F.col("shape") == "item", final_word(F.col("last"))), "line": closing}))
    limited = F.col("limit").isNotNull().cast("int")
    style = candidates.where("line IS NOT NULL").groupBy("line").agg(F.count_distinct("digest").alias("n"), F.countDistinct("chars").alias("sharing"), F.avg(limited).alias("limited"))
    style = style.where((F.col("sharing") >= LEAST_STYLE) & (F.col("n") >= STYLE_SHARE * texts) & (F.col("limited") < 0.5)).select("line", F.lit(True).alias("style"))
    ends = word_ends(documents, candidates.where("word IS NOT NULL").select("word").distinct())
    keyed = candidates.withColumns({"line": F.coalesce("line", own), "word": F.coalesce("word", own)})
    joined = keyed.join(style, "line", "left").join(ends, "word", "left")
    # the document's own line is among those counted
    seen, final = F.greatest(F.coalesce("seen", F.lit(0)) - 1, F.lit(0)), F.greatest(F.coalesce("final", F.lit(0)) - 1, F.lit(0))
    raw = F.regexp_extract(F.rtrim("last"), r"([\p{L}\p{N}_'’.-]+)[)\]}\"”’»]*$", 1)
    # other lines go on after the word, or nothing but cut lines has it
    odd_end = ((seen >= LEAST_SEEN) & (final <= MOST_FINAL * seen)) | ((seen <= final) & (final <= STYLE_SHARE * texts) & raw.rlike(r"^\p{Ll}"))
    exact = F.col("limit").isNotNull() & ((F.col("shape") != "item") | (F.col("limit.width") == 1) & F.col("last").rlike(LIST))
    reason = (
        F.when(F.col("style"), None)
        .when(exact, "at limit")
        .when(F.col("shape") == "open fence", "open fence")
        .when(F.col("shape") == "mark", "mark")
        .when(F.col("shape") == "prose", "unfinished sentence")
        .when(F.col("shape") == "item", F.when(odd_end, "unfinished item").when(F.col("cut_space"), "trailing space"))
    )
    return joined.select("doc_id", "source", reason.alias("reason"), "limit.measure", "limit.length").where("reason IS NOT NULL")


def truncation_rates(documents: DataFrame) -> DataFrame:
    """(source, documents, truncated, rate) of every source; null texts count as documents, null sources form one."""
    found = truncated(documents).groupBy("source").agg(F.countDistinct("doc_id").alias("hits"))
    sizes = documents.groupBy("source").agg(F.count("*").alias("documents"))
    both = sizes.join(found.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    hits = F.coalesce("hits", F.lit(0)).cast("long")
    return both.select("source", "documents", hits.alias("truncated"), F.round(hits / F.col("documents"), 6).alias("rate"))
