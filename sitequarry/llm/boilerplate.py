"""Main content of pages: line-block distribution over lengths weighted by a line model that is trained here."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.characters import ORDER, TABLE_BITS, codes_of, line_means, slots
from sitequarry.llm.residue import FILLER, NOTICES
from sitequarry.llm.rows import one_per_page
from sitequarry.operators.skew import attach
from sitequarry.sources.tables import materialize

#: Pages that the n-gram ratios are fitted on, at most: chosen by a hash of page_id. What recurs is counted over all pages.
SAMPLE_PAGES = 20_000
#: A line is furniture of a site when so many differently titled pages of the site have it, and this share of them.
LEAST_REPEATS, LEAST_SHARE = 3, 0.03
#: Letters of a caption's key, at most.
CAPTION_CHARS = 60
#: Characters of a sampled text that the ratios are fitted on, at most, so that the sample is bounded in bytes.
MOST_CHARS = 20_000
#: Lines of a sliding block. Text surges where a block's weighted length reaches SURGE, or half of the page's greatest block where
#: that is less (a page may hold nothing but a short notice), and dives where it falls below that.
BLOCK_LINES, SURGE = 3, 24.0
#: Weight of a character in a title-like line: it is a heading or a link, which the text around it tells.
TITLE_WEIGHT = 0.25
#: Mean log-likelihood ratio from which a line carries no text: captions, other lines, lines that end a sentence, items and code.
CAPTION_RATIO, FURNITURE_RATIO, SENTENCE_RATIO, ITEM_RATIO = 0.15, 0.3, 0.5, 0.6

_SPACES = re.compile(" {2,}")
_END = set(".!?…;:。！？")
_CLOSERS = "\"'”’»)]*_` "
_MARKUP = re.compile(r"<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->|</?(?:p|div|span|a|b|i|em|strong|ul|ol|li|h[1-6]|nav|header|footer|aside|section|article|main|br|img|table|tr|td|th)\b[^<>\n]*>", re.IGNORECASE | re.DOTALL)
_ITEM = re.compile(r"\s*(?:[-•*+▪◦–]|\d{1,3}[.)])\s+\S")
_CODE = re.compile(r"\s*(?:```|~~~|\$ \S|>>> |GET /|POST /|PUT /|DELETE /|/\w[\w/.-]*$|[\w.-]+ ?[:=] ?[\[({\"'\d]|[\w.]+\([^()]*\)$|\||#{1,6} )")
_ARROW = re.compile("[\u2190-\u2199\u21d0-\u21d9]")
_CRUMBS = re.compile(r"\s+[/>»›|]\s+")
_MARKS = re.compile(r"[|›»>/·•→←]|[—–]| - ")


def line_key(line: str) -> str:
    """Lower case; digits and all that is neither letter nor number become single spaces."""
    return " ".join(re.sub(r"[\W\d_]+", " ", line.lower()).split())


def _ends(line: str) -> bool:
    return line.rstrip(_CLOSERS)[-1:] in _END


def _title_like(line: str) -> bool:
    return not _ends(line) and not _ITEM.match(line) and not _CODE.match(line) and 6 <= len(line) <= 160


def _rates(lines: list[str]) -> np.ndarray:
    """Share of each n-gram, each line bordered by line breaks."""
    counts = np.zeros(1 << TABLE_BITS, np.float32)
    for at in range(0, len(lines), 5000):
        codes, lengths = codes_of(["\n" + " ".join(x.split()) for x in lines[at : at + 5000]])
        grams = slots(codes)
        stop = np.repeat(np.cumsum(lengths), lengths)[: len(grams)]
        inside = np.arange(len(grams)) + ORDER <= stop
        counts += np.bincount(grams[inside], minlength=len(counts))
    return counts / max(1.0, counts.sum())


def fit(pages: list[tuple[int, str, str, list[int], list[int]]]) -> np.ndarray:
    """Table of log ratios by n-gram, from sample pages (site, title, text, places of recurring lines, places of lines of one title only).

    Furniture: lines that recur in differently titled pages of a site. Content: long lines that end a sentence, items and
    code that don't recur, the pages' own titles, and examples of filler and error text, which stand in place of content.
    """
    furniture: dict[tuple[int, str], str] = {}
    content: dict[str, str] = {}
    for site, title, text, recurring, single in pages:
        lines = [" ".join(x.split()) for x in strip_markup(text).split("\n")]
        own = line_key(title or "")
        for at in (x for x in recurring if x < len(lines)):
            key = line_key(lines[at])
            if key != own:
                furniture.setdefault((site, key), lines[at])
        for at in (x for x in single if x < len(lines)):
            line, key = lines[at], line_key(lines[at])
            if key != own and (len(line) >= 50 and _ends(line) or _ITEM.match(line) or _CODE.match(line)):
                content.setdefault(key, line)
        if own:
            content.setdefault("t" + own, title)
    examples = [x for line in (FILLER + "\n" + NOTICES).split("\n") for x in (line, line.replace("{}", ""))]
    body = list(content.values())
    floor = 4e-6
    bad = _rates(list(furniture.values())) + floor
    good = 0.9 * _rates(body) + 0.1 * _rates(examples) + floor
    return np.clip(np.log(bad / good), -3, 3).astype(np.float16)


def line_scores(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Mean ratio of each line of all texts, in order; 0 for lines without an n-gram."""
    return line_means([_SPACES.sub(" ", t) if "  " in t else t for t in texts], table)


def line_weights(title: str, lines: list[str], scores: list[float], captions: set[int]) -> tuple[list[float], list[bool], int]:
    """(weighted length of each line, whether it is title-like, place of the page's own title or -1).

    A line that the model holds for furniture has weight 0: by its score (the limit depends on its form), a trail or
    page title with other things around the title, a link with an arrow. So have title-like lines next to a caption:
    they are its list. Other title-like lines weigh TITLE_WEIGHT a character, all else its length.
    """
    weights, light, own_at = [0.0] * len(lines), [False] * len(lines), -1
    own = line_key(title or "")
    captioned = False
    heads: set[str] | None = None
    for i, raw in enumerate(lines):
        line = raw.strip()
        if not line:
            continue
        score = scores[i]
        marked = bool(own) and len(line) + 12 >= len(own)
        key = line_key(line) if marked and (len(line) <= len(own) + 24 or _MARKS.search(line)) else None
        if own and key == own:
            light[i], weights[i], captioned = own_at >= 0, (TITLE_WEIGHT if own_at >= 0 else 1.0) * len(line), False
            own_at = i if own_at < 0 else own_at
            continue
        if i in captions and score > CAPTION_RATIO:
            captioned = True
            continue
        if key and len(own) >= 8 and own in key and _MARKS.search(line) and not _ends(line) or _ARROW.match(line) and not _ends(line):
            continue
        item, ends = bool(_ITEM.match(line) or _CODE.match(line)), _ends(line)
        if score > (ITEM_RATIO if item else SENTENCE_RATIO if ends else FURNITURE_RATIO):
            captioned = False
            continue
        if item or ends or len(line) > 160 or len(line) > 65 and score < -0.5:
            weights[i], captioned = float(len(line)), False
        elif not captioned:
            if _CRUMBS.search(line):
                heads = {line_key(x) for x in lines if len(x) < 160} - {""} if heads is None else heads
                if line_key(_CRUMBS.split(line)[-1]) in heads:
                    continue  # a trail that ends in one of the page's headings
            light[i], weights[i] = True, TITLE_WEIGHT * len(line)
    return weights, light, own_at


def regions(weights: list[float], light: list[bool], own_at: int = -1) -> list[tuple[int, int]]:
    """(first, last) line of each piece of text between a surge and the dive after it.

    The blocks slide over the lines that aren't blank (weight above 0, or furniture). A surge is the first block that
    reaches the limit, its text starts at the block's first line with weight, or at the page's own title if only
    title-like lines are before it. The dive is after the last full line of the last such block: title-like lines that
    no text follows are outside.
    """
    n = len(weights)
    sums = np.convolve(np.asarray(weights), np.ones(BLOCK_LINES))[BLOCK_LINES - 1 :] if n else np.zeros(0)
    limit = min(SURGE, float(sums.max()) / 2) if n else 0.0
    found: list[tuple[int, int, bool]] = []
    if limit <= 0:
        return []
    k = 0
    while k < n:
        if sums[k] < limit:
            k += 1
            continue
        end = k
        while end + 1 < n and sums[end + 1] >= limit:
            end += 1
        first, last = k, min(n, end + BLOCK_LINES) - 1
        while not weights[first]:
            first += 1
        if first < own_at <= last and all(light[i] or not weights[i] for i in range(first, own_at)):
            first = own_at
        heavy = [i for i in range(first, last + 1) if weights[i] and not light[i]]
        found.append((first, heavy[-1] if heavy else last, bool(heavy)))
        k = end + 1
    # pieces that are nothing but title-like lines are lists of links, unless the page has nothing else
    full = any(x[2] for x in found)
    return [(a, b) for a, b, is_full in found if is_full or not full]


def body_lines(title: str, lines: list[str], scores: list[float], captions: set[int] | None = None) -> list[bool]:
    """Whether each line of a page is body; empty lines are.

    Line-block distribution: lengths, weighted by the line model, are summed over sliding blocks, and the text between
    a surge and the next dive is kept, but for lines without weight.
    """
    at = [i for i, x in enumerate(lines) if x.strip()]
    place = {i: k for k, i in enumerate(at)}
    known = {place[i] for i in captions or () if i in place}
    weights, light, own_at = line_weights(title, [lines[i] for i in at], [scores[i] for i in at], known)
    keep = [not x.strip() for x in lines]
    for first, last in regions(weights, light, own_at):
        for k in range(first, last + 1):
            keep[at[k]] = weights[k] > 0
    return keep


_KEYED = "page_id long, site long, title_no long, text_no long, at array<int>, keys array<string>, able array<boolean>, heads array<boolean>"


def _keyer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text's lines that aren't blank: place, key, whether it may be a caption, and whether the next one is like a title."""
    for batch in batches:
        titles, texts = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        places, keys, able, heads = [], [], [], []
        for title, text in zip(titles, texts, strict=True):
            own = line_key(title or "")
            lines = [(at, " ".join(x.split())) for at, x in enumerate(strip_markup(text).split("\n")) if x.strip()]
            of = [line_key(x) for _, x in lines]
            places.append([at for at, _ in lines])
            keys.append(of)
            able.append([0 < len(k) <= CAPTION_CHARS and k != own for k in of])
            heads.append([k != own and _title_like(x) for (_, x), k in zip(lines[1:], of[1:], strict=True)] + [False] * bool(lines))
        lists = [pa.array(places, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.string())), pa.array(able, pa.list_(pa.bool_())), pa.array(heads, pa.list_(pa.bool_()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), *lists], [c.split()[0] for c in _KEYED.split(", ")])


def keyed_lines(pages: DataFrame, site: Column) -> DataFrame:
    """(page_id, site, title_no, text_no, at, able, heads, hashes), one row a text: its lines as hashes of their keys, null for empty keys."""
    rows = pages.where("page_id IS NOT NULL AND text IS NOT NULL AND text != ''")
    title = F.coalesce("title", F.lit(""))
    rows = rows.select("page_id", site.alias("site"), F.xxhash64(title).alias("title_no"), F.xxhash64("text").alias("text_no"), "title", "text").mapInArrow(_keyer, _KEYED)
    return rows.withColumn("hashes", F.transform("keys", lambda k: F.when(k != "", F.xxhash64(k)))).drop("keys")


def line_counts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(site, hash, titles) and (site, least, pages): in how many differently titled pages of a site a line is, and from how many on it recurs."""
    each = lines.select("site", "title_no", F.explode("hashes").alias("hash")).where("hash IS NOT NULL")
    counts = each.groupBy("site", "hash").agg(F.count_distinct("title_no").alias("titles"))
    least = F.greatest(F.lit(LEAST_REPEATS), LEAST_SHARE * F.count_distinct("title_no"))
    return materialize(counts), materialize(lines.groupBy("site").agg(least.alias("least"), F.count("*").alias("pages")))


def captions(lines: DataFrame, counts: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    """(hash, n) of every caption: a line that recurs in its site, LEAST_REPEATS times or more in all, and is mostly followed by a title-like line that doesn't.

    As a recurring line is in LEAST_SHARE of a site's titles, a site's array has at most (lines a page) / LEAST_SHARE of them.
    """
    often = attach(counts.where(F.col("titles") >= LEAST_REPEATS), sizes, ["site"], "pages", total).where("titles >= least")
    sites = materialize(often.groupBy("site").agg(F.max("pages").alias("pages"), F.collect_list("hash").alias("recurring")))
    marked = attach(lines, sites, ["site"], "pages", total)
    recurs = lambda h: F.coalesce(F.array_contains("recurring", h), F.lit(False))
    following = F.concat(F.slice("hashes", 2, F.size("hashes")), F.array(F.lit(None).cast("long")))
    each = F.arrays_zip(F.col("hashes").alias("hash"), F.col("able").alias("able"), F.col("heads").alias("heads"), following.alias("next"))
    found = F.transform(F.filter(each, lambda x: x["able"] & recurs(x["hash"])), lambda x: F.struct(x["hash"].alias("hash"), (x["heads"] & ~recurs(x["next"])).cast("int").alias("title")))
    seen = marked.select(F.explode(found).alias("x")).groupBy("x.hash").agg(F.count("*").alias("n"), F.sum("x.title").alias("title"))
    return seen.where((F.col("n") >= LEAST_REPEATS) & (F.col("title") >= 0.5 * F.col("n"))).select("hash", "n")


def sample(crawled: DataFrame, lines: DataFrame, counts: DataFrame, sizes: DataFrame, total: int, most: int = SAMPLE_PAGES) -> list[tuple[int, str, str, list[int], list[int]]]:
    """Up to ``most`` pages (site, title, text, places of recurring lines, places of lines of one title only): those with the least hashes of page_id."""
    rank = F.xxhash64(F.lit(5), "page_id")
    chosen = F.pmod(rank, F.lit(1_000_000))
    share = int(min(1.0, 1.3 * most / max(1, total)) * 1_000_000) + 1
    each = lines.where(chosen < share).select("page_id", "text_no", "site", F.explode(F.arrays_zip("at", F.col("hashes").alias("hash"))).alias("x")).select("page_id", "text_no", "site", "x.*")
    known = each.join(counts, ["site", "hash"]).join(sizes, "site")
    places = lambda which: F.collect_set(F.when(which, F.col("at")))
    known = known.groupBy("page_id", "text_no").agg(places(F.col("titles") >= F.col("least")).alias("recurring"), places(F.col("titles") == 1).alias("single"))
    rows = crawled.where(chosen < share).where("page_id IS NOT NULL AND text IS NOT NULL AND text != ''")
    rows = rows.select("page_id", F.xxhash64("site_id").alias("site"), "title", F.left("text", F.lit(MOST_CHARS)).alias("text"), F.xxhash64("text").alias("text_no")).join(known, ["page_id", "text_no"])
    return [tuple(r) for r in rows.orderBy(chosen, rank, "text_no").limit(most).select("site", "title", "text", "recurring", "single").collect()]


def learnt(crawled: DataFrame, extracted: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """The n-gram ratios, and (page_id, text_no, captions): the places of the captions in each text that has any, counted from 0.

    What recurs in a site, and what is a caption, is counted over all crawled pages; only the n-gram ratios come from a sample.
    """
    lines = materialize(keyed_lines(crawled, F.xxhash64("site_id")))
    total = lines.count()
    counts, sizes = line_counts(lines)
    table = fit(sample(crawled, lines, counts, sizes, total))
    known = materialize(captions(lines, counts, sizes, total))
    both = lines.drop("site").unionByName(materialize(keyed_lines(extracted, F.lit(0).cast("long"))).drop("site"))
    able = F.filter(F.arrays_zip("at", F.col("hashes").alias("hash"), "able"), lambda x: x["able"])
    each = both.select("page_id", "text_no", F.explode(able).alias("x")).select("page_id", "text_no", "x.at", "x.hash")
    found = attach(each, known, ["hash"], "n", each.count())
    return table, found.groupBy("page_id", "text_no").agg(F.collect_set("at").alias("captions"))


def _judged(rows: DataFrame, places: DataFrame) -> DataFrame:
    """(record_set, page_id, title, text, captions) of the rows that have a text."""
    rows = rows.where("page_id IS NOT NULL AND text IS NOT NULL").withColumn("text_no", F.xxhash64("text"))
    return rows.join(places, ["page_id", "text_no"], "left").select("record_set", "page_id", "title", "text", "captions")


_OUT = "record_set string, page_id long, line_no long"


def _marker(table: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, ids, titles, texts, places = (batch.column(k).to_pylist() for k in range(5))
            at = 0
            while at < len(ids):
                to, chars = at, 0
                while to < len(ids) and (to == at or chars < 300_000):
                    chars += len(texts[to])
                    to += 1
                out: list[tuple[str, int, int]] = []
                stripped = [strip_markup(t) for t in texts[at:to]]
                scores = line_scores(stripped, table).tolist()
                done = 0
                for record_set, i, title, text, known in zip(sets[at:to], ids[at:to], titles[at:to], stripped, places[at:to], strict=True):
                    lines = text.split("\n")
                    keep = body_lines(title, lines, scores[done : done + len(lines)], set(known or ()))
                    done += len(lines)
                    out += [(record_set, i, k) for k, (good, line) in enumerate(zip(keep, lines, strict=True), 1) if not good and line.strip()]
                columns = list(zip(*out, strict=True)) if out else [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["record_set", "page_id", "line_no"])
                at = to

    return mark


def strip_markup(text: str) -> str:
    """Tags replaced by nothing, line by line: lines keep their numbers."""
    return _MARKUP.sub(lambda m: "\n" * m.group().count("\n"), text) if "<" in text else text


def boilerplate_lines(crawled: DataFrame, extracted: DataFrame) -> DataFrame:
    """(record_set, page_id, line_no) of every non-empty line of a page's text that isn't body.

    Lines are counted as hashes; then each text meets the places of its captions and is judged. Null and empty texts
    have no lines. A page_id delivered twice gives the same rows twice.
    """
    table, places = learnt(crawled, extracted)
    rows = crawled.select(F.lit("crawled").alias("record_set"), "page_id", "title", "text").unionByName(extracted.select(F.lit("extracted").alias("record_set"), "page_id", "title", "text"))
    return _judged(rows, places).mapInArrow(_marker(table), _OUT)


def body_text(crawled: DataFrame, extracted: DataFrame) -> DataFrame:
    """(record_set, page_id, body): each page's text without the lines that aren't body. Null texts have no row.

    The same pass as :func:`boilerplate_lines`; what is kept is joined again within the task.
    """
    table, places = learnt(crawled, extracted)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, ids, titles, texts, known = (batch.column(k).to_pylist() for k in range(5))
            bodies = []
            for title, text, at in zip(titles, texts, known, strict=True):
                clean = strip_markup(text)
                lines = clean.split("\n")
                keep = body_lines(title, lines, line_scores([clean], table).tolist(), set(at or ()))
                bodies.append("\n".join(x for x, good in zip(lines, keep, strict=True) if good).strip("\n"))
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.string()), pa.array(ids, pa.int64()), pa.array(bodies, pa.string())], ["record_set", "page_id", "body"])

    once = one_per_page(crawled.select("page_id", "title", "text", "loaded_at"), ["title", "text"])
    rows = once.select(F.lit("crawled").alias("record_set"), "page_id", "title", "text").unionByName(extracted.select(F.lit("extracted").alias("record_set"), "page_id", "title", "text"))
    return _judged(rows, places).mapInArrow(join, "record_set string, page_id long, body string")
