"""Template residue, filler, error and script notices: character n-gram models and likelihood-ratio windows."""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.characters import ORDER, TABLE_BITS, CharacterModel, codes_of, line_means, ratio_table, slots
from sitequarry.llm.grams import FLUSH, WINDOWS, WindowCounts, log_ratios, slot, steps, whole, window_rows, windows
from sitequarry.llm.rows import one_per_page, union_all
from sitequarry.sources.tables import materialize

FIELDS = ("text", "description")

#: The models: the collection's filler and notices with the seeds of each, filler Latin, natural text.
FILLED, NOTICED, LATIN_TEXT, NATURAL = 0, 1, 2, 3
#: A text is short, and stands in place of a page, below this share of the median length.
SHORT = 0.25
#: A wording beside so large a share of the full pages is furniture; a line of full pages above FOREIGN is no natural text.
FURNITURE_SHARE, FOREIGN = 0.003, 0.6
#: A line of full pages is no natural text, either, when so large a share of it is in sentences that joined the examples, or of its
#: n-grams in the seeds. Only lines with the share SEEN of their n-grams in examples are looked up by their sentences.
KNOWN, SEEN = 0.8, 0.5
#: Both ends of a sentence in place of a page are a template's when so large a share of the short texts, on two sites at least, have them.
TEMPLATE_SHARE = 0.01
#: Width of the likelihood-ratio windows; a window above LEAST_RATIO (mean natural logarithm a character) is residue.
WINDOW, LEAST_RATIO = 14, 0.6
#: A sentence of which this share lies in residue windows is residue (a quotation covers less of its sentence); a sentence in place of
#: a page joins the examples from JOIN_COVERAGE on.
LEAST_COVERAGE, JOIN_COVERAGE = 0.4, 0.6
#: n-grams and letters that a sentence must have to be judged: numbers alone are no wording.
LEAST_GRAMS, LEAST_LETTERS = 3, 4
#: A placeholder is quoted, not left over, where it stands after (or before) the same words in LEAST_QUOTES lines, on LEAST_SITES sites
#: (all, where there are fewer) and on this share of all sites that have it, and hardly any other placeholder stands there.
#: A template left unfilled repeats on its own site only.
LEAST_QUOTES, LEAST_SITES, LEAST_SPREAD, LEAST_PURITY = 4, 3, 0.05, 0.85

#: Filler vocabulary of typesetters.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()

#: Labelled seed examples of filler, one a line: wordings of common editors and typesetters, few for each language.
FILLER = """replace this text with your own content.
click here to edit this text.
placeholder text
dummy text
sample text
your text goes here
asdf asdf
xxxx xxxx xxxx
test test test
blah blah blah
coming soon
hier steht später ihr text.
platzhaltertext
texte à remplacer.
texte d'exemple
texto de ejemplo.
texto de relleno.
texto de exemplo.
tekst zastępczy.
przykładowy tekst
текст-заполнитель.
пример текста"""

#: Labelled seed examples of error, access, waiting and script notices, one a line: reason phrases of the HTTP standard and
#: usual wordings of servers and frameworks, few for each language.
NOTICES = """403 forbidden
404 not found
429 too many requests
500 internal server error
502 bad gateway
503 service unavailable
504 gateway timeout
error 404: the requested page could not be found.
page not found. go back to the home page.
this page is under construction.
access denied. you do not have permission to view this page.
your session has expired. please sign in again to continue.
please confirm that you are not a robot.
checking your browser before accessing the site…
please wait while the page is loading.
please enable javascript in your browser to view this site.
this app needs javascript to run.
fatal error: uncaught exception on line 00
seite nicht gefunden.
zugriff verweigert.
bitte aktivieren sie javascript, um fortzufahren.
page introuvable.
accès refusé.
veuillez activer javascript.
página no encontrada.
acceso denegado.
active javascript para continuar.
página não encontrada.
acesso negado.
ative o javascript para continuar.
nie znaleziono strony.
odmowa dostępu.
włącz obsługę javascript.
страница не найдена.
доступ запрещён.
включите javascript."""

#: Syntax of unfilled placeholders and of values that were never filled in.
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{0,60}\}\}|\{%[^{}\n]{1,60}%\}|[$#]\{[^{}\n]{1,60}\}|<%[^<>\n]{0,60}%>|\[\[[^\[\]\n]{1,60}\]\]|\{\d{1,2}\}"
    r"|%\([A-Za-z_][\w.]{0,40}\)[sd]|%[A-Za-z]+(?:_[A-Za-z]+)*%|\$[A-Za-z_]\w{1,40}\$|##[A-Za-z_]\w{1,40}##|@@[A-Za-z_]\w{1,40}@@|\b__[A-Za-z][A-Za-z_]{1,40}__\b"
    r"|(?:&lt;|<)(?:placeholder|title|name|text|insert)(?:&gt;|>)|\[\s*(?:insert|your|enter|add)\b[^\[\]\n]{0,40}\]|\[insert[a-z]*here\]"
    r"|\[object ?object\]|\bundefined\b|\bnan\b|\btodo\s*:\s*\w[^.\n]{0,30}?(?:section|text|copy|page|here|this)|\byour ?(?:tagline|headline|text|title) ?goes ?here\b",
    re.IGNORECASE,
)


def _plain(text: str) -> str:
    """White space as single spaces, digits as 0."""
    return re.sub(r"\d", "0", " ".join(text.split()))


def sentences(text: str) -> list[str]:
    """Pieces of a text that end at line breaks and at spaces after an end mark."""
    return [x for x in (_plain(p) for p in re.split(r"\n|(?<=[.!?…]) ", text)) if x]


def wording(text: str) -> str:
    """Lower case, with names left out: words that begin with a capital, but for the first."""
    first, *rest = _plain(text).split(" ")
    return " ".join([first.lower(), *("{}" if w[:1].isupper() and not w.isupper() else w.lower() for w in rest)])


def sentence_ends(key: str) -> list[tuple]:
    """What marks a wording as a template filled with words: its first and its last two words, with their place and number."""
    words = key.split(" ")
    return [("first", len(words), *words[:2]), ("last", len(words), *words[-2:])] if len(words) > 3 else []


def key_of(key: str) -> int:
    """A 64-bit hash of a wording or a mark of one that is the same in every process."""
    return int.from_bytes(blake2b(key.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def told_lines(batch: pa.RecordBatch) -> Iterator[str]:
    """The lines of full pages and of their descriptions."""
    for column in batch.columns:
        for value in column.to_pylist():
            if value:
                yield from (_plain(x) for x in value.split("\n") if x.strip())


#: Rows of a count of wordings (model -1: hash and number) and of windows of natural text.
_WORDING = -1


def _count_told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, wordings = WindowCounts(), Counter()
    empty = np.zeros((0, ORDER), np.uint32)

    def said() -> pa.RecordBatch:
        rows = window_rows(_WORDING, np.zeros(0, np.int64), np.zeros(0, np.int64), empty)
        n = len(wordings)
        columns = [pa.array(np.full(n, _WORDING, np.int32)), pa.array([None] * n, pa.string()), pa.array(wordings.keys(), pa.int64()), pa.array(wordings.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, rows.schema.names)

    for lines, numbers in steps(x for b in batches for x in told_lines(b)):
        counts.add(NATURAL, lines, numbers)
        for x, n in zip(lines, numbers, strict=True):
            wordings[key_of(wording(x))] += n
        yield from counts.take()
        if len(wordings) > FLUSH:
            yield said()
            wordings.clear()
    yield from counts.take(last=True)
    yield said()


def _left_out(usual: frozenset[int], known: frozenset[int], template: frozenset[int], given: np.ndarray, seen: np.ndarray, ratios: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Windows, counted off, of lines of unusual wording that consist of known sentences or of the seeds' n-grams, or are above FOREIGN by the ratios."""

    def joined(line: str) -> bool:
        parts = [(x, wording(x)) for x in sentences(line)]
        own = sum(len(x) for x, w in parts if key_of(w) in known or any(key_of(repr(e)) in template for e in sentence_ends(w)))
        return own >= KNOWN * sum(len(x) for x, _ in parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = WindowCounts(sign=-1)
        for lines, numbers in steps(x for b in batches for x in told_lines(b)):
            out = line_means(lines, ratios) >= FOREIGN if ratios is not None else np.zeros(len(lines), bool)
            # what the seeds have is seen, too
            doubtful = np.flatnonzero(~out & (line_means(lines, seen) >= SEEN))
            if len(doubtful):
                made = line_means([lines[k] for k in doubtful], given) >= KNOWN
                out[doubtful] = [y or joined(lines[k]) for k, y in zip(doubtful, made, strict=True)]
            out = [k for k in np.flatnonzero(out) if key_of(wording(lines[k])) not in usual]
            counts.add(NATURAL, [lines[k] for k in out], [numbers[k] for k in out])
            yield from counts.take()
        yield from counts.take(last=True)

    return count


_SENTENCES = "key long, site long, text string, ends array<long>"


def _in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sentences of short texts: wording, site, the sentence and the marks of its ends."""
    for batch in batches:
        out = []
        for site, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for x in sentences(text):
                if len(x) >= ORDER and not PLACEHOLDER.search(x):
                    key = wording(x)
                    out.append((key_of(key), site, x, [key_of(repr(e)) for e in sentence_ends(key)]))
        types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in _SENTENCES.split(", ")])


_EXAMPLES = "key long, model int, text string"


def _join(usual: frozenset[int], template: frozenset[int], seeds: np.ndarray, table: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The wordings that join the examples: those that recur, and, given a table, those that it covers; each with its class."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for r in zip(*(c.to_pylist() for c in batch.columns), strict=True) if r[0] not in usual]
            covered = np.zeros(len(rows))
            if table is not None and rows:
                owner, _, _, coverage = sentence_coverage([r[1] for r in rows], table)
                np.maximum.at(covered, owner, coverage)
            rows = [r for r, c in zip(rows, covered, strict=True) if r[2] or any(e in template for e in r[3]) or c >= JOIN_COVERAGE]
            side = line_means([r[1] for r in rows], seeds) > 0 if rows else np.zeros(0, bool)
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array(np.where(side, FILLED, NOTICED), pa.int32()), pa.array([r[1] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _EXAMPLES.split(", ")])

    return choose


def _count_examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = WindowCounts()
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for model in (FILLED, NOTICED):
            lines = [x for m, x in rows if m == model]
            counts.add(model, lines, [1] * len(lines))
        yield from counts.take()
    yield from counts.take(last=True)


def fit(pages: DataFrame, filler: str = FILLER, notices: str = NOTICES, seed: int = 7) -> np.ndarray:
    """Table of log-likelihood ratios by n-gram: the likeliest of filler, filler Latin and notices against natural text.

    All pages count. The collection's own wordings are learnt from where they stand. Sentences of texts far shorter than
    usual stand in place of a page. Those whose wording recurs on several sites join the seeds, each with the class that
    is likelier; so do those that share an end and their length with many others. The rest join when the models so far
    take them for residue. Natural text is all lines of full pages and their descriptions, so furniture is natural: a
    wording that at least FURNITURE_SHARE of the pages have beside a full body is never residue. What has joined, and
    lines above FOREIGN, are left out of the natural model: their n-grams are counted off the sums of all.
    """
    spark = pages.sparkSession
    rows = pages.where("page_id IS NOT NULL AND text IS NOT NULL AND text != ''")
    size = F.length("text")
    median = rows.agg(F.percentile(size, F.lit(0.5))).first()[0] or 0
    short = size < SHORT * median
    number = {r[0]: r[1] for r in rows.groupBy(short).count().collect()}
    full = rows.where(~short).select(*FIELDS)
    counted = materialize(full.mapInArrow(_count_told, WINDOWS))
    told = materialize(counted.where(F.col("model") == NATURAL).groupBy("model", "gram", "hash").agg(F.sum("n").alias("n")))
    # as each usual wording is beside FURNITURE_SHARE of the full pages, there are at most (lines a page) / FURNITURE_SHARE
    least = max(3.0, FURNITURE_SHARE * number.get(False, 0))
    wordings = counted.where(F.col("model") == _WORDING).groupBy("hash").agg(F.sum("n").alias("n"))
    usual = frozenset(r[0] for r in wordings.where(F.col("n") >= least).select("hash").collect())

    brief = rows.where(short).select(F.xxhash64(F.coalesce("site_id", F.lit(""))).alias("site"), "text")
    brief = materialize(brief.mapInArrow(_in_place, _SENTENCES))
    several = F.min("site") != F.max("site")
    marks = brief.select("site", F.explode("ends").alias("end")).groupBy("end").agg(F.count("*").alias("n"), several.alias("several"))
    template = frozenset(r[0] for r in marks.where("several").where(F.col("n") >= TEMPLATE_SHARE * number.get(True, 0)).select("end").collect())
    pool = materialize(brief.groupBy("key").agg(F.min("text").alias("text"), several.alias("several"), F.first("ends").alias("ends")))

    rng = random.Random(seed)
    latin = [" ".join(rng.choice(LATIN) for _ in range(rng.randint(6, 16))) + "." for _ in range(1500)]
    given = {FILLED: filler.split("\n"), NOTICED: notices.split("\n"), LATIN_TEXT: latin}
    seeds = ratio_table([CharacterModel(given[FILLED])], [CharacterModel(given[NOTICED])])
    first = pa.Table.from_batches([window_rows(m, *windows(x, [1] * len(x))) for m, x in given.items()])
    first = spark.createDataFrame(first).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in WINDOWS.split(", ")])

    def slots_of(grams: DataFrame) -> np.ndarray:
        table = np.zeros(1 << TABLE_BITS, np.float16)
        grams = grams.where(F.col("model").isin(FILLED, NOTICED)).where(whole(F.col("gram"), ORDER))
        table[grams.select(slot(F.col("hash")).alias("slot")).distinct().toArrow()["slot"].to_numpy()] = 1
        return table

    def table_of(table: np.ndarray | None) -> np.ndarray:
        known = materialize(pool.mapInArrow(_join(usual, template, seeds, table), _EXAMPLES))
        examples = materialize(first.unionByName(known.select("model", "text").mapInArrow(_count_examples, WINDOWS)))
        keys = frozenset(known.select("key").toArrow()["key"].to_pylist())  # a number each, of wordings in place of a page
        out = full.mapInArrow(_left_out(usual, keys, template, slots_of(first), slots_of(examples), table), WINDOWS)
        return log_ratios(union_all([told, out, examples]), [FILLED, NOTICED, LATIN_TEXT], NATURAL)

    return table_of(table_of(None))


def sentence_coverage(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start in text, length, coverage) of each sentence: the share of it that lies in residue windows."""
    codes, lengths = codes_of(texts)
    grams = slots(codes)
    if not len(grams):
        return (np.zeros(0, np.int64),) * 4  # no text that is long enough
    score = np.zeros(len(codes))
    score[: len(grams)] = table[grams]
    # sentences end at line breaks and at spaces after an end mark
    space, mark = codes == 32, np.isin(codes, np.array([46, 33, 63, 0x2026], np.uint64))
    end = codes == 10
    end[1:] |= space[1:] & mark[:-1]
    sentence = np.r_[0, np.cumsum(end)[:-1]]
    first = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
    size = np.diff(np.r_[first, len(codes)])
    of = np.repeat(np.arange(len(first)), size)
    stop = np.repeat(first + size, size)
    # a gram counts when it lies within its sentence; a window is a run of grams of one sentence
    place = np.arange(len(codes))
    inside = place + ORDER <= stop
    score[~inside] = 0
    total, number = np.r_[0.0, np.cumsum(score)], np.r_[0, np.cumsum(inside)]
    half = WINDOW // 2
    low, high = np.maximum(place - half, np.repeat(first, size)), np.minimum(place + half + 1, stop)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = (total[high] - total[low]) / (number[high] - number[low])
    hit = inside & (mean > LEAST_RATIO)
    hits, valid = np.bincount(of, hit, len(first)), np.bincount(of, inside, len(first))
    letters = np.bincount(of, (codes >= 97) & (codes <= 122) | (codes >= 0xC0), len(first))
    coverage = np.where((valid >= LEAST_GRAMS) & (letters >= LEAST_LETTERS), hits / np.maximum(valid, 1), 0.0)
    text_start = np.r_[0, np.cumsum(lengths)]
    owner = np.searchsorted(text_start, first, side="right") - 1
    return owner, first - text_start[owner], size, coverage


def _context(text: str, start: int, end: int) -> tuple[str, str, str]:
    """Two words before and after a span within its line, and the line around it; digits as 0."""
    left = text[max(0, start - 60) : start].rsplit("\n", 1)[-1]
    right = text[end : end + 60].split("\n", 1)[0]
    words = lambda s: re.sub(r"\d+", "0", s.lower()).split()
    before, after = words(left), words(right)
    return " ".join((["^"] + before)[-2:]), " ".join((after + ["$"])[:2]), " ".join(before) + "|" + " ".join(after)


_SPANS = "page_id long, site long, field string, kind string, type string, before string, after string, line long, start int, length int"


def _finder(table: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidate spans of each value: placeholders with their context, and residue sentences."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # small steps: a step's arrays are a few hundred bytes a character of its texts
            at = 0
            ids = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            values = {f: batch.column(k + 2).to_pylist() for k, f in enumerate(FIELDS)}
            while at < len(ids):
                to, chars = at, 0
                while to < len(ids) and (to == at or chars < 300_000):
                    chars += sum(len(values[f][to] or "") for f in FIELDS)
                    to += 1
                yield step(ids[at:to], {f: v[at:to] for f, v in values.items()})
                at = to

    def step(ids: list[tuple[int, int]], values: dict[str, list]) -> pa.RecordBatch:
        out: list[tuple] = []
        for field, texts in values.items():
            known = [(i, t) for i, t in zip(ids, texts, strict=True) if t]
            if not known:
                continue
            for i, text in known:
                for m in PLACEHOLDER.finditer(text):
                    before, after, line = _context(text, m.start(), m.end())
                    out.append((*i, field, "placeholder", re.sub(r"\s+", "", m.group().lower()), before, after, hash_of(line), m.start(), m.end() - m.start()))
            owner, start, size, coverage = sentence_coverage([t for _, t in known], table)
            for k in np.flatnonzero(coverage >= LEAST_COVERAGE):
                out.append((*known[owner[k]][0], field, "sentence", None, None, None, None, int(start[k]), int(size[k])))
        columns = list(zip(*out, strict=True)) if out else [()] * 10
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in _SPANS.split(", ")])

    return find


def hash_of(text: str) -> int:
    """A 64-bit hash that is the same in every process."""
    h = 14695981039346656037
    for b in text.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return h - (1 << 64) if h >> 63 else h


def residue_spans(pages: DataFrame) -> DataFrame:
    """(page_id, field, kind, start, length) of every span of residue; offsets count characters from 0.

    One pass over all values finds placeholders and residue sentences. A placeholder that its contexts show to be
    quoted as a subject is dropped: contexts are counted over all values, by distinct lines, so that copies of a page
    don't make a quotation. Null and empty values have no spans. A page_id delivered twice gives the same spans twice.
    """
    table = fit(pages)
    spans = pages.where("page_id IS NOT NULL").select("page_id", F.xxhash64("site_id").alias("site"), *FIELDS).mapInArrow(_finder(table), _SPANS)
    spans = materialize(spans)
    least_sites = min(LEAST_SITES, pages.select("site_id").distinct().limit(LEAST_SITES).count())
    marks = spans.where("kind = 'placeholder'")
    alone = F.col("before").isin("^") & (F.col("after") == "$")
    # the kinds of placeholders are many at most as the ways to write them; their sites are counted by pairs first
    spread = marks.select("type", "site").distinct().groupBy("type").agg(F.count("*").alias("all_sites"))

    def quoting(side: str) -> DataFrame:
        seen = marks.where(~alone).groupBy(side, "type").agg(F.count_distinct("line").alias("n"), F.count_distinct("site").alias("sites"))
        whole = seen.groupBy(side).agg(F.sum("n").alias("all"))
        pure = seen.join(whole, side).where(F.col("n") >= LEAST_PURITY * F.col("all")).join(spread, "type")
        pure = pure.where((F.col("n") >= LEAST_QUOTES) & (F.col("sites") >= least_sites) & (F.col("sites") >= LEAST_SPREAD * F.col("all_sites")))
        return pure.select(side, "type", F.lit(True).alias(f"quoted_{side}"))

    both = marks.join(quoting("before"), ["before", "type"], "left").join(quoting("after"), ["after", "type"], "left")
    left_over = both.where(alone | (F.col("quoted_before").isNull() & F.col("quoted_after").isNull()))
    columns = ["page_id", "field", "kind", "start", "length"]
    # a kind of placeholder that is nearly always quoted is quoted where the words around it were edited, too
    quoted = both.groupBy("type").agg(F.count("*").alias("n"), F.sum((~alone & (F.col("quoted_before").isNotNull() | F.col("quoted_after").isNotNull())).cast("int")).alias("q"), F.sum(alone.cast("int")).alias("a"))
    never = quoted.where((F.col("q") >= 0.7 * F.col("n")) & (F.col("a") <= 0.02 * F.col("n"))).select("type")
    left_over = left_over.join(never, "type", "left_anti")
    return left_over.select(*columns).unionByName(spans.where("kind = 'sentence'").select(*columns))


def without_residue(pages: DataFrame) -> DataFrame:
    """(page_id, text, description): the pages with each affected value set to null; the rest pass on unchanged."""
    bad = residue_spans(pages).select("page_id", "field").distinct().groupBy("page_id").agg(F.collect_set("field").alias("bad"))
    rows = one_per_page(pages, list(FIELDS))
    joined = rows.join(bad, "page_id", "left")
    return joined.select("page_id", *[F.when(~F.coalesce(F.array_contains("bad", f), F.lit(False)), F.col(f)).alias(f) for f in FIELDS])
