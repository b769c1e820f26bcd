"""Near-duplicate pages: an exact grouped prefix join on word shingles.

The sets of shingles are cut into CLASSES by hash. If two sets have a Jaccard similarity of at least t, then in at
least one class their parts have it too (the symmetric differences and the sizes of the parts add up to those of
the wholes, so not every part can lie below the ratio). So each class is joined by itself, by prefixes of the parts,
documents with equal parts forming one group; what passes in a class is then verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.functions.binding import let
from sitequarry.llm.rows import one_per_page
from sitequarry.operators.skew import attach, sieve
from sitequarry.sources.tables import materialize

#: Hash classes of shingles.
CLASSES_BITS = 3
CLASSES = 1 << CLASSES_BITS
#: Documents a join task; more documents give more token ranges a class.
TASK_ROWS = 120_000
#: Shingle frequencies are counted in so many buckets (they only order the prefixes, any order is right).
FREQUENCY_BITS = 19
#: Pairs looked at in one vectorised step.
STEP = 1 << 21
#: Members of a group that meet those of another at once, about: larger groups are cut into chunks.
CHUNK = 512
#: 64-bit words of a whole set's parity map.
MAP_WORDS = 8

_PART_SCHEMA = "class int, range int, id long, total int, size int, low long, high long, digest long, index int, lead boolean, tokens array<int>"
#: A pair of groups (members ``na`` and ``nb``), or, where ``member`` is set, that the group ``a`` of ``na`` members has it.
_JOIN_SCHEMA = "class int, a long, b long, na long, nb long, member long"


def shingle_sets(pages: DataFrame, words: int = 5, least_words: int = 1) -> DataFrame:
    """(page_id, loaded_at, h1, h2, shingles): distinct 32-bit hashes of ``words`` consecutive words, sorted.

    Words are the lower-cased maximal runs of letters and numbers of title, a space and text. Pages whose text is
    null or has fewer than ``least_words`` words, or that have no shingle, are left out. (h1, h2) digest the set.
    """
    word = r"[\p{L}\p{N}]+"
    rows = pages.where("page_id IS NOT NULL AND text IS NOT NULL").where(F.regexp_count("text", F.lit(word)) >= least_words)
    all_words = F.regexp_extract_all(F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), "text")), F.lit(word), F.lit(0))

    def shingles(w: Column) -> Column:
        starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(0)))
        one = lambda x, i: F.shiftright(F.xxhash64(x, *[F.get(w, i + k) for k in range(1, words)]), 32).cast("int")
        return F.sort_array(F.array_distinct(F.transform(starts, one)))

    rows = rows.select("page_id", "loaded_at", let(all_words, shingles).alias("shingles")).where(F.size("shingles") > 0)
    return rows.select("page_id", "loaded_at", F.xxhash64("shingles").alias("h1"), F.xxhash64(F.lit(7), "shingles").alias("h2"), "shingles")


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.asarray(lists.offsets)
    return np.asarray(lists.values)[ends[0] : ends[-1]], np.diff(ends)


def _bucket(values: np.ndarray) -> np.ndarray:
    return ((values.astype(np.uint32) * np.uint32(2654435769)) >> np.uint32(32 - FREQUENCY_BITS)).astype(np.int64)


def shingle_frequencies(sets: DataFrame) -> np.ndarray:
    """Occurrences by bucket; 2 ** FREQUENCY_BITS numbers whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << FREQUENCY_BITS, np.int64)
        for b in batches:
            values, _ = _flat(b.column(0))
            seen += np.bincount(_bucket(values), minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["bucket", "n"])

    rows = sets.select("shingles").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << FREQUENCY_BITS, np.int64)
    table[np.asarray(rows["bucket"])] = np.asarray(rows["n"])
    return np.minimum(table, 2**31 - 1).astype(np.int32)


def _ceil(x: np.ndarray) -> np.ndarray:
    return np.ceil(x - 1e-9).astype(np.int64)


def _splitter(frequencies: np.ndarray, threshold: float, ranges: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts sets into classes: sizes, 128-bit parity maps, digests and prefixes, a row for each class and token range."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                yield part(b.slice(at, 4096))

    def part(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = np.asarray(b.column(0))
        values, lengths = _flat(b.column(1))
        doc = np.repeat(np.arange(len(ids)), lengths)
        raw = values.astype(np.uint32)
        segment = doc * CLASSES + (raw & np.uint32(CLASSES - 1)).astype(np.int64)
        order = np.lexsort((values, frequencies[_bucket(values)], segment))
        values, raw, segment = values[order], raw[order], segment[order]
        first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(segment) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(segment)])
        mixed = raw.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        bit, one = (mixed >> np.uint64(57)), np.uint64(1)
        low = np.bitwise_xor.reduceat(np.where(bit < 64, one << (bit & np.uint64(63)), np.uint64(0)), first) if len(first) else np.zeros(0, np.uint64)
        high = np.bitwise_xor.reduceat(np.where(bit >= 64, one << (bit & np.uint64(63)), np.uint64(0)), first) if len(first) else np.zeros(0, np.uint64)
        digest = np.add.reduceat(mixed, first) if len(first) else np.zeros(0, np.uint64)
        probe = size - _ceil(threshold * size) + 1
        index = size - _ceil(2 * threshold / (1 + threshold) * size) + 1
        place = np.arange(len(values)) - np.repeat(first, size)
        of = np.repeat(np.arange(len(first)), size)
        keep = place < probe[of]
        token, of, place = values[keep], of[keep], place[keep]
        chunk = ((token.astype(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.int64) % ranges
        order = np.lexsort((place, chunk, of))
        token, of, place, chunk = token[order], of[order], place[order], chunk[order]
        key = of * ranges + chunk
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        at = of[start]
        indexed = np.add.reduceat((place < index[of]).astype(np.int32), start) if len(start) else np.zeros(0, np.int32)
        owner = segment[first][at] // CLASSES
        tokens = pa.ListArray.from_arrays(pa.array(np.r_[start, len(key)].astype(np.int32)), pa.array(token.astype(np.int32)))
        columns = [
            (segment[first][at] % CLASSES).astype(np.int32), chunk[start].astype(np.int32), ids[owner], lengths[owner].astype(np.int32), size[at].astype(np.int32),
            low[at].view(np.int64), high[at].view(np.int64), digest[at].view(np.int64), indexed.astype(np.int32), place[start] == 0,
        ]
        names = [c.split()[0] for c in _PART_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), tokens], names)

    return split


def _joiner(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Joins the parts of one class and token range; gives pairs of groups of equal parts, and the groups' members.

    Groups are named by their smallest id, so every range names them alike; members come from the range of the
    group's first token only. Nothing is expanded here: the result has a row a pair of groups and a row a member.
    """

    def join(table: pa.Table) -> pa.Table:
        col = {n: np.asarray(table[n].combine_chunks()) for n in table.column_names if n != "tokens"}
        tokens, lengths = _flat(table["tokens"])
        # equal parts form one group; groups are ranked by size
        order = np.lexsort((col["id"], col["digest"], col["size"]))
        tokens_start = np.r_[0, np.cumsum(lengths)]
        s, d = col["size"][order], col["digest"][order]
        head = np.r_[True, (s[1:] != s[:-1]) | (d[1:] != d[:-1])] if len(s) else np.zeros(0, bool)
        group_start = np.flatnonzero(head)
        members = col["id"][order]
        totals = col["total"][order]
        member_end = np.r_[group_start[1:], len(order)]
        rep = order[group_start]
        size, low, high = col["size"][rep].astype(np.int64), col["low"][rep].view(np.uint64), col["high"][rep].view(np.uint64)
        least_total = np.minimum.reduceat(totals, group_start) if len(rep) else totals
        most_total = np.maximum.reduceat(totals, group_start) if len(rep) else totals
        # postings of the groups, ordered by token and rank
        count = lengths[rep]
        rank = np.repeat(np.arange(len(rep)), count)
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        token = tokens[np.repeat(tokens_start[rep], count) + inner].astype(np.uint32).astype(np.int64)
        indexed = inner < np.repeat(col["index"][rep], count)
        key = (token << 31) | rank
        by = np.argsort(key, kind="stable")
        key, probe_rank = key[by], rank[by]
        i_rank, i_token = rank[indexed], token[indexed]
        last = np.searchsorted(size, np.floor(size / threshold + 1e-9), side="right")
        lo = np.searchsorted(key, (i_token << 31) | (i_rank + 1))
        hi = np.searchsorted(key, (i_token << 31) | last[i_rank])
        width = np.maximum(hi - lo, 0)
        ends = np.cumsum(width)
        found: list[np.ndarray] = []
        at = 0
        while at < len(width):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + STEP, side="right")))
            w = width[at:to]
            n = int(w.sum())
            if n:
                left = np.repeat(i_rank[at:to], w)
                step = np.arange(n) - np.repeat(np.cumsum(w) - w, w)
                right = probe_rank[np.repeat(lo[at:to], w) + step]
                differ = np.bitwise_count(low[left] ^ low[right]) + np.bitwise_count(high[left] ^ high[right])
                ok = differ <= (1 - threshold) / (1 + threshold) * (size[left] + size[right]) + 1e-9
                left, right = left[ok], right[ok]
                # whole sizes must fit for some members
                ok = (most_total[left] >= threshold * least_total[right] - 1e-9) & (most_total[right] >= threshold * least_total[left] - 1e-9)
                found.append(np.unique((left[ok].astype(np.int64) << 31) | right[ok]))
            at = to
        codes = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        counts = member_end - group_start
        name = members[group_start]
        # a group's own pairs, and its members, are told once
        own = np.flatnonzero((counts > 1) & col["lead"][rep])
        left, right = np.r_[codes >> 31, own], np.r_[codes & (2**31 - 1), own]
        told = np.repeat(own, counts[own])
        inner = np.arange(len(told)) - np.repeat(np.cumsum(counts[own]) - counts[own], counts[own])
        within = members[group_start[told] + inner]
        classes = np.full(len(left) + len(told), col["class"][0] if len(order) else 0, np.int32)
        out = [np.r_[name[left], name[told]], np.r_[name[right], name[told]], np.r_[counts[left], counts[told]], np.r_[counts[right], counts[told]]]
        none = np.r_[np.ones(len(left), bool), np.zeros(len(told), bool)]
        member = pa.array(np.r_[np.zeros(len(left), np.int64), within], pa.int64(), mask=none)
        return pa.table([pa.array(classes), *(pa.array(c, pa.int64()) for c in out), member], names=["class", "a", "b", "na", "nb", "member"])

    return join


def parity_maps(sets: DataFrame) -> DataFrame:
    """(id, total, map): size and parity map of each whole set, MAP_WORDS words. Maps of sets with d elements not in common differ in at most d bits."""

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, lengths = _flat(b.column(1))
            mixed = values.astype(np.uint32).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            bit = (mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(55)
            words = np.zeros(len(lengths) * MAP_WORDS, np.uint64)
            at = np.repeat(np.arange(len(lengths)), lengths) * MAP_WORDS + (bit >> np.uint64(6)).astype(np.int64)
            np.bitwise_xor.at(words, at, np.uint64(1) << (bit & np.uint64(63)))
            ends = np.arange(0, len(words) + 1, MAP_WORDS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(words.view(np.int64)))], ["id", "total", "map"])

    return sets.select("id", "shingles").mapInArrow(maps, "id long, total int, map array<long>")


def expand(pairs: DataFrame, members: DataFrame, groups: list[str], carried: list[str]) -> DataFrame:
    """(x, y, x_..., y_... of ``carried``): members of the groups of each pair; x and y differ, a pair within a group comes once.

    ``pairs``: ``groups`` (further key columns), a, b, na, nb; ``members``: ``groups``, a, na, member, ``carried``. A
    group of n members is cut into n / CHUNK chunks, so a join key has about CHUNK members, and the pairs of chunks of
    a large group are spread over all tasks. Rows are joined and filtered as they come, never gathered.
    """
    chunks = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
    each = pairs.withColumn("ca", F.explode(F.sequence(F.lit(0), chunks("na") - 1)))
    least = F.when(F.col("a") == F.col("b"), F.col("ca")).otherwise(0)
    each = each.withColumn("cb", F.explode(F.sequence(least, chunks("nb") - 1))).drop("na", "nb")
    cut = members.withColumn("chunk", F.pmod(F.xxhash64("member"), chunks("na")).cast("int"))
    side = lambda g, c, m: cut.select(*groups, F.col("a").alias(g), F.col("chunk").alias(c), F.col("member").alias(m), *[F.col(x).alias(f"{m}_{x}") for x in carried])
    both = each.join(side("a", "ca", "x"), [*groups, "a", "ca"]).join(side("b", "cb", "y"), [*groups, "b", "cb"])
    within = (F.col("a") == F.col("b")) & (F.col("ca") == F.col("cb"))
    return both.where((F.col("x") != F.col("y")) & (~within | (F.col("x") < F.col("y")))).select("x", "y", *[f"{m}_{c}" for m in "xy" for c in carried])


class NearDuplicates:
    """Classes of pages with equal shingle sets, and the similar pairs among the classes.

    ``members``: (page_id, class_id, class_rows), class_id being the smallest page_id of an equal set; ``pairs``: (a, b,
    similarity) of class_ids, a < b, similarity at least ``threshold``.
    """

    def __init__(self, pages: DataFrame, words: int = 5, threshold: float = 0.8, least_words: int = 1) -> None:
        all_sets = materialize(shingle_sets(pages, words, least_words))
        latest = one_per_page(all_sets.select("page_id", "loaded_at", "h1", "h2"), ["h1", "h2"])
        classes = latest.groupBy("h1", "h2").agg(F.min("page_id").alias("class_id"), F.count("*").alias("class_rows"))
        classes = materialize(classes)
        self.total = all_sets.count()
        self.members = materialize(attach(latest, classes, ["h1", "h2"], "class_rows", self.total).select("page_id", "class_id", "class_rows"))
        # a class's set comes from the row of its first page. Only pages that are no first one, or came more than once,
        # are shuffled with their sets to be dropped; all others pass
        firsts = classes.select(F.col("class_id").alias("page_id"), "h1", "h2")
        once = all_sets.groupBy("page_id", "h1", "h2").agg(F.count("*").alias("n")).join(firsts.withColumn("first", F.lit(True)), ["page_id", "h1", "h2"], "left")
        doubtful, sure = sieve(all_sets.select("page_id", "h1", "h2", "shingles"), "page_id", once.where("first IS NULL OR n > 1").select("page_id"))
        # the grouping has the join's keys, so sets are shuffled once
        sets = doubtful.join(firsts, ["page_id", "h1", "h2"]).groupBy("page_id", "h1", "h2").agg(F.first("shingles").alias("shingles"))
        self.sets = materialize(sure.unionByName(sets).select(F.col("page_id").alias("id"), "shingles"))
        self.pairs = materialize(self._verified(threshold))

    def _candidates(self, threshold: float) -> DataFrame:
        frequencies = shingle_frequencies(self.sets)
        ranges = max(1, -(-self.sets.count() // TASK_ROWS))
        parts = self.sets.select("id", "shingles").mapInArrow(_splitter(frequencies, threshold, ranges), _PART_SCHEMA)
        told = materialize(parts.groupBy("class", "range").applyInArrow(_joiner(threshold), _JOIN_SCHEMA))
        pairs = told.where("member IS NULL").drop("member").distinct()
        single = pairs.where("na = 1 AND nb = 1").select("a", "b")
        groups = pairs.where("na > 1 OR nb > 1")
        members = told.where("member IS NOT NULL").select("class", "a", "na", "member")
        # the other side of a group may be a single one, which is its own only member
        alone = [groups.where(f"n{x} = 1").select("class", F.col(x).alias("a"), F.lit(1).cast("long").alias("na"), F.col(x).alias("member")) for x in "ab"]
        members = members.unionByName(alone[0].unionByName(alone[1]).distinct())
        maps = parity_maps(self.sets)
        members = materialize(members.join(maps, members["member"] == maps["id"]).drop("id"))
        found = expand(groups, members, ["class"], ["total", "map"])
        differ = sum((F.bit_count(F.col("x_map")[k].bitwiseXOR(F.col("y_map")[k])) for k in range(1, MAP_WORDS)), F.bit_count(F.col("x_map")[0].bitwiseXOR(F.col("y_map")[0])))
        least, most = F.least("x_total", "y_total"), F.greatest("x_total", "y_total")
        fits = (least >= threshold * most - 1e-9) & (differ <= (1 - threshold) / (1 + threshold) * (least + most) + 1e-9)
        found = found.where(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        return single.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(found).distinct()

    def _verified(self, threshold: float) -> DataFrame:
        found = materialize(self._candidates(threshold))
        ids = found.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        needed = materialize(sieve(self.sets, "id", ids)[0].join(ids, "id", "left_semi"))
        left = needed.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
        right = needed.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        both = found.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")))
        similarity = F.col("shared") / (F.size("sa") + F.size("sb") - F.col("shared"))
        return both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)

    def page_pairs(self) -> DataFrame:
        """(page_id_a, page_id_b): all similar pairs of pages, copies included; as many rows as there are such pairs."""
        sizes = self.members.select("class_id", "class_rows").distinct()
        rows = lambda x: sizes.select(F.col("class_id").alias(x), F.col("class_rows").alias(f"n{x}"))
        pairs = self.pairs.select("a", "b").join(rows("a"), "a").join(rows("b"), "b").select("a", "b", "na", "nb")
        pairs = pairs.unionByName(sizes.where("class_rows > 1").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"), F.col("class_rows").alias("na"), F.col("class_rows").alias("nb")))
        members = self.members.select(F.col("class_id").alias("a"), F.col("class_rows").alias("na"), F.col("page_id").alias("member"))
        return expand(pairs, members, [], []).select(F.least("x", "y").alias("page_id_a"), F.greatest("x", "y").alias("page_id_b"))

    def groups(self) -> DataFrame:
        """(page_id, class_id, group_id, links): a page's group of similar pages, named by its smallest class_id.

        ``links`` counts the other pages similar to the page itself. Pages similar to none form groups of their own.
        """
        labels = components(self.pairs.select("a", "b"))
        sizes = self.members.select("class_id", "class_rows").distinct()
        ends = self.pairs.select(F.explode(F.array(F.struct(F.col("a").alias("class_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("class_id"), F.col("a").alias("other")))).alias("e")).select("e.*")
        near = ends.join(sizes.select(F.col("class_id").alias("other"), "class_rows"), "other").groupBy("class_id").agg(F.sum("class_rows").alias("near"))
        facts = sizes.join(labels, "class_id", "left").join(near, "class_id", "left").select(
            "class_id", F.coalesce("group_id", "class_id").alias("group_id"), (F.col("class_rows") - 1 + F.coalesce("near", F.lit(0))).alias("links"), "class_rows"
        )
        facts = materialize(facts)
        return attach(self.members.select("page_id", "class_id"), facts, ["class_id"], "class_rows", self.total).drop("class_rows")


def components(pairs: DataFrame) -> DataFrame:
    """(class_id, group_id): connected components, each named by its smallest id; pairs are (a, b).

    Alternating large-star and small-star rounds until no edge changes, which takes at most about the square of the
    logarithm of the number of ids; each round's edges are written. Minima are aggregated before they are shuffled, and
    edges meet them by :func:`attach`, so a hub of many edges is not gathered in one task.
    """
    edges = materialize(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree"))
        large = materialize(attach(both, least, ["u"], "degree", both.count()).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        small = attach(large, least, ["u"], "degree", large.count()).select(F.col("v").alias("x"), "u", "m")
        edges = materialize(small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("x").alias("u"), F.col("m").alias("v"))).where("u != v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    heads = edges.select(F.col("v").alias("class_id"), F.col("v").alias("group_id"))
    return edges.groupBy("u").agg(F.min("v").alias("group_id")).select(F.col("u").alias("class_id"), "group_id").unionByName(heads.distinct())
