"""Garbled text from wrong character encoding: expectation-maximisation over latent encoding chains.

A chain says in which code a text was written and as which codes it was then read. Words that a chain can undo are
weak evidence by themselves; they are pooled over each record, over each source and field (the share of records that went
through the chain) and over all records (how often the word occurs without having gone through it).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.rows import one_per_page
from sitequarry.sources.tables import materialize

FIELDS = ("title", "text")

#: Chains as "written>read", in order; a second reading follows after another ">".
CHAINS = (
    "utf-8>cp1252 utf-8>latin-1 utf-8>cp1250 utf-8>iso8859-2 utf-8>cp1251 utf-8>cp437 utf-8>cp850 utf-8>cp852 utf-8>cp866 utf-8>mac-roman utf-8>mac-cyrillic "
    "utf-8>koi8-r utf-8>cp1254 utf-8>iso8859-15 utf-8>cp1257 utf-8>iso8859-5 utf-8>cp1252>cp1252 utf-8>latin-1>latin-1 utf-8>cp1252>latin-1 utf-8>latin-1>cp1252 "
    "utf-8>cp1250>cp1250 utf-8>cp1251>cp1251 utf-8>mac-roman>mac-roman utf-8>cp437>cp437 utf-8>cp850>cp850 "
    "cp1250>cp1252 cp1250>latin-1 iso8859-2>cp1252 iso8859-2>latin-1 cp1251>cp1252 cp1251>latin-1 koi8-r>cp1252 koi8-r>latin-1 koi8-r>cp1251 cp1251>koi8-r cp866>cp1251 "
    "cp866>cp1252 cp1251>cp866 mac-roman>cp1252 mac-roman>latin-1 cp1252>mac-roman cp1252>latin-1 cp850>cp1252 cp437>cp1252 cp1252>cp850 cp1252>cp437 cp1252>cp1250 cp1252>cp1251 iso8859-5>latin-1"
).split()
#: Characters lost in reading: nothing to undo.
LOST = "lost"

#: Prior strength (records) of the chains' shares over a source and field; share of garbled records to begin with.
PRIOR_RECORDS, PRIOR_SHARE = 20.0, 0.02
#: A multi-byte sequence that decodes is so much evidence (natural logarithm), at most MOST a word; with frequencies a word counts at most WORD.
SEQUENCE, MOST, WORD = 3.0, 8.0, 14.0
#: A one-byte code read as another is only considered for words of so many characters.
LEAST_WORD = 3
#: Rounds of expectation and maximisation.
ROUNDS = 4
#: Words in at least this share of the records are looked up by broadcast (there are at most 1 / HOT x words a record of them).
HOT = 0.002


def _encode(text: str, code: str) -> bytes:
    """Bytes that reading as ``code`` gave; bytes that Windows codes leave undefined were read as C1 controls."""
    try:
        return text.encode(code)
    except UnicodeEncodeError:
        if not code.startswith("cp12"):
            raise
        out = bytearray()
        for c in text:
            try:
                out += c.encode(code)
            except UnicodeEncodeError:
                if not 0x80 <= ord(c) < 0xA0:
                    raise
                out.append(ord(c))
        return bytes(out)


def undo(word: str, chain: str) -> str | None:
    """The word before the chain; None where the chain can't have made it or changes nothing."""
    written, *read = chain.split(">")
    try:
        for k in range(len(read) - 1, -1, -1):
            word, before = _encode(word, read[k]).decode(written), word
            if word == before:
                return None
    except (UnicodeError, ValueError):
        return None
    if any(ord(c) < 32 or 0x7F <= ord(c) < 0xA0 or 0xE000 <= ord(c) < 0xF900 for c in word):
        return None
    return word


def words_of(value: Column) -> Column:
    """Distinct words of a value that have a character beyond ASCII, without ASCII punctuation at their ends."""
    strip = r"^[\x21-\x2F:-@\[-`{-~]+|[\x21-\x2F:-@\[-`{-~]+$"
    parts = F.filter(F.split(value, r"[ \n\t\r]+"), lambda w: w.rlike(r"[^\x00-\x7F]"))
    return F.array_distinct(F.transform(parts, lambda w: F.regexp_replace(w, strip, "")))


def repairs(words: DataFrame) -> DataFrame:
    """(word, chain, repaired, sequences, alone) for each way to undo a word of the dictionary; lost characters as chain 'lost'."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for word in frame["word"]:
                if "�" in word:
                    out.append((word, LOST, None, 2, len(word) == 1))
                    continue
                seen = set()
                control = any(0x80 <= ord(c) < 0xA0 for c in word)
                for chain in CHAINS:
                    if not chain.startswith("utf-8") and not control and len(word) < LEAST_WORD:
                        continue  # any letter is some other letter in another one-byte code
                    fixed = undo(word, chain)
                    if fixed is None or fixed in seen:
                        continue
                    seen.add(fixed)
                    many = sum(ord(c) > 127 for c in fixed) * chain.count(">") if chain.startswith("utf-8") else 0
                    out.append((word, chain, fixed, many, len(fixed) == 1))
            yield pd.DataFrame(out, columns=["word", "chain", "repaired", "sequences", "alone"])

    return words.mapInPandas(run, "word string, chain string, repaired string, sequences int, alone boolean")


def records(pages: DataFrame) -> DataFrame:
    """(field, page_id, site_id, words) of every value that isn't null, one a page and field."""
    rows = pages.select("page_id", "site_id", "loaded_at", *[words_of(F.col(f)).alias(f) for f in FIELDS])
    once = one_per_page(rows, ["site_id", *FIELDS])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("words")) for f in FIELDS]))
    return once.select("page_id", "site_id", each.alias("x")).select("x.field", "page_id", "site_id", "x.words").where("words IS NOT NULL")


def evidence(rows: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Edges (field, page_id, site_id, word) and word table (word, chain, df, df_repaired, bonus, repaired) of suspicious words.

    Word counts are aggregated before they are shuffled; only suspicious words' occurrences are kept. The words that
    many records share are taken out or looked up by broadcast before the join; there is a proven number of them.
    """
    spread = rows.select("field", "page_id", "site_id", F.explode("words").alias("word")).where("word != ''")
    counts = materialize(spread.groupBy("word").agg(F.count("*").alias("df")))
    # a repaired word may occur in any case
    natural = counts.groupBy(F.lower("word").alias("low")).agg(F.sum("df").alias("df_repaired"))
    ways = repairs(counts.select("word").repartition(F.col("word"))).withColumn("low", F.lower("repaired"))
    strip = r"^[\x21-\x2F:-@\[-`{-~]+|[\x21-\x2F:-@\[-`{-~]+$"
    ways = ways.withColumn("low", F.regexp_replace("low", strip, ""))
    ways = ways.join(natural, "low", "left").join(counts, "word")
    bonus = F.when(F.col("chain") == LOST, F.lit(MOST)).when(F.col("alone"), -1.0).otherwise(F.least(F.lit(MOST), F.col("sequences") * SEQUENCE))
    ways = ways.withColumn("bonus", bonus).withColumn("df_repaired", F.coalesce("df_repaired", F.lit(0)))
    first = F.when(F.col("chain") == LOST, 0.0).otherwise(F.log((F.col("df_repaired") + 0.5) / (F.col("df") + 0.5)))
    words = materialize(ways.where(first + F.col("bonus") > -0.5).select("word", "chain", "df", "df_repaired", "bonus", "repaired"))
    bad = words.select("word", "df").distinct()
    least = max(total * HOT, 1.0)
    hot = counts.where(F.col("df") >= least).select("word").join(F.broadcast(bad.where(F.col("df") >= least).select("word", F.lit(True).alias("bad"))), "word", "left")
    marked = spread.join(F.broadcast(hot.select("word", F.coalesce("bad", F.lit(False)).alias("bad"))), "word", "left")
    cold = marked.where("bad IS NULL").drop("bad").join(bad.where(F.col("df") < least).select("word"), "word", "left_semi")
    edges = marked.where("bad").drop("bad").unionByName(cold)
    return materialize(edges), words


def posteriors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(field, page_id, chain, posterior, garbled) for records with suspicious words; and the suspicious words' repairs.

    Each round: a record's score under a chain is the logarithm of the chain's share in its source and field plus its
    words' log-likelihood ratios; posteriors are normalised with the score of no chain; then the shares, and each word's
    number of occurrences outside garbled records, are estimated again.
    """
    total = rows.count()
    edges, words = evidence(rows, total)
    sizes = rows.groupBy("site_id", "field").agg(F.count("*").alias("n"))
    touched = edges.select("site_id", "field").distinct()
    sizes = materialize(sizes.join(touched.withColumnsRenamed({"site_id": "s", "field": "f"}), F.col("site_id").eqNullSafe(F.col("s")) & (F.col("field") == F.col("f")), "left_semi"))
    # pairs of a record and a word's chains; no pair of records ever meets
    pairs = materialize(edges.join(words, "word").select("field", "page_id", "site_id", "word", "chain", "df", "df_repaired", "bonus"))
    rest = pairs.select("word", F.col("df").cast("double").alias("natural")).distinct()
    shares = None
    scored = None
    for _ in range(ROUNDS):
        ratio = F.when(F.col("chain") == LOST, 0.0).otherwise(F.log((F.col("df_repaired") + 0.5) / (F.col("natural") + 0.5)))
        llr = F.least(F.lit(WORD), F.greatest(F.lit(-WORD), ratio + F.col("bonus")))
        score = pairs.join(rest, "word").groupBy("site_id", "field", "page_id", "chain").agg(F.sum(llr).alias("llr"))
        if shares is None:
            score = score.withColumn("share", F.lit(PRIOR_SHARE / 4)).withColumn("none", F.lit(1 - PRIOR_SHARE))
        else:
            keys = {"site_id": "s", "field": "f", "chain": "c"}
            score = score.join(shares.withColumnsRenamed(keys), F.col("site_id").eqNullSafe(F.col("s")) & (F.col("field") == F.col("f")) & (F.col("chain") == F.col("c")), "left").drop("s", "f", "c")
            score = score.withColumn("share", F.coalesce("share", F.lit(1e-4))).withColumn("none", F.coalesce("none", F.lit(1 - PRIOR_SHARE)))
        score = score.withColumn("odds", F.log(F.col("share") / F.col("none")) + F.col("llr"))
        # one row a record: its chains are few, those of its words' repairs
        record = score.groupBy("site_id", "field", "page_id").agg(F.collect_list(F.struct("odds", "chain")).alias("each"))
        top = F.greatest(F.lit(0.0), F.array_max(F.transform("each", lambda e: e["odds"])))
        record = record.withColumn("top", top).withColumn("each", F.transform("each", lambda e: F.struct(F.exp(e["odds"] - F.col("top")).alias("odds"), e["chain"].alias("chain"))))
        record = record.withColumn("none", F.exp(-F.col("top"))).withColumn("all", F.aggregate("each", F.lit(0.0), lambda a, e: a + e["odds"]))
        record = record.withColumns({"chain": F.array_max("each")["chain"], "best": F.array_max("each")["odds"]})
        record = record.withColumn("garbled", F.col("all") / (F.col("none") + F.col("all"))).drop("top")
        scored = materialize(record)
        by_chain = scored.select("site_id", "field", (F.col("all") + F.col("none")).alias("whole"), F.explode("each").alias("e")).groupBy("site_id", "field", "e.chain").agg(F.sum(F.col("e.odds") / F.col("whole")).alias("mass"))
        mass = scored.groupBy("site_id", "field").agg(F.sum("garbled").alias("garbled"))
        joined = by_chain.join(mass.withColumnsRenamed({"site_id": "s", "field": "f"}), F.col("site_id").eqNullSafe(F.col("s")) & (F.col("field") == F.col("f"))).drop("s", "f")
        joined = joined.join(sizes.withColumnsRenamed({"site_id": "s", "field": "f"}), F.col("site_id").eqNullSafe(F.col("s")) & (F.col("field") == F.col("f"))).drop("s", "f")
        shares = joined.select("site_id", "field", "chain", ((F.col("mass") + PRIOR_RECORDS * PRIOR_SHARE / 4) / (F.col("n") + PRIOR_RECORDS)).alias("share"), F.greatest(F.lit(0.05), (F.col("n") - F.col("garbled") + PRIOR_RECORDS * (1 - PRIOR_SHARE)) / (F.col("n") + PRIOR_RECORDS)).alias("none"))
        shares = materialize(shares)
        clean = edges.join(scored.select("field", "page_id", "garbled"), ["field", "page_id"])
        rest = materialize(clean.groupBy("word").agg(F.sum(1 - F.col("garbled")).alias("natural")))
    final = scored.select("field", "page_id", "chain", (F.col("best") / (F.col("none") + F.col("all"))).alias("posterior"), "garbled")
    return final, words


def garbled(pages: DataFrame, least: float = 0.5) -> DataFrame:
    """(field, page_id, chain, garbled) of the values with a wrongly decoded passage, whether or not it can be restored.

    Null and empty values aren't garbled. Values that use rare letters rightly, or that quote garbled sequences, keep
    a low posterior: their words occur as often outside garbled records. A page_id delivered twice counts once.
    """
    final, _ = posteriors(materialize(records(pages)))
    return final.where(F.col("garbled") >= least)


def restored(pages: DataFrame, least: float = 0.5) -> DataFrame:
    """(field, page_id, chain, posterior, value, repaired) of the garbled values; words that no chain restores stay."""
    rows = materialize(records(pages))
    final, words = posteriors(rows)
    cases = materialize(final.where(F.col("garbled") >= least))
    values = one_per_page(pages.select("page_id", "loaded_at", *FIELDS), list(FIELDS))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS]))
    values = values.join(cases.select("page_id").distinct(), "page_id", "left_semi").select("page_id", each.alias("x")).select("page_id", "x.*")
    values = values.join(cases, ["field", "page_id"])
    own = rows.join(cases.select("field", "page_id", "chain"), ["field", "page_id"]).select("field", "page_id", "chain", F.explode("words").alias("word"))
    # for each word the repair that occurs most often elsewhere, of equal ones that of the record's chain
    fixes = own.join(words.where("repaired IS NOT NULL").withColumnRenamed("chain", "way"), "word")
    fixes = fixes.where("df_repaired > 0 OR way = chain OR way LIKE 'utf-8%'").groupBy("field", "page_id", "word").agg(F.max_by("repaired", F.struct("df_repaired", F.col("way") == F.col("chain"))).alias("repaired"))
    maps = fixes.groupBy("field", "page_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "repaired"))).alias("fixes"))
    both = values.join(maps, ["field", "page_id"], "left")
    strip = r"^([\x21-\x2F:-@\[-`{-~]*)(.*?)([\x21-\x2F:-@\[-`{-~]*)$"
    core = lambda w: F.regexp_extract(w, "(?s)" + strip, 2)
    fix = lambda w: F.when(w.rlike(r"[^\x00-\x7F]") & F.try_element_at("fixes", core(w)).isNotNull(), F.concat(F.regexp_extract(w, "(?s)" + strip, 1), F.try_element_at("fixes", core(w)), F.regexp_extract(w, "(?s)" + strip, 3))).otherwise(w)
    pieces = F.regexp_extract_all("value", F.lit(r"[ \n\t\r]+|[^ \n\t\r]+"), F.lit(0))
    repaired = F.when(F.col("fixes").isNull(), F.col("value")).otherwise(F.array_join(F.transform(pieces, fix), ""))
    return both.select("field", "page_id", "chain", "posterior", "value", repaired.alias("repaired"))
