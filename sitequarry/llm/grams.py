"""Character models whose n-grams are counted over whole tables: counts by task, sums and log ratios by joins."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.characters import ALPHABET, BASE, LEAST_LOG, MOST_LOG, ORDER, TABLE_BITS, _hash, codes_of
from sitequarry.sources.tables import materialize

#: Fixed value: a code that is no character, for the places of a window before its line's opening break.
PAD = 0x10FFFF
#: Rows of windows: the model that they belong to, the last ORDER characters, their hash and how often they occur.
WINDOWS = "model int, gram string, hash long, n long"
#: Windows that a task keeps before it merges equal ones, and before it hands them on; characters that it counts at once.
MERGE, FLUSH, STEP_CHARS = 1 << 20, 1 << 19, 1_000_000


def windows(lines: list[str], weights: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, times, codes) of the distinct windows: of each character, and of the closing break, with what stands before it in its line."""
    codes, lengths = codes_of([""] + lines)
    place = np.arange(len(codes))
    opened = np.maximum.accumulate(np.where(codes == 10, place, 0))
    start, end = opened[:-1], place[1:]  # a window never reaches beyond the break before its last character
    columns = []
    for j in range(ORDER):
        at = end - (ORDER - 1 - j)
        columns.append(np.where(at >= start, codes[np.maximum(at, 0)], np.uint64(PAD)))
    key, first, where = distinct(_hash(columns))
    times = np.bincount(where, np.repeat(np.array(weights, np.int64), lengths[1:]), len(key)).astype(np.int64)
    return key, times, np.stack([c[first] for c in columns], 1).astype(np.uint32)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order of appearance, the place of the first of each, and the number of each value's: by hashing, not by sorting."""
    coded = pa.array(values).dictionary_encode()
    where = coded.indices.to_numpy()
    first = np.zeros(len(coded.dictionary), np.int64)
    first[where[::-1]] = np.arange(len(values) - 1, -1, -1)
    return coded.dictionary.to_numpy(), first, where


class WindowCounts:
    """Windows of all lines that a task has seen, by model."""

    def __init__(self, sign: int = 1) -> None:
        self.sign, self.parts, self.rows = sign, {}, 0

    def add(self, model: int, lines: list[str], weights: list[int]) -> None:
        if lines:
            part = windows(lines, weights)
            self.parts.setdefault(model, []).append(part)
            self.rows += len(part[0])

    def take(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """What has been counted, when it is much, or at last."""
        if not self.rows or not last and self.rows < MERGE:
            return
        for model, parts in self.parts.items():
            key, first, where = distinct(np.concatenate([p[0] for p in parts]))
            times = np.bincount(where, np.concatenate([p[1] for p in parts]), len(key)).astype(np.int64)
            self.parts[model] = [(key, times, np.concatenate([p[2] for p in parts])[first])]
        self.rows = sum(len(p[0][0]) for p in self.parts.values())
        if last or self.rows > FLUSH:
            for model, [(key, times, codes)] in self.parts.items():
                for at in range(0, len(key), 100_000):
                    yield window_rows(model, key[at : at + 100_000], times[at : at + 100_000] * self.sign, codes[at : at + 100_000])
            self.parts, self.rows = {}, 0


def window_rows(model: int, key: np.ndarray, times: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
    text = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    grams = [text[k : k + ORDER] for k in range(0, len(text), ORDER)]
    columns = [pa.array(np.full(len(key), model, np.int32)), pa.array(grams, pa.string()), pa.array(key.view(np.int64)), pa.array(times)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in WINDOWS.split(", ")])


def steps(texts: Iterator[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Distinct lines with their numbers, by steps of bounded size."""
    lines, chars = Counter(), 0
    for x in texts:
        if x not in lines:
            chars += len(x)
        lines[x] += 1
        if chars >= STEP_CHARS:
            yield list(lines), list(lines.values())
            lines, chars = Counter(), 0
    if lines:
        yield list(lines), list(lines.values())


def slot(key: Column) -> Column:
    """Table slot of a window's hash."""
    return F.shiftrightunsigned(key, 64 - TABLE_BITS).cast("int")


def whole(gram: Column, k: int) -> Column:
    """Whether the last ``k`` characters of a window are a k-gram of one line."""
    inside = ~gram.contains(chr(PAD))
    return inside & ~(gram.startswith("\n") & gram.endswith("\n")) if k > 1 else inside


def log_ratios(rows: DataFrame, positive: list[int], negative: int) -> np.ndarray:
    """:func:`ratio_table` of models that are given by rows of windows, with ``negative`` discounted by 1 as there.

    Counts of all orders come from the sums of the windows, exact whatever their number. Only one n-gram a slot, the first
    by model and hash, is judged, so that at most 2^TABLE_BITS rows with one number each come to the driver.
    """
    total = materialize(rows.groupBy("model", "gram", "hash").agg(F.sum("n").alias("n")).where("n > 0"))
    discount = F.when(F.col("model") == negative, 1).otherwise(0)
    top = total.where(whole(F.col("gram"), ORDER)).where(F.col("n") > discount)
    judged = materialize(top.groupBy(slot(F.col("hash")).alias("slot")).agg(F.min_by("gram", F.struct("model", "hash")).alias("gram")))
    models = [*positive, negative]
    p: dict[int, Column] = {}
    for k in range(1, ORDER + 1):
        gram = F.substring("gram", ORDER + 1 - k, k)
        # a collection opens with a break
        opening = F.when(F.col("g") == "\n", 1).otherwise(0) if k == 1 else F.lit(0)
        counts = total.select("model", gram.alias("g"), "n").where(whole(F.col("g"), k)).groupBy("model", "g").agg(F.sum("n").alias("n"))
        counts = counts.withColumn("n", F.col("n") + opening - discount).where("n > 0")
        groups = {0: F.lit(True)} if k <= BASE else {m: F.col("model") == m for m in models}
        seen = counts.groupBy("g").agg(*[F.sum(F.when(c, F.col("n"))).alias(f"seen{m}") for m, c in groups.items()])
        before = counts.groupBy(F.substring("g", 1, k - 1).alias("before")).agg(
            *[F.sum(F.when(c, F.col("n"))).alias(f"total{m}") for m, c in groups.items()], *[F.count(F.when(c, 1)).alias(f"kinds{m}") for m, c in groups.items()]
        )
        judged = judged.withColumn("g", gram).join(seen, "g", "left").withColumn("before", F.substring("g", 1, k - 1))
        judged = judged.join(F.broadcast(before) if k == 1 else before, "before", "left").drop("g", "before")  # one row at order 1
        say = {}
        for m in groups:
            base = F.lit(1.0 / ALPHABET) if k == 1 else F.col("p0") if k <= BASE + 1 else F.col(f"p{m}")
            n, whole_n, kinds = (F.coalesce(F.col(f"{c}{m}"), F.lit(0)) for c in ("seen", "total", "kinds"))
            say[f"q{m}"] = F.when(whole_n > 0, (n + kinds * base) / (whole_n + kinds)).otherwise(base)
        judged = judged.withColumns(say)
        judged = judged.select("slot", "gram", *[F.col(f"q{m}").alias(f"p{m}") for m in groups])
    best = F.greatest(*[F.col(f"p{m}") for m in positive])
    found = judged.select("slot", F.log(best / F.col(f"p{negative}")).alias("ratio")).toArrow()
    table = np.zeros(1 << TABLE_BITS, np.float16)
    table[found["slot"].to_numpy()] = np.clip(found["ratio"].to_numpy(), LEAST_LOG, MOST_LOG)
    return table
