"""Filling fixed-capacity containers with documents: bin completion by branch and bound, block by block."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.tokens import document_tokens
from sitequarry.sources.tables import materialize

#: Pieces a block, on average: a block is packed by one task call, whatever the size of the collection.
BLOCK = 8192
#: Kinds of containers packed at once, at most.
MOST_KINDS = 1000
#: Search nodes a block beyond the first descent, and fillings tried at a node: the budget of the search. What it leaves open is
#: reported as the gap to the lower bound.
EXTRA_NODES, BRANCHES = 400, 3
#: Up to so many different sizes every one of them begins a triple, of more those at eight places.
EVERY_SIZE = 48


def pieces(documents: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, capacity, doc_id, piece_no, tokens): one piece a document, more only if it exceeds the capacity.

    A document over the capacity becomes full pieces and the remainder. Kinds without a positive capacity and
    documents without tokens are left out. containers is a table of kinds, not of containers: its rows are few and
    each document meets each kind by definition.
    """
    sizes = documents.select("doc_id", document_tokens(F.col("n_tokens"), F.col("text")).alias("size")).where("size > 0 AND doc_id IS NOT NULL")
    kinds = [(r[0], int(r[1])) for r in containers.where("capacity_tokens > 0").select("container_kind", "capacity_tokens").distinct().limit(MOST_KINDS + 1).collect()]
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers: pack them in parts")
    if not kinds:
        return sizes.where("false").select(F.lit("").alias("container_kind"), F.lit(0).alias("capacity"), "doc_id", F.lit(0).alias("piece_no"), F.col("size").alias("tokens"))
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).alias("capacity")) for k, c in kinds]))
    rows = sizes.select("doc_id", "size", every.alias("kind")).select("doc_id", "size", "kind.*")
    number = F.ceil(F.col("size") / F.col("capacity")).cast("int")
    rows = rows.withColumn("piece_no", F.explode(F.sequence(F.lit(1), number)))
    tokens = F.least(F.col("capacity").cast("long"), F.col("size") - (F.col("piece_no") - 1) * F.col("capacity").cast("long"))
    return rows.select("container_kind", "capacity", "doc_id", "piece_no", tokens.alias("tokens"))


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of sizes."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []
    for size in sorted(sizes, reverse=True):
        at = bisect_left(free, (size, -1))
        if at == len(free):
            bins.append([size])
            room, k = capacity - size, len(bins) - 1
        else:
            room, k = free.pop(at)
            bins[k].append(size)
            room -= size
        if room:
            insort(free, (room, k))
    return bins


def least_bins(sizes: list[int], capacity: int) -> int:
    """Martello and Toth's bound L2: no packing has fewer containers.

    For each threshold k up to half the capacity, pieces above capacity - k stand alone, pieces above half stand apart,
    and what pieces from k to half are too much for the room left beside the latter needs further containers.
    """
    falling = sorted(sizes, reverse=True)
    rising = [-x for x in falling]
    before = [0, *accumulate(falling)]
    half = bisect_left(rising, -(capacity / 2))
    best = -(-before[-1] // capacity)
    for k in {x for x in falling[half:]} | {0}:
        alone, small = bisect_left(rising, k - capacity), bisect_right(rising, -k)
        room = (half - alone) * capacity - (before[half] - before[alone])
        best = max(best, half + max(0, -(-(before[small] - before[half] - room) // capacity)))
    return best


class _Stock:
    """Multiset of the sizes not yet placed."""

    def __init__(self, sizes: list[int]) -> None:
        self.count: dict[int, int] = {}
        for s in sizes:
            self.count[s] = self.count.get(s, 0) + 1
        self.keys = sorted(self.count)
        self.total = sum(sizes)

    def take(self, size: int) -> None:
        left = self.count[size] - 1
        self.total -= size
        if left:
            self.count[size] = left
        else:
            del self.count[size]
            self.keys.pop(bisect_left(self.keys, size))

    def give(self, size: int) -> None:
        self.total += size
        if size in self.count:
            self.count[size] += 1
        else:
            self.count[size] = 1
            insort(self.keys, size)

    def floor(self, size: int) -> int:
        """Greatest size in stock up to ``size``; 0 if none."""
        at = bisect_right(self.keys, size)
        return self.keys[at - 1] if at else 0


def _pairs(stock: _Stock, room: int, most: int) -> list[tuple[int, int]]:
    """Pairs that fill ``room`` best: two pointers over the sizes, sums falling; no more than ``most``."""
    keys, found = stock.keys, []
    low, high = 0, bisect_right(keys, room) - 1
    best = 0
    while low <= high:
        a, b = keys[low], keys[high]
        if a + b > room or (low == high and stock.count[a] < 2):
            high -= 1
            continue
        if a + b > best or len(found) < most:
            found.append((b, a))
            best = max(best, a + b)
            if a + b == room and len(found) >= most:
                break
        low += 1
    found.sort(key=lambda p: (-(p[0] + p[1]), -p[0]))
    return found[:most]


def fillings(stock: _Stock, room: int, most: int) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` from the stock, fullest first, at most ``most``.

    A single document dominates every set whose total it reaches, and a set dominates one that it covers size by
    size. While three documents of the greatest fitting size leave room, that size is taken outright; the rest is
    closed by the best single, pair or triple.
    """
    base: list[int] = []
    while True:
        top = stock.floor(room)
        if not top or room < 4 * top:
            break
        base.append(top)
        stock.take(top)
        room -= top
    options: list[tuple[int, ...]] = []
    one = stock.floor(room)
    if one:
        options.append((one,))
        if one < room:
            options += [p for p in _pairs(stock, room, most) if sum(p) > one]
            if all(sum(o) < room for o in options):
                # the greatest of a triple has at least a third of the room it fills
                firsts = stock.keys[bisect_left(stock.keys, room // 3) : bisect_left(stock.keys, room)]
                if len(firsts) > EVERY_SIZE:
                    firsts = firsts[:: -(len(firsts) // 8)] + [one]
                for first in firsts:
                    if first < room:
                        stock.take(first)
                        options += [(first, *p) for p in _pairs(stock, room - first, 1)]
                        stock.give(first)
    for s in base:
        stock.give(s)
    options.sort(key=lambda o: (-sum(o), len(o)))
    kept: list[tuple[int, ...]] = []
    for o in options:
        s = tuple(sorted(o, reverse=True))
        if not any(len(k) <= len(s) and all(a >= b for a, b in zip(k + (0,) * len(s), s, strict=False)) or (len(k) == 1 and k[0] >= sum(s)) for k in kept):
            kept.append(s)
        if len(kept) == most:
            break
    return [(*base, *k) for k in kept] or [tuple(base)]


def complete_bins(sizes: list[int], capacity: int, extra_nodes: int = EXTRA_NODES, branches: int = BRANCHES) -> list[list[int]]:
    """Bins by bin completion: each holds the largest size left and a filling; branch and bound on the waste.

    Best-fit decreasing gives the first incumbent. A node is pruned when the bins so far and the least number
    that the sizes left need reach the incumbent's. The search ends at the bound :func:`least_bins` or after
    ``extra_nodes`` nodes beyond the first descent.
    """
    incumbent = best_fit(sizes, capacity)
    least = least_bins(sizes, capacity)
    if len(incumbent) <= least:
        return incumbent
    stock, chosen, stack = _Stock(sizes), [], []
    left = len(incumbent) + extra_nodes

    def open_node() -> None:
        top = stock.keys[-1]
        stock.take(top)
        stack.append((top, iter(fillings(stock, capacity - top, branches) if top < capacity else [()])))
        stock.give(top)

    open_node()
    while stack and left > 0:
        top, options = stack[-1]
        if len(chosen) == len(stack):  # come back from below: undo this node's filling
            for s in chosen.pop():
                stock.give(s)
        option = next(options, None)
        if option is None or len(stack) + -(-max(0, stock.total - top - sum(option)) // capacity) >= len(incumbent):
            stack.pop()
            continue
        left -= 1
        for s in (top, *option):
            stock.take(s)
        chosen.append([top, *option])
        if not stock.keys:
            incumbent = [list(b) for b in chosen]
            if len(incumbent) <= least:
                break
        else:
            open_node()
    return incumbent


def pack_block(frame: pd.DataFrame) -> pd.DataFrame:
    """Containers of one block of one kind."""
    capacity = int(frame["capacity"].iloc[0])
    frame = frame.sort_values(["tokens", "doc_id", "piece_no"]).reset_index(drop=True)
    sizes = frame["tokens"].tolist()
    waiting: dict[int, list[int]] = {}
    for at, size in enumerate(sizes):
        waiting.setdefault(size, []).append(at)
    number, place, fill = [0] * len(sizes), [0] * len(sizes), [0] * len(sizes)
    bins = complete_bins(sizes, capacity)
    least = least_bins(sizes, capacity)
    for k, content in enumerate(bins, 1):
        total = sum(content)
        for j, size in enumerate(content, 1):
            at = waiting[size].pop()
            number[at], place[at], fill[at] = k, j, total
    return frame.assign(container_no=number, place=place, fill=fill, least=least)[["container_kind", "capacity", "block", "container_no", "place", "doc_id", "piece_no", "tokens", "fill", "least"]]


def pack(documents: DataFrame, containers: DataFrame, block: int = BLOCK) -> DataFrame:
    """(container_kind, capacity, block, container_no, place, doc_id, piece_no, tokens, fill, least): where each piece goes.

    A container is named by kind, block and container_no; ``fill`` is its total and ``least`` the fewest containers its
    block can do with. Pieces as large as the capacity
    are containers of their own (block -1) and never leave the JVM. The others are cut into blocks by a hash of
    doc_id, so that each task call packs about ``block`` of them; each block leaves at most one container badly filled.
    """
    rows = materialize(pieces(documents, containers))
    full = rows.where("tokens = capacity").select(
        "container_kind", "capacity", F.lit(-1).cast("long").alias("block"), F.xxhash64("doc_id", "piece_no").alias("container_no"), F.lit(1).cast("long").alias("place"),
        "doc_id", "piece_no", "tokens", F.col("tokens").alias("fill"), F.lit(1).cast("long").alias("least"),
    )
    rest = rows.where("tokens < capacity")
    most = rest.groupBy("container_kind").count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-most // block))
    cut = rest.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("long"))
    packed = cut.groupBy("container_kind", "block").applyInPandas(pack_block, "container_kind string, capacity int, block long, container_no long, place long, doc_id long, piece_no int, tokens long, fill long, least long")
    return packed.unionByName(full)
