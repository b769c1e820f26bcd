"""Row selection shared by the operators of this subpackage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.operators.skew import newest_rows


def one_per_page(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row a page_id: the delivery with the latest ``loaded_at`` (ties: greatest values). Null page_ids are left out.

    Only rows of pages that were delivered more than once are shuffled with their values.
    """
    rank = F.coalesce("loaded_at", F.timestamp_micros(F.lit(-(2**55))))
    return newest_rows(rows.select("page_id", "loaded_at", *columns), "page_id", F.struct(rank, F.xxhash64(*columns))).drop("loaded_at")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
