"""A local name for an expensive expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body (or a lambda in it) uses it.

    A column defined in an earlier select doesn't do: the optimiser merges both selects and puts the whole
    expression wherever it is used, inside of lambdas too.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
