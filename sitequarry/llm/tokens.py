"""Document sizes in tokens of the public WordPunct tokenizer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wordpunct_count(text: Column) -> Column:
    """Maximal runs of letters, digits and underscores, or of other non-space characters."""
    return F.regexp_count(text, F.lit(r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"))


def document_tokens(n_tokens: Column, text: Column) -> Column:
    """``n_tokens`` where given, else counted; 0 where the text is null too."""
    return F.coalesce(n_tokens.cast("long"), wordpunct_count(text).cast("long"), F.lit(0).cast("long"))
