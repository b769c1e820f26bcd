"""Text column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of ECMAScript, as a character class body.
JS_SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def js_trim(text: Column) -> Column:
    """Removes ECMAScript white space at both ends (NBSP and BOM included)."""
    return F.regexp_replace(text, f"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")


def normalize_whitespace(text: Column) -> Column:
    """Runs of ECMAScript white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"[{JS_SPACE}]+", " "))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def word_count(text: Column) -> Column:
    """Words of the normalised text; 0 when it is empty or null."""
    normal = normalize_whitespace(text)
    return F.when(F.coalesce(F.length(normal), F.lit(0)) == 0, 0).otherwise(F.size(F.split(normal, " ")))


def first_sentences(text: Column, most: int = 180) -> Column:
    """The text when short enough, else its leading sentences and an ellipsis.

    The text is normalised; when it has more than ``most`` UTF-16 units it is cut there, then at the
    last full stop or question mark followed by a space if that lies past unit 60.
    """
    normal = normalize_whitespace(text)
    # substring on UTF-16 units: code points below U+10000 are one unit each, so only texts with
    # surrogate pairs in the first part need the encoded form.
    wide = F.decode(F.substring(F.encode(normal, "UTF-16BE"), 1, 2 * most), "UTF-16BE")
    cut = F.when(F.substring(normal, 1, most).rlike(r"[\x{10000}-\x{10FFFF}]"), wide).otherwise(F.substring(normal, 1, most))
    back = F.reverse(cut)
    spot = lambda mark: F.when(F.instr(back, mark) > 0, F.length(cut) - F.instr(back, mark) - 1).otherwise(-1)
    last = F.greatest(spot(" ."), spot(" ?"))
    kept = F.when(last > 60, F.substring(cut, F.lit(1), last)).otherwise(cut)
    return F.when(utf16_length(normal) <= most, normal).otherwise(F.concat(F.trim(kept), F.lit("…")))


def hash_content(*parts: Column) -> Column:
    """First 16 hex digits of SHA-256 over the parts joined by NUL; null parts count as empty."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 16)


def line_key(line: Column) -> Column:
    """Lower case; digits 0-9 and all that is neither letter nor number become spaces; runs count as one; trimmed."""
    return F.trim(F.regexp_replace(F.lower(line), r"[0-9[^\p{L}\p{N}]]+", " "))
