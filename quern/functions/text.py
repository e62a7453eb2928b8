"""Text columns: classes of characters, trimming, folding of widths, visible length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: three ranges that differ on purpose
HAN = r"[\x{4E00}-\x{9FFF}]"
HAN_EXTENDED = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"
HAN_WIDE = r"[\x{3400}-\x{9FFF}]"
#: Units that a strategy may touch.
UNIT = {"han": HAN_EXTENDED, "letter": r"\p{L}"}


def strip(text: Column) -> Column:
    """Without white space at both ends, by Unicode's notion of it."""
    return F.regexp_replace(text, r"(?U)^[\s\x{1C}-\x{1F}]+|[\s\x{1C}-\x{1F}]+$", "")


def fold_width(text: Column) -> Column:
    """Full-width ASCII and the ideographic space as their plain forms."""
    wide = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
    return F.translate(text, wide, "".join(chr(0x21 + i) for i in range(94)) + " ")


def visible_length(text: Column) -> Column:
    """Characters that are neither separators nor controls."""
    return F.length(F.regexp_replace(text, r"[\p{C}\p{Z}]", ""))


def has_two_visible(text: Column) -> Column:
    """Whether the visible length is 2 at least; without going through the whole text."""
    return text.rlike(r"[^\p{C}\p{Z}][\p{C}\p{Z}]*[^\p{C}\p{Z}]")


def has_han(text: Column) -> Column:
    return text.rlike(HAN)


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)[^\s\x{1C}-\x{1F}]")


def has_line_separator(value: Column) -> Column:
    """Whether any string of the value (of any nesting) holds U+2028 or U+2029."""
    return F.to_json(value).rlike(r"[\x{2028}\x{2029}]")


def show_secret(value: Column) -> Column:
    """The first and last four characters; shorter secrets are hidden whole."""
    return F.when(F.length(value) <= 8, "****").otherwise(F.concat(F.left(value, F.lit(4)), F.lit("..."), F.right(value, F.lit(4))))
