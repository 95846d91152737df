"""Text building blocks: Unicode whitespace, NFKC, sets of null words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point that counts as whitespace (Unicode
# White_Space plus the four information separators). Spark's trim() knows only
# U+0020 and Java's \s only ASCII.
WS_RANGES = ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
             (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
             (0x3000, 0x3000))
WS_CHARS = "".join(chr(c) for lo, hi in WS_RANGES for c in range(lo, hi + 1))


def strip_ws(c: Column) -> Column:
    """Drop whitespace at both ends."""
    return F.trim(c, F.lit(WS_CHARS))


def squash_ws(c: Column) -> Column:
    """Drop whitespace everywhere."""
    return F.translate(c, WS_CHARS, "")


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition, by the ICU library Spark ships.

    ``try_reflect`` keeps the work in the JVM. Catalyst takes it for
    non-deterministic, so callers project the result before aggregating or
    joining on it.
    """
    return F.try_reflect(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))


def fold(c: Column) -> Column:
    """NFKC, trimmed, lower case: how headers and status words are compared."""
    return F.lower(strip_ws(nfkc(c)))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip_ws(c) == "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))
