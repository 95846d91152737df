"""Exact money: text or number to DECIMAL, and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import PARSED
from .cells import value_text
from .text import WS_CHARS, nfkc

# Characters to ignore in an amount. The words that mean "no
# amount" (nan, none, null, -, —) need no list: none of them casts to a number.
IGNORED_CHARS = "¥￥$€,，_"


def _to_decimal(s: Column) -> Column:
    """Cast plain number text to DECIMAL(38,18) without a rounding surprise.

    The cast rounds at the 18th fractional digit. A longer fraction is cut to
    17 digits plus one sticky digit that only says whether the tail was zero,
    so a later half-up or half-even decision sees the right side of the tie.
    """
    return F.regexp_replace(s, r"(\.\d{17})(?:0*([1-9])\d*|0+)$", "$1$2").try_cast(PARSED)


def parse_amount(c: Column, dtype: T.DataType = T.StringType()) -> Column:
    """Amount as DECIMAL(38,18); NULL when missing, unreadable or too large."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)):
        return c.try_cast(PARSED)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return _to_decimal(c.cast("double").cast("string"))
    return _to_decimal(
        F.translate(nfkc(value_text(c, dtype)), IGNORED_CHARS + WS_CHARS, ""))


def round_amount(c: Column, places: int = 2, mode: str = "half_up") -> Column:
    """Round a decimal; half away from zero unless ``mode`` is ``half_even``."""
    rounded = F.bround(c, places) if mode == "half_even" else F.round(c, places)
    return rounded.cast(T.DecimalType(38, places))
