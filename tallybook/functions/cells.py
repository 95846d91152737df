"""From a typed column or a sheet cell to text.

Every function takes the column and its Spark type, because what a value looks
like as text depends on the type it had (10002.0 is ``10002``; the text
"10002.0" stays as it is). Sheet cells carry their type in ``kind``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import blank_to_null, strip_ws


def is_cell(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StructType) and {"kind", "text"} <= set(dtype.names)


def _is_int(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_exact_number(dtype: T.DataType) -> bool:
    return _is_int(dtype) or isinstance(dtype, T.DecimalType)


def _is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def _is_moment(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType))


def float_text(c: Column) -> Column:
    """Shortest text of a double; whole numbers lose the ``.0``."""
    x = c.cast("double")
    shown = x.cast("string")
    size = F.abs(x)
    plain = F.regexp_replace(shown.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    small = F.regexp_replace(shown.try_cast("decimal(38,30)").cast("string"), r"0+$", "")
    mantissa = F.regexp_replace(F.substring_index(shown, "E", 1), r"\.0$", "")
    exponent = F.substring_index(shown, "E-", -1)
    return (
        F.when(F.isnan(x), "nan")
        .when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
        .when((x == F.floor(x)) & (size < 9.2e18), x.try_cast("bigint").cast("string"))
        .when(size >= 9.2e18, F.coalesce(shown.try_cast("decimal(38,0)").cast("string"), shown))
        .when(size >= 1e7, plain)
        .when(size >= 1e-3, shown)
        .when(size >= 1e-4, small)
        .otherwise(F.concat(mantissa, F.lit("e-"), F.lpad(exponent, 2, "0")))
    )


def decimal_text(c: Column, dtype: T.DecimalType) -> Column:
    s = c.cast("string")
    return F.regexp_replace(s, r"\.?0+$", "") if dtype.scale > 0 else s


def plain_text(c: Column, dtype: T.DataType) -> Column:
    """The value's own text, not trimmed; NULL for a missing value."""
    if is_cell(dtype):
        return F.when(c["kind"] != "null", c["text"])
    if isinstance(dtype, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if _is_float(dtype):
        return float_text(c)
    if isinstance(dtype, T.DecimalType):
        return decimal_text(c, dtype)
    if _is_moment(dtype):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return c.cast("string")


def value_text(c: Column, dtype: T.DataType) -> Column:
    """As ``plain_text``, but booleans count as missing (ids and amounts)."""
    if isinstance(dtype, T.BooleanType):
        return F.lit(None).cast("string")
    if is_cell(dtype):
        return F.when(~c["kind"].isin("null", "b"), c["text"])
    return plain_text(c, dtype)


def cell_text(c: Column, dtype: T.DataType = T.StringType()) -> Column:
    """Display text: '' for missing, dates without a midnight, minutes otherwise."""
    if is_cell(dtype):
        moment = F.when(c["text"].rlike(r" 00:00:00$"), F.substring(c["text"], 1, 10)).otherwise(
            F.substring(c["text"], 1, 16))
        shown = F.when(c["kind"] == "dt", moment).when(c["kind"] != "null", strip_ws(c["text"]))
        return F.coalesce(shown, F.lit(""))
    if _is_moment(dtype):
        day = F.date_format(c, "yyyy-MM-dd")
        at_midnight = c == F.date_trunc("day", c).cast(dtype)
        return F.coalesce(F.when(at_midnight, day)
                          .otherwise(F.date_format(c, "yyyy-MM-dd HH:mm")), F.lit(""))
    if isinstance(dtype, T.StringType):
        return F.coalesce(strip_ws(plain_text(c, dtype)), F.lit(""))
    return F.coalesce(plain_text(c, dtype), F.lit(""))


def order_text(c: Column, dtype: T.DataType = T.StringType()) -> Column:
    """Order number as compared: display text, NULL when blank."""
    return blank_to_null(cell_text(c, dtype))
