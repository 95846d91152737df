"""Payee ids and ledger status words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..rules import Rules, regex_any
from .cells import is_exact_number, plain_text, value_text
from .text import blank_to_null, fold, nfkc, squash_ws, strip_ws

# Texts that mean "no id", and separators dropped from its
# front (as a character class).
NULL_WORDS = ("nan", "none", "null")
LEADING_SEPARATORS = ":：\\-—_ "

# Status word to ledger status.
STATUS_WORDS = {
    "已结算": "settled", "settled": "settled", "完成": "settled", "已付": "settled",
    "待定": "pending", "pending": "pending", "未结算": "pending",
    "报价": "quote", "quote": "quote",
}


def normalize_uid(c: Column, dtype: T.DataType = T.StringType(), rules: Rules = Rules()) -> Column:
    """Canonical payee id, NULL when there is none.

    The null words are tested before NFKC, so a full-width spelling of them is
    an id like any other. Each step names its input once: an expression that
    repeats its child grows exponentially when such steps are nested.
    """
    text = value_text(c, dtype)
    if is_exact_number(dtype):  # plain digits: nothing to fold
        folded = text
    else:
        present = F.regexp_replace(strip_ws(text), rf"(?i)\A(?:{'|'.join(NULL_WORDS)})\z", "")
        folded = F.upper(squash_ws(nfkc(present)))
    prefix = f"(?:{regex_any(rules.prefixes_upper)})?" if rules.prefixes_upper else ""
    uid = blank_to_null(F.regexp_replace(folded, rf"\A{prefix}[{LEADING_SEPARATORS}]*", ""))
    if rules.uid_full_match:
        uid = F.regexp_extract(uid, rules.uid_full_match, 0)
        uid = blank_to_null(uid)
    return uid


def normalize_status(c: Column, dtype: T.DataType = T.StringType(), default: str = "settled") -> Column:
    """Ledger status of a status word; anything unknown gives ``default``."""
    words = F.create_map(*[F.lit(x) for pair in STATUS_WORDS.items() for x in pair])
    return F.coalesce(F.try_element_at(words, fold(plain_text(c, dtype))), F.lit(default))


def first_keyword(text: Column, keywords: list[str]) -> Column:
    """First keyword (in list order) that occurs in ``text``, else NULL."""
    return F.coalesce(*[F.when(text.contains(k), F.lit(k)) for k in keywords],
                      F.lit(None).cast("string"))
