"""Ids, status words, amounts, rounding and display text."""

import datetime as dt
import unicodedata
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook import Rules
from tallybook.functions.cells import cell_text, order_text
from tallybook.functions.ids import first_keyword, normalize_status, normalize_uid
from tallybook.functions.money import parse_amount, round_amount
from tallybook.functions.text import WS_CHARS, nfkc, squash_ws, strip_ws
from tallybook.schemas import CELL


def run(spark, values, dtype, build):
    """``build(column, dtype)`` over a column of ``values``, in order."""
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", dtype)])
    df = spark.createDataFrame(list(enumerate(values)), schema)
    rows = df.select("i", build(F.col("v"), dtype).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


UIDS = [
    ("10001", "10001"), ("  10001 \t", "10001"), ("10 00 1", "10001"), ("Ｕ10086", "U10086"),
    ("１００８６", "10086"), ("UID:10006", "10006"), ("uid:10006", "10006"), ("uid：－10006", "10006"),
    ("用户10007", "10007"), ("账号UID9", "UID9"), ("abc123", "ABC123"), ("10002.0", "10002.0"),
    ("-5", "5"), ("ｎａｎ", "NAN"), ("a b　c d", "ABCD"), ("ﬁx", "FIX"), ("ß", "SS"),
    (None, None), ("", None), ("   ", None), ("nan", None), ("None", None), (" null ", None),
    ("UID", None), ("—_-", None), ("nan1", "NAN1"), ("\tnull\n", None),
]


def test_uid_text(spark):
    got = run(spark, [u for u, _ in UIDS], T.StringType(), lambda c, t: normalize_uid(c, t))
    assert got == [w for _, w in UIDS]


def test_uid_prefix_order(spark):
    rules = Rules(uid_prefixes=["UID", "UID:X"])
    assert run(spark, ["UID:X1"], T.StringType(), lambda c, t: normalize_uid(c, t, rules)) == ["X1"]
    rules = Rules(uid_prefixes=["a.c", "", " b "])
    assert run(spark, ["A.C7", "ABC7", "b7"], T.StringType(),
               lambda c, t: normalize_uid(c, t, rules)) == ["7", "ABC7", "7"]
    assert run(spark, ["UID:1"], T.StringType(),
               lambda c, t: normalize_uid(c, t, Rules(uid_prefixes=[]))) == ["UID:1"]


def test_uid_regex_is_a_full_match(spark):
    rules = Rules(uid_regex=r"\d+|X")
    assert run(spark, ["10001", "A1", "1A", "X", "1\n"], T.StringType(),
               lambda c, t: normalize_uid(c, t, rules)) == ["10001", None, None, "X", "1"]


def test_uid_numbers(spark):
    uid = lambda c, t: normalize_uid(c, t)
    floats = [10002.0, 1.5, 12345678.25, 0.00012, 1.2e-05, 1e22, -3.0, float("nan"), None,
              0.1 + 0.2, 9007199254740992.0]
    assert run(spark, floats, T.DoubleType(), uid) == [
        "10002", "1.5", "12345678.25", "0.00012", "1.2E-05", str(10**22), "3", None, None,
        "0.30000000000000004", "9007199254740992"]
    assert run(spark, [7, -7, None], T.LongType(), uid) == ["7", "7", None]
    assert run(spark, [True, False, None], T.BooleanType(), uid) == [None] * 3
    assert run(spark, [Decimal("7.00"), Decimal("7.50")], T.DecimalType(9, 2), uid) == ["7", "7.5"]


def test_uid_cells(spark):
    cells = [("s", " uid:7 "), ("f", "10002"), ("b", "True"), ("null", None), None,
             ("dt", "2026-07-22 00:00:00")]
    assert run(spark, cells, CELL, lambda c, t: normalize_uid(c, t)) == [
        "7", "10002", None, None, None, "2026-07-2200:00:00"]


def test_nfkc_and_whitespace_agree_with_unicode_tables(spark):
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    # characters the two libraries' Unicode versions share
    texts = [f"a{chr(c)}́b" for c in points if unicodedata.category(chr(c)) != "Cn"]
    got = run(spark, texts, T.StringType(), lambda c, t: nfkc(c))
    wrong = [(t, g) for t, g in zip(texts, got) if unicodedata.normalize("NFKC", t) != g]
    assert len(wrong) == 0, wrong[:5]
    spaces = {chr(c) for c in points if chr(c).isspace()}
    assert set(WS_CHARS) == spaces
    sides = [f"{w}x{w}y{w}" for w in sorted(spaces)]
    assert run(spark, sides, T.StringType(), lambda c, t: strip_ws(c)) == [s.strip() for s in sides]
    assert set(run(spark, sides, T.StringType(), lambda c, t: squash_ws(c))) == {"xy"}


def test_status_words(spark):
    words = ["已结算", "SETTLED", "完成", "已付", " 待定 ", "pending", "未结算", "报价", "ＱＵＯＴＥ",
             "随便什么", "", None]
    want = ["settled"] * 4 + ["pending"] * 3 + ["quote"] * 2
    assert run(spark, words, T.StringType(), lambda c, t: normalize_status(c, t)) == want + ["settled"] * 3
    assert run(spark, words[-3:], T.StringType(),
               lambda c, t: normalize_status(c, t, "pending")) == ["pending"] * 3


AMOUNTS = [
    ("1,234.50", "1234.50"), ("¥88.5", "88.5"), ("￥ 1,000", "1000"), ("$2,000.10", "2000.10"),
    ("８８．５", "88.5"), ("€5", "5"), ("1，5", "15"), ("1_000", "1000"), ("1,5", "15"), ("+5", "5"),
    ("5.", "5"), (".5", "0.5"), ("1e5", "100000"), ("-2.50", "-2.50"), ("٣", "3"),
    (None, None), ("", None), ("待定", None), ("-", None), ("—", None), ("abc", None), ("nan", None),
    ("None", None), ("100元", None), ("(5)", None), ("0x10", None), ("5d", None), ("Infinity", None),
    ("1e400", None), ("123456789012345678901", None),
]


def test_parse_amount_text(spark):
    got = run(spark, [a for a, _ in AMOUNTS], T.StringType(), lambda c, t: parse_amount(c, t))
    assert got == [None if w is None else Decimal(w) for _, w in AMOUNTS]


def test_parse_amount_numbers(spark):
    parse = lambda c, t: parse_amount(c, t)
    assert run(spark, [120.0, 1234.567, float("nan"), float("inf"), None], T.DoubleType(), parse) == [
        Decimal(120), Decimal("1234.567"), None, None, None]
    assert run(spark, [88], T.LongType(), parse) == [Decimal(88)]
    assert run(spark, [True], T.BooleanType(), parse) == [None]
    assert run(spark, [dt.date(2026, 7, 22)], T.DateType(), parse) == [None]
    cells = [("f", "120"), ("s", "¥ 3"), ("b", "True"), ("null", None)]
    assert run(spark, cells, CELL, parse) == [Decimal(120), Decimal(3), None, None]


@pytest.mark.parametrize("text,places,mode,want", [
    ("0.125", 2, "half_up", "0.13"), ("2.675", 2, "half_up", "2.68"), ("-2.675", 2, "half_up", "-2.68"),
    ("1234.567", 2, "half_up", "1234.57"), ("120", 2, "half_up", "120.00"),
    ("0.125", 2, "half_even", "0.12"), ("0.135", 2, "half_even", "0.14"),
    ("1.2345", 3, "half_up", "1.235"), ("1.2345", 0, "half_up", "1"), ("2.5", 0, "half_even", "2"),
    ("0.125", 2, "unknown", "0.13"), ("0.30000000000000004", 2, "half_up", "0.30"),
    ("0.12499999999999999999999", 2, "half_up", "0.12"),
    ("0.12500000000000000000001", 2, "half_even", "0.13"),
    ("0.12500000000000000000000", 2, "half_even", "0.12"),
])
def test_rounding(spark, text, places, mode, want):
    got = run(spark, [text], T.StringType(), lambda c, t: round_amount(parse_amount(c, t), places, mode))
    assert str(got[0]) == want


def test_cell_text(spark):
    assert run(spark, ["  x ", None, "　"], T.StringType(), cell_text) == ["x", "", ""]
    assert run(spark, [120.0, 0.5, None], T.DoubleType(), cell_text) == ["120", "0.5", ""]
    assert run(spark, [True, False], T.BooleanType(), cell_text) == ["True", "False"]
    assert run(spark, [3], T.IntegerType(), cell_text) == ["3"]
    moments = [dt.datetime(2026, 7, 22), dt.datetime(2026, 7, 22, 8, 5, 9), None]
    for kind in (T.TimestampType(), T.TimestampNTZType()):
        assert run(spark, moments, kind, cell_text) == ["2026-07-22", "2026-07-22 08:05", ""]
    assert run(spark, [dt.date(2026, 7, 22)], T.DateType(), cell_text) == ["2026-07-22"]
    cells = [("dt", "2026-07-22 00:00:00"), ("dt", "2026-07-22 08:05:09"), ("s", " a "),
             ("dt", "2026-07-22 00:00:30"), ("null", None), ("b", "True"), None]
    assert run(spark, cells, CELL, cell_text) == [
        "2026-07-22", "2026-07-22 08:05", "a", "2026-07-22 00:00", "", "True", ""]


def test_order_text_and_keywords(spark):
    assert run(spark, [" A ", " ", None], T.StringType(), order_text) == ["A", None, None]
    assert run(spark, [9001.0], T.DoubleType(), order_text) == ["9001"]
    hit = lambda c, t: first_keyword(c, ["冻结", "退款"])
    assert run(spark, ["退款冻结", "退款", "正常", ""], T.StringType(), hit) == ["冻结", "退款", None, None]
    assert run(spark, ["x"], T.StringType(), lambda c, t: first_keyword(c, [])) == [None]


def test_rules():
    rules = Rules.from_dict({"amount_places": "3", "uid_prefixes": None, "unknown": 1})
    assert (rules.amount_places, rules.uid_prefixes, rules.rounding) == (3, (), "half_up")
    assert Rules(anomaly_status_keywords=["a", "", "b"]).review_keywords == ["a"]
    for bad in ({"amount_places": -1}, {"amount_places": 17}, {"amount_tolerance": "NaN"}):
        with pytest.raises(ValueError):
            Rules(**bad)
