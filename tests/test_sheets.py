"""Header detection, mapping suggestion, resolution and application."""

import random

import pytest

from tallybook.operators.sheets import (FIELD_KEYWORDS, apply_mapping, detect_headers, load_mapping,
                                        parse_mapping, resolve_columns, save_mapping, sheet_status,
                                        suggest_mapping, validate_mapping)
from tallybook.schemas import FIELDS, SHEET


def sheet(spark, files):
    """``files``: name -> rows of cells (text, None or (kind, text))."""
    cell = lambda c: ("null", None) if c is None else c if isinstance(c, tuple) else ("s", c)
    rows = [(name, i, [cell(c) for c in row]) for name, lines in files.items()
            for i, row in enumerate(lines)]
    return spark.createDataFrame(rows, SHEET)


SAMPLE = [["本周对账"], ["制表"], ["UID", "昵称", "订单号", "结算金额", "日期", "状态"],
          ["K31", "阿岚", "T-1", ("i", "12"), "2025-03-04", "完结"], [None, " "], [],
          ["K32", None, "T-2"]]


def mapping_of(spark, rows):
    maps = suggest_mapping(detect_headers(sheet(spark, {"f": rows}))).collect()
    return {k: (v["column"], v["header"]) for k, v in maps[0]["mapping"].items()} if maps else None


def test_header_below_titles(spark):
    h = detect_headers(sheet(spark, {"f": SAMPLE})).first()
    assert (h["header_idx"], h["score"]) == (2, 6)


def test_two_fields_needed(spark):
    assert detect_headers(sheet(spark, {"f": [["备注", "随便"], ["a", "b"]]})).count() == 0
    assert detect_headers(sheet(spark, {"f": [["UID", "x"]]})).count() == 0


def test_only_early_rows_count(spark):
    header = ["UID", "金额"]
    assert detect_headers(sheet(spark, {"f": [["x"]] * 14 + [header]})).first()["header_idx"] == 14
    assert detect_headers(sheet(spark, {"f": [["x"]] * 15 + [header]})).count() == 0


def test_best_score_then_earliest(spark):
    rows = [["uid", "金额"], ["uid", "金额", "状态"], ["uid", "金额", "日期"]]
    assert detect_headers(sheet(spark, {"f": rows})).first()["header_idx"] == 1


def test_suggestion_prefers_equal_headers(spark):
    assert mapping_of(spark, SAMPLE) == {
        "uid": (0, "UID"), "amount": (3, "结算金额"), "order_no": (2, "订单号"), "date": (4, "日期"),
        "name": (1, "昵称"), "status": (5, "状态")}
    got = mapping_of(spark, [["包裹编号", "应付金额", "会员姓名", "流转状态"]])
    assert got["uid"] == (0, "包裹编号") and got["amount"] == (1, "应付金额")
    assert got["status"] == (3, "流转状态") and got["name"] == (2, "会员姓名")
    assert mapping_of(spark, [["付款编号", " ＵＩＤ ", "AMOUNT"]])["uid"] == (1, "ＵＩＤ")


def plain_header(rows):
    best, found = 0, None
    for i, row in enumerate(rows[:15]):
        cells = [c.strip().lower() for c in row if c is not None]
        score = sum(any(k in c for c in cells for k in ks) for ks in FIELD_KEYWORDS.values())
        if score > best:
            best, found = score, i
    return found if best >= 2 else None


def plain_mapping(row):
    cells = [(i, c.strip().lower()) for i, c in enumerate(row) if c and c.strip()]
    out = {}
    for field, words in FIELD_KEYWORDS.items():
        hits = [i for i, c in cells if c in words] or [i for i, c in cells
                                                       if any(w in c for w in words)]
        if hits:
            out[field] = (hits[0], row[hits[0]].strip())
    return out


def test_random_sheets_match_a_plain_model(spark):
    rnd = random.Random(7)
    words = [w for ws in FIELD_KEYWORDS.values() for w in ws] + ["x", "备注", "y z", "Paid", None, " "]
    cell = lambda: rnd.choice([lambda: rnd.choice(words), lambda: f" {rnd.choice(words)} x",
                               lambda: "q"])()
    files = {f"f{i}": [[cell() for _ in range(rnd.randint(0, 6))] for _ in range(rnd.randint(1, 18))]
             for i in range(80)}
    maps = {r["source_file"]: r for r in suggest_mapping(detect_headers(sheet(spark, files))).collect()}
    for name, rows in files.items():
        idx = plain_header(rows)
        if idx is None:
            assert name not in maps
            continue
        assert maps[name]["header_idx"] == idx
        got = {k: (v["column"], v["header"]) for k, v in maps[name]["mapping"].items()}
        want = plain_mapping(rows[idx])
        assert got == want
        assert set(maps[name]["missing_fields"]) == {"uid", "amount"} - set(want)


def applied(spark, rows, mapping):
    s = sheet(spark, {"f": rows})
    headers = detect_headers(s)
    records = apply_mapping(s, resolve_columns(headers, mapping)).orderBy("row_no").collect()
    text = lambda c: c and c["text"]
    return {r["row_no"]: {f: text(r[f]) for f in FIELDS if text(r[f]) is not None} for r in records}


def test_records_keep_sheet_rows(spark):
    got = applied(spark, SAMPLE, {"uid": "UID", "amount": "结算金额", "name": {"column": 1}})
    assert got == {4: {"uid": "K31", "amount": "12", "name": "阿岚"}, 7: {"uid": "K32"}}


def test_column_resolution(spark):
    rows = [["Uid", "金额", "金额"], ["1", "2", "3"]]
    assert applied(spark, rows, {"uid": " ｕid ", "amount": "金额"}) == {2: {"uid": "1", "amount": "2"}}
    fallback = {"uid": {"column": 2, "header": "missing"}, "amount": {"header": "金额", "column": 0}}
    assert applied(spark, rows, fallback) == {2: {"uid": "3", "amount": "2"}}
    outside = {"uid": {"column": -1}, "amount": {"column": 9}}
    assert applied(spark, rows, outside) == {2: {}}
    suggestions = suggest_mapping(detect_headers(sheet(spark, {"f": rows})))
    assert applied(spark, rows, suggestions) == {2: {"uid": "1", "amount": "2"}}


def test_mapping_forms():
    assert parse_mapping('{"uid": "UID", "x": "y"}') == {"uid": {"column": None, "header": "UID"}}
    assert validate_mapping({"uid": {"column": 0}, "amount": "a"})["uid"]["column"] == 0
    with pytest.raises(ValueError):
        validate_mapping({"uid": "UID"})
    with pytest.raises(ValueError):
        parse_mapping("[1]")


def test_mapping_store(spark, tmp_path):
    path = str(tmp_path / "maps")
    assert load_mapping(spark, path) is None
    save_mapping(spark, path, {"uid": "UID", "amount": {"column": 3, "header": "金额"}})
    save_mapping(spark, path, {"uid": "id", "amount": "a"}, profile="other")
    save_mapping(spark, path, {"uid": "ID", "amount": {"column": 3, "header": "金额"}})
    assert load_mapping(spark, path) == {"uid": {"column": None, "header": "ID"},
                                         "amount": {"column": 3, "header": "金额"}}
    with pytest.raises(ValueError):
        save_mapping(spark, path, {"amount": "x"})


def test_file_status(spark):
    files = {"ok": SAMPLE, "none": [["x"]], "empty": [["uid", "金额"], [" "]], "bad": []}
    s = sheet(spark, files)
    listed = spark.createDataFrame([("ok", "utf-8"), ("none", "gbk"), ("empty", "utf-8"), ("bad", None)],
                                   "source_file string, encoding string")
    headers = detect_headers(s)
    records = apply_mapping(s, resolve_columns(headers, {"uid": "uid", "amount": "金额"}))
    got = {r["source_file"]: (r["status"], r["n_rows"])
           for r in sheet_status(listed, headers, records).collect()}
    assert got == {"ok": ("ok", 2), "none": ("no_header", 0), "empty": ("no_data", 0),
                   "bad": ("unreadable", 0)}
