"""Delimited text, workbooks, the inbox and the audit log."""

import csv
import hashlib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tallybook.operators.sheets import (apply_mapping, detect_headers, resolve_columns,
                                        sheet_status)
from tallybook.plans.pipelines import folder_records
from tallybook.sources.audit import append_audit, audit_tail
from tallybook.sources.delimited import read_delimited
from tallybook.sources.inbox import content_hashes, inbox_totals, pending_files, scan_inbox
from tallybook.sources.ledger import Ledger
from tallybook.sources.lines import count_blocks, number_lines, raw_lines
from tallybook.sources.listing import FILE_FACTS, list_files
from tallybook.sources.sheets import UnsupportedFormat, read_sheets
from tallybook.sources.tables import read_or_empty
from tallybook.sources.workbook import ERROR_ROW, read_workbooks
from workload.xlsx import workbook_bytes


def rows_of(df):
    """source name -> cells texts by row, from a sheet table."""
    out = {}
    for r in df.collect():
        out.setdefault(r["source_file"].rsplit("/", 1)[-1], {})[r["row_idx"]] = [
            c["text"] for c in r["cells"]]
    return out


def random_csv(rnd, multiline):
    def field():
        kind = rnd.random()
        if kind < 0.3:
            return "".join(rnd.choice("ab金 1") for _ in range(rnd.randint(0, 5)))
        if kind < 0.55:
            parts = ["a", '""', ",", "金"] + (["\n", "\r\n"] if multiline else [])
            return '"' + "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 6))) + '"'
        return rnd.choice(['a"b', '"x"y"z', '""', "7", '"\t9"'])

    text = ""
    for _ in range(rnd.randint(0, 40)):
        text += rnd.choice(["", "", "\n", "  \n"]) if rnd.random() < 0.2 else ""
        text += ",".join(field() for _ in range(rnd.randint(1, 5))) + rnd.choice(["\n", "\r\n"])
    if multiline and rnd.random() < 0.3:
        text += '1,"open\nend'
    return text


@pytest.mark.parametrize("split,seed", [("128m", 1), ("150", 2), ("61", 3)])
def test_csv_matches_the_csv_module(spark, conf, tmp_path, split, seed):
    conf("spark.sql.files.maxPartitionBytes", split)
    conf("spark.sql.files.openCostInBytes", "1")
    rnd, want = random.Random(seed), {}
    for i in range(24 if split == "128m" else 9):
        encoding = rnd.choice(["utf-8", "utf-8-sig", "gbk"])
        data = random_csv(rnd, multiline=i % 3 == 0).encode(encoding)
        (tmp_path / f"f {i}.csv").write_bytes(data)
        try:
            text = data.decode("utf-8-sig")
        except UnicodeDecodeError:
            text = data.decode("gbk")
        want[f"f {i}.csv"] = dict(enumerate(csv.reader(io.StringIO(text))))
    got = rows_of(read_delimited(spark, str(tmp_path)).sheets)
    assert got == {k: v for k, v in want.items() if v}


def test_csv_encodings(spark, tmp_path):
    (tmp_path / "bom.csv").write_bytes("单号,金额\n\"\tK-77\",31.05\n".encode("utf-8-sig"))
    (tmp_path / "gbk.csv").write_bytes("UID,金额\n4711,63.20\n".encode("gbk"))
    (tmp_path / "bad.csv").write_bytes(b"\xff\xff,1\n")
    scan = read_delimited(spark, str(tmp_path))
    got = rows_of(scan.sheets)
    assert got["bom.csv"] == {0: ["单号", "金额"], 1: ["\tK-77", "31.05"]}
    assert got["gbk.csv"][0] == ["UID", "金额"] and "bad.csv" not in got
    kinds = {r["source_file"].rsplit("/", 1)[-1]: r["encoding"] for r in scan.files.collect()}
    assert kinds == {"bom.csv": "utf-8", "gbk.csv": "gbk", "bad.csv": None}


def test_line_numbers_notice_changed_splits(spark, conf, tmp_path):
    (tmp_path / "a.csv").write_text("".join(f"line {i}\n" for i in range(200)))
    conf("spark.sql.files.openCostInBytes", "1")
    conf("spark.sql.files.maxPartitionBytes", "100")
    lines = raw_lines(spark, str(tmp_path))
    blocks = count_blocks(lines)
    numbered = number_lines(lines, blocks)
    assert numbered.filter("value <> concat('line ', line_no)").count() == 0
    conf("spark.sql.files.maxPartitionBytes", "170")
    with pytest.raises(Exception, match="splits changed"):
        number_lines(raw_lines(spark, str(tmp_path)), blocks).select(F.max("line_no")).collect()


STYLES = ('<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm"/>'
          '<numFmt numFmtId="165" formatCode="0.00&quot;day&quot;"/></numFmts>'
          '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>')


def test_workbook_cells(spark, tmp_path):
    rows = [["UID", " 金额 "], None,
            [7, 120.5, True, "a&b", None, "x", (1, 46225), (2, 46225.3375), (3, 2.5), (1, 0.5)]]
    (tmp_path / "b.xlsx").write_bytes(workbook_bytes(rows, STYLES))
    (tmp_path / "~$b.xlsx").write_bytes(b"lock")
    got = {r["row_idx"]: [(c["kind"], c["text"]) for c in r["cells"]]
           for r in read_workbooks(spark, str(tmp_path)).collect()}
    assert got == {
        0: [("s", "UID"), ("s", " 金额 ")],
        2: [("i", "7"), ("f", "120.5"), ("b", "True"), ("s", "a&b"), ("null", None), ("s", "x"),
            ("dt", "2026-07-22 00:00:00"), ("dt", "2026-07-22 08:06:00"), ("f", "2.5"),
            ("s", "12:00:00")]}


def test_workbook_shared_strings_and_damage(spark, tmp_path):
    good = workbook_bytes([["x"]], shared=["甲", "乙"])
    (tmp_path / "good.xlsx").write_bytes(good)
    (tmp_path / "bad.xlsx").write_bytes(b"not a zip")
    got = rows_of(read_workbooks(spark, str(tmp_path)))
    assert got["good.xlsx"] == {0: ["x"]}
    assert list(got["bad.xlsx"]) == [ERROR_ROW]


def test_folder_of_both_kinds(spark, tmp_path):
    (tmp_path / "a.CSV").write_text("uid,金额\n1,2\n")
    (tmp_path / "b.xlsx").write_bytes(workbook_bytes([["uid", "金额"], [3, 4.5]]))
    (tmp_path / "bad.xlsx").write_bytes(b"zip?")
    (tmp_path / "blank.csv").write_text("\n")
    (tmp_path / "old.xls").write_bytes(b"\xd0\xcf")
    scan = read_sheets(spark, str(tmp_path))
    got = rows_of(scan.sheets)
    assert got == {"a.CSV": {0: ["uid", "金额"], 1: ["1", "2"]},
                   "b.xlsx": {0: ["uid", "金额"], 1: ["3", "4.5"]}, "blank.csv": {0: []}}
    kinds = {r["source_file"].rsplit("/", 1)[-1]: r["encoding"] for r in scan.files.collect()}
    assert kinds == {"a.CSV": "utf-8", "b.xlsx": "xlsx", "bad.xlsx": None, "blank.csv": "utf-8",
                     "old.xls": None}
    headers = detect_headers(scan.sheets)
    records = apply_mapping(scan.sheets, resolve_columns(headers, {"uid": "uid", "amount": "金额"}))
    status = {r["source_file"].rsplit("/", 1)[-1]: r["status"]
              for r in sheet_status(scan.files, headers, records).collect()}
    assert status == {"a.CSV": "ok", "b.xlsx": "ok", "bad.xlsx": "unreadable",
                      "blank.csv": "no_header", "old.xls": "unsupported_format"}
    with pytest.raises(UnsupportedFormat, match="old.xls"):
        read_sheets(spark, str(tmp_path), fail_on_unsupported=True)


def test_inbox_scan(spark, tmp_path):
    inbox = tmp_path / "in box"
    inbox.mkdir()
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    assert scan_inbox(spark, str(tmp_path / "none"), ledger.processed()).count() == 0
    data = b"x" * 256
    (inbox / "b.csv").write_bytes(data)
    (inbox / "a.XLSX").write_bytes(b"y" * 1537)
    (inbox / "c.xls").write_bytes(b"z")
    (inbox / "~$b.csv").write_bytes(b"t")
    (inbox / "notes.txt").write_bytes(b"t")
    got = scan_inbox(spark, str(inbox), ledger.processed()).collect()
    assert [r["name"] for r in got] == ["a.XLSX", "b.csv", "c.xls"]
    assert [r["size_kb"] for r in got] == [1.5, 0.2, 0.0]
    assert got[1]["sha256"] == hashlib.sha256(data).hexdigest() and not got[1]["processed"]
    assert got[2]["sha256"] is None and ".xls" in got[2]["warning"] and got[0]["warning"] is None
    scanned = scan_inbox(spark, str(inbox), ledger.processed())
    assert tuple(inbox_totals(scanned).first()) == (2, 2)
    assert [r["name"] for r in pending_files(scanned).collect()] == ["a.XLSX", "b.csv"]


def test_one_content_has_one_hash_at_any_size(spark, tmp_path):
    data = {"a": b"one\ntwo\n", "b": b"one\ntwo", "c": b"\xef\xbb\xbfone\ntwo\n", "d": b"one\ntwo\n"}
    for name, content in data.items():
        (tmp_path / f"{name}.csv").write_bytes(content)
    want = {n: hashlib.sha256(c).hexdigest() for n, c in data.items()}
    for line in (0, 8, 1 << 20):  # streamed, mixed, loaded whole
        got = content_hashes(spark, str(tmp_path), whole_below=line).collect()
        assert {r["path"][-5]: r["sha256"] for r in got} == want
    assert len(set(want.values())) == 3


def test_an_open_quote_ends_only_its_file(spark, conf, tmp_path, monkeypatch):
    monkeypatch.setattr("tallybook.sources.delimited.MAX_ROW_CHARS", 2000)
    (tmp_path / "open.csv").write_text('uid,金额\n1,"2\n' + "3,4\n" * 2000)
    (tmp_path / "good.csv").write_text('uid,金额\n1,"2\n3"\n')
    scan = read_sheets(spark, str(tmp_path))
    assert rows_of(scan.sheets) == {"good.csv": {0: ["uid", "金额"], 1: ["1", "2\n3"]}}
    kinds = {r["source_file"].rsplit("/", 1)[-1]: r["encoding"] for r in scan.files.collect()}
    assert kinds == {"open.csv": None, "good.csv": "utf-8"}


def test_a_damaged_workbook_ends_only_itself(spark, tmp_path):
    good = workbook_bytes([["x", 1]])
    (tmp_path / "good.xlsx").write_bytes(good)
    (tmp_path / "lower.xlsx").write_bytes(repacked(good, lambda n, d: d.replace(b'r="A1"', b'r="a1"')))
    (tmp_path / "odd.xlsx").write_bytes(repacked(good, lambda n, d: d.replace(b'r="A1"', b'r="1"')))
    locked = bytearray(good)
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):  # the flag of encrypted members
        place = locked.find(mark)
        while place >= 0:
            locked[place + at] |= 1
            place = locked.find(mark, place + 4)
    (tmp_path / "locked.xlsx").write_bytes(bytes(locked))
    torn = bytearray(repacked(good, lambda n, d: d + b"<!-- " + bytes(range(32, 60)) * 50 + b" -->"))
    start = torn.find(b"xl/worksheets") + 40
    torn[start:start + 40] = b"\xff" * 40
    (tmp_path / "torn.xlsx").write_bytes(bytes(torn))
    got = rows_of(read_workbooks(spark, str(tmp_path)))
    assert got["good.xlsx"] == got["lower.xlsx"] == {0: ["x", "1"]}
    for name in ("odd.xlsx", "locked.xlsx", "torn.xlsx"):
        assert list(got[name]) == [ERROR_ROW]


def repacked(book, change):
    """The same workbook with each member changed, deflated."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as old, \
            zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for name in old.namelist():
            new.writestr(name, change(name, old.read(name)))
    return out.getvalue()


def test_audit_log(spark, tmp_path):
    path = str(tmp_path / "audit")
    assert audit_tail(spark, path).count() == 0
    for i in range(4):
        append_audit(spark, path, f"act{i}", note="备注", n=i)
    got = audit_tail(spark, path, 3).collect()
    assert [r["action"] for r in got] == ["act1", "act2", "act3"] and "备注" in got[0]["detail"]
    assert audit_tail(spark, path, 0).count() == 0
    log = tmp_path / "log"
    log.mkdir()
    (log / "audit.jsonl").write_text('{"ts": "1", "action": "a"}\nnot json\n\n{"ts": "2"}\n')
    got = audit_tail(spark, str(log), 3).collect()  # the blank line counts, then goes
    assert [(r["ts"], r["raw"]) for r in got] == [(None, "not json"), ("2", None)]


def test_every_file_of_an_inbox_is_shown(spark, tmp_path):
    inbox = tmp_path / "in box"
    inbox.mkdir()
    data = {"a.csv": b"uid,x\n", "empty.csv": b"", "_b.csv": b"b", ".c.xlsx": b"c", "e.xls": b"",
            "~$t.csv": b"t", "notes.txt": b"n"}
    for name, content in data.items():
        (inbox / name).write_bytes(content)
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    shown = {r["name"]: r for r in scan_inbox(spark, str(inbox), ledger.processed()).collect()}
    assert set(shown) == {"a.csv", "empty.csv", "_b.csv", ".c.xlsx", "e.xls"}
    for name in ("a.csv", "empty.csv", "_b.csv", ".c.xlsx"):
        assert shown[name]["path"] == f"file:{inbox}/{name}"
        assert shown[name]["sha256"] == hashlib.sha256(data[name]).hexdigest()
    assert tuple(inbox_totals(scan_inbox(spark, str(inbox), ledger.processed())).first()) == (4, 4)
    for day in ("1", "2"):
        (tmp_path / "days" / f"day={day}").mkdir(parents=True)
        (tmp_path / "days" / f"day={day}" / f"d{day}.csv").write_bytes(day.encode())
    files = list_files(spark, str(tmp_path / "days"))
    assert files.rdd.getNumPartitions() == 3  # a folder each
    assert {(r["path"], r["sha256"]) for r in content_hashes(spark, str(tmp_path / "days")).collect()} == {
        (f"file:{tmp_path}/days/day={d}/d{d}.csv", hashlib.sha256(d.encode()).hexdigest())
        for d in ("1", "2")}
    facts = read_or_empty(spark, str(inbox / "a.csv"), FILE_FACTS, "binaryFile").drop("content")
    assert list_files(spark, str(inbox / "a.csv")).collect() == facts.select(*files.columns).collect()
    assert list_files(spark, str(inbox / "*.csv")).count() == 2  # as Spark lists: a.csv, ~$t.csv
    (tmp_path / "plain" / "below").mkdir(parents=True)
    (tmp_path / "plain" / "below" / "f.csv").write_bytes(b"f")
    assert list_files(spark, str(tmp_path / "plain")).count() == 0
    assert list_files(spark, [str(inbox / "_b.csv"), str(inbox / "gone.csv")]).count() == 1


def test_files_that_are_not_opened_have_an_outcome(spark, tmp_path):
    for name, content in (("ok.csv", "uid,金额\n1,2\n"), ("none.csv", ""), ("_u.csv", "uid,金额\n1,2\n")):
        (tmp_path / name).write_text(content)
    found = folder_records(read_sheets(spark, str(tmp_path)), {"uid": "uid", "amount": "金额"})
    assert {r["source_file"].rsplit("/", 1)[-1]: (r["status"], r["n_rows"])
            for r in found.status.collect()} == {
        "ok.csv": ("ok", 1), "none.csv": ("empty_file", 0), "_u.csv": ("hidden_name", 0)}
