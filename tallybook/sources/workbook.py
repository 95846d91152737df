"""Workbooks (.xlsx) as sheets: one task reads one file, rows stream out.

A sheet holds at most 1,048,576 rows, so a file is a fair unit of work. Only
paths travel from Spark to Python; each task opens its files itself through
the file system Arrow resolves from the path.
"""

from __future__ import annotations

import datetime as dt
import re
import sys
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SHEET

# Executors get this module's functions with the job, not by importing it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_ROWS = 4096
ERROR_ROW = -1

_ARROW_CELL = pa.struct([("kind", pa.string()), ("text", pa.string())])
_ARROW_SHEET = pa.schema([("source_file", pa.string()), ("row_idx", pa.int64()),
                          ("cells", pa.list_(_ARROW_CELL))])

# The built-in number formats of the file format that are dates or times.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_NOT_PATTERN = re.compile(r'\[(?!h+\]|m+\]|s+\])[^\]]*\]|"[^"]*"|\\.|_.|\*.', re.I)
_EPOCHS = {False: dt.datetime(1899, 12, 30), True: dt.datetime(1904, 1, 1)}


def _tag(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _elements(archive: zipfile.ZipFile, name: str, wanted: str):
    """Stream the ``wanted`` elements of one part, freeing each when done."""
    if name not in archive.namelist():
        return
    with archive.open(name) as part:
        for _, element in ElementTree.iterparse(part):
            if _tag(element) == wanted:
                yield element
                element.clear()


def _string_of(element) -> str:
    """Text of a shared or inline string; phonetic hints do not count."""
    out = []
    for child in element:
        tag = _tag(child)
        if tag == "t":
            out.append(child.text or "")
        elif tag == "r":
            out.extend(t.text or "" for t in child if _tag(t) == "t")
    return "".join(out)


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    """Positions of the cell styles that show a number as a date or time."""
    custom, styles = {}, set()
    for element in _elements(archive, "xl/styles.xml", "styleSheet"):
        for part in element:
            if _tag(part) == "numFmts":
                custom = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in part}
            elif _tag(part) == "cellXfs":
                for i, style in enumerate(part):
                    code = int(style.get("numFmtId") or 0)
                    pattern = _NOT_PATTERN.sub("", custom.get(code, "").split(";")[0])
                    if code in _DATE_FORMATS or re.search("[dmhysDMHYS]", pattern):
                        styles.add(i)
    return styles


def _sheet_part(archive: zipfile.ZipFile, sheet: str | None) -> tuple[str, bool]:
    """Path of the first (or named) sheet, and whether dates count from 1904."""
    book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
    since_1904, target = False, None
    for element in book.iter():
        if _tag(element) == "workbookPr":
            since_1904 = element.get("date1904") in ("1", "true")
        if _tag(element) == "sheet" and target is None and sheet in (None, element.get("name")):
            target = next(v for k, v in element.attrib.items() if k.endswith("}id"))
    if target is None:
        raise KeyError(f"no sheet named {sheet!r}")
    links = ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
    part = next(e.get("Target") for e in links if e.get("Id") == target)
    return (part[1:] if part.startswith("/") else f"xl/{part}"), since_1904


def _moment(serial: float, since_1904: bool) -> tuple[str, str]:
    days, fraction = divmod(serial, 1)
    span = dt.timedelta(milliseconds=round(fraction * 86_400_000))
    if 0 <= serial < 1 and span.days == 0:
        return "s", str((dt.datetime.min + span).time())
    if 0 < serial < 60 and not since_1904:
        days += 1  # the format believes in 29 February 1900
    return "dt", str(_EPOCHS[since_1904] + dt.timedelta(days=days) + span)


def _number(text: str) -> tuple[str, str]:
    if not re.search(r"[.eE]", text):
        return "i", str(int(text))
    value = float(text)
    return "f", str(int(value)) if value.is_integer() else repr(value)


def _cell(element, shared: list[str], dates: set[int], since_1904: bool) -> tuple:
    """(kind, text) of one cell element."""
    kind = element.get("t", "n")
    parts = {_tag(child): child for child in element}
    if kind == "inlineStr":
        return ("s", _string_of(parts["is"])) if "is" in parts else ("null", None)
    raw = parts["v"].text if "v" in parts else None
    if raw is None or (raw == "" and kind != "str"):
        return "null", None
    if kind == "s":
        return "s", shared[int(raw)]
    if kind == "b":
        return "b", "True" if raw == "1" else "False"
    if kind in ("str", "e"):
        return "s", raw
    if kind == "d":
        return "dt", str(dt.datetime.fromisoformat(raw.rstrip("Z")))
    if int(element.get("s") or 0) in dates:
        return _moment(float(raw), since_1904)
    return _number(raw)


def _column_index(reference: str) -> int:
    index = 0
    letters = re.match("[A-Za-z]+", reference)
    if not letters:
        raise ValueError(f"no cell reference: {reference!r}")
    for letter in letters.group().upper():
        index = index * 26 + ord(letter) - 64
    return index - 1


def sheet_rows(file, sheet: str | None = None) -> Iterator[tuple[int, list]]:
    """(0-based row, cells) of one workbook; rows the file leaves out are skipped."""
    with zipfile.ZipFile(file) as archive:
        part, since_1904 = _sheet_part(archive, sheet)
        shared = [_string_of(e) for e in _elements(archive, "xl/sharedStrings.xml", "si")]
        dates = _date_styles(archive)
        at = -1
        for row in _elements(archive, part, "row"):
            at = int(row.get("r")) - 1 if row.get("r") else at + 1
            cells: list = []
            for element in row:
                where = element.get("r")
                index = _column_index(where) if where else len(cells)
                cells.extend([{"kind": "null", "text": None}] * (index - len(cells)))
                kind, text = _cell(element, shared, dates, since_1904)
                cells.append({"kind": kind, "text": text})
            yield at, cells


def _read_file(path: str, sheet: str | None) -> list[pa.RecordBatch]:
    """All rows of one workbook, or one error row when it cannot be read.

    Rows are handed on only when the whole file was read, so a damaged file
    never shows up in part.
    """
    batches, rows = [], []
    pack = lambda rs: pa.RecordBatch.from_pylist(rs, schema=_ARROW_SHEET)
    try:
        system, inner = fs.FileSystem.from_uri(as_uri(path))
        with system.open_input_file(inner) as file:
            for at, cells in sheet_rows(file, sheet):
                rows.append({"source_file": path, "row_idx": at, "cells": cells})
                if len(rows) == BATCH_ROWS:
                    batches.append(pack(rows))
                    rows = []
    except OSError:  # the store, not the file: the task is tried again
        raise
    except Exception as e:  # whatever a damaged file leads to, it ends only that file
        error = [{"kind": "error", "text": f"{type(e).__name__}: {e}"}]
        return [pack([{"source_file": path, "row_idx": ERROR_ROW, "cells": error}])]
    return batches + ([pack(rows)] if rows else [])


def _parse(batches: Iterator[pa.RecordBatch], sheet: str | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            yield from _read_file(path, sheet)


def as_uri(path: str) -> str:
    """``file:/x`` is Hadoop's spelling of a local path."""
    return path[len("file:"):] if path.startswith("file:") else path


def read_workbooks(spark: SparkSession, paths, sheet: str | None = None) -> DataFrame:
    """Rows of the first (or named) sheet of every .xlsx file under ``paths``.

    A file that cannot be read gives one row numbered ``ERROR_ROW``.
    """
    files = (spark.read.format("binaryFile").load(paths)
             .filter(F.lower("path").endswith(".xlsx") & ~F.col("path").rlike(r"/~\$[^/]*\z"))
             .select("path"))
    return files.mapInArrow(lambda batches: _parse(batches, sheet), SHEET)
