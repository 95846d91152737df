"""A folder of sheets of both kinds as one table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SHEET
from ..session import charset_settings, materialize
from .delimited import read_delimited
from .inbox import is_hidden, list_inbox
from .tables import empty_table
from .workbook import ERROR_ROW, read_workbooks

EMPTY, HIDDEN = "empty_file", "hidden_name"  # why a file is not opened
CSV_GLOB = "*.[cC][sS][vV]"


class UnsupportedFormat(ValueError):
    """The folder holds files that cannot be read as sheets."""


@dataclass(frozen=True)
class SheetScan:
    """``sheets`` is written once to the shared folder: text is parsed once and
    the header search, which filters on row_idx, skips most of the table.
    ``files`` has (source_file, supported, encoding, left_out); a supported file
    without an encoding could not be read, and ``left_out`` says why one was not
    opened at all."""

    sheets: DataFrame
    files: DataFrame


def read_sheets(spark: SparkSession, folder: str, *, sheet: str | None = None,
                fail_on_unsupported: bool = False) -> SheetScan:
    with charset_settings(spark):
        return _read_sheets(spark, folder, sheet, fail_on_unsupported)


def _read_sheets(spark, folder, sheet, fail_on_unsupported) -> SheetScan:
    listed = list_inbox(spark, folder)
    if fail_on_unsupported:
        refused = listed.filter(~F.col("supported")).select("name").limit(20).collect()
        if refused:
            raise UnsupportedFormat(
                f"only .xlsx and .csv can be read, not {[r['name'] for r in refused]}")
    kinds = {r["format"] for r in listed.select("format").distinct().collect()}
    text = read_delimited(spark, folder, CSV_GLOB) if ".csv" in kinds else None
    books = read_workbooks(spark, folder, sheet) if ".xlsx" in kinds else None
    parts = [df for df in (text and text.sheets, books) if df is not None]
    if not parts:
        parts = [empty_table(spark, SHEET)]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    staged = materialize(rows, "sheets")
    broken = staged.filter(F.col("row_idx") == ERROR_ROW).select(
        F.col("source_file"), F.lit(True).alias("broken"))
    files = listed.select(
        F.col("path").alias("source_file"), "supported",
        F.when(F.col("format") == ".xlsx", "xlsx").alias("encoding"),
        F.when(F.col("length") == 0, EMPTY).when(is_hidden(F.col("path")), HIDDEN)
        .alias("left_out"))
    if text is not None:
        known = materialize(text.files, "encodings").withColumnRenamed("encoding", "text_encoding")
        files = files.join(known, "source_file", "left").select(
            "source_file", "supported", F.coalesce("encoding", "text_encoding").alias("encoding"),
            "left_out")
    files = files.join(broken, "source_file", "left").select(
        "source_file", "supported",
        F.when(F.col("broken").isNull(), F.col("encoding")).alias("encoding"), "left_out")
    return SheetScan(staged.filter(F.col("row_idx") != ERROR_ROW), files)
