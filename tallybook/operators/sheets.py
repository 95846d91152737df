"""Find the header of every sheet, suggest and apply a column mapping.

All files go through one job. Only the first rows of a sheet are looked at for
its header, and each keyword list is one regular expression, so nothing is
exploded or joined to find it.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fold, strip_ws
from ..rules import regex_any
from ..schemas import FIELDS, REQUIRED_FIELDS
from .lookup import SkewPolicy, salted_lookup

# Header keywords per field.
FIELD_KEYWORDS = {
    "uid": ["uid", "用户id", "用户 id", "工会id", "主播id", "账号", "memberid",
            "member", "编号", "id"],
    "amount": ["结算金额", "应结金额", "金额", "佣金", "分成", "结算", "amount"],
    "order_no": ["订单号", "订单编号", "单号", "订单", "order"],
    "date": ["日期", "结算日期", "时间", "周期", "date"],
    "name": ["昵称", "姓名", "主播", "name"],
    "status": ["状态", "status"],
}
HEADER_SCAN_ROWS = 15
MIN_HEADER_FIELDS = 2

MAPPING = T.MapType(T.StringType(), T.StructType([
    T.StructField("column", T.IntegerType()), T.StructField("header", T.StringType())]))


def folded_cells(cells: Column) -> Column:
    """Cell texts as headers are compared; '' for a missing cell."""
    return F.transform(cells, lambda c: F.coalesce(
        fold(F.when(c["kind"] != "null", c["text"])), F.lit("")))


def shortest_words(words: list[str]) -> list[str]:
    """Words without those that contain another one: they add no match."""
    return [w for w in words if not any(o != w and o in w for o in words)]


def row_line(cells: Column) -> Column:
    """All cells of a row folded as one string, cells apart by a line end."""
    texts = F.transform(cells, lambda c: F.when(c["kind"] != "null", c["text"]))
    return fold(F.array_join(texts, "\n"))


def header_score(line: Column) -> Column:
    """How many of the fields have a keyword in some cell of a ``row_line``.

    No keyword holds a line end, so looking through the whole line at once
    finds the same keywords as looking at each cell.
    """
    def has(field: str) -> Column:
        first, *others = shortest_words(FIELD_KEYWORDS[field])
        found = line.contains(first)
        for word in others:
            found = found | line.contains(word)
        return found.cast("int")

    score = has(FIELDS[0])
    for field in FIELDS[1:]:
        score = score + has(field)
    return score


def detect_headers(sheets: DataFrame) -> DataFrame:
    """Header row per file: the best-scoring early row, the earliest of equals.

    Files without a row that shows at least two fields are absent.
    """
    early = sheets.filter(F.col("row_idx") < HEADER_SCAN_ROWS)
    scored = (early.withColumn("line", row_line(F.col("cells")))
              .withColumn("score", header_score(F.col("line"))).drop("line")
              .filter(F.col("score") >= MIN_HEADER_FIELDS))
    best = F.max_by(F.struct("row_idx", "score", "cells"),
                    F.col("score") * HEADER_SCAN_ROWS - F.col("row_idx"))
    found = scored.groupBy("source_file").agg(best.alias("h"))
    return found.select(
        "source_file", F.col("h.row_idx").alias("header_idx"), F.col("h.score").alias("score"),
        F.col("h.cells").alias("header"), folded_cells(F.col("h.cells")).alias("folded"))


def suggest_mapping(headers: DataFrame) -> DataFrame:
    """Per file a map field -> (column, header).

    A cell equal to a keyword wins over one that contains it; among equals the
    leftmost. One cell may serve several fields.
    """
    folded, header = F.col("folded"), F.col("header")

    def found(field: str) -> Column:
        words = FIELD_KEYWORDS[field]
        pattern = regex_any(words)
        first = lambda test: F.array_min(
            F.transform(folded, lambda c, i: F.when(test(c), i)))
        return F.coalesce(first(lambda c: c.isin(*words)), first(lambda c: c.rlike(pattern)))

    at = headers.select("source_file", "header_idx", "header",
                        *[found(f).cast("int").alias(f) for f in FIELDS])
    pairs = F.array(*[F.struct(
        F.lit(f).alias("key"),
        F.struct(F.col(f).alias("column"),
                 strip_ws(F.get(header, F.col(f))["text"]).alias("header")).alias("value"))
        for f in FIELDS])
    known = F.filter(pairs, lambda p: p["value"]["column"].isNotNull())
    mapping = F.map_from_entries(known)
    return at.select("source_file", "header_idx", mapping.alias("mapping")).withColumn(
        "missing_fields", missing_fields(F.col("mapping")))


def missing_fields(mapping: Column) -> Column:
    required = F.lit(list(REQUIRED_FIELDS))
    return F.array_except(required, F.map_keys(mapping))


def parse_mapping(mapping: str | Mapping) -> dict[str, dict]:
    """A user's mapping (object or JSON text) in the long form.

    Accepts ``{"uid": "UID"}`` and ``{"uid": {"column": 0, "header": "UID"}}``.
    """
    if isinstance(mapping, str):
        mapping = json.loads(mapping)
    if not isinstance(mapping, Mapping):
        raise ValueError("a mapping is an object: field -> header or {column, header}")
    out = {}
    for field in FIELDS:
        value = mapping.get(field)
        if isinstance(value, str):
            out[field] = {"column": None, "header": value}
        elif isinstance(value, Mapping):
            column = value.get("column")
            out[field] = {"column": column if isinstance(column, int) else None,
                          "header": str(value.get("header") or "")}
    return out


def validate_mapping(mapping: str | Mapping) -> dict[str, dict]:
    parsed = parse_mapping(mapping)
    missing = [f for f in REQUIRED_FIELDS if f not in parsed]
    if missing:
        raise ValueError(f"the mapping lacks the required fields {missing}")
    return parsed


def _fold_py(text: str) -> str:
    return unicodedata.normalize("NFKC", text).strip().lower()


def resolve_columns(headers: DataFrame, mapping: Mapping | str | DataFrame) -> DataFrame:
    """Column index per file and field: (source_file, header_idx, uid, ...).

    The header name decides, first match from the left; the given index is only
    used when no header has that name. A negative index is no column.
    ``mapping`` is one mapping for all files or a (source_file, mapping) table.
    """
    folded = F.col("folded")
    place = lambda name: F.nullif(
        F.array_position(folded, name).cast("int"), F.lit(0)) - 1
    if isinstance(mapping, DataFrame):
        base = headers.join(mapping.select("source_file", "mapping"), "source_file")
        names = base.withColumns({f"_{f}": fold(F.col("mapping")[f]["header"]) for f in FIELDS})
        index = {}
        for f in FIELDS:
            given = F.col("mapping")[f]["column"]
            wanted = F.nullif(F.col(f"_{f}"), F.lit(""))
            index[f] = F.coalesce(place(wanted), F.when(given >= 0, given))
        return names.select("source_file", "header_idx", *[c.alias(f) for f, c in index.items()])
    parsed = parse_mapping(mapping)
    columns = []
    for f in FIELDS:
        m = parsed.get(f) or {"column": None, "header": ""}
        given = m["column"] if m["column"] is not None and m["column"] >= 0 else None
        index = F.lit(given).cast("int")
        name = _fold_py(m["header"])
        if name:
            index = F.coalesce(place(F.lit(name)), index)
        columns.append(index.alias(f))
    return headers.select("source_file", "header_idx", *columns)


def apply_mapping(sheets: DataFrame, columns: DataFrame, *,
                  policy: SkewPolicy = SkewPolicy()) -> DataFrame:
    """Records from sheets: rows below the header that are not blank.

    ``row_no`` is the 1-based sheet row; blank rows are dropped but counted.
    A short row or an unmapped field gives NULL.
    """
    index = columns.select("source_file", "header_idx",
                           *[F.col(f).alias(f"_{f}") for f in FIELDS])
    rows = salted_lookup(sheets, index, ["source_file"], spread_by=["row_idx"],
                         policy=policy, how="inner")
    filled = F.exists("cells", lambda c: (c["kind"] != "null") & (strip_ws(c["text"]) != ""))
    return rows.filter((F.col("row_idx") > F.col("header_idx")) & filled).select(
        "source_file", (F.col("row_idx") + 1).alias("row_no"),
        *[F.get("cells", F.col(f"_{f}")).alias(f) for f in FIELDS])


def sheet_status(files: DataFrame, headers: DataFrame, records: DataFrame) -> DataFrame:
    """Per file: ok, or why it gives no records, and how many it gives.

    ``files`` has (source_file, encoding) and may have ``supported`` and ``left_out``.
    """
    counts = records.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows"))
    found = headers.select("source_file", F.lit(True).alias("has_header"))
    unread = F.col("encoding").isNull()
    refused = F.col("supported") == F.lit(False) if "supported" in files.columns else F.lit(False)
    left_out = F.col("left_out") if "left_out" in files.columns else F.lit(None).cast("string")
    return (
        files.join(found, "source_file", "left").join(counts, "source_file", "left")
        .select("source_file",
                F.when(refused, "unsupported_format").when(left_out.isNotNull(), left_out)
                .when(unread, "unreadable")
                .when(F.col("has_header").isNull(), "no_header")
                .when(F.col("n_rows").isNull(), "no_data").otherwise("ok").alias("status"),
                F.coalesce("n_rows", F.lit(0)).alias("n_rows")))


# ------------------------------------------------------------ mapping store

MAPPING_ROWS = T.StructType([
    T.StructField("field", T.StringType()), T.StructField("column", T.IntegerType()),
    T.StructField("header", T.StringType())])


def save_mapping(spark: SparkSession, path: str, mapping: str | Mapping,
                 profile: str = "default") -> dict[str, dict]:
    """Check and store a mapping under a profile name, replacing the old one."""
    parsed = validate_mapping(mapping)
    rows = [(f, m["column"], m["header"]) for f, m in parsed.items()]
    (spark.createDataFrame(rows, MAPPING_ROWS).coalesce(1)
     .write.mode("overwrite").parquet(f"{path}/profile={profile}"))
    return parsed


def load_mapping(spark: SparkSession, path: str, profile: str = "default") -> dict[str, dict] | None:
    """The stored mapping (at most one row per field), None when there is none."""
    from ..sources.tables import read_or_empty

    rows = read_or_empty(spark, f"{path}/profile={profile}", MAPPING_ROWS).collect()
    found = {r["field"]: {"column": r["column"], "header": r["header"]} for r in rows}
    return {f: found[f] for f in FIELDS if f in found} or None
