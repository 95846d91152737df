"""Comma-separated files as sheets: exact row numbers, splittable at any size.

Semantics: UTF-8 (a byte order mark is dropped), else GBK, else unreadable;
fields keep their text as is; a blank line is a row without cells; a quoted
field may span lines, which then form one row.

Spark's own CSV reader skips blank lines and needs ``multiLine`` (one task per
file) for quoted line ends. Here each line is judged alone: what does it do to
the state "inside quotes"? It leaves it, sets it, clears it or flips it. These
four effects compose, so the state at any line follows from running windows
inside a block and over the few blocks of a file. Files without any line that
ends inside quotes, nearly all, need no windows: there a line is a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import CHARSET_CONF, materialize
from .lines import Blocks, count_blocks, number_lines, raw_lines

# Characters of one row over several lines; beyond it a quote was left open.
MAX_ROW_CHARS = 16 << 20

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
# A line that starts outside quotes and ends inside: whole fields, then an
# opening quote that nothing closes. A quote inside an unquoted field is text.
_ENDS_OPEN = rf'\A(?:(?:{_QUOTED}"[^,]*+|[^",][^,]*+|),)*+{_QUOTED}\z'
_FIELD = rf'({_QUOTED}"[^,]*+|[^,]*+),'
_UNQUOTE = r'(?s)\A"([^"]*+(?:""[^"]*+)*+)"(.*)\z'


@dataclass(frozen=True)
class DelimitedScan:
    """``sheets`` in the sheet layout; ``files`` (source_file, encoding)."""

    sheets: DataFrame
    files: DataFrame


def ends_open(line: Column) -> Column:
    return F.when(line.contains('"'), line.rlike(_ENDS_OPEN)).otherwise(False)


def split_fields(row: Column) -> Column:
    """The fields of one complete row; a blank row has none."""
    closed = F.when(ends_open(row), F.concat(row, F.lit('"'))).otherwise(row)
    fields = F.regexp_extract_all(F.concat(closed, F.lit(",")), F.lit(_FIELD), F.lit(1))
    unquote = lambda c: F.when(
        c.startswith('"'),
        F.concat(F.replace(F.regexp_extract(c, _UNQUOTE, 1), F.lit('""'), F.lit('"')),
                 F.regexp_extract(c, _UNQUOTE, 2))).otherwise(c)
    return (F.when(row == "", F.array().cast("array<string>"))
            .when(~row.contains('"'), F.split(row, ","))
            .otherwise(F.transform(fields, unquote)))


def _as_cells(fields: Column) -> Column:
    return F.transform(fields, lambda c: F.struct(F.lit("s").alias("kind"), c.alias("text")))


def _drop_cr(line: Column) -> Column:
    return F.regexp_replace(line, r"\r\z", "")


def _decoded(value: Column, encoding: Column) -> Column:
    return F.when(encoding == "gbk", F.decode(value.cast("binary"), "GBK")).otherwise(value)


def read_delimited(spark: SparkSession, paths, glob: str | None = None) -> DelimitedScan:
    """Scan comma-separated files. Runs one counting pass at once."""
    if any(spark.conf.get(key, None) != value for key, value in CHARSET_CONF.items()):
        raise RuntimeError(f"reading GBK text needs the session options {CHARSET_CONF}")
    lines = raw_lines(spark, paths, glob).filter(~F.col("source_file").rlike(r"/~\$[^/]*\z"))
    value = F.col("value")
    as_gbk = F.decode(value.cast("binary"), "GBK")
    blocks = count_blocks(
        lines,
        utf8=F.bool_and(F.is_valid_utf8("value")),
        gbk=F.bool_and(~as_gbk.contains("�")),
        open_lines=F.count_if(ends_open(value)))
    files = blocks.table.groupBy("source_file").agg(
        F.when(F.bool_and("utf8"), "utf-8").when(F.bool_and("gbk"), "gbk").alias("encoding"),
        (F.sum("open_lines") > 0).alias("spans"))
    known = Blocks(blocks.table.join(files, "source_file"), blocks.count)
    spanning = files.agg(F.bool_or("spans").alias("any")).first()["any"]

    numbered = number_lines(lines, known, "encoding", "spans").filter(
        F.col("encoding").isNotNull())
    one_line = numbered.filter(~F.col("spans")) if spanning else numbered
    rows = one_line.select(
        "source_file", F.col("line_no").alias("row_idx"),
        _drop_cr(_decoded(value, F.col("encoding"))).alias("row"))
    if spanning:
        more, endless = _spanning_rows(numbered.filter("spans"))
        rows = rows.unionByName(more)
        files = files.join(endless, "source_file", "left").withColumn(
            "encoding", F.when(F.col("endless").isNull(), F.col("encoding")))
    sheets = rows.select("source_file", "row_idx", _as_cells(split_fields(F.col("row")))
                         .alias("cells"))
    return DelimitedScan(sheets, files.select("source_file", "encoding"))


# ------------------------------------------------- rows over several lines

def _with_state(df: DataFrame, part: list[str], order: str) -> DataFrame:
    """Running effect of everything up to and including each row.

    ``out_a`` and ``in_b`` say whether the row ends inside quotes when it was
    entered outside or inside. ``fixed`` is the state when some row so far set
    or cleared it, else NULL; ``flips`` is the parity of the flips since.
    """
    upto = (Window.partitionBy(*part).orderBy(order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sets = F.col("out_a") == F.col("in_b")
    flips = F.col("out_a") & ~F.col("in_b")
    run = df.withColumn("_flips", F.sum(flips.cast("int")).over(upto)).withColumn(
        "_last", F.last(F.when(sets, F.struct(F.col("out_a").alias("v"),
                                              F.col("_flips").alias("at"))), True).over(upto))
    odd = F.pmod(F.col("_flips") - F.coalesce(F.col("_last.at"), F.lit(0)), F.lit(2)) == 1
    return (run.withColumn("fixed", F.when(odd, ~F.col("_last.v")).otherwise(F.col("_last.v")))
            .withColumn("flipped", odd).drop("_flips", "_last"))


def _resolve(fixed: Column, flipped: Column, start: Column) -> Column:
    return F.coalesce(fixed, F.when(flipped, ~start).otherwise(start))


def _spanning_rows(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of files in which some quoted field spans lines, and the files left out.

    A quote that is never closed turns the rest of a file into one row. The
    size of every row is counted before its lines are gathered; a file with a
    row above ``MAX_ROW_CHARS`` is unreadable as a whole.
    """
    text = _decoded(F.col("value"), F.col("encoding"))
    judged = numbered.select(
        "source_file", "block", "line_no", text.alias("line"),
        ends_open(F.col("value")).alias("out_a"),
        ends_open(F.concat(F.lit('"'), F.col("value"))).alias("in_b"))
    in_block = ["source_file", "block"]
    local = _with_state(judged, in_block, "line_no")

    # effect of a whole block = running effect at its last line
    last = F.struct("line_no", "fixed", "flipped")
    effect = local.groupBy(*in_block).agg(F.max_by(last, "line_no").alias("e"))
    per_block = effect.select(
        *in_block,
        F.coalesce("e.fixed", F.col("e.flipped")).alias("out_a"),
        F.coalesce("e.fixed", ~F.col("e.flipped")).alias("in_b"))
    over_file = Window.partitionBy("source_file").orderBy("block")
    outside = F.lit(False)
    entered = _with_state(per_block, ["source_file"], "block").withColumn(
        "ends_in", _resolve(F.col("fixed"), F.col("flipped"), outside)).select(
        *in_block, F.lag("ends_in", 1, False).over(over_file).alias("block_in"))

    by_line = Window.partitionBy(*in_block).orderBy("line_no")
    starts = (
        local.join(entered, in_block)
        .withColumn("line_in", _resolve(F.lag("fixed").over(by_line),
                                        F.lag("flipped", 1, False).over(by_line),
                                        F.col("block_in")))
        .withColumn("nth", F.sum((~F.col("line_in")).cast("bigint")).over(by_line)))
    earlier = over_file.rowsBetween(Window.unboundedPreceding, -1)
    before = starts.groupBy(*in_block).agg(F.max("nth").alias("n")).select(
        *in_block, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"))
    placed = starts.join(before, in_block).withColumn(
        "row_idx", (F.col("rows_before") + F.col("nth") - 1).cast("bigint"))
    sizes = placed.groupBy("source_file", "row_idx").agg(
        F.sum(F.length("line") + 1).alias("n"))
    endless = materialize(sizes.filter(F.col("n") > MAX_ROW_CHARS).select(
        "source_file", F.lit(True).alias("endless")).distinct(), "endless-rows")
    rows = (
        placed.join(endless, "source_file", "left_anti").groupBy("source_file", "row_idx")
        .agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("parts"))
        .select("source_file", "row_idx",
                _drop_cr(F.array_join("parts.line", "\n")).alias("row")))
    return rows, endless
