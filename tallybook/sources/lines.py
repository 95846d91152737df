"""Text files as numbered lines, without giving any file to one task.

Spark splits a big text file into blocks. Within a block rows keep their order,
so a line's number is (lines in earlier blocks of the file) + (its place in the
block). The first pass counts lines per block, a small table; the second joins
that table back to the lines, by broadcast while its row count allows. The lines
themselves are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

# One row per 128 MB of text: a million rows of under 200 bytes describe 128 TB.
MAX_BROADCAST_BLOCKS = 1_000_000


def plain_path(uri: Column) -> Column:
    """A file's path as listed, from its percent-encoded URI."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def raw_lines(spark: SparkSession, paths, glob: str | None = None,
              larger_than: int | None = None) -> DataFrame:
    """Lines split at \\n only; ``value`` holds the file's bytes unchecked.

    ``larger_than`` keeps files above that size; it prunes files, not lines.
    """
    reader = spark.read.option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(paths)
    if larger_than is not None:
        lines = lines.filter(F.col("_metadata.file_size") > larger_than)
    return lines.select(
        plain_path(F.col("_metadata.file_path")).alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        "value")


@dataclass(frozen=True)
class Blocks:
    table: DataFrame
    count: int

    def beside(self, df: DataFrame) -> DataFrame:
        """The table as the right side of a join with ``df`` on (file, block).

        A block is at most one input split, so without broadcast the shuffled
        groups are even whatever the file sizes.
        """
        return F.broadcast(df) if self.count <= MAX_BROADCAST_BLOCKS else df


def count_blocks(lines: DataFrame, **facts: Column) -> Blocks:
    """Lines per block and before it, plus aggregate ``facts`` per block."""
    counted = materialize(
        lines.groupBy("source_file", "block").agg(
            F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n_lines"),
            *[c.alias(n) for n, c in facts.items()]),
        "blocks")
    earlier = (Window.partitionBy("source_file").orderBy("block")
               .rowsBetween(Window.unboundedPreceding, -1))
    table = counted.withColumn(
        "lines_before", F.coalesce(F.sum("n_lines").over(earlier), F.lit(0)))
    return Blocks(table, counted.count())


def number_lines(lines: DataFrame, blocks: Blocks, *extra: str) -> DataFrame:
    """``lines`` with ``line_no`` (0-based in the file) and ``extra`` block columns.

    Both passes must see the same splits. If a setting changed in between, the
    places do not fit and the job fails rather than misnumber.
    """
    # One joined column, so a missing or misplaced block cannot go unnoticed.
    side = blocks.beside(blocks.table.select(
        "source_file", "block", "first_seq", "n_lines", "lines_before", *extra))
    joined = lines.join(side, ["source_file", "block"], "left")
    place = F.col("seq") - F.col("first_seq")
    fits = place.between(F.lit(0), F.col("n_lines") - 1)
    line_no = F.when(fits, F.col("lines_before") + place).otherwise(
        F.raise_error(F.lit("input splits changed between the two passes")))
    return joined.select("source_file", "block", line_no.cast("bigint").alias("line_no"),
                         "value", *extra)
