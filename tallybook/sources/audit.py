"""Append-only audit log as JSON lines."""

from __future__ import annotations

import json
import time
from datetime import datetime
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_ws
from .lines import plain_path


def append_audit(spark: SparkSession, path: str, action: str, *, at: datetime | None = None,
                 **detail) -> dict:
    """Write one event. Events sort by the time in their file's folder name."""
    event = {"ts": (at or datetime.now()).isoformat(timespec="seconds"), "action": action, **detail}
    line = json.dumps(event, ensure_ascii=False, default=str)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("errorifexists").text(
        f"{path}/seq={time.time_ns():020d}")
    return event


def append_audit_rows(rows: DataFrame, path: str, action: str, *,
                      at: datetime | None = None) -> None:
    """Write one event per row, its columns as facts; of many files as of one."""
    head = {"ts": (at or datetime.now()).isoformat(timespec="seconds"), "action": action}
    text = [F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.DecimalType)
            else F.col(f.name) for f in rows.schema.fields]
    line = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in head.items()], *text),
                     {"ignoreNullFields": "false"})
    rows.select(line.alias("value")).write.mode("errorifexists").text(
        f"{path}/seq={time.time_ns():020d}")


def audit_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All log lines with their place: (file, block, seq, value)."""
    try:
        lines = spark.read.option("recursiveFileLookup", "true").text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file string, block long, seq long, value string")
    return lines.select(plain_path(F.col("_metadata.file_path")).alias("file"),
                        F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("seq"), "value")


FIRST_FILES = 8  # files opened at first for a tail


def audit_tail(spark: SparkSession, path: str, limit: int = 10) -> DataFrame:
    """The last ``limit`` lines in file order, parsed.

    Blank lines count against the limit and are then dropped; a line that is
    not JSON comes back in ``raw``. Files are opened from the newest backwards,
    four times as many each time, until they hold enough lines.
    """
    return tail_of(newest_lines(spark, path, limit), limit, ["file", "block", "seq"])


def newest_lines(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """The lines of the newest files that hold ``limit`` lines together, or all."""
    lines = audit_lines(spark, path)
    # the names are listed, the files not opened
    files = sorted(lines.inputFiles(), key=lambda f: unquote(f))
    many = FIRST_FILES
    while many < len(files):
        newest = audit_lines(spark, files[-many:])
        if newest.limit(limit).count() >= limit:
            return newest
        many *= 4
    return lines


def tail_of(lines: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """``audit_tail`` over any table of lines sorted by ``order``."""
    last = lines.orderBy(*[F.col(c).desc() for c in order]).limit(max(limit, 0))
    line = strip_ws(F.col("value"))
    bad = F.try_parse_json("line").isNull()
    return (
        last.withColumn("line", line).filter(F.col("line") != "")
        .select(*order,
                F.get_json_object("line", "$.ts").alias("ts"),
                F.get_json_object("line", "$.action").alias("action"),
                F.when(~bad, F.col("line")).alias("detail"),
                F.when(bad, F.col("line")).alias("raw"))
        .orderBy(*order))
