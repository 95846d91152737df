"""Stored reports: one table of items by bucket, one summary row per file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null
from ..operators.classify import ITEM_COLUMNS, bucket_label, bucket_rank
from ..schemas import BUCKETS, TO_SETTLE

REQUIRED_ITEMS = ("source_file", "row_no", "bucket", "uid", "order_no", "amount")
REQUIRED_SUMMARY = ("source_file", "batch_id", "file_sha256", *BUCKETS, "to_settle_amount")


JSON_ITEMS = T.StructType([
    T.StructField(c, T.LongType() if c in ("row_no", "first_row") else T.StringType())
    for c in ITEM_COLUMNS])


class NotAReport(ValueError):
    """The folder lacks something every report has."""


@dataclass(frozen=True)
class Report:
    """``summary`` has the header and the counts of each file, zeros included."""

    items: DataFrame
    summary: DataFrame


def batch_id(run_date: Column, sha256: Column) -> Column:
    """Label of one file's run: date and the first 8 digits of its hash."""
    return F.concat(F.date_format(run_date, "yyyyMMdd"), F.lit("-"), short_hash(sha256))


def short_hash(sha256: Column, n: int = 8) -> Column:
    return F.left(sha256, F.lit(n))


def _as_text(df: DataFrame, fmt: str) -> DataFrame:
    """JSON and CSV carry decimals as text, so no reader makes floats of them."""
    if fmt == "parquet":
        return df
    return df.select(*[F.col(f.name).cast("string").alias(f.name)
                       if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
                       for f in df.schema.fields])


def write_report(report: Report, path: str, fmt: str = "parquet") -> None:
    """Replace the report at ``path``; items lie in one folder per bucket."""
    items = _as_text(report.items, fmt)
    items.write.mode("overwrite").partitionBy("bucket").format(fmt).save(f"{path}/items")
    _as_text(report.summary, fmt).write.mode("overwrite").format(fmt).save(
        f"{path}/summary")


def read_report(spark: SparkSession, path: str, fmt: str = "parquet", places: int = 2) -> Report:
    """Open a stored report and check that it is one."""
    money = T.DecimalType(38, places)

    def load(part: str, required: tuple[str, ...], decimals: tuple[str, ...]) -> DataFrame:
        reader = spark.read.format(fmt)
        if fmt == "json" and part == "items":  # inferring would read everything
            reader = reader.schema(JSON_ITEMS)
        try:
            df = reader.load(f"{path}/{part}")
        except AnalysisException as e:
            raise NotAReport(f"{path} has no readable {part}") from e
        missing = [c for c in required if c not in df.columns]
        if missing:
            raise NotAReport(f"the {part} at {path} lack the columns {missing}")
        return df.withColumns({c: F.col(c).cast(money) for c in decimals if c in df.columns})

    return Report(load("items", REQUIRED_ITEMS, ("amount", "ref_amount")),
                  load("summary", REQUIRED_SUMMARY, ("to_settle_amount",)))


def review_extract(items: DataFrame) -> DataFrame:
    """What a reviewer sees per item, with the bucket's label and rank."""
    return items.select(
        bucket_rank(F.col("bucket")).alias("bucket_rank"),
        bucket_label(F.col("bucket")).alias("bucket_label"),
        "bucket", "source_file", "row_no",
        F.coalesce(blank_to_null(F.col("uid")), F.col("raw_uid")).alias("uid"),
        F.coalesce("order_no", F.lit("")).alias("order_no"),
        "amount", "ref_amount", "date", "name", "reason")


def in_report_order(items: DataFrame) -> DataFrame:
    """Buckets in their fixed order, rows in sheet order. For sinks only."""
    return items.orderBy(bucket_rank(F.col("bucket")), "source_file", "row_no")


def write_review(report: Report, path: str) -> None:
    """Review tables as CSV, one folder per bucket, plus the summary facts.

    The range-partitioned sort splits a large bucket or file over many tasks;
    part files follow each other in sheet order.
    """
    (review_extract(report.items).orderBy("bucket_rank", "source_file", "row_no")
     .drop("bucket_rank").write.mode("overwrite").partitionBy("bucket")
     .option("header", "true").csv(f"{path}/items"))
    summary_facts(report.summary).write.mode("overwrite").option("header", "true").csv(
        f"{path}/summary")


def summary_facts(summary: DataFrame) -> DataFrame:
    """The summary in long form: (source_file, fact_no, fact, value), 11 per file."""
    name = F.regexp_extract("source_file", r"[^/]*\z", 0)
    facts = [("source_file", name), ("batch_id", F.col("batch_id")),
             ("generated_at", F.col("generated_at").cast("string")),
             ("total_rows", F.col("total_rows")), (TO_SETTLE, F.col(TO_SETTLE)),
             ("to_settle_amount", F.col("to_settle_amount")),
             *[(b, F.col(b)) for b in BUCKETS if b != TO_SETTLE]]
    rows = F.array(*[F.struct(F.lit(i + 1).alias("fact_no"), F.lit(n).alias("fact"),
                              c.cast("string").alias("value")) for i, (n, c) in enumerate(facts)])
    return summary.select("source_file", F.inline(rows))
