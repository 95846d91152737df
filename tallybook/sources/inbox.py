"""The inbox: which files are there, what is in them, which are done."""

from __future__ import annotations

import hashlib
import sys

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ledger import processed_lookup
from .listing import FILE_FACTS, list_files
from .tables import read_or_empty
from .workbook import as_uri

# Executors get this module's functions with the job, not by importing it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Suffixes the inbox shows; those that can be read; temp-file mark.
LISTED = (".xlsx", ".csv", ".xls")
READABLE = (".xlsx", ".csv")
TEMP_PREFIX = "~$"

OLD_FORMAT_WARNING = "old .xls format is not supported; save the file as .xlsx"

# ``binaryFile`` loads a file whole, and no file above 2 GB at all. The digest is
# the same on either side of the line.
WHOLE_BELOW = 512 << 20
HASH_CHUNK = 8 << 20


def list_inbox(spark: SparkSession, folder: str) -> DataFrame:
    """Facts about the listed files, without opening any.

    (path, name, format, length, size_kb, mtime, modified, supported)
    """
    name = F.regexp_extract("path", r"[^/]+\z", 0)
    suffix = F.lower(F.regexp_extract(F.col("name"), r"(?s).(\.[^.]+)\z", 1))
    return (
        list_files(spark, folder)
        .select("path", name.alias("name"), "length", "modificationTime")
        .withColumn("format", suffix)
        .filter(F.col("format").isin(*LISTED) & ~F.col("name").startswith(TEMP_PREFIX))
        .select("path", "name", "format", "length",
                F.bround(F.col("length") / 1024, 1).alias("size_kb"),
                F.date_format("modificationTime", "yyyy-MM-dd HH:mm").alias("mtime"),
                F.col("modificationTime").alias("modified"),
                F.col("format").isin(*READABLE).alias("supported")))


def content_hashes(spark: SparkSession, paths, *, whole_below: int = WHOLE_BELOW) -> DataFrame:
    """(path, sha256): the hex SHA-256 of each file's bytes, whatever its size.

    Spark loads and hashes files of up to ``whole_below`` bytes. A larger one is
    streamed through the same digest in chunks by one task: a digest is one
    sequential pass by nature, and takes no memory to speak of. So are the files
    that Spark's sources leave out.
    """
    loaded = read_or_empty(spark, paths, FILE_FACTS, "binaryFile")
    small = loaded.filter(F.col("length") <= whole_below).select(
        "path", F.sha2("content", 256).alias("sha256"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = list_files(spark, paths).filter(
        (F.col("length") > whole_below) | left_out(F.col("path"), F.col("length"))).select("path")
    return small.unionByName(rest.repartition(tasks, "path").mapInArrow(
        _stream_hashes, "path string, sha256 string"))


def left_out(path: Column, length: Column) -> Column:
    """Whether Spark's file sources do not show a file."""
    return (length == 0) | is_hidden(path)


def is_hidden(path: Column) -> Column:
    return path.rlike(r"/[_.][^/]*\z")


def _stream_hashes(batches):
    for batch in batches:
        for path in batch.column(0).to_pylist():
            digest = hashlib.sha256()
            system, inner = fs.FileSystem.from_uri(as_uri(path))
            with system.open_input_stream(inner) as file:
                while chunk := file.read(HASH_CHUNK):
                    digest.update(chunk)
            yield pa.RecordBatch.from_pylist([{"path": path, "sha256": digest.hexdigest()}])


def scan_inbox(spark: SparkSession, folder: str, processed: DataFrame) -> DataFrame:
    """Every listed file with its hash and whether it was settled before.

    Files in the old format are listed with a warning and never hashed.
    """
    files = list_inbox(spark, folder)
    hashes = content_hashes(spark, folder)
    hashed = files.join(hashes, "path", "left").withColumn(
        "sha256", F.when(F.col("supported"), F.col("sha256")))
    return processed_lookup(hashed, processed).select(
        "path", "name", "format", "size_kb", "mtime", "sha256",
        F.coalesce("processed", F.lit(False)).alias("processed"), "processed_batch",
        F.when(~F.col("supported"), OLD_FORMAT_WARNING).alias("warning")).orderBy("path")


def pending_files(scanned: DataFrame) -> DataFrame:
    """Readable files whose content was not settled yet, in order."""
    return scanned.filter(F.col("format").isin(*READABLE) & ~F.col("processed")).orderBy("name")


def inbox_totals(scanned: DataFrame) -> DataFrame:
    """One row: how many readable files there are, and how many are pending."""
    readable = F.col("format").isin(*READABLE)
    return scanned.agg(
        F.count_if(readable).alias("inbox_total"),
        F.count_if(readable & ~F.col("processed")).alias("inbox_pending"))
