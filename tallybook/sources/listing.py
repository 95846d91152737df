"""Folder listings as a partitioned data source that shows every file.

Spark's file sources leave out empty files and names that start with ``_`` or
``.``; an inbox has to show them. Each folder is a partition of its own: the one
given, and below it those named ``key=value``, as Spark's sources find them.
Nothing is opened. Folders that Arrow's file systems cannot reach, and patterns,
are listed by Spark's own source, without those files.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .tables import read_or_empty

# Executors get this module's classes with the job, not by importing it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTING = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType())])

# The layout of Spark's binaryFile source.
FILE_FACTS = T.StructType([*LISTING.fields, T.StructField("content", T.BinaryType())])

PATTERN = re.compile(r"[*?{}\[\]\\]")


def arrow_path(path: str) -> str:
    """``file:/x`` is Hadoop's spelling of a local path."""
    return re.sub(r"\Afile:/+", "/", path)


def spark_path(place: str, inner: str) -> str:
    """The path of a found file as Spark spells it; ``place`` is the folder asked for."""
    parts = urlsplit(place)
    if not parts.scheme or parts.scheme == "file":
        return f"file:{inner}"
    host = parts.netloc
    return f"{parts.scheme}://{inner if inner.startswith(host + '/') else host + inner}"


class Place(InputPartition):
    def __init__(self, place: str, inner: str):
        super().__init__(inner)
        self.place, self.inner = place, inner


class FolderReader(DataSourceReader):
    def __init__(self, places: list[str]):
        self.places = places

    def partitions(self) -> list[Place]:
        found = []
        for place in self.places:
            system, inner = fs.FileSystem.from_uri(arrow_path(place))
            below = [inner]
            while below:
                folder = below.pop()
                found.append(Place(place, folder))
                below += [f.path for f in system.get_file_info(
                    fs.FileSelector(folder, allow_not_found=True))
                    if f.type == fs.FileType.Directory and "=" in f.base_name
                    and f.base_name[0] not in "_."] if is_folder(system, folder) else []
        return found

    def read(self, partition: Place) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(arrow_path(partition.place))
        if is_folder(system, partition.inner):
            infos = system.get_file_info(fs.FileSelector(partition.inner, allow_not_found=True))
        else:
            infos = system.get_file_info([partition.inner])
        infos = [f for f in infos if f.type == fs.FileType.File]
        times = [None if f.mtime_ns is None else f.mtime_ns // 1000 for f in infos]
        yield pa.RecordBatch.from_arrays(
            [pa.array([spark_path(partition.place, f.path) for f in infos], pa.string()),
             pa.array(times, pa.timestamp("us", "UTC")),
             pa.array([f.size for f in infos], pa.int64())],
            ["path", "modificationTime", "length"])


def is_folder(system, inner: str) -> bool:
    return system.get_file_info([inner])[0].type == fs.FileType.Directory


class FolderSource(DataSource):
    """``spark.read.format("folder_listing").option("places", json list of folders)``"""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> T.StructType:
        return LISTING

    def reader(self, schema: T.StructType) -> FolderReader:
        return FolderReader(json.loads(self.options["places"]))


def reachable(spark: SparkSession, place: str) -> bool:
    """Whether Arrow's file systems open ``place`` and see what Spark sees there."""
    if PATTERN.search(place):
        return False
    if not urlsplit(place).scheme:
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        if not (default.startswith("file:") and place.startswith("/")):
            return False
    try:
        fs.FileSystem.from_uri(arrow_path(place))
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def list_files(spark: SparkSession, places: str | list[str]) -> DataFrame:
    """(path, modificationTime, length) of every file in the folders, or of files."""
    asked = [places] if isinstance(places, str) else list(places)
    if not all(reachable(spark, p) for p in asked):
        return read_or_empty(spark, places, FILE_FACTS, "binaryFile").drop("content")
    spark.dataSource.register(FolderSource)
    found = spark.read.format("folder_listing").option("places", json.dumps(asked)).load()
    return found.withColumn("modificationTime", F.date_trunc("millisecond", "modificationTime"))
