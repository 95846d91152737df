"""What reconciling asks of the ledger, aggregated once per commit.

``facts/`` under the ledger root is a table partitioned by commit and bucketed by
uid: for each (uid, order) of a commit, whether it is settled and its newest
reference amount. Both merge, so the facts of all commits are those of the whole
ledger, and the buckets let a batch be joined with years of commits without
shuffling or reading one entry again. A commit's facts are written before the row
that makes it visible. Merging twice changes nothing, so neither does a repeated
write. Commits made without facts get theirs when they are next asked for.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.classify import ledger_by_order
from ..schemas import PARSED
from ..session import setting
from .tables import read_or_empty

FACTS = T.StructType([
    T.StructField("uid", T.StringType()),
    T.StructField("order_key", T.StringType()),
    T.StructField("settled", T.BooleanType()),
    T.StructField("ref", PARSED),
    T.StructField("ref_age", T.DecimalType(38, 0)),
])
LAYOUT = T.StructType([T.StructField("buckets", T.IntegerType())])
FACT_BUCKETS = 64


def co_located(spark: SparkSession):
    """While a job is planned, let a join by (uid, order) use buckets by uid alone."""
    return setting(spark, spark__sql__requireAllClusterKeysForCoPartition="false")


def merge_facts(facts: DataFrame) -> DataFrame:
    """One row per (uid, order) from those of several commits."""
    return facts.groupBy("uid", "order_key").agg(
        F.bool_or("settled").alias("settled"), F.max_by("ref", "ref_age").alias("ref"),
        F.max("ref_age").alias("ref_age"))


class FactTable:
    """The facts of a ledger folder. The bucket count is fixed when it is first written."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = FACT_BUCKETS):
        self.spark, self.root, self.wanted = spark, root, buckets
        self.name = "ledger_facts_" + hashlib.sha256(root.encode()).hexdigest()[:16]

    def buckets(self) -> int:
        row = read_or_empty(self.spark, f"{self.root}/facts_layout", LAYOUT).first()
        if row is None:
            self.spark.createDataFrame([(self.wanted,)], LAYOUT).coalesce(1).write.mode(
                "overwrite").parquet(f"{self.root}/facts_layout")
            return self.wanted
        return row["buckets"]

    def open(self) -> DataFrame:
        """The table as this session's catalog knows it, with all commits on disk."""
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FACTS)
        location = f"{self.root}/facts".replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, commit_seq bigint) USING parquet "
            f"PARTITIONED BY (commit_seq) CLUSTERED BY (uid) INTO {self.buckets()} BUCKETS "
            f"LOCATION '{location}'")
        if read_or_empty(self.spark, f"{self.root}/facts", FACTS).inputFiles():
            self.spark.catalog.recoverPartitions(self.name)
        return self.spark.table(self.name)

    def add(self, entries: DataFrame) -> None:
        """Write the facts of ``entries``, of one commit or of several."""
        table = self.open()
        facts = (ledger_by_order(entries, ["commit_seq"]).select(*table.columns)
                 .repartition(self.buckets(), "uid"))
        with setting(self.spark, spark__sql__sources__partitionOverwriteMode="dynamic"):
            facts.write.mode("overwrite").insertInto(self.name)

    def commits(self) -> set[int]:
        """Commits that have facts, by their folders."""
        self.open()
        shown = self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()
        return {int(r["partition"].split("=")[1]) for r in shown}

    def upto(self, last: int) -> DataFrame:
        return merge_facts(self.open().filter(F.col("commit_seq") <= last))
