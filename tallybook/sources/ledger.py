"""The ledger: entries, processed files and commits as Parquet tables.

Layout under the ledger root, one folder per commit number in each table::

    entries/commit_seq=7/      rows
    processed/commit_seq=7/    files settled by this commit
    facts/commit_seq=7/        what reconciling asks of its entries (see ``facts``)
    commits/commit_seq=7/      one row, written last

A commit becomes visible with its row in ``commits``; readers ignore higher
numbers. A run that died before that row leaves folders nobody reads, and the
next run takes the same number and overwrites them, so nothing is paid twice.
There is one writer at a time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.money import round_amount
from ..functions.text import strip_ws
from ..schemas import COMMITS, ENTRIES, MONEY, PROCESSED, SETTLED
from .facts import FACT_BUCKETS, FACTS, FactTable
from .tables import empty_table, read_or_empty

ENTRY_VALUES = [f.name for f in ENTRIES.fields if f.name != "commit_seq"]


@dataclass(frozen=True)
class Commit:
    commit_seq: int
    n_entries: int
    amount: Decimal


class Ledger:
    """A ledger folder. Opening one that does not exist reads as empty.

    ``fact_buckets`` is used when the ledger is first written: as many tasks join
    a batch with the ledger later, so take one per 128 MB of facts to come.
    """

    def __init__(self, spark: SparkSession, root: str, fact_buckets: int = FACT_BUCKETS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.fact_table = FactTable(spark, self.root, fact_buckets)

    # ---- reading
    def commits(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.root}/commits", COMMITS)

    def last_commit(self) -> int:
        """Newest commit number, read off the folder names without a job."""
        return max(self._numbers(), default=0)

    def _numbers(self, upto: int | None = None) -> list[int]:
        found = re.findall(r"/commit_seq=(\d+)/", "\n".join(self.commits().inputFiles()))
        return [n for n in map(int, found) if upto is None or n <= upto]

    def _visible(self, table: str, schema, upto: int | None) -> DataFrame:
        last = self.last_commit() if upto is None else upto
        if last == 0:
            return empty_table(self.spark, schema)
        rows = read_or_empty(self.spark, f"{self.root}/{table}", schema)
        return rows.filter(F.col("commit_seq") <= last)

    def entries(self, upto: int | None = None) -> DataFrame:
        return self._visible("entries", ENTRIES, upto)

    def processed(self, upto: int | None = None) -> DataFrame:
        return self._visible("processed", PROCESSED, upto)

    def facts(self, upto: int | None = None) -> DataFrame:
        """(uid, order_key, settled, ref, ref_age) of all visible entries, bucketed by uid.

        Equal to the aggregate over ``entries``; only commits that were written
        without facts are read, once, to add them.
        """
        last = self.last_commit() if upto is None else upto
        if last == 0:
            return empty_table(self.spark, FACTS)
        lacking = set(self._numbers(last)) - self.fact_table.commits()
        if lacking:
            self.fact_table.add(self.entries(last).filter(F.col("commit_seq").isin(*lacking)))
        return self.fact_table.upto(last)

    # ---- writing
    def append(self, kind: str, batch_id: str, entries: DataFrame, *, at: datetime,
               processed: DataFrame | None = None) -> Commit:
        """Add one commit. ``entries`` have the entry columns but commit_seq.

        Amounts are rounded to cents, half up, whatever the rules say; a
        missing order number becomes '' (any order).
        """
        seq = self.last_commit() + 1
        where = f"{self.root}/{{}}/commit_seq={seq}"
        # Sorted inside each file and with a Bloom filter, so that a question
        # about one uid skips nearly all row groups; no shuffle for it.
        seen = Observation()
        rows = entry_columns(entries).sortWithinPartitions("uid").observe(
            seen, F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum("amount"), F.lit(0).cast(MONEY)).cast(MONEY).alias("s"))
        rows.write.mode("overwrite").option(
            "parquet.bloom.filter.enabled#uid", "true").parquet(where.format("entries"))
        if processed is not None:
            processed.select("sha256", "filename", "batch_id", "processed_at").write.mode(
                "overwrite").parquet(where.format("processed"))
        written = self.spark.read.schema(ENTRIES).parquet(where.format("entries"))
        self.fact_table.add(written.withColumn("commit_seq", F.lit(seq).cast("bigint")))
        done = seen.get  # of the tasks whose files were committed, each once
        row = [(kind, batch_id, done["n"], done["s"], at)]
        self.spark.createDataFrame(row, COMMITS[1:]).coalesce(1).write.mode(
            "errorifexists").parquet(where.format("commits"))
        return Commit(seq, done["n"], done["s"])


def entry_columns(rows: DataFrame) -> DataFrame:
    """``rows`` cast to the entry layout; absent columns get their defaults."""
    types = {f.name: f.dataType for f in rows.schema.fields}
    defaults = {"file_seq": F.lit(0), "row_no": F.lit(0), "order_no": F.lit(""),
                "batch_id": F.lit(None), "source_file": F.lit(""), "note": F.lit(""),
                "created_at": F.lit(None)}
    out = []
    for field in ENTRIES.fields[1:]:
        c = F.col(field.name) if field.name in types else defaults[field.name]
        if field.name == "amount":
            c = round_amount(c, 2)
        elif field.name == "order_no":
            c = F.coalesce(c, F.lit(""))
        out.append(c.cast(field.dataType).alias(field.name))
    return rows.select(*out)


def payable_entries(items: DataFrame) -> DataFrame:
    """Items that can be settled: an amount and an id that is not blank."""
    uid = strip_ws(F.col("uid"))
    return (items.filter(F.col("amount").isNotNull() & (uid != ""))
            .withColumn("uid", uid).withColumn("status", F.lit(SETTLED)))


def processed_lookup(files: DataFrame, processed: DataFrame) -> DataFrame:
    """``files`` (with sha256) plus whether and in which batch each was settled.

    A forced re-run may register a content once only, so the register has one
    row per sha256.
    """
    known = processed.select("sha256", F.col("batch_id").alias("processed_batch"),
                             F.col("processed_at"))
    return files.join(known, "sha256", "left").withColumn(
        "processed", F.col("processed_at").isNotNull())


def query_ledger(entries: DataFrame, uid: str | None = None, limit: int = 50) -> DataFrame:
    """The newest entries, of one uid (taken as written) or of all."""
    rows = entries.filter(F.col("uid") == uid) if uid else entries
    order = [F.col(c).desc() for c in ("commit_seq", "file_seq", "row_no") if c in rows.columns]
    return rows.orderBy(*order).limit(limit)


def ledger_stats(entries: DataFrame, processed: DataFrame) -> DataFrame:
    """One row: entries, settled entries and their amount, processed files."""
    settled = F.col("status") == SETTLED
    amount = F.when(settled, F.col("amount")).cast(MONEY)
    rows = entries.select(F.lit(True).alias("is_entry"), settled.alias("settled"),
                          amount.alias("amount"))
    files = processed.select(F.lit(False).alias("is_entry"), F.lit(False).alias("settled"),
                             F.lit(None).cast(MONEY).alias("amount"))
    return rows.unionAll(files).agg(
        F.count_if("is_entry").alias("entries"), F.count_if("settled").alias("settled"),
        F.coalesce(F.sum("amount"), F.lit(0)).cast(MONEY).alias("settled_amount"),
        F.count_if(~F.col("is_entry")).alias("processed_files"))
