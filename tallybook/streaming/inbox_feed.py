"""The inbox as a stream: reconcile files as they arrive.

The file source remembers paths, the ledger's register remembers contents: a
copy of an old file under a new name is reconciled again, but apply refuses it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..rules import Rules
from ..sources.inbox import FILE_FACTS, READABLE, TEMP_PREFIX
from ..sources.ledger import Ledger
from ..plans.pipelines import NoData, reconcile_folder

# Paths of one micro-batch are collected; this bounds how many there are.
MAX_FILES_PER_BATCH = 1000


def start_inbox_feed(spark: SparkSession, folder: str, ledger: Ledger, report_root: str,
                     checkpoint: str, *, mapping, rules: Rules = Rules(),
                     available_now: bool = True) -> StreamingQuery:
    """Store one report per micro-batch at ``report_root/batch=<id>``.

    A batch that is repeated after a failure overwrites its own report.
    """
    name = F.lower(F.regexp_extract("path", r"[^/]+\z", 0))
    readable = name.endswith(READABLE[0]) | name.endswith(READABLE[1])
    arrivals = (
        spark.readStream.format("binaryFile").schema(FILE_FACTS)
        .option("maxFilesPerTrigger", MAX_FILES_PER_BATCH).load(folder)
        .filter(readable & ~name.startswith(TEMP_PREFIX)).select("path"))

    def settle_batch(batch: DataFrame, batch_id: int) -> None:
        paths = [r["path"] for r in batch.collect()]
        if not paths:
            return
        try:
            reconcile_folder(spark, paths, ledger, f"{report_root}/batch={batch_id}",
                             rules=rules, mapping=mapping)
        except NoData:
            return

    writer = arrivals.writeStream.foreachBatch(settle_batch).option(
        "checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
