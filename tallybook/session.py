"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Runtime SQL settings for reading GBK text: the charset itself, and U+FFFD in
# place of an error for bytes that are not valid in it.
CHARSET_CONF = {
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.legacy.codingErrorAction": "true",
}


def build_session(app: str = "tallybook", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **CHARSET_CONF,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


@contextmanager
def setting(spark: SparkSession, **conf: str):
    """Set runtime options (dots as ``__``), and put back what was there before."""
    wanted = {key.replace("__", "."): value for key, value in conf.items()}
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def charset_settings(spark: SparkSession):
    """The options that reading GBK text needs, for as long as a job runs."""
    return setting(spark, **{k.replace(".", "__"): v for k, v in CHARSET_CONF.items()})


# One shuffle partition per this many input bytes; AQE merges small ones.
SHUFFLE_BYTES = 128 << 20
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def wanted_partitions(spark: SparkSession, *inputs: DataFrame) -> int:
    """Shuffle partitions to start with: enough for the inputs, never fewer than set."""
    now = int(spark.conf.get(INITIAL_PARTITIONS, None)
              or spark.conf.get("spark.sql.shuffle.partitions"))
    return max(now, sum(input_bytes(df) or 0 for df in inputs) // SHUFFLE_BYTES)


def sized_shuffles(spark: SparkSession, *inputs: DataFrame):
    """While a job runs, start its shuffles with enough partitions for the inputs.

    The default of 200 would make partitions of half a terabyte out of 100 TB.
    Adaptive execution merges what turns out small, so a high start is cheap.
    The session keeps its own setting afterwards.
    """
    key = INITIAL_PARTITIONS.replace(".", "__")
    return setting(spark, **{key: str(wanted_partitions(spark, *inputs))})


_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage, as the session names it.

    Only a local session without the setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with the machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="tallybook-")
    return _LOCAL_ROOTS[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/tallybook/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the table.

    Later readers prune columns and skip the work above; a lost executor costs
    no recomputation beyond the table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``materialize``, with aggregates over the rows collected by the job that writes them.

    Tasks report with their part of the table, so one that is repeated counts once.
    """
    spark = df.sparkSession
    path, seen = scratch_path(spark, name), Observation()
    watched = df.observe(seen, *[c.alias(n) for n, c in metrics.items()])
    watched.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get


# What Catalyst says of a relation whose size it does not know.
UNKNOWN_BYTES = (1 << 63) - 1


def input_bytes(df: DataFrame) -> int | None:
    """Catalyst's size of everything ``df`` scans; None when it cannot tell."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    except Exception:  # no JVM handle (remote session) or no statistics
        return None
    return None if any(s >= UNKNOWN_BYTES for s in sizes) else sum(sizes)
