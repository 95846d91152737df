"""Intermediate tables in the shared folder, without leaving their shuffles behind."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import materialize

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """Set a session option, and put back what was there."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table that later steps read; the shuffles it took are then removed.

    A lost executor cannot take the table with it, so they are not needed again.
    """
    with setting(df.sparkSession, DROP_SHUFFLES, "true"):
        return materialize(df, name)
