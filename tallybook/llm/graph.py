"""Connected components by alternating large and small stars, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .staging import stage


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star step, then one small-star step, on (a, b) with a > b.

    A node's least neighbour is that of its links to smaller ones, so a star's centre
    has none to look up. ``moved`` marks rows that a step changed; they may repeat.
    """
    least = edges.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m"))
    large = edges.join(least, edges["b"] == least["of"], "left").select(
        "a", F.coalesce("m", "b").alias("b"), F.col("m").isNotNull().alias("moved"))
    large = large.repartition("a").groupBy("a", "b").agg(F.max("moved").alias("moved"))
    small = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    first = F.col("b") == F.col("m")
    return small.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"),
                        F.col("m").alias("b"), (F.col("moved") | ~first).alias("moved"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each linked node reaches, itself included.

    Every step leaves a table; the links become stars within about log(n) steps, and a
    step that moves none has left out repeated ones.
    """
    current = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .where("a <> b"), "links")
    moved = 1
    while moved:
        seen = Observation()
        current = stage(_stars(current).observe(seen, F.count_if("moved").alias("moved")),
                        "stars").drop("moved")
        moved = seen.get["moved"]
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component")))
