"""A training corpus from raw documents, in five stages.

``run(spark, sf_dir)`` applies them to ``documents``; each stage's rows are
written as Parquet and read again by the next. All but the last return the
columns of documents; the last returns what the token files read back as. The
files are in id order; each copy has its training position, which the mix leaves
in a table of its own, named in the metadata of ``doc_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import decontaminate, mixing, neardup, tokens, toxicity
from tallybook.llm.queries import tokenizer_path
from tallybook.llm.staging import stage
from tallybook.session import scratch_path

POSITIONS = "training_positions"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the least id."""
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_contaminated(
        docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes, in training order; the last copy of a source is cut."""
    mixed, positions = mixing.mixed_with_positions(docs)
    path = scratch_path(spark, "pipeline-positions")
    positions.write.mode("errorifexists").parquet(path)
    return mixed.withMetadata("doc_id", {POSITIONS: path})


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, as read back, with the training position of each copy.

    Rows that no mix has planned have none.
    """
    path = docs.schema["doc_id"].metadata.get(POSITIONS)
    rows = docs.select("doc_id", "text", "source")
    if path is None:
        rows = rows.withColumn("position", F.lit(None).cast("double"))
    else:
        rows = mixing.with_positions(rows, spark.read.parquet(path), "position")
    return tokens.read_frames(tokens.write_frames(
        rows, scratch_path(spark, "pipeline-frames"), tokenizer_path(), position=True))


STAGES = [("toxicity", drop_toxic), ("near-dedup", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("mixing", mix_sources),
          ("tokens", write_tokens)]

ORACLE_SQL = None  # SQL can express neither the model nor the tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
