"""Registered queries of the numbered operators: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (chat, collocations, decontaminate, fingerprints, hardneg, licenses, mixing, neardup,
               packing, quality, substrings, tokens, toxicity)

CHAT_CONTROL = -7  # conversation that says control strings of the template


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A vocabulary of the installed public tokenizers."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_neardup(spark, sf):
    return neardup.near_duplicates(_table(spark, sf, "documents"), shingle=3, threshold=(85, 100))


def op2_mixing(spark, sf):
    return mixing.mix_counts(mixing.mix_plan(_table(spark, sf, "documents")))


def op3_chat(spark, sf):
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(CHAT_CONTROL, 0, "user", said),
                                  (CHAT_CONTROL, 1, "assistant", said)],
                                 "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return chat.conversation_digests(chat.format_conversations(rows.union(more)))


def op4_toxicity(spark, sf):
    return toxicity.toxicity_scores(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op5_substrings(spark, sf):
    return substrings.removal_counts(_table(spark, sf, "documents"))


def op6_decontaminate(spark, sf):
    return decontaminate.contamination(_table(spark, sf, "documents"),
                                       _table(spark, sf, "benchmark"))


def op7_licenses(spark, sf):
    return licenses.license_matches(_table(spark, sf, "documents"),
                                    licenses.template_table(spark))


def op8_quality(spark, sf):
    return quality.quality_scores(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op9_tokens(spark, sf):
    frames = tokens.write_frames(_table(spark, sf, "documents"),
                                 scratch_path(spark, "token-frames"), tokenizer_path())
    return tokens.read_frames(frames)


def op10_fingerprints(spark, sf):
    return fingerprints.edited_fingerprints(_table(spark, sf, "documents"))


def op11_collocations(spark, sf):
    return collocations.collocations(_table(spark, sf, "documents"))


def op12_packing(spark, sf):
    table = packing.token_pieces(_table(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.json"))
    packed = packing.pack(table.withColumn("ids_crc32", F.crc32("ids")))
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"),
                         "ids_crc32", "sequence_id", "offset")


def op13_hard_negatives(spark, sf):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf, "embeddings").select(
        "vec_id", label.alias("label"), F.col("embedding").alias("vector"))
    return hardneg.hard_negatives(rows, F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (
    op1_neardup, op2_mixing, op3_chat, op4_toxicity, op5_substrings, op6_decontaminate,
    op7_licenses, op8_quality, op9_tokens, op10_fingerprints,
    op11_collocations, op12_packing, op13_hard_negatives)}
