"""Mixing sources to target weights, as a curriculum over training time.

Sources, by code point and the null source last, weigh ``weights`` in turn and
share ``share`` times all words. A target stops at ``max_repeats`` times its
source; the excess goes to the others by weight. In time 0..1 a source's weight
runs linearly along its ramp. Its documents, in an order set by a hash of their
ids, form a stream of words that is read until the target is met: up to
``max_repeats`` copies of each, the last one cut. A copy trains where the
integral of the ramp reaches the middle of its words.

Stream offsets come from sums per hash bucket, so no source passes one task.
Null texts have no words and are never taken; null sources are one source;
repeated rows are documents of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .staging import stage
from .words import Words, pieces, text_buffers

WEIGHTS = (5.0, 2.0, 1.0)
RAMPS = ((1.0, 1.0), (0.5, 1.5), (1.5, 0.5))
MAX_REPEATS = 3
BUCKET_ROWS = 1024
SIZES = "doc_id long, source string, size long, content long"


def _sizes(batches):
    for piece in pieces(batches):
        words = Words(*text_buffers(piece.column("text")))
        yield pa.RecordBatch.from_arrays(
            [piece.column("doc_id").cast(pa.int64()), piece.column("source").cast(pa.string()),
             pa.array(words.counts, pa.int64()), piece.column("content")],
            ["doc_id", "source", "size", "content"])


def _source_key() -> Column:
    """The source, sorted by code point, the null source last."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("z"))


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]),
                        (index % len(values) + 1).cast("int"))


def source_targets(totals: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS,
                   share: float = 1.0) -> DataFrame:
    """Targets from (key, source_size): rates are cut off where a source runs out.

    Sorted by the rate at which they run out, each source sees what is left for
    it and those after it; the first that does not run out sets the rate of all
    after it.
    """
    by_key = Window.orderBy("key")
    everything = Window.partitionBy()
    ranked = (totals.withColumn("rank", F.row_number().over(by_key) - 1)
              .withColumn("weight", _pick(weights, F.col("rank")))
              .withColumn("cap", F.col("source_size") * float(max_repeats))
              .withColumn("all", F.sum("source_size").over(everything) * float(share)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    left = (F.col("all") - F.coalesce(F.sum("cap").over(
        order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rate = left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    open_ = F.col("cap") / F.col("weight") > F.col("rate")
    return (ranked.withColumn("rate", rate)
            .withColumn("level", F.max(F.when(open_, F.col("rate"))).over(everything))
            .withColumn("target", F.least("cap", F.col("weight") * F.coalesce("level", "rate")))
            .withColumn("target", F.when(open_, F.col("target")).otherwise(F.col("cap")))
            .select("key", "rank", "source_size", "target"))


def mix_plan(docs: DataFrame, weights=WEIGHTS, ramps=RAMPS, max_repeats: int = MAX_REPEATS,
             share: float = 1.0, seed: int = 11) -> DataFrame:
    """A row per document: its copies, each with its training position and its words."""
    sized = materialize(
        docs.select("doc_id", "text", "source", F.xxhash64("text").alias("content")).mapInArrow(_sizes, SIZES)
        .withColumn("key", _source_key())
        .withColumn("place", F.xxhash64("doc_id", "content", F.lit(seed))), "mix-sizes")
    n_buckets = max(1, sized.count() // BUCKET_ROWS)
    sized = sized.withColumn("bucket", F.pmod("place", F.lit(n_buckets)))
    sums = sized.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    targets = source_targets(sums.groupBy("key").agg(F.sum("words").alias("source_size")),
                             weights, max_repeats, share)
    offsets = (sums.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0)))
               .drop("words").join(targets, "key"))
    inside = Window.partitionBy("key", "bucket").orderBy("place", "doc_id", "content")
    placed = (sized.join(offsets, ["key", "bucket"])
              .withColumn("start", F.col("offset") + F.sum("size").over(
                  inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")))
    a, b = _pick([r[0] for r in ramps], F.col("rank")), _pick([r[1] for r in ramps],
                                                              F.col("rank"))

    def copy(k):
        start = F.col("start") + k * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"),
                                             F.floor("target").cast("long") - start))
        u = (start + words / 2) / F.col("target")
        when = u * (a + b) / (a + F.sqrt(a * a + (b * b - a * a) * u))
        return F.struct(k.cast("int").alias("copy"), words.alias("words"),
                        F.when(words > 0, when).alias("position"))

    copies = F.filter(F.array(*[copy(F.lit(k)) for k in range(max_repeats)]),
                      lambda c: c["words"] > 0)
    return placed.select("doc_id", "source", "size", "content", "source_size", "target",
                         "start", copies.alias("copies"))


def mix_counts(plan: DataFrame) -> DataFrame:
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"])
    return plan.select("doc_id", "source", "size", "source_size", "target",
                       taken.alias("taken"), F.size("copies").alias("copies"),
                       F.get("copies", F.lit(0))["position"].alias("first_position"))


def training_order(plan: DataFrame) -> DataFrame:
    """Every copy, range-sorted by training position."""
    return (plan.select("doc_id", "source", "size", "content", F.explode("copies").alias("c"))
            .select("doc_id", "source", "size", "content", "c.copy", "c.words", "c.position")
            .repartitionByRange("position", "doc_id", "copy")
            .sortWithinPartitions("position", "doc_id", "copy"))


def _cut(names, words_column):
    """Texts cut after as many words as a column says; only the named columns stay."""
    def cut(batches):
        for piece in pieces(batches):
            data, at = text_buffers(piece.column("text"))
            words = Words(data, at)
            want = np.asarray(piece.column(words_column))
            short = np.flatnonzero(want < words.counts)
            texts = piece.column("text")
            if len(short):
                out = texts.to_pylist()
                for i in short.tolist():
                    end = words.ends[words.first[i] + want[i] - 1]
                    out[i] = data[at[i]:end].tobytes().decode()
                texts = pa.array(out, texts.type)
            yield pa.RecordBatch.from_arrays(
                [texts if n == "text" else piece.column(n) for n in names], names)
    return cut


def _free(docs: DataFrame) -> str:
    """A prefix that no column of docs has."""
    own = "_mix"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    return own


def _named(rows: DataFrame, own: str, content: Column | None = None) -> DataFrame:
    """Rows with what names a text: id, source and content."""
    content = F.xxhash64("text") if content is None else content
    return rows.withColumns({own + "id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                             own + "key": _source_key(), own + "content": content})


def _taken(docs: DataFrame, plan: DataFrame, own: str) -> DataFrame:
    """Documents with a struct of each copy that the plan has of them.

    Rows equal in id, source and text take the plans of such rows in turn.
    """
    keys = [own + n for n in ("id", "key", "content")]
    copies, turn = own + "copies", own + "n"
    plan = (_named(plan, own, F.col("content")).groupBy(*keys)
            .agg(F.sort_array(F.collect_list(F.struct("start", "copies"))).alias(copies))
            .where(F.exists(copies, lambda p: F.size(p["copies"]) > 0)))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    return (_named(docs, own).join(plan.hint("merge"), keys).withColumn(turn, number - 1)
            .select(*docs.columns, F.explode(F.get(copies, F.col(turn))["copies"]).alias(own + "c")))


def _cut_documents(docs: DataFrame, plan: DataFrame, own: str) -> DataFrame:
    copy, words, position = (own + n for n in ("copy", "words", "position"))
    c = F.col(own + "c")
    taken = (_taken(docs, plan, own)
             .select(*docs.columns, c["copy"].alias(copy), c["words"].alias(words),
                     c["position"].alias(position))
             .repartitionByRange(position, "doc_id", copy)
             .sortWithinPartitions(position, "doc_id", copy))
    return taken.mapInArrow(_cut(docs.columns, words), docs.schema)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, one row a copy, in training order, with their columns.

    Each of the rows equal in id, source and text takes the copies planned for one of them.
    """
    return _cut_documents(docs, mix_plan(docs, **options), _free(docs))


def mixed_with_positions(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """``mixed_documents`` and, for each of its texts, the training positions of its copies.

    The second has (id, key, content, positions), as ``with_positions`` reads it.
    """
    own = _free(docs)
    plan = stage(mix_plan(docs, **options), "mix-plan")
    named = [F.col(own + n).alias(n) for n in ("id", "key", "content")]

    def cut(c):
        return c["words"] < F.col("size")

    whole = (_named(plan.withColumn("c", F.explode("copies")).where(~cut(F.col("c"))), own,
                    F.col("content")).select(*named, F.col("c.position").alias("position")))
    # The one copy of a source that is cut has another content than its document.
    short = (_taken(docs.select("doc_id", "source", "text"), plan.withColumn(
        "copies", F.filter("copies", cut)), own)
        .select("doc_id", "source", "text", F.col(own + "c")["words"].alias("words"),
                F.col(own + "c")["position"].alias("position")))
    kept = short.drop("words")
    short = _named(short.mapInArrow(_cut(kept.columns, "words"), kept.schema), own)
    positions = whole.union(short.select(*named, "position")).groupBy("id", "key", "content").agg(
        F.sort_array(F.collect_list("position")).alias("positions"))
    return _cut_documents(docs, plan, own), positions


def with_positions(mixed: DataFrame, positions: DataFrame, name: str) -> DataFrame:
    """Rows of the mix with the training position of each as column ``name``.

    Copies of a text that are equal take its positions in turn.
    """
    own = _free(mixed)
    keys = [own + n for n in ("id", "key", "content")]
    planned = positions.select(*[F.col(a).alias(b) for a, b in zip(("id", "key", "content"), keys)],
                               F.col("positions").alias(own + "p"))
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))) - 1
    return (_named(mixed, own).join(planned.hint("merge"), keys, "left")
            .withColumn(own + "n", turn)
            .withColumn(name, F.get(own + "p", F.col(own + "n") % F.size(own + "p")))
            .select(*mixed.columns, name))
