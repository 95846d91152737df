"""Substring dedup: relative Lempel-Ziv parsing against all reference blocks.

A block is a piece of the corpus. Every document is factored against every
block that shares a seed with it; blocks meet where a shuffle brings equal
seeds together, never pair by pair.

* Seeds: of each window of ``window`` words, the run of ``seed`` words with the
  least hash. Windows of one seed that follow each other form a phrase. Equal
  text gives equal seeds and, inside a repeated passage, equal phrases.
* Phrases whose seed occurs nowhere else cannot hold a repeated window.
* Long factors: a phrase equal to an earlier one is copied whole from it.
* Factor boundaries: a phrase that is the first of its kind but whose seed is
  shared is checked window by window, since a factor may begin or end in it.
* Greedy parse: pieces copied from consecutive places join to one factor.

A factor (start, end, source document, source start) covers only words of
windows that also start earlier: in a smaller doc_id, or earlier in the same
document. Inside a block, later repeats are settled before any shuffle, so a
seed or window sends at most one row a block however often it occurs.

Null texts have no words; texts shorter than a window have no factor. Rows
without an id come after all others. Rows of the same id are one document, in
which a word's number is its place: a window does not repeat itself in a row of its
own id that has it at the same place. Rows of one id may have different texts; a
hash of the text tells which row a phrase is of, and equal rows get equal results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage
from .words import (NOT_SPACE, U64, Words, gram_hashes, gram_starts, mix, pieces, powers, ranges,
                    text_buffers)

WINDOW = 20
SEED = 6
BLOCK_BYTES = 8 << 20
LAST = (1 << 63) - 1  # stands for a missing id
WINDOWS_AT_ONCE = 1 << 20

SEEDS = "key long, doc_id long, content long, phrase int, sure boolean"
PHRASES = ("key long, doc_id long, content long, start long, count int, sure boolean, ref_doc long, "
           "ref_start long, hashes binary")
SPANS = ("key long, doc_id long, content long, start long, count int, sure boolean, ref_doc long, "
         "ref_start long")
FACTOR = "array<struct<start: long, end: long, ref_doc: long, ref_start: long>>"


class Phrases:
    """Runs of windows with one seed: first word, windows, text and number in it."""

    def __init__(self, words: Words, window: int, seed: int):
        self.hashes = words.hashes()
        at = gram_starts(words.first, window)
        grams = gram_hashes(self.hashes, seed)
        bits = U64(max(len(words), 2).bit_length())
        least = ((grams >> bits) << bits) | np.arange(len(grams), dtype=U64)
        span, reach = window - seed + 1, 1
        while reach < span:
            step = min(reach, span - reach)
            least = np.minimum(least[:max(len(least) - step, 0)], least[step:])
            reach += step
        seed_at = (least[at] & ((U64(1) << bits) - U64(1))).astype(np.int64)
        text_of = np.searchsorted(words.first, at, "right") - 1
        head = np.ones(len(at), bool)
        head[1:] = (seed_at[1:] != seed_at[:-1]) | (text_of[1:] != text_of[:-1])
        first = np.flatnonzero(head)
        self.word = at[first]
        self.count = np.diff(np.append(first, len(at)))
        self.text = text_of[first]
        self.seed = grams[seed_at[first]]
        self.of_text = np.searchsorted(self.text, np.arange(len(words.counts) + 1))
        self.number = np.arange(len(first)) - self.of_text[self.text]
        self.start = self.word - words.first[self.text]
        self.window = window

    def content(self) -> np.ndarray:
        """A hash of all words of each phrase."""
        n = len(self.hashes)
        base = 0xD1342543DE82EF95
        total = np.concatenate([[U64(0)], np.cumsum(self.hashes * powers(base, n))])
        end = self.word + self.count + self.window - 1
        back = powers(pow(base, -1, 1 << 64), n)
        return mix((total[end] - total[self.word]) * back[self.word] + self.count.astype(U64))


def _own_key(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A key of its own for a row that is settled, so that such rows spread out."""
    return mix(mix(doc.astype(U64)) + start.astype(U64)).view(np.int64)


def _ids(piece) -> np.ndarray:
    return pc.fill_null(piece.column("doc_id").cast(pa.int64()), LAST).to_numpy()


def first_places(keys: np.ndarray, doc: np.ndarray, start: np.ndarray):
    """For each row the row of the earliest place with its key, and whether it is earlier."""
    order = np.lexsort((start, doc, keys))
    head = np.ones(len(keys), bool)
    head[1:] = keys[order][1:] != keys[order][:-1]
    group = np.cumsum(head) - 1
    earliest = np.empty(len(keys), np.int64)
    earliest[order] = order[np.flatnonzero(head)[group]] if len(keys) else order
    return earliest, (doc[earliest] != doc) | (start[earliest] != start)


def _seeds(window, seed):
    def run(batches):
        for piece in pieces(batches, limit=BLOCK_BYTES):
            p = Phrases(Words(*text_buffers(piece.column("text")), NOT_SPACE), window, seed)
            doc, content = _ids(piece)[p.text], piece.column("content").to_numpy()[p.text]
            kinds, first, kind, times = np.unique(p.seed, return_index=True,
                                                  return_inverse=True, return_counts=True)
            sure = times[kind] > 1
            told = first[times > 1]  # one row a block tells other blocks of such a seed
            key = np.where(sure, _own_key(doc, p.number), p.seed.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([key, p.seed[told].view(np.int64)])),
                 pa.array(np.concatenate([doc, doc[told]])),
                 pa.array(np.concatenate([content, content[told]])),
                 pa.array(np.concatenate([p.number, np.full(len(told), -1)]), pa.int32()),
                 pa.array(np.concatenate([sure, np.zeros(len(told), bool)]))],
                ["key", "doc_id", "content", "phrase", "sure"])
    return run


def _phrases(window, seed):
    def run(batches):
        for piece in pieces(batches, limit=BLOCK_BYTES):
            p = Phrases(Words(*text_buffers(piece.column("text")), NOT_SPACE), window, seed)
            listed = piece.column("phrases")
            size = pc.list_value_length(listed).to_numpy()
            rows = np.unique(np.repeat(p.of_text[:-1], size)
                             + pc.list_flatten(listed).to_numpy().astype(np.int64))
            doc, start, whole = _ids(piece)[p.text[rows]], p.start[rows], p.content()[rows]
            earliest, sure = first_places(whole, doc, start)
            grams = gram_hashes(p.hashes, window)
            size = np.where(sure, 0, p.count[rows])
            flat = grams[ranges(p.word[rows], size)]
            offsets = np.concatenate([[0], np.cumsum(size)]) * 8
            payload = pa.Array.from_buffers(
                pa.binary(), len(rows),
                [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(sure, _own_key(doc, start), whole.view(np.int64))),
                 pa.array(doc), pa.array(piece.column("content").to_numpy()[p.text[rows]]),
                 pa.array(start), pa.array(p.count[rows], pa.int32()),
                 pa.array(sure), pa.array(doc[earliest]), pa.array(start[earliest]), payload],
                ["key", "doc_id", "content", "start", "count", "sure", "ref_doc", "ref_start",
                 "hashes"])
    return run


def _windows(batches):
    """The windows of phrases that are the first of their kind, as rows of their own."""
    for batch in batches:
        count = batch.column("count").to_numpy().astype(np.int64)
        total = np.cumsum(count)
        cut = [0, *(np.searchsorted(total, np.arange(WINDOWS_AT_ONCE, int(total[-1]),
                                                     WINDOWS_AT_ONCE)) + 1
                    if len(total) else []), batch.num_rows]
        for lo, hi in zip(cut[:-1], cut[1:]):
            if hi <= lo:
                continue
            part, size = batch.slice(lo, hi - lo), count[lo:hi]
            keys = np.frombuffer(b"".join(part.column("hashes").to_pylist()), U64)
            doc = np.repeat(part.column("doc_id").to_numpy(), size)
            start = ranges(part.column("start").to_numpy(), size)
            earliest, sure = first_places(keys, doc, start)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(sure, _own_key(doc, start), keys.view(np.int64))),
                 pa.array(doc), pa.array(np.repeat(part.column("content").to_numpy(), size)),
                 pa.array(start), pa.array(np.ones(len(doc)), pa.int32()),
                 pa.array(sure), pa.array(doc[earliest]), pa.array(start[earliest])],
                ["key", "doc_id", "content", "start", "count", "sure", "ref_doc", "ref_start"])


def _settle(rows: DataFrame) -> DataFrame:
    """Point every unsettled row at the earliest place with its key."""
    place = F.struct("doc_id", "start")
    first = F.min(place).over(Window.partitionBy("key", "sure"))
    return (rows.withColumn("first", first)
            .withColumn("ref_doc", F.when(F.col("sure"), F.col("ref_doc"))
                        .otherwise(F.col("first.doc_id")))
            .withColumn("ref_start", F.when(F.col("sure"), F.col("ref_start"))
                        .otherwise(F.col("first.start")))
            .withColumn("copied", F.col("sure") | (F.col("first") < place))
            .drop("first", "sure", "key"))


def _id(column: Column | str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST))


def duplicate_factors(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Per document id (``LAST`` for none) and hash of its text, where windows repeat: the
    copied pieces.

    Pieces are in words and may overlap; ``join_factors`` parses them.
    """
    texts = docs.select(_id().alias("doc_id"), F.xxhash64("text").alias("content"), "text")
    seeds = texts.mapInArrow(_seeds(window, seed), SEEDS)
    shared = (seeds.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key", "sure")))
              .where((F.col("sure") | (F.col("n") > 1)) & (F.col("phrase") >= 0))
              .select("doc_id", "content", "phrase"))
    shared = stage(shared, "substring-seeds").groupBy("doc_id", "content").agg(
        F.collect_set("phrase").alias("phrases"))
    phrases = stage(_settle(texts.join(shared, ["doc_id", "content"]).mapInArrow(
        _phrases(window, seed), PHRASES)), "substring-phrases")
    boundary = phrases.where(~F.col("copied")).select(
        "doc_id", "content", "start", "count", "hashes")
    windows = stage(_settle(boundary.mapInArrow(_windows, SPANS)).where("copied"),
                    "substring-windows")
    copied = phrases.where("copied").drop("hashes").unionByName(windows)
    return copied.groupBy("doc_id", "content").agg(F.collect_list(F.struct(
        "start", (F.col("start") + F.col("count") + (window - 1)).alias("end"),
        "ref_doc", "ref_start")).cast(FACTOR).alias("copies"))


def join_factors(copies: list[dict]) -> list[dict]:
    """Greedy factors of one document, left to right: pieces copied on from one source join."""
    out: list[dict] = []
    for c in sorted(copies, key=lambda c: (c["start"], -c["end"])):
        last = out[-1] if out else None
        if last and c["start"] <= last["end"] and c["ref_doc"] == last["ref_doc"] and \
                c["ref_start"] - last["ref_start"] == c["start"] - last["start"]:
            last["end"] = max(last["end"], c["end"])
        elif not last or c["end"] > last["end"]:
            out.append(dict(c))
    return out


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def _kept(batches):
    """Words kept of each text, joined by one space, as counts and a digest."""
    for piece in pieces(batches, limit=BLOCK_BYTES):
        words = Words(*text_buffers(piece.column("text")), NOT_SPACE)
        copies = piece.column("copies")
        size = pc.fill_null(pc.list_value_length(copies), 0).to_numpy()
        flat = pc.list_flatten(copies)
        base = np.repeat(words.first[:-1], size)
        gone = covered(flat.field("start").to_numpy() + base,
                       flat.field("end").to_numpy() + base, len(words))
        removed = np.concatenate([[0], np.cumsum(gone)])
        removed = removed[words.first[1:]] - removed[words.first[:-1]]
        raw, digests = words.data.tobytes(), []
        starts, ends = words.starts.tolist(), words.ends.tolist()
        keep = np.flatnonzero(~gone)
        first = np.searchsorted(keep, words.first)
        keep = keep.tolist()
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            digests.append(hashlib.sha256(
                b" ".join([raw[starts[i]:ends[i]] for i in keep[lo:hi]])).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), pa.array(words.counts, pa.int64()),
             pa.array(removed, pa.int64()), pa.array(digests)],
            ["doc_id", "n_words", "n_removed", "kept_sha256"])


def removal_counts(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Per document: words, words removed, and a digest of those kept."""
    factors = duplicate_factors(docs, window, seed).withColumnRenamed("doc_id", "_id")
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), _id().alias("_id"),
                        F.xxhash64("text").alias("content"), "text")
            .join(factors, ["_id", "content"], "left").select("doc_id", "text", "copies")
            .mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_sha256 string"))
