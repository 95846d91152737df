"""Benchmark decontamination: an FM-index per shard of the corpus.

Each piece of the documents is a shard. A word that no test item has cannot lie
in an occurrence, so a shard's index covers its runs of test words, as long as
the shortest phrase or longer; nothing else of the text is left out. Phrases are
searched backwards through wavelet-matrix ranks, located by sampled suffix
positions, and merged to removal spans.

Test items come in blocks of at most ``BLOCK_BYTES`` of text; each block is
broadcast and searched in all documents one after the other, and each adds its spans
to those the row has. No row is moved, so rows with equal or null ids stay apart,
however many blocks there are.

Null or empty texts have no words and no hits; items without words are no
phrase; repeated item ids count once; other columns are not read.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fmindex import FMIndex
from .words import ALNUM, LOWER, Words, pieces, ranges, text_buffers

WINDOW = 10
BLOCK_BYTES = 8 << 20

SPANS = ("doc_id long, n_words long, spans array<struct<start: long, end: long>>, "
         "items array<string>")


class Phrases:
    """The windows of some test items, as symbols of their own vocabulary."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        text = pa.array([t for _, t in items], pa.large_string())
        words = Words(*text_buffers(text), ALNUM)
        hashes = words.hashes(LOWER)
        self.vocabulary = np.unique(hashes)
        symbols = np.searchsorted(self.vocabulary, hashes) + 2
        seen: dict[tuple, int] = {}
        owners: list[set] = []
        for (name, _), lo, hi in zip(items, words.first[:-1], words.first[1:]):
            row = symbols[lo:hi].tolist()
            if not row:
                continue
            size = min(window, len(row))
            for i in range(len(row) - size + 1):
                key = tuple(row[i:i + size])
                if key not in seen:
                    seen[key] = len(owners)
                    owners.append(set())
                owners[seen[key]].add(name)
        self.flat = np.array([s for key in seen for s in key], np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(key) for key in seen])]).astype(np.int64)
        self.shortest = min((len(key) for key in seen), default=0)
        names = [sorted(o) for o in owners]
        self.names = np.array([n for o in names for n in o], object)
        self.owned = np.concatenate([[0], np.cumsum([len(o) for o in names])]).astype(np.int64)


def shard_hits(words: Words, phrases: Phrases):
    """Word spans and (text, item) pairs of all occurrences in one shard."""
    hashes = words.hashes(LOWER)
    slot = np.minimum(np.searchsorted(phrases.vocabulary, hashes),
                      max(len(phrases.vocabulary) - 1, 0))
    known = (phrases.vocabulary[slot] == hashes) if len(phrases.vocabulary) else \
        np.zeros(len(hashes), bool)
    text_of = np.repeat(np.arange(len(words.counts)), words.counts)
    same = np.zeros(len(known) + 1, bool)  # the run before goes on at this word
    same[1:-1] = known[1:] & known[:-1] & (text_of[1:] == text_of[:-1])
    run_start = np.flatnonzero(known & ~same[:-1])
    run_end = np.flatnonzero(known & ~same[1:]) + 1
    long_enough = run_end - run_start >= max(phrases.shortest, 1)
    run_start, run_end = run_start[long_enough], run_end[long_enough]
    none = np.empty(0, np.int64)
    if not len(run_start) or not len(phrases.flat):
        return none, none, none, np.empty(0, object)
    size = run_end - run_start
    at = ranges(run_start, size)  # word number of each symbol kept
    out = np.arange(len(at)) + np.repeat(np.arange(len(size)), size)
    symbols = np.ones(len(at) + len(size), np.int64)  # 1 ends a run
    symbols[out] = slot[at] + 2
    word_at = np.zeros(len(symbols), np.int64)
    word_at[out] = at
    index = FMIndex(symbols)
    phrase, where = index.locate(*index.search(phrases.flat, phrases.first))
    start = word_at[where]
    end = start + np.diff(phrases.first)[phrase]
    pair = np.unique(text_of[start] * len(phrases.first) + phrase) if len(start) else none
    text, phrase = pair // len(phrases.first), pair % len(phrases.first)
    count = np.diff(phrases.owned)[phrase]
    names = phrases.names[ranges(phrases.owned[phrase], count)]
    return start, end, np.repeat(text, count), names


def _search(shared, last):
    """Add a block's spans and items to each row; but for the last block, the text goes on."""
    def search(batches):
        phrases = SimpleNamespace(**shared.value)
        for piece in pieces(batches):
            words = Words(*text_buffers(piece.column("text")), ALNUM)
            start, end, text, names = shard_hits(words, phrases)
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, start, 1)
            np.add.at(cover, end, -1)
            items = [set() for _ in range(piece.num_rows)]
            if "spans" in piece.schema.names:
                before = piece.column("spans")
                base = np.repeat(words.first[:-1], pc.list_value_length(before).to_numpy())
                before = pc.list_flatten(before)
                np.add.at(cover, before.field("start").to_numpy() + base, 1)
                np.add.at(cover, before.field("end").to_numpy() + base, -1)
                items = [set(names) for names in piece.column("items").to_pylist()]
            hit = np.cumsum(cover[:-1]) > 0
            heads = words.first[:-1][words.counts > 0]
            carried = np.zeros(len(hit), bool)
            carried[1:] = hit[:-1]
            carried[heads] = False
            begins = np.flatnonzero(hit & ~carried)
            goes_on = np.zeros(len(hit), bool)
            goes_on[:-1] = carried[1:] & hit[1:]
            stops = np.flatnonzero(hit & ~goes_on) + 1
            first = np.searchsorted(begins, words.first)
            base = np.repeat(words.first[:-1], np.diff(first))
            spans = pa.ListArray.from_arrays(
                pa.array(first, pa.int32()),
                pa.StructArray.from_arrays([pa.array(begins - base, pa.int64()),
                                            pa.array(stops - base, pa.int64())],
                                           ["start", "end"]))
            for t, name in zip(text.tolist(), names.tolist()):
                items[t].add(name)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").cast(pa.int64()), pa.array(words.counts, pa.int64()),
                 spans, pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                 *([] if last else [piece.column("text")])],
                ["doc_id", "n_words", "spans", "items", *([] if last else ["text"])])
    return search


def _blocks(benchmark: DataFrame, limit: int):
    rows, size = [], 0
    for row in (benchmark.where(F.col("text").isNotNull())
                .select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text")
                .toLocalIterator()):
        rows.append(tuple(row))
        size += len(row[1])
        if size >= limit:
            yield rows
            rows, size = [], 0
    yield rows


def benchmark_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: its words, merged removal spans in words, and the items found."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    blocks = list(_blocks(benchmark, block_bytes))
    for n, block in enumerate(blocks, 1):
        shared = spark.sparkContext.broadcast(vars(Phrases(block, window)))
        last = n == len(blocks)
        rows = rows.mapInArrow(_search(shared, last), SPANS + ("" if last else ", text string"))
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The spans as counts, and a digest of the items found."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    found = benchmark_spans(docs, benchmark, **options).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def _clean(shared):
    def clean(batches):
        phrases = SimpleNamespace(**shared.value)
        for piece in pieces(batches):
            words = Words(*text_buffers(piece.column("text")), ALNUM)
            start = shard_hits(words, phrases)[0]
            keep = np.ones(piece.num_rows, bool)
            keep[np.searchsorted(words.first, start, "right") - 1] = False
            yield piece.filter(pa.array(keep))
    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents without any benchmark phrase, with all their columns; nothing is shuffled."""
    for block in _blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(vars(Phrases(block, window)))
        docs = docs.mapInArrow(_clean(shared), docs.schema)
    return docs
