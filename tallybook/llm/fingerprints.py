"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into short paragraphs at line ends, after words that a hash picks
(one in ``PARAGRAPH_WORDS``), and after ``LONGEST`` words, so cuts move with the
content. Each paragraph adds its digest, numbered among equal ones, to one cell
in each third of a sketch: a count, a sum of digests and a sum of check values.
The sketches of two versions are subtracted cell by cell and peeled; what peels
off are the digests that only one version has. Where cells are left over, both
are sketched again ``GROWTH`` times as large.

Null texts are empty; texts without words have empty sketches, which are alike.
Equal texts have equal fingerprints. Rows without an id have no place in the
order, and are their own next document; rows of one id are ordered by text.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import NOT_SPACE, U64, Words, mix, pieces, text_buffers

PARAGRAPH_WORDS = 4
LONGEST = 16
CELLS = 24
GROWTH = 4
PART_ROWS = 2048
MAX_PARTS = 20_000
OUTPUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


class Paragraphs:
    """The numbered paragraph digests of some texts."""

    def __init__(self, data, offsets):
        words = Words(data, offsets, NOT_SPACE)
        self.n = len(offsets) - 1
        hashes = words.hashes()
        lines = np.concatenate([[0], np.cumsum(data == 0x0A)])
        head = np.zeros(len(words), bool)
        if len(words):
            head[1:] = (hashes[:-1] % U64(PARAGRAPH_WORDS) == 0) | (
                lines[words.starts[1:]] > lines[words.ends[:-1]])
            head[words.first[:-1][words.counts > 0]] = True
            at = np.flatnonzero(head)
            since = np.arange(len(words)) - np.repeat(at, np.diff(np.append(at, len(words))))
            head |= since % LONGEST == 0
        at = np.flatnonzero(head)
        place = np.arange(len(words)) - np.repeat(at, np.diff(np.append(at, len(words))))
        running = np.concatenate([[U64(0)], np.cumsum(mix(hashes + place.astype(U64) * U64(31)))])
        ends = np.append(at[1:], len(words))[:len(at)]
        digest = mix(running[ends] - running[at])
        text_of = np.searchsorted(words.first, at, "right") - 1
        order = np.lexsort((digest, text_of))
        text_of, digest = text_of[order], digest[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (digest[1:] != digest[:-1]) | (text_of[1:] != text_of[:-1])
        first = np.flatnonzero(fresh)
        copy = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        self.text_of, self.keys = text_of, mix(digest + copy.astype(U64) * U64(0x9E37))
        self.counts = np.bincount(text_of, minlength=self.n)


def cell_numbers(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    third = cells // 3
    return [(mix(keys ^ U64(0xA5A5 * (i + 1) + cells)) % U64(third)).astype(np.int64) + i * third
            for i in range(3)]


def check_value(keys: np.ndarray) -> np.ndarray:
    return mix(keys + U64(0x51ED27)) >> U64(32)


def sketch(keys: np.ndarray, owner: np.ndarray, n: int, cells: int):
    """(counts, digest sums, check sums), one row of cells per owner."""
    counts = np.zeros(n * cells, np.int64)
    sums, checks = np.zeros(n * cells, U64), np.zeros(n * cells, U64)
    check = check_value(keys)
    for number in cell_numbers(keys, cells):
        at = owner * cells + number
        counts += np.bincount(at, minlength=n * cells)
        np.add.at(sums, at, keys)
        np.add.at(checks, at, check)
    return counts, sums, checks


def peel(counts, sums, checks, n: int, cells: int):
    """Digests that one side has, as (pair, key, side); and which pairs came out whole."""
    pairs, keys, sides = [], [], []
    live = np.flatnonzero(np.abs(counts) == 1)
    while len(live):
        side = counts[live]
        key = np.where(side == 1, sums[live], -sums[live])
        check = np.where(side == 1, checks[live], -checks[live])
        pure = check == check_value(key)
        live, key, side = live[pure], key[pure], side[pure]
        pair = live // cells
        order = np.lexsort((key, pair))
        pair, key, side = pair[order], key[order], side[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])
        pair, key, side = pair[new], key[new], side[new]
        touched = []
        for number in cell_numbers(key, cells):
            at = pair * cells + number
            np.subtract.at(counts, at, side)
            np.subtract.at(sums, at, np.where(side == 1, key, -key))
            value = check_value(key)
            np.subtract.at(checks, at, np.where(side == 1, value, -value))
            touched.append(at)
        pairs.append(pair), keys.append(key), sides.append(side)
        live = np.unique(np.concatenate(touched))
        live = live[np.abs(counts[live]) == 1]
    left = (counts != 0) | (sums != 0) | (checks != 0)
    whole = ~left.reshape(n, cells).any(1)
    return (np.concatenate([np.empty(0, np.int64), *pairs]),
            np.concatenate([np.empty(0, U64), *keys]),
            np.concatenate([np.empty(0, np.int64), *sides]), whole)


def differences(a: Paragraphs, a_texts, b: Paragraphs, b_texts, cells: int = CELLS):
    """How many digests only the first, and only the second text of each pair has."""
    only = np.zeros((2, len(a_texts)), np.int64)
    todo = np.arange(len(a_texts))
    while len(todo):
        parts = []
        for side, texts in ((a, a_texts[todo]), (b, b_texts[todo])):
            first = np.searchsorted(side.text_of, np.arange(side.n + 1))
            size = side.counts[texts]
            where = np.arange(size.sum()) + np.repeat(
                first[texts] - (np.cumsum(size) - size), size)
            parts.append(sketch(side.keys[where], np.repeat(np.arange(len(todo)), size),
                                len(todo), cells))
        pair, _, sign, whole = peel(*(x - y for x, y in zip(*parts)), len(todo), cells)
        for side, value in ((0, 1), (1, -1)):
            found = np.bincount(pair[sign == value], minlength=len(todo))
            only[side, todo[whole]] = found[whole]
        todo = todo[~whole]
        cells *= GROWTH
    return only


def likeness(a: Paragraphs, a_texts, b: Paragraphs, b_texts) -> np.ndarray:
    """Twice the shared digests over all digests; 1 for two texts without any."""
    only = differences(a, a_texts, b, b_texts)
    total = a.counts[a_texts] + b.counts[b_texts]
    return np.where(total > 0, 1 - only.sum(0) / np.maximum(total, 1), 1.0)


def fingerprints(p: Paragraphs, cells: int = CELLS) -> list[str]:
    counts, sums, checks = sketch(p.keys, p.text_of, p.n, cells)
    rows = np.concatenate([
        p.counts.astype("<u4")[:, None].view(np.uint8).reshape(p.n, -1),
        counts.astype("<u4").reshape(p.n, cells).view(np.uint8).reshape(p.n, -1),
        sums.astype("<u8").reshape(p.n, cells).view(np.uint8).reshape(p.n, -1),
        checks.astype("<u4").reshape(p.n, cells).view(np.uint8).reshape(p.n, -1)], axis=1)
    return [base64.b64encode(r.tobytes()).decode() for r in rows]


def edited_texts(data, offsets, following) -> tuple[list[bytes], np.ndarray]:
    """Each text with its last quarter replaced by the head of another, and its characters."""
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(heads, offsets)
    heads = np.append(heads, len(data))
    size = np.diff(first)
    quarter = size // 4
    cut = np.where(quarter > 0, heads[first[1:] - quarter], offsets[1:])
    stop = np.where(quarter >= size[following], offsets[1:][following],
                    heads[np.minimum(first[following] + quarter, len(heads) - 1)])
    raw = data.tobytes()
    return [raw[a:b] + raw[c:d] for a, b, c, d in zip(
        offsets[:-1].tolist(), cut.tolist(), offsets[following].tolist(), stop.tolist())], size


def _compare(batches):
    """Rows in order of (part, extra, id, text); extra rows only serve as next ones."""
    held = None
    for piece in pieces(batches):
        held = piece if held is None else pa.Table.from_batches([held, piece]) \
            .combine_chunks().to_batches()[0]
        if held.num_rows > 1:
            yield from _rows(held)
            held = held.slice(held.num_rows - 1)
    if held is not None:
        yield from _rows(held, last=True)


def _rows(batch, last=False):
    data, offsets = text_buffers(batch.column("text"))
    n = batch.num_rows
    named = ~np.asarray(pc.is_null(batch.column("doc_id")))
    following = np.where(named, np.minimum(np.arange(n) + 1, n - 1), np.arange(n))
    wanted = ~np.asarray(batch.column("extra").to_numpy(zero_copy_only=False), bool)
    if not last:
        wanted[-1] = False
    rows = np.flatnonzero(wanted)
    if not len(rows):
        return
    texts, size = edited_texts(data, offsets, following)
    texts = [texts[i] for i in rows.tolist()]
    own = Paragraphs(data, offsets)
    changed = Paragraphs(*text_buffers(pa.array(texts, pa.large_binary())
                                       .cast(pa.large_string())))
    prints = fingerprints(own)
    number = np.arange(len(rows))
    yield pa.RecordBatch.from_arrays(
        [batch.column("doc_id").take(pa.array(rows)), pa.array(size[rows]),
         pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
         pa.array([prints[i] for i in rows.tolist()]), pa.array(fingerprints(changed)),
         pa.array(likeness(own, rows, changed, number)),
         pa.array(likeness(own, rows, own, following[rows]))],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
         "near_edited", "near_next"])


def _deal(bounds):
    """The range of ids that a row is in; the first id of a range also ends the one before."""
    def deal(batches):
        edges = np.array(bounds, np.int64)
        for batch in batches:
            ids = pc.fill_null(batch.column("doc_id").cast(pa.int64()), 0).to_numpy()
            named = ~np.asarray(pc.is_null(batch.column("doc_id")))
            part = np.where(named, np.searchsorted(edges, ids, "right") - 1, 0)
            again = np.flatnonzero(named & (edges[part] == ids))
            rows = pa.array(np.concatenate([np.arange(batch.num_rows), again]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([part, (part[again] - 1) % len(edges)]), pa.int32()),
                 pa.array(np.arange(len(rows)) >= batch.num_rows),
                 batch.column("doc_id").cast(pa.int64()).take(rows),
                 batch.column("text").take(rows)], ["part", "extra", "doc_id", "text"])
    return deal


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    Texts move once, to ranges of ids of about equal row counts.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    parts = min(max(ids.count() // PART_ROWS, 1), MAX_PARTS)
    bounds = sorted({int(q) for q in ids.approxQuantile(
        "doc_id", [i / parts for i in range(parts)], 1 / (4 * parts))}) or [0]
    dealt = docs.select("doc_id", "text").mapInArrow(
        _deal(bounds), "part int, extra boolean, doc_id long, text string")
    ordered = dealt.repartitionById(len(bounds), "part").sortWithinPartitions(
        "part", "extra", "doc_id", "text")
    return ordered.mapInArrow(_compare, OUTPUT)
