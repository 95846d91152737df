"""Words and hashes of whole Arrow text columns, as NumPy arrays.

Texts are never turned into Python strings: a column's UTF-8 buffer is scanned
as bytes, in pieces of bounded size. Null texts are empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Text bytes worked on at a time; a longer single text is a piece of its own.
PIECE_BYTES = 4 << 20
HASH_BYTES = 1 << 19
CODE_BYTES = 64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)  # the first n bytes of eight


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values of a seed."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + (U64(seed) << U64(32))) * GOLDEN)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each one starts (n + 1 offsets)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    lo, hi = int(at[0]), int(at[-1])
    if hi == lo:
        return np.empty(0, np.uint8), at - lo
    return np.frombuffer(data, np.uint8, hi - lo, lo), at - lo


def pieces(batches, column: str = "text", limit: int = PIECE_BYTES):
    """Cut record batches so that no piece has more text than the limit, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_buffers(batch.column(column))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(at, at[row] + limit, "right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield batch.slice(row, end - row)
            row = end


class Words:
    """The words of some texts: byte spans, and the first word of each text."""

    def __init__(self, data, offsets, letters=NOT_SPACE):
        n = len(data)
        inside = np.frombuffer(data.tobytes().translate(letters.tobytes()), bool)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = False, False
            before[1:] = inside[:-1] & ~edge[1:-1]
            after[:-1] = inside[1:] & ~edge[1:-1]
        self.data = data
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def __len__(self):
        return len(self.starts)

    def select(self, which: np.ndarray) -> Words:
        """Some of the words, without their texts."""
        out = Words.__new__(Words)
        out.data, out.starts, out.ends = self.data, self.starts[which], self.ends[which]
        return out

    def codes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, ASCII case aside, taken eight at a time.

        Words above ``CODE_BYTES`` have their hash of ``hashes``.
        """
        low = self.data.tobytes().translate(LOWER.tobytes()) + bytes(8)
        eight = np.ndarray(len(low) - 7, "<u8", low, strides=(1,))  # from each byte on
        left = self.ends - self.starts
        out = mix(left.astype(U64) * GOLDEN ^ eight[self.starts] & KEEP.take(left, mode="clip"))
        which = np.flatnonzero((left > 8) & (left <= CODE_BYTES))
        at, left = self.starts[which] + 8, left[which] - 8
        while len(which):
            part = eight[at] & KEEP.take(left, mode="clip")
            out[which] = mix(out[which] + GOLDEN ^ part)
            more = np.flatnonzero(left > 8)
            which, at, left = which[more], at[more] + 8, left[more] - 8
        long = np.flatnonzero(self.ends - self.starts > CODE_BYTES)
        if len(long):
            out[long] = self.select(long).hashes(LOWER)
        return out

    def hashes(self, fold=None) -> np.ndarray:
        """A 64-bit hash of each word's bytes: a polynomial by prefix sums, mixed."""
        out = np.empty(len(self), U64)
        value = stream(7, 256)
        if fold is not None:
            value = value[fold]
        base = 0x9E3779B97F4A7C15 | 5
        inverse = pow(base, -1, 1 << 64)
        size = 0
        up = down = None
        word = 0
        while word < len(self):
            lo = int(self.starts[word])
            end = max(int(np.searchsorted(self.ends, lo + HASH_BYTES, "right")), word + 1)
            hi = int(self.ends[end - 1])
            if hi - lo > size:
                size = max(hi - lo, min(HASH_BYTES, len(self.data)))
                up = powers(base, size)
                down = powers(inverse, size)
            total = np.zeros(hi - lo + 1, U64)
            np.cumsum(value[self.data[lo:hi]] * up[:hi - lo], out=total[1:])
            s, e = self.starts[word:end] - lo, self.ends[word:end] - lo
            out[word:end] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U64) * GOLDEN)
            word = end
        return out


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.cumprod(out, out=out)


def join_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * U64(0xD6E8FEB86659FD93) + right)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words, by doubling; also across texts."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    out, have, power, span = None, 0, words, 1
    while True:
        if size & span:
            if out is None:
                out, have = power, span
            else:
                m = len(words) - have - span + 1
                out, have = join_hash(out[:m], power[have:have + m]), have + span
        if have == size:
            return out[:n]
        power = join_hash(power[:len(power) - span], power[span:])
        span *= 2


def gram_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Positions (word numbers) at which a whole run of ``size`` words of one text starts."""
    counts = np.diff(first)
    return ranges(first[:-1], np.maximum(counts - size + 1, 0))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def large_column(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
