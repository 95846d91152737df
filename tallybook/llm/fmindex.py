"""An FM-index over a sequence of small integers, searched for many phrases at once."""

from __future__ import annotations

import numpy as np

from .words import ranges


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Sorted suffixes, by doubling the sorted prefix until all ranks differ."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    width = 1
    while True:
        key = rank * (n + int(symbols.max()) + 2)
        key[:n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        width = min(2 * width, n)


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit of the symbols a level."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = max(int(top).bit_length(), 1)
        self.ones, self.zeros = [], []
        row = symbols.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(row) - int(bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        lo, hi = np.zeros_like(upto), upto.copy()
        for depth, ones in enumerate(self.ones):
            bit = (symbol >> (self.levels - 1 - depth)) & 1 == 1
            a, b = ones[lo], ones[hi]
            lo = np.where(bit, self.zeros[depth] + a, lo - a)
            hi = np.where(bit, self.zeros[depth] + b, hi - b)
        return hi - lo


class FMIndex:
    """Backward search and located occurrences. Symbols are 1 or more."""

    def __init__(self, symbols: np.ndarray, sample: int = 8):
        text = np.concatenate([symbols, [0]])
        order = suffix_array(text)
        self.bwt = text[order - 1]
        top = int(text.max())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.tree = WaveletMatrix(self.bwt, top)
        self.top, self.n = top, len(text)
        self.sampled = order % sample == 0
        self.known = np.where(self.sampled, order, -1)

    def search(self, flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of each phrase; phrase p is flat[first[p]:first[p + 1]]."""
        left = np.diff(first)
        lo = np.zeros(len(left), np.int64)
        hi = np.full(len(left), self.n, np.int64)
        live = np.flatnonzero(left > 0)
        hi[left == 0] = 0
        at = first[1:].copy()
        while len(live):
            at[live] -= 1
            c = flat[at[live]].astype(np.int64)
            fits = c <= self.top
            hi[live[~fits]] = lo[live[~fits]]
            live, c = live[fits], c[fits]
            lo[live] = self.before[c] + self.tree.rank(c, lo[live])
            hi[live] = self.before[c] + self.tree.rank(c, hi[live])
            live = live[(hi[live] > lo[live]) & (at[live] > first[live])]
        return lo, np.maximum(hi, lo)

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase number, text position) of every occurrence, by walks to sampled suffixes."""
        count = hi - lo
        phrase = np.repeat(np.arange(len(lo)), count)
        row = ranges(lo, count)
        steps = np.zeros(len(row), np.int64)
        walking = np.flatnonzero(~self.sampled[row])
        while len(walking):
            r = row[walking]
            c = self.bwt[r].astype(np.int64)
            row[walking] = self.before[c] + self.tree.rank(c, r)
            steps[walking] += 1
            walking = walking[~self.sampled[row[walking]]]
        return phrase, self.known[row] + steps
