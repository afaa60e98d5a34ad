"""An FM-index over integer symbols, in numpy.

Suffixes are sorted by prefix doubling, each round only those that are not yet
alone; the Burrows-Wheeler transform is held in a wavelet matrix whose levels
are packed bits with a count for each word of 64; every ``SAMPLE``-th text
position is kept, and an occurrence is located by walking back to one of them.
All searches of a pattern set go on together.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order; the last symbol must be the smallest
    and stand nowhere else."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    depth = max(1, 62 // bits)
    key = text.astype(np.int64)
    have = 1
    while have * 2 <= depth:  # each key takes in the symbols of the one behind it
        key = key << (bits * have)
        key[: max(0, n - have)] |= key[have:] >> (bits * have)
        have *= 2
    order = np.argsort(key, kind="stable")
    key = key[order]
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    alone = fresh & np.concatenate((fresh[1:], [True]))
    slots = np.flatnonzero(~alone)
    depth = have
    while len(slots):
        at = order[slots]
        behind = at + depth
        follow = np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + follow
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0))
        alone = fresh & np.concatenate((fresh[1:], [True]))
        slots = slots[~alone]
        depth *= 2
    return order


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray):
        self.n = n = len(symbols)
        self.levels = max(1, int(symbols.max()).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            own = np.packbits(bit, bitorder="little")
            packed[: len(own)] = own
            word = packed.view(np.uint64)
            count = np.zeros(len(word) + 1, np.int64)
            np.cumsum(np.bitwise_count(word), out=count[1:])
            self.words.append(word)
            self.before.append(count)
            self.zeros.append(n - int(bit.sum()))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before lo and before hi."""
        start = np.zeros_like(lo)
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            a, b, c = self._ones(k, start), self._ones(k, lo), self._ones(k, hi)
            z = self.zeros[k]
            start, lo, hi = np.where(one, z + a, start - a), np.where(one, z + b, lo - b), np.where(one, z + c, hi - c)
        return lo - start, hi - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at positions, and how often each stands before."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for k in range(self.levels):
            word = self.words[k][at >> 6]
            one = (word >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            a, b = self._ones(k, start), self._ones(k, at)
            z = self.zeros[k]
            start, at = np.where(one, z + a, start - a), np.where(one, z + b, at - b)
            symbol = symbol * 2 + one
        return symbol, at - start


class FmIndex:
    """Of symbols of at least 1; 0 is the end mark this adds."""

    def __init__(self, symbols: np.ndarray):
        text = np.concatenate((symbols, [0])).astype(np.int64)
        order = suffix_order(text)
        self.n, self.sigma = len(text), int(text.max()) + 1
        self.bwt = WaveletMatrix(text[order - 1])
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.sigma))))
        sampled = order % SAMPLE == 0
        self.marks = WaveletMatrix(sampled.astype(np.int64))
        self.samples = order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns of one length, a row each; empty where lo >= hi."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            known = c < self.sigma
            hi[live[~known]] = 0
            live, c = live[known], c[known]
            a, b = self.bwt.rank(c, lo[live], hi[live])
            lo[live], hi[live] = self.before[c] + a, self.before[c] + b
            live = live[lo[live] < hi[live]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        rows, out, steps = rows.copy(), np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            at = rows[live]
            mark, ones = self.marks.access(at)
            done = mark.astype(bool)
            out[live[done]] = self.samples[ones[done]] + steps[live[done]]
            live, at = live[~done], at[~done]
            c, before = self.bwt.access(at)
            rows[live] = self.before[c] + before
            steps[live] += 1
        return out
