"""FM-index over a sequence of small integers: suffix array, wavelet matrix, backward search.

All steps are numpy passes over whole arrays; many patterns are searched at once.
"""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling the compared length until all ranks differ."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        step = np.empty(n, dtype=np.int64)
        step[:1] = 0
        step[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(step)
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        k *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector with prefix counts for each bit of a symbol."""

    def __init__(self, s: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = ((s >> level) & 1).astype(bool)
            ones = np.zeros(len(s) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(s) - int(ones[-1]))
            s = np.concatenate([s[~bit], s[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c[j] occurs before position i[j]."""
        start = np.zeros_like(i)
        for level in range(self.bits):
            bit = ((c >> (self.bits - 1 - level)) & 1).astype(bool)
            ones, zero = self.ones[level], self.zeros[level]
            a, b = ones[start], ones[i]
            start, i = np.where(bit, zero + a, start - a), np.where(bit, zero + b, i - b)
        return i - start


class FMIndex:
    """Index of s, whose symbols are 0 to size-1; suffix positions divisible by ``sample`` are stored."""

    def __init__(self, s: np.ndarray, size: int, sample: int = 8):
        s = np.concatenate([np.asarray(s, dtype=np.int64) + 1, [0]])  # 0 ends the text and is its least symbol
        order = suffix_array(s)
        self.n = len(s)
        self.last = s[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=size + 1))])
        self.matrix = WaveletMatrix(self.last, max(1, int(size).bit_length()))
        stored = order % sample == 0
        self.place = np.cumsum(stored) - 1
        self.stored, self.positions = stored, order[stored]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of patterns (rows, padded on the right); empty where one doesn't occur."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            on = np.flatnonzero((k < lengths) & (lo < hi))
            c = patterns[on, k] + 1
            base = self.before[c]
            lo[on], hi[on] = base + self.matrix.rank(c, lo[on]), base + self.matrix.rank(c, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix rank: steps back to the nearest stored one."""
        rows, out = rows.astype(np.int64), np.zeros(len(rows), np.int64)
        left, steps = np.arange(len(rows)), 0
        while len(left):
            here = self.stored[rows[left]]
            out[left[here]] = self.positions[self.place[rows[left[here]]]] + steps
            left = left[~here]
            c = self.last[rows[left]]
            rows[left] = self.before[c] + self.matrix.rank(c, rows[left])
            steps += 1
        return out
