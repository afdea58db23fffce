"""FM-index over integer symbols, all operations on whole arrays."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling. s must end with a unique smallest symbol, 0. The
    first round compares as many symbols as fit into one number."""
    n = len(s)
    bits = max(1, int(s.max()).bit_length())
    width = max(1, min(n, 62 // bits))
    key = s.astype(np.int64)
    for k in range(1, width):
        key <<= bits
        key[: n - k] |= s[k:]
    rank = np.empty(n, dtype=np.int64)
    while True:
        order = np.argsort(key)  # equal keys get the same rank, whatever their order
        in_order = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(in_order[1:] != in_order[:-1])])
        if rank[order[-1]] == n - 1 or width >= n:
            return order
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        width *= 2


class WaveletMatrix:
    """rank(c, i): occurrences of c among the first i symbols."""

    def __init__(self, s: np.ndarray, sigma: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        s = s.astype(np.int64)
        for bit in reversed(range(max(1, int(sigma - 1).bit_length()))):
            ones = (s >> bit) & 1
            before = np.concatenate([[0], np.cumsum(ones, dtype=np.int32)])
            zeros = len(s) - int(before[-1])
            self.levels.append((bit, before, zeros))
            s = np.concatenate([s[ones == 0], s[ones == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        start = np.zeros_like(i)
        for bit, before, zeros in self.levels:
            one = ((c >> bit) & 1).astype(bool)
            up_i, up_s = before[i], before[start]
            i = np.where(one, zeros + up_i, i - up_i)
            start = np.where(one, zeros + up_s, start - up_s)
        return i - start


class FMIndex:
    """Count and locate phrases in a sequence of symbols >= 1 (0 is the end mark)."""

    def __init__(self, symbols: np.ndarray, sigma: int, step: int = 16):
        s = np.concatenate([symbols, [0]]).astype(np.int64)
        order = suffix_array(s)
        self.n = len(s)
        self.bwt = s[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])
        self.wavelet = WaveletMatrix(self.bwt, sigma)
        kept = order % step == 0
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.kept, self.samples = kept, order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all rows of phrases at once: suffix ranges [low, high)."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        for k in reversed(range(phrases.shape[1])):
            c = phrases[:, k]
            low = self.first[c] + self.wavelet.rank(c, low)
            high = self.first[c] + self.wavelet.rank(c, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back until a sampled row."""
        rows, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        todo = np.flatnonzero(~self.kept[rows])
        while len(todo):
            at = rows[todo]
            c = self.bwt[at]
            rows[todo] = self.first[c] + self.wavelet.rank(c, at)
            steps[todo] += 1
            todo = todo[~self.kept[rows[todo]]]
        return self.samples[self.kept_before[rows]] + steps
