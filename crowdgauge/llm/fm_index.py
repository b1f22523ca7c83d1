"""An FM-index over words: suffix order, Burrows-Wheeler transform in a wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np

_U = np.uint64


class BitVector:
    """Bits in words of 64 with the count of ones before each word."""

    def __init__(self, bits: np.ndarray):
        size = len(bits) // 64 + 1
        padded = np.zeros(size * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(_U)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = (np.cumsum(ones) - ones).astype(np.int32)
        self.ones = int(ones.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word = i >> 6
        below = (_U(1) << (i & 63).astype(_U)) - _U(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """A sequence of symbols below 2**levels, one bit vector for each bit, highest first."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.vectors, self.zeros = levels, [], []
        current = symbols
        for level in range(levels - 1, -1, -1):
            bits = ((current >> level) & 1).astype(np.uint8)
            vector = BitVector(bits)
            self.vectors.append(vector)
            self.zeros.append(len(bits) - vector.ones)
            ones = bits.astype(bool)
            current = np.concatenate([current[~ones], current[ones]])

    def follow(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where place i goes when only ``symbols`` are followed down all levels."""
        for depth, (vector, zeros) in enumerate(zip(self.vectors, self.zeros, strict=True)):
            ones = vector.rank(i)
            up = ((symbols >> (self.levels - 1 - depth)) & 1).astype(bool)
            i = np.where(up, zeros + ones, i - ones)
        return i


class FMIndex:
    """Index of texts over a dense alphabet; patterns of at most ``depth`` symbols are exact.

    ``texts`` are the symbols 1..n of all texts one after the other, each ended by 0; patterns hold no 0.
    Suffixes are ordered by their first ``depth`` symbols.
    """

    def __init__(self, texts: np.ndarray, depth: int = 128):
        n = len(texts)
        rank = texts.astype(np.int64)
        self.ranks, length = {1: rank}, 1
        order = np.argsort(rank, kind="stable")
        while length < depth:
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - length)] = rank[length:] + 1
            both = rank * (int(rank.max()) + n + 2) + ahead
            order = np.argsort(both, kind="stable")
            ordered = both[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
            length *= 2
            self.ranks[length] = rank
        self.suffixes = order
        top = int(texts.max()) if n else 0
        self.matrix = WaveletMatrix(texts[order - 1].astype(np.int64), max(1, top.bit_length()))
        counts = np.bincount(texts, minlength=top + 1)
        starts = np.cumsum(counts) - counts
        symbols = np.arange(top + 1)
        self.shift = starts - self.matrix.follow(symbols, np.zeros(top + 1, np.int64))
        self.size = n

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Intervals of the patterns that ``symbols`` make in front of those of [low, high)."""
        shift = self.shift[symbols]
        return self.matrix.follow(symbols, low) + shift, self.matrix.follow(symbols, high) + shift

    def groups(self, k: int) -> np.ndarray:
        """For each place of the suffix order, the number of its first k symbols among all."""
        whole = 1
        while whole * 2 <= k:
            whole *= 2
        rank = self.ranks[whole]
        ahead = np.minimum(np.arange(self.size) + k - whole, self.size - 1)
        first, second = rank[self.suffixes], rank[ahead[self.suffixes]]
        fresh = np.append(False, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        return np.cumsum(fresh)


def matching_minima(
    index: FMIndex, texts: np.ndarray, first: np.ndarray, size: np.ndarray, lowest: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Matching statistics of streamed texts, read from their ends by backward search.

    ``texts[first : first + size]`` are the streamed texts, which the index holds too, so a search
    never fails. ``lowest`` has a value for each place of the suffix order. Returns, for each place of
    ``texts`` from which ``k`` symbols are left in its text, the least value among all occurrences of
    these symbols, and how often they occur; elsewhere (largest value, 0).
    """
    group = index.groups(k)
    starts = np.append(0, np.flatnonzero(np.diff(group)) + 1)
    least = np.minimum.reduceat(lowest, starts)
    often = np.diff(np.append(starts, len(group)))
    found = np.full(len(texts), np.iinfo(np.int64).max)
    times = np.zeros(len(texts), np.int64)
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    low, high = np.zeros(len(size), np.int64), np.full(len(size), index.size)
    for t in range(1, int(size.max()) + 1 if len(size) else 0):
        n = int(np.searchsorted(-size, -t, side="right"))
        at = first[:n] + size[:n] - t
        low[:n], high[:n] = index.step(texts[at], low[:n], high[:n])
        if t >= k:
            held = group[low[:n]]
            found[at], times[at] = least[held], often[held]
    return found, times
