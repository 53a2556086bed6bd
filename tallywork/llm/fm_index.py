"""An FM-index over a sequence of whole numbers: wavelet-tree ranks and sampled suffixes.

The sequence is made of segments. Each ends with the separator 0, so no phrase reaches
across two segments, and suffixes are compared up to the next separator only.
"""

from __future__ import annotations

import numpy as np


class RankBits:
    """A bit vector that counts the ones before a position."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletTree:
    """Ranks of symbols, one bit vector per binary digit (the levels lie side by side)."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.digits = max(1, int(alphabet - 1).bit_length())
        self.levels, self.zeros = [], []
        for shift in reversed(range(self.digits)):
            bits = (symbols >> shift) & 1 == 1
            self.levels.append(RankBits(bits))
            self.zeros.append(len(bits) - int(bits.sum()))
            symbols = np.concatenate((symbols[~bits], symbols[bits]))
        every = np.arange(alphabet)
        self.first = self._walk(every, np.zeros(alphabet, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.ones(at)
            at = np.where((symbol >> (self.digits - 1 - level)) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before position ``at``."""
        return self._walk(symbol, at) - self.first[symbol]

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``at`` and how often it occurs before."""
        symbol = np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.levels, self.zeros):
            one, ones = bits.get(at), bits.ones(at)
            symbol = symbol * 2 + one
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at - self.first[symbol]


def suffix_order(sequence: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by doubling the compared length.

    Separators differ from each other (the earlier is the smaller), so the doubling ends with
    the longest segment.
    """
    n = len(sequence)
    separators = sequence == 0
    rank = sequence.astype(np.int64) + np.count_nonzero(separators)
    rank[separators] = np.arange(np.count_nonzero(separators))
    length, order = 1, np.argsort(rank, kind="stable")
    while True:
        ordered = rank[order]
        places = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if not n or places[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = places
        following = np.zeros(n, np.int64)
        following[:-length] = rank[length:] + 1
        key = rank * (n + 1) + following
        order = np.argsort(key, kind="stable")
        rank, length = key, length * 2


class FmIndex:
    """Finds phrases by backward search and locates them by sampled suffix positions."""

    def __init__(self, sequence: np.ndarray, alphabet: int, sample_every: int = 16):
        n = self.size = len(sequence)
        suffixes = suffix_order(sequence)
        counts = np.bincount(sequence, minlength=alphabet)
        self.smaller = np.concatenate(([0], np.cumsum(counts)))[:-1]
        self.transform = WaveletTree(sequence[suffixes - 1].astype(np.int64), alphabet)
        # A walk back never needs to cross a separator: the first place of a segment is sampled.
        sampled = (suffixes % sample_every == 0) | (sequence[suffixes - 1] == 0)
        self.is_sampled = RankBits(sampled)
        self.sampled = suffixes[sampled]
        assert n == 0 or sequence[-1] == 0

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row interval of each phrase; ``phrases`` is right-aligned in its matrix."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        width = phrases.shape[1]
        for step in range(width):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, width - 1 - step]
            low[live] = self.smaller[symbol] + self.transform.rank(symbol, low[live])
            high[live] = self.smaller[symbol] + self.transform.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.is_sampled.get(rows))
        while len(walking):
            symbol, rank = self.transform.symbol_and_rank(rows[walking])
            rows[walking] = self.smaller[symbol] + rank
            steps[walking] += 1
            walking = walking[~self.is_sampled.get(rows[walking])]
        return self.sampled[self.is_sampled.ones(rows)] + steps
