"""A word-level FM-index in numpy: wavelet-tree ranks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np

#: Suffix positions kept: every so many, and each first word after a gap.
SAMPLE = 16
END, GAP = 0, 1  # symbols; words are 2 and up


class BitRank:
    """Bits with the count of ones before any place."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(words)
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(ones[:-1], dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletTree:
    """Symbols by their bits, highest first; at each level zeros are moved before ones, in order."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels: list[tuple[int, BitRank, int]] = []
        for shift in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            bits = ((symbols >> shift) & 1).astype(np.uint8)
            self.levels.append((shift, BitRank(bits), int(len(bits) - bits.sum())))
            symbols = np.concatenate((symbols[bits == 0], symbols[bits == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros_like(at), at
        for shift, bits, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            a, b = bits.rank(low), bits.rank(high)
            low = np.where(one, zeros + a, low - a)
            high = np.where(one, zeros + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before."""
        symbol, low = np.zeros_like(at), np.zeros_like(at)
        for shift, bits, zeros in self.levels:
            one = bits.get(at)
            a, b = bits.rank(low), bits.rank(at)
            low = np.where(one == 1, zeros + a, low - a)
            at = np.where(one == 1, zeros + b, at - b)
            symbol = symbol | (one << shift)
        return symbol, at - low


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; equal gaps count as different, which ends it early."""
    n = len(text)
    gaps = np.flatnonzero(text == GAP)
    rank = text.astype(np.int64) + len(gaps)
    rank[text == END] = 0
    rank[gaps] = 1 + np.arange(len(gaps))
    step = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (second.max() + 1) + second
        order = np.argsort(key, kind="stable")
        there = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate(([0], np.cumsum(there[1:] != there[:-1])))
        if new[order[-1]] == n - 1:
            return order
        rank, step = new, step * 2


class FMIndex:
    """Of a sequence of words (2 and up) in which runs end with a gap (1)."""

    def __init__(self, sequence: np.ndarray, largest: int):
        text = np.concatenate((sequence, [END])).astype(np.int64)
        order = suffix_array(text)
        last = text[order - 1]  # of the whole text's suffix: END
        self.tree = WaveletTree(last, largest)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=largest + 2))))
        self.n = len(text)
        kept = (order % SAMPLE == 0) | (last == GAP) | (last == END)
        self.kept, self.positions = BitRank(kept.astype(np.uint8)), order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For phrases of one length (a row each): the range of suffixes that begin with each."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        for symbol in phrases.T[::-1]:
            low = self.first[symbol] + self.tree.rank(symbol, low)
            high = self.first[symbol] + self.tree.rank(symbol, high)
            high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of the suffixes of these rows."""
        at, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        todo = np.flatnonzero(self.kept.get(at) == 0)
        while len(todo):
            symbol, before = self.tree.access(at[todo])
            at[todo] = self.first[symbol] + before
            steps[todo] += 1
            todo = todo[self.kept.get(at[todo]) == 0]
        return self.positions[self.kept.rank(at)] + steps
