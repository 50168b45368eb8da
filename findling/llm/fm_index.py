"""A word-level FM-index over a shard of texts, in numpy.

The shard is one sequence of symbols: its distinct words, and before every text
a separator of its own, smaller than all words. The suffix array is sorted in
full by prefix doubling; its Burrows-Wheeler transform is kept as a wavelet
matrix of packed bits with running counts, and every eighth text position as a
sample.
"""

from __future__ import annotations

import numpy as np

SAMPLE_EVERY = 8


class BitRank:
    """Packed bits that count the ones before any position."""

    def __init__(self, bits: np.ndarray):
        n_words = len(bits) // 64 + 1
        padded = np.zeros(n_words * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(ones[:-1], dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    """Rank of any symbol before any position of a sequence."""

    def __init__(self, symbols: np.ndarray, n_bits: int):
        self.levels: list[tuple[int, BitRank, int]] = []
        current = symbols
        for shift in range(n_bits - 1, -1, -1):
            ones = (current >> shift) & 1 != 0
            self.levels.append((shift, BitRank(ones), int(len(ones) - ones.sum())))
            current = np.concatenate([current[~ones], current[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` stands before its position ``at``."""
        start = np.zeros_like(at)
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift) & 1 != 0
            lower, upper = bits.rank(start), bits.rank(at)
            start = np.where(one, zeros + lower, start - lower)
            at = np.where(one, zeros + upper, at - upper)
        return at - start

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it stands before it."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for shift, bits, zeros in self.levels:
            one = bits.get(at)
            lower, upper = bits.rank(start), bits.rank(at)
            start = np.where(one, zeros + lower, start - lower)
            at = np.where(one, zeros + upper, at - upper)
            symbol |= one.astype(symbol.dtype) << shift
        return symbol, at - start


def suffix_array(symbols: np.ndarray, n_symbols: int) -> np.ndarray:
    """Starts of all suffixes in order; a suffix that ends is smaller than any that goes on."""
    n = len(symbols)
    width = max(1, int(n_symbols + 1).bit_length())
    depth = max(1, min(62 // width, n))
    padded = np.concatenate([symbols + 1, np.zeros(depth, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key = key << width | padded[k : k + n]
    order = np.argsort(key)
    ordered = key[order]
    starts = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    # A suffix is ranked by where its group begins, so ranks stay true while groups split.
    group = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)
    rank[n] = -1
    rank[order] = group
    while True:
        tied = np.nonzero(~starts | np.concatenate([~starts[1:], [False]]))[0]
        if not len(tied):
            return order
        suffix = order[tied]
        after = rank[np.minimum(suffix + depth, n)]
        by = np.lexsort((after, rank[suffix]))
        order[tied] = suffix[by]
        ranks, after = rank[suffix[by]], after[by]
        new = np.concatenate([[True], (ranks[1:] != ranks[:-1]) | (after[1:] != after[:-1])])
        starts[tied] = new
        rank[order[tied]] = np.maximum.accumulate(np.where(new, tied, 0))
        depth *= 2


class FMIndex:
    """Counts and places of phrases in a sequence of symbols below ``n_symbols``."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        symbols = symbols.astype(np.int64)
        order = suffix_array(symbols, n_symbols)
        n_bits = max(1, int(max(n_symbols - 1, 1)).bit_length())
        self.bwt = WaveletMatrix(symbols[order - 1], n_bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols))])
        sampled = order % SAMPLE_EVERY == 0
        self.sampled, self.places, self.n = BitRank(sampled), order[sampled], len(symbols)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases, right-aligned rows of symbols; a negative one is absent."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        alive = np.arange(len(phrases))
        for back in range(1, phrases.shape[1] + 1):
            symbol = phrases[alive, -back]
            going = lengths[alive] >= back
            alive, symbol = alive[going], symbol[going]
            absent = symbol < 0
            high[alive[absent]] = low[alive[absent]]
            alive, symbol = alive[~absent], symbol[~absent]
            low[alive] = self.first[symbol] + self.bwt.rank(symbol, low[alive])
            high[alive] = self.first[symbol] + self.bwt.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the sequence of every row, by walking back to a sample."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.nonzero(~self.sampled.get(at))[0]
        while len(walking):
            symbol, before = self.bwt.get(at[walking])
            at[walking] = self.first[symbol] + before
            steps[walking] += 1
            walking = walking[~self.sampled.get(at[walking])]
        return self.places[self.sampled.rank(at)] + steps
