"""An FM-index over word symbols: suffix order, wavelet matrix, backward search and sampled positions, in numpy.

The text is a sequence of symbols; 0 separates and is never searched for. Every 0 counts as a symbol of its own,
ordered by position, so suffixes are compared up to the next 0 at most and their order is total.
"""

from __future__ import annotations

import numpy as np

#: Every so many positions the suffix position is kept; starts after a 0 are kept too.
SAMPLE = 16


def suffix_array(text: np.ndarray, n_symbols: int) -> np.ndarray:
    """Prefix doubling; only the suffixes that are still tied are sorted again. text ends with 0."""
    n = len(text)
    words = np.flatnonzero(text)
    rank = np.empty(n, dtype=np.int64)
    separators = n - len(words)
    rank[text == 0] = np.arange(separators)
    counts = np.bincount(text[words], minlength=n_symbols + 1)
    rank[words] = (separators + np.cumsum(counts) - counts)[text[words]]
    tied, step, bits = words[counts[text[words]] > 1], 1, int(n).bit_length()
    while len(tied):
        key = (rank[tied] << bits) | rank[tied + step]
        order = np.argsort(key)
        key, tied = key[order], tied[order]
        first = np.r_[True, key[1:] != key[:-1]]
        base = key >> bits
        group = np.maximum.accumulate(np.where(np.r_[True, base[1:] != base[:-1]], np.arange(len(key)), 0))
        start = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        rank[tied] = base + (start - group)
        tied = tied[~(first & np.r_[first[1:], True])]
        step *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    return order


class Bits:
    """A bit vector with ranks: 64-bit words and the count before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.r_[packed, np.zeros(-len(packed) % 8 + 8, dtype=np.uint8)].view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Wavelet:
    """A wavelet matrix: occurrences of a symbol before a position, and the symbol at a position."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = []
        for bit in reversed(range(max(1, int(n_symbols).bit_length()))):
            on = (symbols >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(on), len(symbols) - int(on.sum())))
            symbols = np.concatenate([symbols[~on], symbols[on]])
        self.start = self._down(np.arange(n_symbols + 1), np.zeros(n_symbols + 1, dtype=np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where(symbol >> bit & 1, zeros + ones, i - ones)
        return i

    def occurrences(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._down(symbol, i) - self.start[symbol]

    def at(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), dtype=np.int64)
        for bit, bits, zeros in self.levels:
            on, ones = bits.get(i), bits.rank(i)
            out |= on.astype(np.int64) << bit
            i = np.where(on, zeros + ones, i - ones)
        return out


class FMIndex:
    def __init__(self, text: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        suffixes = suffix_array(text, n_symbols)
        previous = np.where(suffixes > 0, text[suffixes - 1], 0)
        self.bwt = Wavelet(previous, n_symbols)
        counts = np.bincount(text, minlength=n_symbols + 1)
        self.first = np.cumsum(counts) - counts
        kept = (suffixes % sample == 0) | (previous == 0)
        self.sampled, self.positions = Bits(kept), suffixes[kept]
        self.n = len(text)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges [lo, hi) of all patterns at once, from their last symbol back. patterns: a row each,
        aligned right."""
        lo, hi = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        width = patterns.shape[1]
        for k in range(width):
            live = np.flatnonzero((lengths > k) & (lo < hi))
            symbol = patterns[live, width - 1 - k]
            lo[live] = self.first[symbol] + self.bwt.occurrences(symbol, lo[live])
            hi[live] = self.first[symbol] + self.bwt.occurrences(symbol, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: back through the text to the next kept position."""
        out, steps, todo, at = np.zeros(len(rows), dtype=np.int64), 0, np.arange(len(rows)), rows
        while len(todo):
            known = self.sampled.get(at)
            out[todo[known]] = self.positions[self.sampled.rank(at[known])] + steps
            todo, at = todo[~known], at[~known]
            symbol = self.bwt.at(at)
            at = self.first[symbol] + self.bwt.occurrences(symbol, at)
            steps += 1
        return out
