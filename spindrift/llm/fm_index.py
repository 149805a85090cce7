"""A compressed FM-index of word sequences in numpy, and matching statistics by backward search.

The sequences' words are numbered; number 0 ends each sequence. The Burrows-Wheeler transform lies in a wavelet matrix of
packed bit vectors with ranks; the lengths of common prefixes of neighbouring suffixes lead from an interval to that of a
shorter match. Suffixes are sorted by their first DEPTH words, which is enough for matches up to that length.
"""

from __future__ import annotations

from itertools import chain

import numpy as np

DEPTH = 64


class _Bits:
    """A bit vector in 64-bit words, and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(counts, dtype=np.int32) - counts
        self.zeros = len(bits) - int(counts.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class FMIndex:
    def __init__(self, sequences: list[list[bytes]]):
        flat = list(chain.from_iterable(sequences))
        number = {w: i for i, w in enumerate(dict.fromkeys(flat), 1)}
        self.lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        self.starts = np.cumsum(self.lengths + 1) - (self.lengths + 1)
        self.n = n = len(flat) + len(sequences)
        words = np.ones(n, bool)
        words[self.starts + self.lengths] = False
        self.text = np.zeros(n, np.int64)
        self.text[words] = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        symbols = len(number) + 1
        ranks, order = self._sort()
        bwt = self.text[order - 1]
        counts = np.bincount(self.text, minlength=symbols)
        first = np.cumsum(counts) - counts
        self.levels = [None] * max(1, (symbols - 1).bit_length())
        rest = bwt
        for k in range(len(self.levels)):
            bit = (rest >> (len(self.levels) - 1 - k) & 1).astype(np.uint8)
            self.levels[k] = _Bits(bit)
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])
        every = np.arange(symbols)
        self.shift = first - self._descend(every, np.zeros(symbols, np.int64))
        self._prefixes(ranks, order)

    def _sort(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Ranks of the suffixes by their first 1, 2, 4, ... words, and their order by the first DEPTH words.

        Each round sorts what the last one left in order, so that only suffixes that were equal so far move.
        """
        order = np.argsort(self.text, kind="stable")
        ranks, width = [self._ranks(order, self.text[order])], 1
        while width < DEPTH:
            rank = ranks[-1].astype(np.int64)
            after = np.zeros(self.n, np.int64)
            after[: max(0, self.n - width)] = rank[width:] + 1
            key = (rank * (self.n + 1) + after)[order]
            step = np.argsort(key, kind="stable")
            order = order[step]
            ranks.append(self._ranks(order, key[step]))
            width *= 2
        return ranks[:-1], order

    def _ranks(self, order: np.ndarray, key: np.ndarray) -> np.ndarray:
        rank = np.empty(self.n, np.int32)
        rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if self.n else 0
        return rank

    def _prefixes(self, ranks: list[np.ndarray], order: np.ndarray) -> None:
        """Words that each suffix shares with the one before it in the order, and the smallest of 1, 2, 4, ... of these."""
        shared = np.zeros(self.n + 1, np.int8)
        if self.n > 1:
            a, b, got = order[:-1], order[1:], np.zeros(self.n - 1, np.int64)
            for k in range(len(ranks) - 1, -1, -1):
                x, y = a + got, b + got
                inside = (x < self.n) & (y < self.n)
                same = inside & (ranks[k][np.minimum(x, self.n - 1)] == ranks[k][np.minimum(y, self.n - 1)])
                got += same << k
            shared[1 : self.n] = got
        shared[0] = shared[-1] = -1
        self.least = [shared]
        while (1 << len(self.least)) <= self.n:
            last, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-half], last[half:]))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, bits in enumerate(self.levels):
            ones = bits.ones(at)
            one = symbol >> (len(self.levels) - 1 - k) & 1
            at = np.where(one == 1, bits.zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of matches longer by one word to the left."""
        both = self._descend(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) + np.concatenate([self.shift[symbol]] * 2)
        return both[: len(lo)], both[len(lo) :]

    def shorten(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next larger interval around each and how many words its suffixes share."""
        least = self.least
        words = np.maximum(least[0][lo], least[0][hi]).astype(np.int64)
        none = words <= 0
        lo, hi = lo.copy(), hi.copy()
        for k in range(len(least) - 1, -1, -1):
            step, row = 1 << k, least[k]
            at = lo - step + 1
            ok = ~none & (at >= 0)
            ok[ok] = row[at[ok]] >= words[ok]
            lo[ok] -= step
            ok = ~none & (hi + step <= self.n + 1)
            ok[ok] = row[hi[ok]] >= words[ok]
            hi[ok] += step
        return np.where(none, 0, lo), np.where(none, self.n, hi), np.maximum(words, 0)

    def statistics(self, which: np.ndarray, least: int = 2) -> list[np.ndarray]:
        """For each word of the chosen sequences, how many words from there on stand `least` times in the index at least.

        Each sequence goes at its own pace: in a round its match grows by a word, or is shortened where it can't.
        """
        sizes, starts = self.lengths[which], self.starts[which]
        out = np.zeros((len(which), int(sizes.max(initial=0))), np.int16)
        rows = np.flatnonzero(sizes)
        at, lo, hi, words = sizes[rows] - 1, np.zeros(len(rows), np.int64), np.full(len(rows), self.n, np.int64), np.zeros(len(rows), np.int64)
        while len(rows):
            x, y = self.extend(self.text[starts[rows] + at], lo, hi)
            longer = y - x >= least
            bad = np.flatnonzero(~longer)
            if len(bad):
                none = words[bad] == 0
                skip, bad = bad[none], bad[~none]
                x[skip], y[skip], words[skip], longer[skip] = 0, self.n, -1, True
                x[bad], y[bad], words[bad] = self.shorten(lo[bad], hi[bad])
            lo, hi = x, y
            words += longer
            out[rows[longer], at[longer]] = words[longer]
            at = at - longer
            on = at >= 0
            if not on.all():
                rows, at, lo, hi, words = rows[on], at[on], lo[on], hi[on], words[on]
        return [out[i, :k] for i, k in enumerate(sizes.tolist())]
