"""An FM-index over the words of one shard of texts, in arrays."""

from __future__ import annotations

import numpy as np

#: Symbols that an index holds at most, besides the end: three ranks have to fit into a number.
MOST_SYMBOLS = (1 << 21) - 2


def sorted_suffixes(text: np.ndarray) -> np.ndarray:
    """All suffixes in order. ``text`` ends with 0, which stands nowhere else.

    The first sort packs several symbols into a key; each later one compares three
    ranks at a time, so the compared length triples, and only for suffixes that are
    still tied (repeated passages).
    """
    n, bits = len(text), max(1, int(text.max()).bit_length())
    h = max(1, 62 // bits)
    padded = np.concatenate([text, np.zeros(h, text.dtype)])
    key = text.astype(np.int64)
    for k in range(1, h):
        key = key << bits | padded[k : k + n]
    order = np.argsort(key)
    rank, tied = np.zeros(n + 1, np.int64), np.arange(n)
    key = key[order]
    wide = n.bit_length()
    if 3 * wide > 63:
        raise ValueError("a shard of 2 million words at most")
    while True:
        new = np.ones(len(tied), bool)
        new[1:] = key[1:] != key[:-1]
        start = np.maximum.accumulate(np.where(new, tied, 0))
        rank[order[tied]] = start + 1
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
        if not len(tied):
            return order
        s = order[tied]
        key = (rank[s] << wide | rank[np.minimum(s + h, n)]) << wide | rank[np.minimum(s + 2 * h, n)]
        by = np.argsort(key)
        order[tied], key = s[by], key[by]
        h *= 3


class WaveletRanks:
    """Ranks of symbols in a sequence, by a wavelet matrix: one bit of the symbols per level,
    zeros moved before ones, with running counts of ones."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.bits = len(symbols), bits
        self.zeros, self.ones = [], []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b & 1).astype(bool)
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        lo, hi = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, one = self.ones[level], (symbols >> b & 1).astype(bool)
            lo1, hi1 = ones[lo], ones[hi]
            lo = np.where(one, self.zeros[level] + lo1, lo - lo1)
            hi = np.where(one, self.zeros[level] + hi1, hi - hi1)
        return hi - lo

    def at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before it."""
        symbol, lo, p = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64), places.astype(np.int64)
        for level in range(self.bits):
            ones = self.ones[level]
            bit = ones[p + 1] - ones[p] == 1
            lo1, p1 = ones[lo], ones[p]
            lo = np.where(bit, self.zeros[level] + lo1, lo - lo1)
            p = np.where(bit, self.zeros[level] + p1, p - p1)
            symbol = symbol << 1 | bit
        return symbol, p - lo


class FMIndex:
    """Backward search for phrases in a sequence of positive symbols below ``alphabet``.

    The suffixes sampled are those at every ``sample``-th position.
    """

    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = 8):
        text = np.concatenate([symbols, [0]]).astype(np.int32)
        suffixes = sorted_suffixes(text)
        self.n = len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        self.ranks = WaveletRanks(text[suffixes - 1], max(1, int(alphabet - 1).bit_length()))
        kept = suffixes % sample == 0
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.samples = suffixes[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of rows of each phrase; a row of ``phrases`` has as many symbols as its
        length, right-aligned after -1."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero((phrases[:, k] >= 0) & (lo < hi))
            if not len(live):
                continue
            c = phrases[live, k]
            both = self.ranks.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live], hi[live] = self.first[c] + both[: len(c)], self.first[c] + both[len(c) :]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the text: each row steps back to the next sampled suffix."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(left):
            has = self.kept[at + 1] > self.kept[at]
            out[left[has]] = self.samples[self.kept[at[has]]] + steps[left[has]]
            left, at = left[~has], at[~has]
            if len(left):
                c, before = self.ranks.at(at)
                at = self.first[c] + before
                steps[left] += 1
        return out
