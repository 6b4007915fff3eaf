"""FM-index of word sequences: a wavelet matrix over the transform, backward search for many streamed sequences at once.

Suffixes are sorted by their first ``depth`` words only; searches never ask for more, and up to that length counting in a
prefix of the transform is exact. A sequence that matched ``depth`` words goes on from the words without the last one:
the suffixes that share ``depth - 1`` words stand together, and a bit vector marks where such runs begin.
"""

from __future__ import annotations

import numpy as np

#: Marks a place without an owner.
NOBODY = np.iinfo(np.int64).max


class BitVector:
    """Packed bits with the number of ones before each word of 64."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """A sequence of symbols, one bit vector per bit of a symbol, highest first."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        self.levels: list[tuple[int, BitVector, int]] = []
        rest = symbols.astype(np.uint32)
        for bit in reversed(range(max(1, int(kinds - 1).bit_length()))):
            ones = (rest >> np.uint32(bit)) & np.uint32(1)
            zeros = rest[ones == 0]
            self.levels.append((bit, BitVector(ones), len(zeros)))
            rest = np.concatenate((zeros, rest[ones == 1]))
        self.begin = np.zeros(0, dtype=np.int64)
        self.begin = self._descend(np.arange(kinds), np.zeros(kinds, dtype=np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, vector, zeros in self.levels:
            ones = vector.rank(at)
            at = np.where((symbol >> bit) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs among the first ``at`` places."""
        return self._descend(symbol, at) - self.begin[symbol]


def _ranks(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    fresh = np.zeros(len(key), dtype=np.int64)
    fresh[1:] = key[order][1:] != key[order][:-1]
    out = np.empty(len(key), dtype=np.int64)
    out[order] = np.cumsum(fresh)
    return out


class FmIndex:
    """Index of sequences of symbols 1 .. kinds - 1, back to back in ``symbols`` with ``bounds``; each has an owner."""

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray, owners: np.ndarray, kinds: int, depth: int):
        self.depth = depth
        sizes = np.diff(bounds) + 1  # each sequence is closed by symbol 0
        begin = np.cumsum(sizes) - sizes
        n = int(sizes.sum())
        text = np.zeros(n, dtype=np.int64)
        body = np.ones(n, dtype=bool)
        body[begin + sizes - 1] = False
        text[body] = symbols
        end = np.repeat(begin + sizes - 1, sizes)
        place = np.arange(n)

        def paired(rank: np.ndarray, ahead: int) -> np.ndarray:
            """Rank of a suffix and of the one ``ahead`` of it in the same sequence."""
            there = place + ahead
            inside = there < end
            return rank * (int(rank.max(initial=0)) + 1) + np.where(inside, rank[np.where(inside, there, 0)], 0)

        rank, sorted_by = text, 1
        while 2 * sorted_by < depth:
            rank = _ranks(paired(rank, sorted_by))
            sorted_by *= 2
        whole = paired(rank, depth - sorted_by)
        shorter = paired(rank, depth - 1 - sorted_by)
        order = np.argsort(whole)
        self.size = n
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=kinds))))
        first = np.zeros(n, dtype=bool)
        first[begin] = True
        transform = np.where(first[order], 0, text[order - 1])
        self.wavelets = WaveletMatrix(transform, kinds)

        def groups(key: np.ndarray) -> np.ndarray:
            fresh = np.ones(n, dtype=bool)
            fresh[1:] = key[order][1:] != key[order][:-1]
            return fresh

        runs = groups(shorter)
        self.runs, self.run_begin = BitVector(runs), np.append(np.flatnonzero(runs), n)
        equal = groups(whole)
        self.equal = BitVector(equal)
        owner = np.repeat(owners, sizes)[order]
        self.first_owner = np.minimum.reduceat(owner, np.flatnonzero(equal)) if n else owner

    def first_owners(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each place of the streamed sequences the smallest owner of the ``depth`` words that begin there, else NOBODY.

        All sequences go from right to left together. A match that can't be longer drops its last word and begins anew
        there; a match of full length keeps its words but the last. Symbol 0 stands for words that the index doesn't hold.
        """
        out = np.full(len(symbols), NOBODY, dtype=np.int64)
        begin, end = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
        keep = end - begin >= self.depth
        begin, end = begin[keep], end[keep]
        at, low, high = end.copy(), np.zeros(len(end), dtype=np.int64), np.full(len(end), self.size, dtype=np.int64)
        while len(begin):
            full = end - at == self.depth
            run = self.runs.rank(low + 1) - 1
            low, high = np.where(full, self.run_begin[run], low), np.where(full, self.run_begin[run + 1], high)
            end = end - full
            symbol = symbols[at - 1]
            both = self.wavelets.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
            base = self.counts[symbol]
            new_low, new_high = base + both[: len(symbol)], base + both[len(symbol) :]
            met = (new_high > new_low) & (symbol > 0)
            alone = ~met & (at == end)  # the index doesn't hold this word
            end = np.where(met, end, end - 1)
            at = np.where(met | alone, at - 1, end)
            low, high = np.where(met, new_low, 0), np.where(met, new_high, self.size)
            done = np.flatnonzero(met & (end - at == self.depth))
            out[at[done]] = self.first_owner[self.equal.rank(low[done] + 1) - 1]
            go = (end - begin >= self.depth) & (at > begin)
            if not go.all():
                begin, end, at, low, high = begin[go], end[go], at[go], low[go], high[go]
        return out
