"""A compressed full-text index (FM-index) over word numbers, searched backward for many texts at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with the number of ones before each 64 bits."""

    def __init__(self, bit: np.ndarray):
        padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, np.uint8)
        padded[: len(bit)] = bit
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.ones = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = places >> 6
        below = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Rank over a sequence of small numbers: one packed bit vector for each bit of the numbers."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels = max(1, int(top - 1).bit_length())
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        n = len(values)
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            self.bits.append(Bits(bit))
            self.zeros.append(n - int(bit.sum()))
            values = np.concatenate((values[~bit], values[bit]))
        starts = np.zeros(top, np.int64)
        self.first = self.trace(np.arange(top), starts)

    def trace(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            ones = self.bits[k].rank(places)
            places = np.where(symbols >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, places - ones)
        return places

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol comes before its place."""
        return self.trace(symbols, places) - self.first[symbols]


class FmIndex:
    """Index of several sequences of word numbers (1 and up), sorted by their first ``depth`` words.

    It holds the wavelet matrix of the Burrows-Wheeler transform, the symbol starts, and bit marks at the rows where the
    first ``depth`` or ``depth - 1`` words change. It answers for patterns of up to ``depth`` words. Neither the text nor
    its suffix order stays in memory. ``least`` holds the smallest owner of the texts in each group of rows with equal
    first ``depth`` words.
    """

    def __init__(self, sequences: list[np.ndarray], depth: int, symbols: int, owners: list[int]):
        self.depth = depth
        sizes = np.array([len(s) for s in sequences])
        text = np.zeros(int((sizes + 1).sum()), np.int64)
        base = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        for at, s in zip(base, sequences, strict=True):
            text[at : at + len(s)] = s
        rank, short = self.sort(text, depth)
        order = np.argsort(rank, kind="stable")
        self.matrix = WaveletMatrix(text[order - 1], symbols + 1)
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols + 1))))
        self.n = len(text)
        self.fresh, firsts = self.marks(rank[order])
        self.least = np.full(len(firsts), np.iinfo(np.int64).max)
        np.minimum.at(self.least, rank, np.repeat(np.array(owners, np.int64), sizes + 1))  # ranks number the groups
        self.wide, edges = self.marks(short[order])
        self.edges = np.append(edges, self.n)

    @staticmethod
    def marks(ranks: np.ndarray) -> tuple[Bits, np.ndarray]:
        """Bits at the rows whose rank is new, and these rows."""
        new = np.concatenate(([True], ranks[1:] != ranks[:-1]))
        return Bits(new), np.flatnonzero(new)

    def group(self, rows: np.ndarray) -> np.ndarray:
        """Which group of rows with equal first ``depth`` words each row is in."""
        return self.fresh.rank(rows + 1) - 1

    def wider(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that share all but the last of the first ``depth`` words."""
        at = self.wide.rank(rows + 1) - 1
        return self.edges[at], self.edges[at + 1]

    @staticmethod
    def sort(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of all suffixes by their first ``depth`` words and by one fewer, by doubling."""

        def joined(rank: np.ndarray, step: int) -> np.ndarray:
            ahead = np.zeros(len(rank), np.int64)
            ahead[: len(rank) - step] = rank[step:] + 1
            return np.unique(rank * np.int64(len(rank) + 2) + ahead, return_inverse=True)[1].astype(np.int64)

        rank, sorted_to = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
        if depth == 1:
            return rank, np.zeros(len(text), np.int64)
        while sorted_to * 2 < depth:
            rank, sorted_to = joined(rank, min(sorted_to, len(text))), sorted_to * 2
        short = joined(rank, depth - 1 - sorted_to) if depth - 1 > sorted_to else rank
        return joined(rank, min(depth - sorted_to, len(text))), short

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search."""
        both = self.matrix.rank(np.concatenate((symbols, symbols)), np.concatenate((lo, hi)))
        start = self.starts[symbols]
        return start + both[: len(lo)], start + both[len(lo) :]

    def match(self, queries: list[np.ndarray]) -> list[np.ndarray]:
        """For each query and each of its windows of ``depth`` words, the group of index rows that begin with it; -1 if none.

        Queries are read from their ends. A match is kept at ``depth`` words and loses its last word before the next
        step. If a step finds nothing, no window can hold that word and all words of the match: the search starts again
        one word further left than the match began.
        """
        depth, sizes = self.depth, np.array([len(q) for q in queries])
        out = [np.full(max(0, n - depth + 1), -1, np.int64) for n in sizes]
        todo = np.flatnonzero(sizes >= depth)
        flat = np.concatenate([*queries, np.zeros(1, np.int64)]).astype(np.int64)
        base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        end = sizes[todo].copy()  # where the match ends
        at = end.copy()  # where it begins
        lo, hi = np.zeros(len(todo), np.int64), np.full(len(todo), self.n, np.int64)
        found_query, found_place, found_group = [], [], []
        while len(todo):
            symbols = flat[base[todo] + at - 1]
            new_lo, new_hi = self.extend(symbols, lo, hi)
            good = (new_hi > new_lo) & (symbols > 0)
            at = at - good
            lo, hi = np.where(good, new_lo, 0), np.where(good, new_hi, self.n)
            end = np.where(good, end, np.minimum(end - 1, end))
            at = np.where(good, at, end)
            full = good & (end - at == depth)
            if full.any():
                rows = lo[full]
                found_query.append(todo[full])
                found_place.append(at[full])
                found_group.append(self.group(rows))
                lo[full], hi[full] = self.wider(rows)
                end = end - full
            # the window that would start at the next word to the left must end where the match ends
            more = np.where(good, at > 0, end >= depth) & (end >= depth)
            if not more.all():
                todo, at, end, lo, hi = todo[more], at[more], end[more], lo[more], hi[more]
        if found_query:
            who, place, group = np.concatenate(found_query), np.concatenate(found_place), np.concatenate(found_group)
            for q, p, g in zip(who.tolist(), place.tolist(), group.tolist(), strict=True):
                out[q][p] = g
        return out
