"""Longest dictionary words in texts, in one pass over numbers: a trie whose nodes are hashes of prefixes.

A node is the hash of a prefix of a word and knows the longest word on its path. Hashes of all stretches of a text come from
one running sum, so the deepest node at each place is found by doubling and then halving the length, for all places at once:
the time grows with the logarithm of the longest word, not with it, and neither with how far words overlap. Words that are
found are compared character by character, so a clash of hashes gives no false word.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads all 64 bits (wraps on overflow)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of some texts one after the other, and the number of each text's."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), sizes


class Keys:
    """Places of 64-bit hashes in a table, found through a directory of their first bits."""

    def __init__(self, keys: np.ndarray):
        """Distinct hashes; ``find`` gives places in their sorted order."""
        self.keys = np.sort(keys)
        bits = max(1, int(2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, asked: np.ndarray) -> np.ndarray:
        """Places of the hashes; the table's size for those that it lacks."""
        n = len(self.keys)
        out = np.full(len(asked), n, np.int64)
        slot = (asked >> self.shift).astype(np.int64)
        at, end = self.starts[slot], self.starts[slot + 1]
        live = np.flatnonzero(at < end)
        while len(live):
            same = self.keys[at[live]] == asked[live]
            out[live[same]] = at[live[same]]
            live = live[~same]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out


class Stretches:
    """Hashes of any stretches of a row of characters."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(1)) * powers(n, _BASE), out=self.sums[1:])
        self.back = powers(n + 1, _BACK)

    def hashes(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return mixed((self.sums[starts + sizes] - self.sums[starts]) * self.back[starts] + sizes.astype(np.uint64))


class Trie:
    """Distinct words that are not empty. Words are numbered as given."""

    def __init__(self, words: list[str]):
        self.codes, self.sizes = code_points(words)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.longest = int(self.sizes.max()) if len(words) else 0
        n = len(self.codes)
        owner = np.repeat(np.arange(len(words)), self.sizes)
        depth = np.arange(n) - self.starts[owner] + 1
        nodes = Stretches(self.codes).hashes(self.starts[owner], depth)
        ends = Keys(nodes[self.starts + self.sizes - 1]) if len(words) else Keys(np.empty(0, np.uint64))
        word_at = np.empty(len(words), np.int64)
        if len(words):
            word_at[ends.find(nodes[self.starts + self.sizes - 1])] = np.arange(len(words))
        met = ends.find(nodes)
        # the last end of a word along each word's own path
        last = np.maximum.accumulate(np.where(met < len(words), np.arange(n), -1)) if n else np.empty(0, np.int64)
        best = np.where(last >= self.starts[owner], word_at[met[last]] if len(words) else -1, -1) if n else np.empty(0, np.int64)
        distinct, first = np.unique(nodes, return_index=True)
        self.nodes, self.best = Keys(distinct), np.append(best[first], -1)

    def nbytes(self) -> int:
        return self.codes.nbytes + self.nodes.keys.nbytes + self.nodes.starts.nbytes + self.best.nbytes + 2 * self.sizes.nbytes

    def longest_at(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each place the number of the longest word that begins there and ends by ``ends``, else -1."""
        n = len(codes)
        found = np.full(n, -1, np.int64)
        if not self.longest or not n:
            return found
        text, node = Stretches(codes), np.full(n, len(self.nodes.keys), np.int64)
        room = np.minimum(ends - np.arange(n), self.longest)
        low, high = np.zeros(n, np.int64), room.copy()  # deepest node known, and the depth that may still be one
        live, step = np.flatnonzero(room > 0), 1
        while len(live):  # double the length while there is a node
            size = np.minimum(step, room[live])
            at = self.nodes.find(text.hashes(live, size))
            hit = at < len(self.nodes.keys)
            node[live[hit]], low[live[hit]] = at[hit], size[hit]
            high[live[~hit]] = size[~hit] - 1
            live = live[hit & (size < room[live])]
            step *= 2
        live = np.flatnonzero(low < high)
        live = live[low[live] > 0]
        while len(live):  # then halve what is left
            size = (low[live] + high[live] + 1) // 2
            at = self.nodes.find(text.hashes(live, size))
            hit = at < len(self.nodes.keys)
            node[live[hit]], low[live[hit]] = at[hit], size[hit]
            high[live[~hit]] = size[~hit] - 1
            live = live[low[live] < high[live]]
        found = self.best[node]
        return self.checked(codes, found)

    def checked(self, codes: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Takes words out whose characters are not those of the text."""
        at = np.flatnonzero(found >= 0)
        for begin in range(0, len(at), 1 << 16):
            own = at[begin : begin + (1 << 16)]
            word = found[own]
            sizes = self.sizes[word]
            firsts = np.cumsum(sizes) - sizes
            inside = np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)
            same = codes[np.repeat(own, sizes) + inside] == self.codes[np.repeat(self.starts[word], sizes) + inside]
            found[own[~np.logical_and.reduceat(same, firsts)]] = -1
        return found


def greedy(found: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the words that a scan from the left takes: the longest at each place, going on behind it."""
    at = np.flatnonzero(found >= 0)
    ends = (at + sizes[found[at]]).tolist()
    kept, end = [], 0
    for i, (b, e) in enumerate(zip(at.tolist(), ends, strict=True)):
        if b >= end:
            kept.append(i)
            end = e
    return at[kept]
