"""Recursions over tag lattices of many sentences at once: one step takes the next position of every sentence."""

from __future__ import annotations

import numpy as np


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Lattice:
    """Positions of sentences that lie one after the other. Empty sentences have no position."""

    def __init__(self, sizes: np.ndarray):
        self.sizes = sizes
        self.starts = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        self.first = self.starts[order]
        self.longest = int(sizes.max()) if len(sizes) else 0
        # of each step how many sentences are long enough
        self.live = np.searchsorted(-sizes[order], -np.arange(self.longest), side="left")
        self.owner = np.repeat(np.arange(len(sizes)), sizes)

    def at(self, step: int) -> np.ndarray:
        return self.first[: self.live[step]] + step

    def followers(self) -> np.ndarray:
        """Positions that are not the first of their sentence."""
        inner = np.ones(int(self.sizes.sum()), bool)
        inner[self.starts[self.sizes > 0]] = False
        return np.flatnonzero(inner)

    def marginals(self, y: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log Z by sentence, tag probabilities by position, and summed probabilities of (previous, next) tags."""
        if not edge.any():  # no position hangs on another
            total = log_sum(y, 1)
            prob, at = np.exp(y - total[:, None]), self.followers()
            return np.bincount(self.owner, total, len(self.sizes)), prob, prob[at - 1].T @ prob[at]
        forward, backward = y.copy(), np.zeros_like(y)
        for step in range(1, self.longest):
            at = self.at(step)
            forward[at] += log_sum(forward[at - 1][:, :, None] + edge, 1)
        for step in range(self.longest - 1, 0, -1):
            at = self.at(step)
            backward[at - 1] = log_sum(edge + (y[at] + backward[at])[:, None, :], 2)
        z = np.zeros(len(self.sizes))
        held = self.sizes > 0
        if held.any():
            z[held] = log_sum(forward[(self.starts + self.sizes - 1)[held]], 1)
        own = z[self.owner][:, None]
        at, pairs = self.followers(), np.zeros_like(edge)
        for begin in range(0, len(at), 1 << 15):
            part = at[begin : begin + (1 << 15)]
            pairs += np.exp(forward[part - 1][:, :, None] + edge + (y[part] + backward[part])[:, None, :] - own[part][:, :, None]).sum(axis=0)
        return z, np.exp(forward + backward - own), pairs

    def viterbi(self, y: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The best tags under each of several edge tables [tables, previous, next], decoded from the right; smaller tags at ties."""
        tables, n, t = len(edges), *y.shape
        if not edges.any():
            return np.broadcast_to(y.argmax(axis=1), (tables, n)).astype(np.int64)
        best, after = np.broadcast_to(y, (tables, n, t)).copy(), np.zeros((tables, n, t), np.int16)
        for step in range(self.longest - 1, 0, -1):
            at = self.at(step)
            total = edges[:, None] + best[:, at][:, :, None, :]
            after[:, at - 1] = total.argmax(axis=3)
            best[:, at - 1] = y[at - 1] + total.max(axis=3)
        tags = np.zeros((tables, n), np.int64)
        table = np.arange(tables)[:, None]
        for step in range(self.longest):
            at = self.at(step)
            tags[:, at] = best[:, at].argmax(axis=2) if step == 0 else after[table, at - 1, tags[:, at - 1]]
        return tags

    def seen_pairs(self, tags: np.ndarray, t: int) -> np.ndarray:
        """Counts of (previous, next) tags."""
        at = self.followers()
        return np.bincount(tags[at - 1] * t + tags[at], minlength=t * t).reshape(t, t).astype(float)
