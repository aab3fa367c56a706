"""Vantage-point trees over 64-bit fingerprints under Hamming distance, in numpy.

A node keeps a vantage point and a radius: members within the radius are inside, the rest outside. By the triangle inequality a
query at distance d from the vantage point has no member within r inside if d - r > radius, and none outside if d + r <= radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF = 32


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class Tree:
    """Nodes as arrays; a leaf has inside -1 and members [start, end) of ``order``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, max_leaves: int | None = None):
        self.points = points
        self.order = np.arange(len(points))
        self.vantage: list[int] = []
        self.radius: list[int] = []
        self.inside: list[int] = []
        self.outside: list[int] = []
        self.span: list[tuple[int, int]] = []
        self.leaf_id: list[int] = []
        self.leaves = 0
        self._build(leaf, max_leaves)

    def _node(self, s: int, e: int) -> int:
        for x, v in ((self.vantage, 0), (self.radius, 0), (self.inside, -1), (self.outside, -1), (self.span, (s, e)), (self.leaf_id, -1)):
            x.append(v)
        return len(self.span) - 1

    def _build(self, leaf: int, max_leaves: int | None) -> None:
        rng = np.random.default_rng(7)
        queue = [self._node(0, len(self.points))]
        done = []
        while queue:
            if max_leaves and len(queue) + len(done) >= max_leaves:
                break
            node = queue.pop(0)  # the oldest, so that a bounded tree is balanced
            s, e = self.span[node]
            part = self._split(s, e, rng) if e - s > leaf else None
            if part is None:
                done.append(node)
                continue
            at, radius, vp = part
            self.vantage[node], self.radius[node] = vp, radius
            self.inside[node], self.outside[node] = self._node(s, at), self._node(at, e)
            queue += [self.inside[node], self.outside[node]]
        for node in sorted([*queue, *done], key=lambda k: self.span[k]):
            self.leaf_id[node] = self.leaves
            self.leaves += 1

    def _split(self, s: int, e: int, rng: np.random.Generator) -> tuple[int, int, int] | None:
        members = self.order[s:e]
        for _ in range(4):
            vp = self.points[members[rng.integers(len(members))]]
            d = distance(self.points[members], vp)
            radius = int(np.median(d))
            if radius >= d.max():
                radius = int(d.max()) - 1
            if radius >= 0 and (within := d <= radius).any() and not within.all():
                self.order[s:e] = np.concatenate((members[within], members[~within]))
                return s + int(within.sum()), radius, int(vp)
        return None

    def leaves_within(self, queries: np.ndarray, r: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each leaf with the indices of the queries that can have members within r in it."""
        stack = [(0, np.arange(len(queries)))]
        while stack:
            node, q = stack.pop()
            if not len(q):
                continue
            if self.inside[node] < 0:
                yield node, q
                continue
            d = distance(queries[q], np.uint64(self.vantage[node]))
            stack.append((self.inside[node], q[d - r <= self.radius[node]]))
            stack.append((self.outside[node], q[d + r > self.radius[node]]))

    def pairs(self, queries: np.ndarray, r: int, block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (query index, point index) at distance r or less, exactly."""
        for node, q in self.leaves_within(queries, r):
            s, e = self.span[node]
            members = self.order[s:e]
            step = max(1, block // max(1, len(members)))
            for i in range(0, len(q), step):
                a, b = np.nonzero(distance(queries[q[i : i + step], None], self.points[members][None, :]) <= r)
                yield q[i + a], members[b]

    def route(self, points: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point index, leaf, home): every point at home in one leaf, and copied as a query to each leaf that can hold points within r
        of it and that is parted from its home by a node in which it lies inside. So each pair over a boundary meets once or more."""
        out: list[tuple[np.ndarray, int, bool]] = []
        stack = [(0, np.arange(len(points)), True)]
        while stack:
            node, q, home = stack.pop()
            if not len(q):
                continue
            if self.inside[node] < 0:
                out.append((q, self.leaf_id[node], home))
                continue
            d, radius = distance(points[q], np.uint64(self.vantage[node])), self.radius[node]
            if home:
                stack.append((self.inside[node], q[d <= radius], True))
                stack.append((self.outside[node], q[d > radius], True))
                stack.append((self.outside[node], q[(d <= radius) & (d + r > radius)], False))
            else:
                stack.append((self.inside[node], q[d - r <= radius], False))
                stack.append((self.outside[node], q[d + r > radius], False))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        sizes = [len(q) for q, _, _ in out]
        return np.concatenate([q for q, _, _ in out]), np.repeat([k for _, k, _ in out], sizes), np.repeat([h for _, _, h in out], sizes)


class Labels:
    """Union-find over 0..n-1, a block of links at a time; a label is the smallest member."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (nxt := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = nxt
