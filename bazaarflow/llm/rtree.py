"""STR-packed R-trees over integer vectors, searched by windows of the inner product.

A box bounds the inner product with a query coordinate by coordinate: a positive component takes the
box's upper or lower end, a negative one the other. The search keeps a best-first queue of boxes.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np

LEAF = 128
FANOUT = 16
SPLIT_DIMS = 4
_EXACT = float(2**53)


class Tree(NamedTuple):
    """``points`` in packed order; node i has children (or, in a leaf, points) first[i] up to last[i]."""

    order: np.ndarray
    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    last: np.ndarray
    leaves: int  # nodes 0 to leaves - 1 are leaves, the last node is the root


class Window(NamedTuple):
    """Scores that are wanted; None for no limit."""

    tag: int
    low: int | None
    high: int | None


def packed_order(points: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Sort-tile-recursive order: slabs along the widest-spread coordinate, each tiled along the next."""
    spread = points.astype(np.float64).var(axis=0) if len(points) else np.zeros(points.shape[1])
    dims = np.argsort(-spread, kind="stable")[:SPLIT_DIMS].tolist()
    out: list[np.ndarray] = []
    stack = [(np.arange(len(points)), dims)]
    while stack:
        some, rest = stack.pop()
        if not rest:
            out.append(some)
            continue
        some = some[np.argsort(points[some, rest[0]], kind="stable")]
        tiles = -(-len(some) // leaf)
        slabs = max(1, round(tiles ** (1 / len(rest)) + 0.49))
        size = max(1, -(-tiles // slabs)) * leaf
        stack += [(some[i:i + size], rest[1:]) for i in range(0, len(some), size)][::-1]
    return np.concatenate(out) if out else np.arange(0)


def build(points: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT) -> Tree:
    order = packed_order(points, leaf)
    points = points[order]
    starts = np.arange(0, len(points), leaf)
    first, last = [starts], [np.minimum(starts + leaf, len(points))]
    low = [np.minimum.reduceat(points, starts, axis=0)]
    high = [np.maximum.reduceat(points, starts, axis=0)]
    begin = 0
    while len(low[-1]) > 1:
        count = len(low[-1])
        starts = np.arange(0, count, fanout)
        low.append(np.minimum.reduceat(low[-1], starts, axis=0))
        high.append(np.maximum.reduceat(high[-1], starts, axis=0))
        first.append(begin + starts)
        last.append(begin + np.minimum(starts + fanout, count))
        begin += count
    return Tree(order, points, np.concatenate(low), np.concatenate(high), np.concatenate(first),
                np.concatenate(last), len(low[0]))


def exact(tree: Tree, queries: np.ndarray) -> tuple[Tree, np.ndarray]:
    """Tree and queries in a type whose inner products are exact: doubles, or Python integers beyond."""
    largest = max(float(np.abs(tree.low.astype(np.float64)).max(initial=0)),
                  float(np.abs(tree.high.astype(np.float64)).max(initial=0)))
    asked = float(np.abs(queries.astype(np.float64)).max(initial=0))
    kind = np.float64 if largest * asked * max(1, queries.shape[1]) < _EXACT else object
    return tree._replace(
        points=tree.points.astype(kind), low=tree.low.astype(kind), high=tree.high.astype(kind)), queries.astype(kind)


def intervals(tree: Tree, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest inner product each query can have with a point of each node."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    return up @ tree.low.T + down @ tree.high.T, up @ tree.high.T + down @ tree.low.T


class Best:
    """The k best of one window so far: scores descending, then ids ascending."""

    def __init__(self, window: Window, k: int):
        self.window, self.k = window, k
        self.scores: list[int] = []
        self.ids: list[int] = []

    def needs(self):
        """Scores below this cannot be among the best; None while every score can."""
        if len(self.ids) == self.k:
            return self.scores[-1]
        return self.window.low

    def add(self, scores: np.ndarray, ids: list[list[int]], own: int | None) -> None:
        found = list(zip([-s for s in self.scores], self.ids))
        for score, several in zip(scores.tolist(), ids):
            found += [(-int(score), i) for i in several if i != own]
        best = sorted(found)[:self.k]
        self.scores, self.ids = [-s for s, _ in best], [i for _, i in best]


def search(
    tree: Tree, low: np.ndarray, high: np.ndarray, query: np.ndarray, bests: list[Best], ids: list[list[int]],
    own: int | None,
) -> int:
    """Let the points of ``tree`` compete for one query's windows; returns how many leaves were read.

    ``low`` and ``high`` are the query's ``intervals``, ids[p] the rows that hold point p of the packed
    order. The queue gives the box with the greatest possible score. A box is pruned when its
    interval lies outside a window or strictly below the window's k-th best, for every window; when
    that holds for the greatest, it holds for all.
    """
    def wanted(node: int) -> bool:
        for best in bests:
            need = best.needs()
            if (need is None or high[node] >= need) and (best.window.high is None or low[node] <= best.window.high):
                return True
        return False

    root = len(tree.low) - 1
    queue = [(-high[root], root)]
    read = 0
    while queue:
        greatest, node = heapq.heappop(queue)
        needs = [best.needs() for best in bests]
        if all(need is not None and -greatest < need for need in needs):
            break
        if not wanted(node):
            continue
        first, last = int(tree.first[node]), int(tree.last[node])
        if node >= tree.leaves:
            for child in range(first, last):
                if wanted(child):
                    heapq.heappush(queue, (-high[child], child))
            continue
        read += 1
        scores = tree.points[first:last] @ query
        for best, need in zip(bests, needs):
            fits = np.ones(len(scores), bool) if need is None else scores >= need
            if best.window.high is not None:
                fits &= scores <= best.window.high
            some = np.flatnonzero(fits)
            enough = best.k + (own is not None)
            if some.size > enough:  # all that tie with the last one stay
                cut = np.sort(scores[some])[-enough]
                some = some[scores[some] >= cut]
            if some.size:
                best.add(scores[some], [ids[first + p] for p in some], own)
    return read
