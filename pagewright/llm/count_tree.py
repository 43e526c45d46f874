"""R-tree over count vectors, and linking the points of one group with it.

A set's tokens are hashed into groups; the group counts are a point. The overlap of two sets is at most the sum of the
smaller counts, group by group. A node's box has the largest counts below it, so the same sum bounds the overlap with
every point in it. Boxes and points that cannot reach the threshold are passed over; the rest are verified.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Children of a node.
FAN = 16


def enough(overlap, a, b):
    """Whether sets of ``a`` and ``b`` tokens with this overlap have a Jaccard similarity of 3/4 at least."""
    return 7 * overlap >= 3 * (a + b)


class Tree:
    """Points packed by size, then by their fullest spread coordinate; levels from the leaves up."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        m = len(points)
        widest = points[:, np.argmax(points.var(axis=0))] if m > FAN else np.zeros(m)
        slab = np.empty(m, int)
        slab[np.argsort(sizes, kind="stable")] = np.arange(m) // (FAN * FAN)
        self.order = np.lexsort((widest, slab))
        self.levels = []                          # (box of largest counts, smallest size, largest size)
        high, low, top = points[self.order], sizes[self.order], sizes[self.order]
        while True:
            self.levels.append((high, low, top))
            if len(high) <= FAN:
                return
            cuts = np.arange(0, len(high), FAN)
            high, low, top = np.maximum.reduceat(high, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(top, cuts)

    def near(self, point: np.ndarray, size: int) -> np.ndarray:
        """Points whose overlap with the given one is not bounded below the threshold."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low, top = self.levels[depth]
            keep = (4 * top[nodes] >= 3 * size) & (4 * size >= 3 * low[nodes])
            nodes = nodes[keep]
            nodes = nodes[enough(np.minimum(high[nodes], point).sum(axis=1), low[nodes], size)]
            if depth and len(nodes):
                nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
            if not len(nodes):
                return nodes
        return self.order[nodes]


def _folded(point: np.ndarray, groups: int) -> np.ndarray:
    return point.reshape(-1, groups).sum(axis=0)


def link(points: list[np.ndarray], sizes: np.ndarray, verified: Callable[[int, int], bool] | None = None,
         asking: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect the points as all their links would. A pair that is connected already is not looked at again.

    Points have a power of two of groups, more for larger sets; each number of groups has a tree of its own, which holds
    larger points folded. ``verified`` judges a surviving pair; without it the bound decides. ``asking``: only pairs with
    one of these points.
    """
    m = len(points)
    if m < 2:
        return []
    groups, joined, edges = np.array([len(p) for p in points]), np.arange(m), []
    asks = np.zeros(m, bool)
    asks[np.arange(m) if asking is None else asking] = True
    for width in np.unique(groups).tolist():
        level = groups == width
        # larger points are in this tree if their size is near enough to some of this level
        inside = np.flatnonzero(level | ((groups > width) & (3 * sizes <= 4 * sizes[level].max())))
        if len(inside) < 2 or not asks[inside].any():
            continue
        held = np.array([_folded(points[i], width) for i in inside])
        tree = Tree(held, sizes[inside])
        for at, i in enumerate(inside.tolist()):
            if not asks[i]:
                continue
            near = inside[tree.near(held[at], int(sizes[i]))]
            near = near[joined[near] != joined[i]]
            if not level[i]:
                near = near[level[near]]          # pairs of larger points meet in their own tree
            for j in near.tolist():
                if joined[i] != joined[j] and (verified is None or verified(i, j)):
                    edges.append((i, j))
                    joined[joined == joined[j]] = joined[i]
    return edges
