"""Approximate nearest neighbours: a forest of hash prefixes.

Each tree gives every vector a long string of bits (the sides of ``DEPTH`` random planes, each set at the median of the
shard, so prefixes split the rows evenly) and keeps a shard's strings as one sorted array. A query descends each tree to
its longest prefix, a range of the array; then all trees ascend together, a bit at a time, and their ranges grow until
they hold enough candidates. Distances to the candidates are exact, in doubles, on the original vectors. Shards answer
by themselves; their answers are merged in a tree.

Rows without an id, and vectors that are null, zero, or hold null or non-finite components, take no part. Shorter
vectors count zero beyond their end. Rows that agree in id and vector count once. A query never finds rows of its own
id. Equal distances go to the smaller id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm import vectors_in_tiles as tiles

DEPTH = 32


def strings(planes: np.ndarray, medians: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Bit strings as integers: one line for each tree, one column for each vector."""
    bits = np.einsum("tdw,nw->tnd", planes, v) > medians[:, None, :]
    return (bits.astype(np.uint64) << np.arange(DEPTH - 1, -1, -1, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


def candidates(q: np.ndarray, v: np.ndarray, trees: int, wanted: int) -> list[np.ndarray]:
    """For each query the places in ``v`` that the ascent has gathered when the trees hold ``wanted`` entries in all."""
    planes = np.random.default_rng(20).standard_normal((trees, DEPTH, v.shape[1]))
    medians = np.median(np.einsum("tdw,nw->tdn", planes, v), axis=2)
    held, asked = strings(planes, medians, v), strings(planes, medians, q)
    order = np.argsort(held, axis=1, kind="stable")
    held = np.take_along_axis(held, order, axis=1)
    low, high = np.zeros((trees, len(q)), int), np.zeros((trees, len(q)), int)
    rising = np.ones(len(q), bool)                # queries whose trees still ascend
    for level in range(DEPTH + 1):                # bits given up so far
        shift = np.uint64(level)
        for t in range(trees):
            prefix = asked[t, rising] >> shift
            low[t, rising] = np.searchsorted(held[t], prefix << shift, "left")
            high[t, rising] = np.searchsorted(held[t], ((prefix + np.uint64(1)) << shift) - np.uint64(1), "right")
        rising &= (high - low).sum(axis=0) < wanted
        if not rising.any():
            break
    return [np.unique(np.concatenate([order[t, low[t, i]:high[t, i]] for t in range(trees)])) for i in range(len(q))]


def nearest(df: DataFrame, is_query: Column, k: int, trees: int = 16, per_hit: int = 100, vec_id: str = "vec_id",
            vector: str = "embedding", block_rows: int = 4096, shard_rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query`` (of ``id``) the ``k`` nearest of the candidates
    found, by Euclidean distance. In each shard the trees ascend until they hold ``per_hit * k`` entries together."""
    rows = tiles.prepared(df, vec_id, vector, lambda x: x)
    rows = rows.where(F.exists("v", lambda x: x != 0))

    def found(q_ids, q, ids, v):
        out = []
        for own, point, places in zip(q_ids, q, candidates(q, v, trees, per_hit * k), strict=True):
            places = places[ids[places] != own]
            distance = np.sqrt(((v[places] - point) ** 2).sum(axis=1))
            best = tiles.first(distance, ids[places], k)
            out.append((places[best], distance[best]))
        return out

    hits = tiles.search(rows, rows.where(is_query), found, "double", k, block_rows, shard_rows)
    return tiles.ranked(hits, lambda key: key)
