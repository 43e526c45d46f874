"""Exact top-k search: tiled matrix products of queries and shards, partial selection per tile, tree merging.

Vectors are quantised to whole numbers, so the inner product is an integer and exact: a tile multiplies in doubles where
no sum can pass 2**53, and in Python's unbounded integers where one could. Scores beyond the range of a long are held
at its ends. A query never finds rows of its own id.

Rows without an id, and vectors that are null or hold null or non-finite components, take no part. Shorter vectors count
zero beyond their end. Rows that agree in id and vector count once. Ties go to the smaller id. An empty table, or a
query without candidates, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm import vectors_in_tiles as tiles

LONG = 2**63 - 1
EXACT = 2.0**53
#: Whole numbers are stored over this power of two, which is exact and leaves room for those that no double holds.
UNIT = 2.0**64


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products of whole-number matrices, held to the range of a long."""
    reach = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(1, q.shape[1])
    if reach < EXACT:
        return (q @ v.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in v]
    return np.array([[max(-LONG, min(LONG, sum(int(a) * b for a, b in zip(line, row, strict=True)))) for row in whole]
                     for line in q], np.int64).reshape(len(q), len(v))


def floored(y: Column) -> Column:
    """floor(y) as a double, of any finite y. Spark's own floor makes longs."""
    near = F.rint(y)
    return near - F.when(near > y, 1.0).otherwise(0.0)


def quantised(x: Column, scale: float) -> Column:
    """floor(scale * x) / UNIT; a product beyond doubles is whole anyway, and rounded as if they reached that far."""
    y = F.lit(scale) * x
    return F.when(F.abs(y) == float("inf"), x / UNIT * scale).otherwise(floored(y) / UNIT)


def whole(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers stored: doubles, or Python's integers where a double could not hold one."""
    if max(np.abs(q).max(initial=0), np.abs(v).max(initial=0)) < EXACT / UNIT * EXACT:
        return q * UNIT, v * UNIT
    return tuple(np.array([[int(Fraction(x) * int(UNIT)) for x in row] for row in m.tolist()], object).reshape(m.shape) for m in (q, v))


def top_k(df: DataFrame, is_query: Column, k: int, scale: float = 64.0, vec_id: str = "vec_id", vector: str = "embedding",
          block_rows: int = 4096, shard_rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query`` (of ``id``) its ``k`` highest products with the
    others, of vectors turned into floor(scale * x). A tile holds about ``block_rows * shard_rows`` scores."""
    rows = tiles.prepared(df, vec_id, vector, lambda x: quantised(x, scale))

    def found(q_ids, q, ids, v):
        keys = -products(*whole(q, v))
        out = []
        for own, line in zip(q_ids, keys, strict=True):
            others = np.flatnonzero(ids != own)
            places = others[tiles.first(line[others], ids[others], k)]
            out.append((places, line[places]))
        return out

    hits = tiles.search(rows, rows.where(is_query), found, "bigint", k, block_rows, shard_rows)
    return tiles.ranked(hits, lambda key: -key)
