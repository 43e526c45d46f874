"""Queries against shards of vectors, tile by tile, and tree merging of what the tiles find.

Both sides are dealt by a hash of their id, queries to blocks and rows to shards of a bounded expected size; every block
meets every shard in one task, which holds just those two. A tile keeps ``k`` hits a query. Hits are merged in a tree:
``fan_in`` shards at a time, ``k`` kept at each node, so no task sees more than ``fan_in * k`` hits of a query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import written


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds neither nulls nor non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def prepared(df: DataFrame, vec_id: str, vector: str, component: Callable[[Column], Column]) -> DataFrame:
    """(id, v): rows with an id and a vector that is usable as doubles with its components mapped; written once, read by
    both sides."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    rows = df.select(F.col(vec_id).cast("bigint").alias("id"), doubles.alias("v"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    return written(rows.select("id", F.transform("v", component).alias("v")), "vectors")


def matrix(table: pa.Table, id_: str, vector: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and vectors of a group, by id; rows that agree in both once."""
    ids = table.column(id_).to_numpy()
    lists = table.column(vector).combine_chunks()
    values, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
    rows = np.split(values, ends[:-1]) if len(ends) else []
    seen, keep = set(), []
    for i in np.argsort(ids, kind="stable").tolist():
        if (key := (ids[i], rows[i].tobytes())) not in seen:
            seen.add(key)
            keep.append(i)
    return ids[keep], [rows[i] for i in keep]


def padded(rows: list[np.ndarray], width: int) -> np.ndarray:
    """One matrix; shorter vectors count zero beyond their end."""
    out = np.zeros((len(rows), width), rows[0].dtype if rows else float)
    for line, row in zip(out, rows, strict=True):
        line[:len(row)] = row
    return out


#: (query ids, query matrix, row ids, row matrix) -> for each query the places of its hits in the rows, and their keys
Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]


def first(keys: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest keys, ties by smaller id: partial selection, then a sort of what is left."""
    if len(keys) > k:
        bar = np.partition(keys, k - 1)[k - 1]
        left = np.flatnonzero(keys <= bar)
    else:
        left = np.arange(len(keys))
    return left[np.lexsort((ids[left], keys[left]))[:k]]


def search(rows: DataFrame, queries: DataFrame, found: Search, key_type: str, k: int, block_rows: int, shard_rows: int,
           fan_in: int = 8) -> DataFrame:
    """(query_id, hits): the ``k`` best (key, id) of each query, smallest key first, ties by smaller id."""
    n_rows, n_queries = rows.count(), queries.count()
    shards, blocks = max(1, -(-n_rows // shard_rows)), max(1, -(-n_queries // block_rows))
    left = queries.select("id", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).alias("block"),
                          F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    # names of their own: sides of a cogroup that come from one table are told apart by them
    right = rows.select(F.col("id").alias("row_id"), F.col("v").alias("row"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"),
                        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"))
    arrow = pa.int64() if key_type == "bigint" else pa.float64()
    hit = pa.struct([("key", arrow), ("id", pa.int64())])
    schema = pa.schema([("query_id", pa.int64()), ("node", pa.int64()), ("hits", pa.list_(hit))])

    def tile(key, asked: pa.Table, held: pa.Table) -> pa.Table:
        q_ids, q = matrix(asked, "id", "v")
        ids, v = matrix(held, "row_id", "row")
        width = max((len(x) for x in [*q, *v]), default=0)
        hits = found(q_ids, padded(q, width), ids, padded(v, width)) if len(q) and len(v) else []
        lengths = [len(places) for places, _ in hits]
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        places = np.concatenate([p for p, _ in hits]) if hits else np.zeros(0, int)
        keys = np.concatenate([x for _, x in hits]) if hits else np.zeros(0)
        cells = pa.StructArray.from_arrays([pa.array(keys, arrow), pa.array(ids[places], pa.int64())], fields=list(hit))
        shard = key[0].as_py()
        asked_ids = q_ids[:len(hits)]
        return pa.table([pa.array(asked_ids, pa.int64()), pa.array(np.full(len(hits), shard, np.int64)),
                         pa.ListArray.from_arrays(pa.array(offsets), cells)], schema=schema)

    lists = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        tile, f"query_id bigint, node bigint, hits array<struct<key:{key_type},id:bigint>>")
    while True:
        lists = lists.withColumn("node", F.floor(F.col("node") / fan_in)).groupBy("query_id", "node").agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k).alias("hits"))
        shards = -(-shards // fan_in)
        if shards <= 1:
            return lists.select("query_id", "hits")


def ranked(found: DataFrame, score: Callable[[Column], Column]) -> DataFrame:
    """(query_id, rank, vec_id, score), one row a hit."""
    rows = found.select("query_id", F.posexplode("hits").alias("place", "hit"))
    return rows.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"),
                       score(F.col("hit.key")).alias("score"))
