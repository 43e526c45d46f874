"""Exact cosine top-k. Unit vectors are multiplied in Arrow batches; every task keeps only its own best rows."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagewright.operators.ordered import top_k

QUERY_BYTES = 64 << 20      # question vectors shipped with one pass over the store
PASS_SEARCHES = 1024        # searches of one pass; a task holds the scores of one Arrow batch for all of them


@dataclass(frozen=True)
class Search:
    """One vector search: its list id, its vector, how many rows, and what applies before ranking: an optional
    ``column in allowed`` test, and the cells it is limited to, of rows that carry a ``cell``."""

    key: str
    vector: tuple[float, ...]
    k: int
    column: str | None = None
    allowed: tuple[str, ...] = ()
    cells: frozenset[int] | None = None


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if flat.size != len(column) * width:
        raise ValueError(f"stored vectors and question vectors differ in width (question: {width})")
    return flat.reshape(-1, width).astype(np.float64)


def _best(scores: np.ndarray, ords: list[np.ndarray], k: int) -> np.ndarray:
    """Positions of the k best, ties by list order; all rows tied with the k-th score take part in the tie-break."""
    if scores.size > k:
        floor = np.partition(scores, scores.size - k)[scores.size - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(scores.size)
    return near[np.lexsort((*[o[near] for o in reversed(ords)], -scores[near]))][:k]


def _one_pass(store: DataFrame, searches: list[Search], id_col: str, ord_cols: list[str]) -> DataFrame:
    widths = {len(s.vector) for s in searches}
    if len(widths) != 1:
        raise ValueError("question vectors differ in width")
    width = widths.pop()
    questions = np.array([s.vector for s in searches], dtype=np.float64).T
    filters = sorted({s.column for s in searches if s.column} | {"cell" for s in searches if s.cells is not None})
    named = list(dict.fromkeys([id_col, *ord_cols]))
    out = T.StructType([T.StructField("list_key", T.StringType()), *[store.schema[c] for c in named],
                        T.StructField("score", T.DoubleType())])
    arrow_out = to_arrow_schema(out)

    def part(batches):
        pool = [None] * len(searches)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table.filter(pc.is_valid(table["embedding"])).combine_chunks()
            if not table.num_rows:
                continue
            scores = np.round(_matrix(table["embedding"].combine_chunks(), width) @ questions, 9)
            columns = {c: table[c].to_numpy(zero_copy_only=False) for c in [*named, *filters]}
            for i, s in enumerate(searches):
                rows = (np.flatnonzero(np.isin(columns[s.column].astype(str), list(s.allowed))) if s.column
                        else np.arange(len(scores)))
                if s.cells is not None:
                    rows = rows[np.isin(columns["cell"][rows], list(s.cells))]
                held = [columns[c][rows] for c in named] + [scores[rows, i]]
                if pool[i] is not None:
                    held = [np.concatenate(pair) for pair in zip(pool[i], held)]
                pick = _best(held[-1], [held[named.index(c)] for c in ord_cols], s.k)
                pool[i] = [a[pick] for a in held]
        for s, held in zip(searches, pool):
            if held is not None and len(held[-1]):
                values = [[s.key] * len(held[-1]), *[a.tolist() for a in held]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, type=f.type) for v, f in zip(values, arrow_out)], schema=arrow_out)

    slim = store.select(*named, "embedding", *[c for c in filters if c not in named])
    return slim.mapInArrow(part, out)


def search(store: DataFrame, searches: list[Search], id_col: str, ord_cols: list[str]) -> DataFrame:
    """(list_key, rank, id, order columns, score) of every search, score = cosine of unit vectors.

    All searches share one pass over the store while their vectors fit ``QUERY_BYTES``; more of them take further
    passes. A task emits at most k rows per search, so the shuffle that ranks them is small however large the store.
    """
    if not searches:
        raise ValueError("no searches given")
    per_pass = min(PASS_SEARCHES, max(1, QUERY_BYTES // (8 * max(1, len(searches[0].vector)))))
    found = None
    for i in range(0, len(searches), per_pass):
        rows = _one_pass(store, searches[i:i + per_pass], id_col, ord_cols)
        found = rows if found is None else found.unionByName(rows)
    return _ranked(found, searches, ord_cols)


def _ranked(found: DataFrame, searches: list[Search], ord_cols: list[str]) -> DataFrame:
    limit = max(s.k for s in searches)
    ranked = top_k(found, ["list_key"], [F.col("score").desc(), *ord_cols], limit)
    if len({s.k for s in searches}) > 1:
        wanted = F.create_map(*[F.lit(v) for s in searches for v in (s.key, s.k)])
        ranked = ranked.where(F.col("rank") <= wanted[F.col("list_key")])
    return ranked


def merged(found: list[DataFrame], searches: list[Search], ord_cols: list[str]) -> DataFrame:
    """The results of the same searches over parts of a store that share no row, as those over all of it."""
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return _ranked(rows.drop("rank"), searches, ord_cols)
