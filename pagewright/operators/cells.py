"""Vector cells: cosine search that reads a few cells of a clustered table instead of all of it.

Unit vectors are grouped around centres (spherical k-means, trained on a bounded sample; every row is assigned). The
table is partitioned by cell, so a search that names its cells reads their folders only, and ranks what it reads by exact
scores. Searching the nearest ``probes`` cells is approximate. :func:`search_exact` turns it into an exact search: each
cell knows the widest angle between its centre and its rows, which bounds every score in it; cells whose bound reaches
the k-th score found so far are read as well, no others.

Rows without a vector belong to cell -1, which no search reads. Vectors are taken as unit vectors, as the store's are.
A cell with a third of all rows is several files: rows are rebalanced by size before they are written.
"""

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagewright.operators import vectors
from pagewright.session import materialize

#: Rows a centre is trained on, about, and rows trained on at most.
PER_CELL, SAMPLE = 256, 1 << 20
ROUNDS = 10
#: Bytes of centres that go to every task.
CENTRE_BYTES = 64 << 20
#: Scores that a task holds at once while it assigns.
SCORES = 4_000_000
#: Sums of the training are of whole numbers, so that every run gives the same centres.
_STEP = 1 << 30

_SUMS = pa.schema([("cell", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])
CENTRES = "cell int, n bigint, widest double, centre array<double>"


def _vectors(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows that have a vector, those vectors)."""
    column = batch.column(name)
    here = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(here)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return here, flat.reshape(len(here), -1) if len(here) else flat.reshape(0, 0)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, cosine with its centre) of each row; ties to the smaller cell."""
    cells, cosines, step = [], [], max(1, SCORES // len(centres))
    for i in range(0, len(rows), step):
        scores = rows[i:i + step] @ centres.T
        best = scores.argmax(axis=1)
        cells.append(best)
        cosines.append(scores[np.arange(len(best)), best])
    return (np.concatenate(cells), np.concatenate(cosines)) if cells else (np.zeros(0, int), np.zeros(0))


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _added(table: pa.Table) -> pa.Table:
    total = np.array(table.column("total").to_pylist(), np.int64).sum(axis=0)
    return pa.table({"cell": table.column("cell")[:1], "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()),
                     "total": pa.array([total.tolist()], pa.list_(pa.int64()))}, schema=_SUMS)


def train(rows: DataFrame, id_col: str, cells: int, vector: str = "embedding", rounds: int = ROUNDS,
          per_cell: int = PER_CELL) -> np.ndarray:
    """Centres of ``cells`` cells, or fewer where there are fewer rows; a cell that loses all its rows keeps its centre.

    Trained on about ``per_cell`` rows a cell, ``SAMPLE`` at most, drawn by a digest of the id. Tasks sum their rows by
    cell; the driver holds the centres."""
    held = rows.where(F.col(vector).isNotNull()).select(F.xxhash64(F.col(id_col).cast("string")).alias("draw"), F.col(vector).alias("v"))
    n = held.count()
    if not n:
        return np.zeros((0, 0))
    wanted = min(SAMPLE, cells * per_cell)
    sample = held if n <= wanted else held.where(F.pmod("draw", F.lit(1 << 31)) < int((1 << 31) * wanted / n))
    sample = materialize(sample, "cell-sample")
    first = sample.orderBy("draw", "v").limit(cells).select("v").collect()
    centres = _unit(np.array([r["v"] for r in first], np.float64))
    if centres.nbytes > CENTRE_BYTES:
        raise ValueError(f"{cells} centres of this width pass {CENTRE_BYTES >> 20} MB; ask for fewer cells")
    for _ in range(rounds):
        def summed(batches):
            total, count = np.zeros(centres.shape, np.int64), np.zeros(len(centres), np.int64)
            for batch in batches:
                _, v = _vectors(batch, "v")
                if len(v):
                    own, _ = _nearest(v, centres)
                    np.add.at(total, own, np.rint(v * _STEP).astype(np.int64))
                    count += np.bincount(own, minlength=len(centres))
            held = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(count[held]), pa.array(total[held].tolist(), pa.list_(pa.int64()))],
                                             schema=_SUMS)

        ddl = "cell int, n bigint, total array<bigint>"
        moved = centres.copy()
        for row in sample.select("v").mapInArrow(summed, ddl).groupBy("cell").applyInArrow(_added, ddl).collect():
            moved[row["cell"]] = _unit(np.array([row["total"]], np.float64))[0]
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def assign(rows: DataFrame, centres: np.ndarray, vector: str = "embedding") -> DataFrame:
    """``rows`` with ``cell`` and ``cosine``, the cosine with the cell's centre; -1 and null without a vector."""
    out = T.StructType([*rows.schema, T.StructField("cell", T.IntegerType()), T.StructField("cosine", T.DoubleType())])
    arrow_out = to_arrow_schema(out)

    def placed(batches):
        for batch in batches:
            here, v = _vectors(batch, vector)
            cell, cosine = np.full(batch.num_rows, -1), np.full(batch.num_rows, np.nan)
            if len(here) and len(centres):
                cell[here], cosine[here] = _nearest(v, centres)
            columns = [batch.column(i).cast(f.type) for i, f in enumerate(arrow_out) if i < batch.num_columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cell, pa.int32()), pa.array(cosine, mask=cell < 0)], schema=arrow_out)

    return rows.mapInArrow(placed, out)


def write(rows: DataFrame, centres: np.ndarray, path: str, vector: str = "embedding") -> None:
    """``rows`` below ``path``/rows, a folder for each cell, and their cells below ``path``/cells."""
    assigned = assign(rows, centres, vector)
    assigned.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    spark = rows.sparkSession
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    sizes = spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count("*").alias("n"), F.min("cosine").alias("least"))
    widest = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("least"))))
    (known.join(sizes, "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("n"), widest.alias("widest"), "centre")
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/cells"))


class CellIndex:
    """A table written by :func:`write`. The driver holds its centres; questions name the cells they read."""

    def __init__(self, spark: SparkSession, path: str):
        self.rows = spark.read.parquet(f"{path}/rows")
        held = spark.read.schema(CENTRES).parquet(f"{path}/cells").where("n > 0").orderBy("cell").collect()
        self.cells = np.array([r["cell"] for r in held], int)
        self.sizes = np.array([r["n"] for r in held], int)
        self.widest = np.array([r["widest"] for r in held], float)
        self.centres = np.array([r["centre"] for r in held], float)

    def _probed(self, searches: list[vectors.Search], probes: int) -> list[vectors.Search]:
        if not len(self.cells):
            return []
        scores = np.array([s.vector for s in searches], float) @ self.centres.T
        order = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
        return [replace(s, cells=frozenset(self.cells[near].tolist())) for s, near in zip(searches, order)]

    def read(self, searches: list[vectors.Search]) -> DataFrame:
        """The rows of all cells that some of the searches names."""
        return self.rows.where(F.col("cell").isin(sorted(set().union(*(s.cells for s in searches)))))

    def share(self, searches: list[vectors.Search], probes: int) -> float:
        """Of the rows that have a vector, the share that a search compares, on average."""
        found = self._probed(searches, probes)
        size = dict(zip(self.cells.tolist(), self.sizes.tolist()))
        return float(np.mean([sum(size[c] for c in s.cells) for s in found]) / max(1, self.sizes.sum())) if found else 0.0

    def search(self, searches: list[vectors.Search], id_col: str, ord_cols: list[str], probes: int) -> DataFrame:
        """As :func:`vectors.search`, over the ``probes`` nearest cells of each search. A filtered search that finds fewer
        rows than it asks for there goes over all cells."""
        found = self._probed(searches, probes)
        if not found:
            return vectors.search(self.rows.limit(0), searches, id_col, ord_cols)
        hits = vectors.search(self.read(found), found, id_col, ord_cols)
        if not any(s.column for s in found):
            return hits
        hits = materialize(hits, "cell-hits")
        counts = {r["list_key"]: r["count"] for r in hits.groupBy("list_key").count().collect()}
        short = [replace(s, cells=None) for s in found if s.column and counts.get(s.key, 0) < s.k]
        if not short:
            return hits
        again = vectors.search(self.rows.where("cell >= 0"), short, id_col, ord_cols)
        return hits.where(~F.col("list_key").isin([s.key for s in short])).unionByName(again)

    def search_exact(self, searches: list[vectors.Search], id_col: str, ord_cols: list[str], probes: int) -> DataFrame:
        """As :func:`vectors.search`, exactly: after the nearest cells, those that may hold a better row are read too."""
        found = self._probed(searches, probes)
        if not found:
            return vectors.search(self.rows.limit(0), searches, id_col, ord_cols)
        hits = materialize(vectors.search(self.read(found), found, id_col, ord_cols), "cell-hits")
        floors = {r["list_key"]: r["floor"] for r in hits.groupBy("list_key").agg(
            F.min("score").alias("floor"), F.count("*").alias("n")).collect() if r["n"] >= next(s.k for s in found if s.key == r["list_key"])}
        more = []
        for s in found:
            angle = np.arccos(np.clip(self.centres @ np.array(s.vector), -1, 1))
            bound = np.cos(np.maximum(0.0, angle - self.widest)) + 1e-8    # scores are rounded to nine places
            reach = frozenset(self.cells[bound >= floors.get(s.key, -np.inf)].tolist()) - s.cells
            if reach:
                more.append(replace(s, cells=reach))
        if not more:
            return hits
        again = vectors.search(self.read(more), more, id_col, ord_cols)
        return vectors.merged([hits, again], searches, ord_cols)
