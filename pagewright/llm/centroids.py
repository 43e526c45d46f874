"""Centroid clustering over zone maps of a space-filling curve.

Vectors are laid out once along a Hilbert curve over a coarse grid of all their components: range-partitioned and sorted by
curve key, then cut into blocks of neighbours. A block is one row: its vectors as one matrix, and the box of their smallest
and largest components. A round reads the blocks and nothing else. The nearest and the farthest point of a box bound the
distance from a centroid to all that the block holds; a centroid whose nearest point is farther than the farthest point of another
is no candidate of the block. Vectors are compared with the candidates of their block by one matrix product, exactly.
Each task sums its vectors by cluster; those sums, a row for each cluster, are summed in two steps.

Components are whole numbers, ``floor(SCALE * x)``. Blocks of components below ``NARROW`` compute in doubles, in which all
values that occur are whole and below 2**53; a block that holds a larger one computes in Python's integers, without a box. Sums are exact always. A
distance or a total that passes 64 bits is null. A round that moves no centroid is the last that is computed: further ones would repeat it.

Vectors that are null, of another length, or hold null or non-finite components take no part. Rows count as often as they
stand, those equal in id and vector too. A missing id reads as an empty string where first centroids are drawn; equal draws go by
components. With fewer vectors than centroids there are fewer centroids. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import written

LENGTH, SCALE = 64, 1024
CENTROIDS, ROUNDS, SEED = 8, 10, 3
#: Vectors of a block; bits of the grid for each component.
BLOCK, BITS = 64, 3
#: Magnitude below which squared distances of ``LENGTH`` components are exact in doubles.
NARROW = 1 << 22
#: Parts that tasks' sums meet in before they meet by cluster alone.
PARTS = 32


def kept(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", length: int = LENGTH) -> DataFrame:
    """(vec_id, v): the vectors that take part, as doubles."""
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("v").isNotNull() & (F.size("v") == length) & ~F.coalesce(bad, F.lit(True)))


def curve_keys(grid: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Places along the Hilbert curve of grid points (a row each, ``bits`` bits a coordinate), as bytes that sort like them."""
    x = grid.T.astype(np.uint8)
    n, q = len(x), 1 << (bits - 1)
    while q > 1:                                  # turn every sub-cube back to the first one's orientation
        low = np.uint8(q - 1)
        for i in range(n):
            on = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] ^= np.where(on, low, swap)
            x[i] ^= np.where(on, 0, swap).astype(np.uint8)
        q >>= 1
    for i in range(1, n):                         # Gray code
        x[i] ^= x[i - 1]
    turn, q = np.zeros(x.shape[1], np.uint8), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[n - 1] & q, q - 1, 0).astype(np.uint8)
        q >>= 1
    x ^= turn
    planes = np.stack([(x >> np.uint8(b)) & 1 for b in range(bits - 1, -1, -1)])     # bit, coordinate, point
    packed = np.packbits(planes.reshape(bits * n, -1).T, axis=1)
    return [row.tobytes() for row in packed]


def _matrix(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly, ``scale`` a power of two."""
    return math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale


_BLOCK = "ids array<bigint>, narrow boolean, held binary, low array<int>, high array<int>"
_BLOCK_SCHEMA = pa.schema([("ids", pa.list_(pa.int64())), ("narrow", pa.bool_()), ("held", pa.binary()), ("low", pa.list_(pa.int32())),
                           ("high", pa.list_(pa.int32()))])


def blocks(vectors: DataFrame, length: int = LENGTH, scale: int = SCALE, size: int = BLOCK, bits: int = BITS) -> DataFrame:
    """One row a block of ``vectors`` along the curve: ids, vectors, box."""
    of = [F.get("v", F.lit(i)) for i in range(length)]
    spread = vectors.agg(F.array(*map(F.avg, of)).alias("mean"), F.array(*map(F.stddev_pop, of)).alias("deviation")).first()
    mean = np.array([x if x is not None and math.isfinite(x) else 0.0 for x in spread["mean"]])
    cell = np.array([4 * x / (1 << bits) if x and math.isfinite(x) else 1.0 for x in spread["deviation"]])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                grid = np.clip(np.floor((_matrix(batch, length) - mean) / cell) + (1 << bits) // 2, 0, (1 << bits) - 1)
                yield batch.append_column("curve", pa.array(curve_keys(grid, bits), pa.binary()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for start in range(0, batch.num_rows, size):
                some = batch.slice(start, size)
                x = _matrix(some, length)
                row = {"ids": some.column("vec_id").to_pylist(), "narrow": bool((np.abs(x) < NARROW / scale - 1).all())}
                if row["narrow"]:
                    v = np.floor(x * scale).astype(np.int32)
                    row |= {"held": v.tobytes(), "low": v.min(axis=0), "high": v.max(axis=0)}
                else:
                    row |= {"held": x.tobytes(), "low": None, "high": None}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=_BLOCK_SCHEMA)

    keyed = written(vectors.mapInArrow(placed, "vec_id bigint, v array<double>, curve binary"), "curve")
    return written(keyed.repartitionByRange("curve").sortWithinPartitions("curve", "vec_id", "v").mapInArrow(cut, _BLOCK), "blocks")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Centroids that may be nearest to a vector in the box, ascending."""
    nearest = (np.maximum(np.maximum(low - centroids, centroids - high), 0) ** 2).sum(axis=1)
    farthest = (np.maximum(np.abs(centroids - low), np.abs(high - centroids)) ** 2).sum(axis=1)
    return np.flatnonzero(nearest <= farthest.min())


class Assigner:
    """Nearest centroids (ties: the smaller number) of the vectors of a block."""

    def __init__(self, centroids: list[list[int]], scale: int):
        self.scale, self.exact = scale, np.array(centroids, object)
        self.narrow = all(abs(c) < NARROW for row in centroids for c in row)
        self.centroids = np.array(centroids, float) if self.narrow else None

    def of(self, narrow: bool, held: bytes, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(vectors, clusters, squared distances, how many centroids were compared)."""
        length = self.exact.shape[1]
        if narrow and self.narrow:
            v = np.frombuffer(held, np.int32).reshape(-1, length).astype(float)
            near = candidates(low.astype(float), high.astype(float), self.centroids)
            c = self.centroids[near]
            far = (c * c).sum(axis=1) - 2 * (v @ c.T)
            best = far.argmin(axis=1)
            return v, near[best], far[np.arange(len(v)), best] + (v * v).sum(axis=1), len(near)
        if narrow:
            v = np.frombuffer(held, np.int32).reshape(-1, length).astype(object)
        else:
            v = np.array([[whole(x, self.scale) for x in row] for row in np.frombuffer(held).reshape(-1, length).tolist()], object)
        far = ((v[:, None, :] - self.exact[None]) ** 2).sum(axis=2)
        best = far.argmin(axis=1)
        return v, best, far[np.arange(len(v)), best], len(self.exact)


def _box(batch: pa.RecordBatch, i: int) -> tuple[bool, bytes, np.ndarray, np.ndarray]:
    low, high = batch.column("low")[i], batch.column("high")[i]
    return (batch.column("narrow")[i].as_py(), batch.column("held")[i].as_py(), np.array(low.as_py() or [], np.int64), np.array(high.as_py() or [], np.int64))


_SUMS = pa.schema([("cluster", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))])


def _added(table: pa.Table) -> pa.Table:
    """The sums of one cluster, or of a part of it."""
    columns = [list(map(int, row)) for row in table.column("sums").to_pylist()]
    return pa.table({"cluster": table.column("cluster")[:1], "part": table.column("part")[:1], "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()),
                     "sums": pa.array([[str(sum(c)) for c in zip(*columns, strict=True)]], pa.list_(pa.string()))}, schema=_SUMS)


def _moved(held: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """The centroids after one round; whole sums leave tasks as decimal strings."""
    k, length = len(centroids), len(centroids[0])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign, totals, counts = Assigner(centroids, scale), [[0] * length for _ in range(k)], [0] * k
        for batch in batches:
            for i in range(batch.num_rows):
                v, cluster, _, _ = assign.of(*_box(batch, i))
                for c in np.unique(cluster).tolist():
                    mine = v[cluster == c]
                    counts[c] += len(mine)
                    totals[c] = [t + int(s) for t, s in zip(totals[c], mine.sum(axis=0).tolist(), strict=True)]
        found = [c for c in range(k) if counts[c]]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([0] * len(found), pa.int32()), pa.array([counts[c] for c in found], pa.int64()),
                                          pa.array([list(map(str, totals[c])) for c in found], pa.list_(pa.string()))], schema=_SUMS)

    schema = "cluster int, part int, n bigint, sums array<string>"
    parts = held.mapInArrow(summed, schema).withColumn("part", (F.spark_partition_id() % PARTS).cast("int"))
    for keys in (["cluster", "part"], ["cluster"]):
        parts = parts.groupBy(*keys).applyInArrow(_added, schema)
    moved = list(centroids)
    for row in parts.collect():                   # a row for each centroid
        moved[row.cluster] = [int(s) // row.n for s in row.sums]
    return moved


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED, scale: int = SCALE) -> list[list[int]]:
    """The ``k`` vectors with the smallest digests of seed and id."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select("v", drawn.alias("drawn")).orderBy("drawn", "v").limit(k).collect()
    return [[whole(x, scale) for x in row.v] for row in rows]


def _long(value: int) -> int | None:
    return value if value < 2**63 else None


def clusters(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED,
             length: int = LENGTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, candidates), one row a vector that takes part;
    ``candidates`` is how many centroids it was compared with in the end."""
    vectors = kept(df, vec_id, vector, length)
    centroids = first_centroids(vectors, k, seed, scale)
    schema = "vec_id bigint, cluster int, distance bigint, candidates int"
    names = ["cluster_inertia", "inertia", "centroid_sha256"]
    if not centroids:
        empty = df.sparkSession.createDataFrame([], schema)
        return empty.withColumns(dict(zip(names, (F.lit(None).cast(t) for t in ("bigint", "bigint", "string")), strict=True)))
    held = blocks(vectors, length, scale)
    for _ in range(rounds):
        before, centroids = centroids, _moved(held, centroids, scale)
        if centroids == before:
            break

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = Assigner(centroids, scale)
        for batch in batches:
            for i in range(batch.num_rows):
                _, cluster, far, compared = assign.of(*_box(batch, i))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values, pa.array(cluster, pa.int32()), pa.array([_long(int(d)) for d in far.tolist()], pa.int64()),
                     pa.array([compared] * len(cluster), pa.int32())], ["vec_id", "cluster", "distance", "candidates"])

    found = written(held.mapInArrow(assigned, schema), "assigned")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count_if(F.col("distance").isNull()).alias("beyond"))
    totals: list[int | None] = [0] * len(centroids)
    for row in sums.collect():                    # a row for each centroid
        totals[row.cluster] = None if row.beyond else _long(int(row.total))
    inertia = None if None in totals else _long(sum(totals))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    own = F.get(F.array(*[F.lit(t).cast("bigint") for t in totals]), F.col("cluster"))
    digest = F.get(F.array(*map(F.lit, digests)), F.col("cluster"))
    return found.withColumns(dict(zip(names, (own, F.lit(inertia).cast("bigint"), digest), strict=True)))
