"""N-gram Jaccard join: near-duplicate documents by exact similarity of their word shingles.

A document's set is its distinct shingles of five words. Documents with equal sets form a class. Classes link at a
Jaccard similarity of 3/4 or more; a component is what links reach. Every linked pair of classes is found:

1. One pass counts shingles by hash into a table of fixed size (a frequency for ordering, not for judging) and gives
   each document the fingerprint of its set.
2. Each class is profiled: its group counts, and the first quarter of its shingles in order of (frequency, hash). Sets
   similar enough share one of these whatever the order; with rare ones first, few others do.
3. Shingles that several classes have there make buckets; buckets of the same classes count once. In a bucket an R-tree
   of group counts bounds the overlaps; what survives connects into clusters.
4. The sets of a cluster's classes are met once, and a second R-tree pass verifies the pairs that survive on them.

Buckets and clusters beyond a fixed number of classes are cut into chunks. A cut bucket connects all of its classes. A
cut cluster has some of its classes in every chunk, so that near copies connect; classes left outside the largest
component are then compared with all others of the cluster, chunk by chunk. No task holds more than a few chunks.

Null and empty texts, and texts of white space, have the empty set: size 0, linked with nothing, their own component.
With fewer than five words the whole sequence is the one shingle. Rows that agree in id and text are the same document;
each has its row. A row without an id takes part in links, and has the smallest id of its component, null if no row of
it has one. Shingles and classes go by 64-bit and 128-bit hashes of what they hold; graph nodes by 64 bits of the class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.llm.common import releasing, row_digest, text_key, written
from pagewright.llm.components import components
from pagewright.llm.count_tree import enough, link

WORDS = 5
#: Counters of the frequency table, and how they are cut to be summed.
COUNTERS = 1 << 19
SLICE = 1 << 12
#: Groups of a count vector: a power of two from 2**6 to 2**14, a fourth of the set's size or more. Fewer groups would
#: fill up and bound nothing; vectors of neighbouring lengths compare by folding the longer one.
LEAST_GROUPS, MOST_GROUPS = 6, 14
#: Classes of a bucket or cluster that one task compares.
CHUNK = 512
#: Classes of a cut cluster that every chunk holds, about.
PIVOTS = 16
#: Bits of the filters that are sent to tasks.
BITS = 1 << 25
#: Words a task keeps the hash of; the store is emptied when full, which costs time only.
KEPT = 200_000
#: Rows and bytes of text that a task has in hand at a time.
STEP_ROWS, STEP_BYTES = 1_000, 4 << 20

MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 40:
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, MIX[0]), (27, MIX[1])):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, hashes: _Hashes) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles."""
    words = text.lower().split() if text else []  # of bytes: A-Z only, and ASCII white space only
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(hashes) > KEPT:
        hashes.clear()
    if len(w) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64) if words else w
    n = len(w) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for i in range(WORDS):
        total += _mixed(w[i:i + n] ^ STEPS[i]) * STEPS[i]
    return np.unique(_mixed(total))


def fingerprint(held: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(held.tobytes()), "<i8").tolist())


def counts_of(held: np.ndarray) -> np.ndarray:
    """Group counts of a set."""
    groups = 1 << min(MOST_GROUPS, max(LEAST_GROUPS, (len(held) // 4).bit_length()))
    return np.bincount((held >> np.uint64(40)).astype(np.int64) & (groups - 1), minlength=groups)


def packed(counts: np.ndarray) -> bytes:
    """A byte for the width of a count, then the counts."""
    width = 1 if counts.max() < 256 else 4
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int32)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, fewer at a time."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)) // STEP_BYTES
        start = 0
        while start < batch.num_rows:
            end = min(start + STEP_ROWS, max(start + 1, int(np.searchsorted(sizes, sizes[start], "right"))))
            yield batch.slice(start, end - start)
            start = end


def _sets(batch: pa.RecordBatch, hashes: _Hashes) -> Iterator[np.ndarray]:
    for text in batch.column("text").cast(pa.binary()):
        yield shingles(text.as_py(), hashes)


FIRST = "doc_id bigint, key bigint, n bigint, c bigint, lo bigint, slice int, counts binary"
_FIRST = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("lo", pa.int64()),
                    ("slice", pa.int32()), ("counts", pa.binary())])


@releasing
def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, then the task's counters, a row for each slice."""
    counters, hashes = np.zeros(COUNTERS, np.int64), _Hashes()
    for batch in _steps(batches):
        sizes, marks = [], []
        for held in _sets(batch, hashes):
            np.add.at(counters, (held & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
            sizes.append(len(held))
            marks.append(fingerprint(held))
        none = pa.nulls(len(sizes))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array([a for a, _ in marks], pa.int64()),
             pa.array([b for _, b in marks], pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], schema=_FIRST)
    parts = range(COUNTERS // SLICE) if counters.any() else []
    none = pa.nulls(len(parts), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [none] * 5 + [pa.array(parts, pa.int32()), pa.array([counters[p * SLICE:(p + 1) * SLICE].tobytes() for p in parts], pa.binary())],
        schema=_FIRST)


def _summed(table: pa.Table) -> pa.Table:
    total = np.zeros(SLICE, np.int64)
    for raw in table.column("counts"):
        total += np.frombuffer(raw.as_py(), np.int64)
    return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _frequencies(first: DataFrame) -> np.ndarray:
    """The frequency table: of fixed size, summed in two steps so that no task reads a slice of every task before it."""
    rows = first.where("slice IS NOT NULL").select("slice", "counts", F.pmod(F.xxhash64("counts"), F.lit(256)).alias("part"))
    for keys in (["slice", "part"], ["slice"]):
        rows = rows.groupBy(*keys).applyInArrow(_summed, "slice int, counts binary")
    out = np.zeros(COUNTERS, np.int64)
    held = rows.toArrow()
    for part, raw in zip(held.column("slice").to_pylist(), held.column("counts").to_pylist(), strict=True):
        out[part * SLICE:(part + 1) * SLICE] = np.frombuffer(raw, np.int64)
    return out


def _filter_bits(rows: DataFrame, value: str) -> np.ndarray:
    """A bit for each hash value of ``rows``; of fixed size, whatever their number. A filter: what it passes is checked."""
    at = F.pmod(F.col(value), F.lit(BITS))
    words = rows.groupBy(F.floor(at / 64).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({value}, 64) AS int))")).alias("bits"))
    held, out = words.toArrow(), np.zeros(BITS // 64, np.uint64)
    out[held.column("word").to_numpy()] = held.column("bits").to_numpy().view(np.uint64)
    return out


def _passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.astype(np.int64).view(np.uint64) & np.uint64(BITS - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, int, int]]:
    """(table, from, to) of each run of equal keys in sorted batches."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        rest = None
        if not table.num_rows:
            continue
        table = table.combine_chunks()
        changed = np.zeros(table.num_rows, bool)
        for key in keys:
            values = table.column(key).to_numpy()
            changed[1:] |= values[1:] != values[:-1]
        cuts = [0, *np.flatnonzero(changed).tolist()]
        for start, end in zip(cuts, cuts[1:], strict=False):
            yield table, start, end
        rest = table.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), 0, rest.num_rows


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edge_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())],
                                      schema=_EDGE)


class _Columns:
    """Numpy views of the table a run lies in, made once a table; points of a run are unpacked for it alone."""

    def __init__(self):
        self.table = None

    def of(self, table: pa.Table, start: int, end: int) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
        if table is not self.table:
            self.table = table
            self.held = {f.name: table.column(f.name).to_numpy() for f in table.schema if pa.types.is_integer(f.type)}
        return {k: v[start:end] for k, v in self.held.items()}, [unpacked(raw.as_py()) for raw in table.column("vector").slice(start, end - start)]


@releasing
def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Connect what survives the bound in each chunk of a bucket; of a cut bucket, connect all."""
    columns, out = _Columns(), []
    for table, start, end in _runs(batches, ["token", "chunk"]):
        held, points = columns.of(table, start, end)
        c = held["c"]
        if held["cut"][0]:
            least = int(held["least"][0])
            out += [(int(x), least) for x in c if x != least]
        else:
            out += [(int(c[i]), int(c[j])) for i, j in link(points, held["n"])]
        if len(out) > 10_000:
            yield _edge_batch(out)
            out = []
    yield _edge_batch(out)


@releasing
def _cluster_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links of each tile of a cluster."""
    columns, out = _Columns(), []
    for table, start, end in _runs(batches, ["cluster", "tile", "side"]):
        held, points = columns.of(table, start, end)
        c, n = held["c"], held["n"]
        sets = [np.frombuffer(raw.as_py(), np.uint64) for raw in table.column("held").slice(start, end - start)]

        def verified(i: int, j: int) -> bool:
            overlap = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            return bool(enough(overlap, len(sets[i]), len(sets[j])))

        asking = np.flatnonzero(held["asks"])
        out += [(int(c[i]), int(c[j])) for i, j in link(points, n, verified, asking)]
        if len(out) > 10_000:
            yield _edge_batch(out)
            out = []
    yield _edge_batch(out)


def _tiled(rows: DataFrame, keys: list[str], edges) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(edges, "a bigint, b bigint")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, root), one row a document; component_id is the smallest id of its
    component, root names the component whether or not it has an id (null for the empty set)."""
    spark = df.sparkSession
    share = spark.sparkContext.broadcast
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    same = ["id0", "none", "key"]                 # what names a document: equality on these also meets null ids
    named_by = {"id0": F.coalesce("doc_id", F.lit(0)), "none": F.col("doc_id").isNull()}
    first = written(docs.mapInArrow(_first_pass, FIRST), "shingles")
    frequency = share(_frequencies(first))
    members = first.where("slice IS NULL").select("doc_id", "key", "n", "c", "lo")
    some = members.where("n > 0").withColumns(named_by)
    classes = some.groupBy("c", "lo").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("none", "id0", "key")).alias("rep"))
    reps = written(classes.select("c", "lo", "least_id", "rep.*"), "classes")

    @releasing
    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in _steps(batches):
            sizes, firsts, vectors = [], [], []
            for held in _sets(batch, hashes):
                n = len(held)
                order = np.argsort(frequency.value[(held & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")
                sizes.append(n)
                firsts.append(held[order[:n - -(-3 * n // 4) + 1]].view(np.int64) if n else held.view(np.int64))
                vectors.append(packed(counts_of(held)))
            ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
            flat = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64())), pa.array(vectors, pa.binary())],
                ["doc_id", "key", "n", "first", "vector"])

    every = docs.mapInArrow(profiled, "doc_id bigint, key bigint, n bigint, first array<bigint>, vector binary").where("n > 0")
    met = every.withColumns(named_by).join(reps, same).dropDuplicates(same)
    profiles = written(met.select("c", "n", "first", "vector"), "profiles")

    # buckets: shingles that several classes have among their first; those of the same classes once
    shared = profiles.select("c", F.explode("first").alias("token")).groupBy("token").agg(
        F.count("*").alias("many"), F.min("c").alias("least"), F.bit_xor("c").alias("mark")).where("many > 1")
    buckets = written(shared.groupBy("many", "least", "mark").agg(F.min("token").alias("token")), "buckets")
    wanted = share(_filter_bits(buckets, "token"))

    @releasing
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("first")
            values = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            hit = _passes(wanted.value, values)
            rows = pa.array(owner[hit])
            yield pa.RecordBatch.from_arrays([pa.array(values[hit], pa.int64()), *(batch.column(x).take(rows) for x in ("c", "n", "vector"))],
                                             ["token", "c", "n", "vector"])

    places = profiles.mapInArrow(placed, "token bigint, c bigint, n bigint, vector binary").join(buckets, "token")
    chunks = F.ceil(F.col("many") / chunk)
    cut = places.select("token", "c", "n", "vector", (F.col("many") > chunk).cast("int").alias("cut"), "least",
                        F.pmod(F.xxhash64("c"), chunks).alias("chunk"))
    clusters = written(components(_tiled(cut, ["token", "chunk"], _bucket_edges)).select(
        F.col("node").alias("c"), F.col("root").alias("cluster")), "clusters")

    # the sets of the classes that are in clusters
    grouped = reps.join(clusters, "c")
    keys = share(_filter_bits(grouped, "key"))

    @releasing
    def held_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in _steps(batches):
            batch = batch.filter(pa.array(_passes(keys.value, batch.column("key").to_numpy())))
            sets = list(_sets(batch, hashes))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(list(map(len, sets)), pa.int64()),
                 pa.array([packed(counts_of(x)) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())],
                ["doc_id", "key", "n", "vector", "held"])

    found = docs.mapInArrow(held_sets, "doc_id bigint, key bigint, n bigint, vector binary, held binary")
    sized = grouped.groupBy("cluster").agg(F.count("*").alias("many"))
    grouped = grouped.join(sized, "cluster")
    met = found.withColumns(named_by).join(grouped, same).dropDuplicates(same)
    sets = written(met.select("cluster", "many", "c", "n", "vector", "held"), "sets")

    chunks = F.ceil(F.col("many") / chunk)
    own = F.array(F.pmod(F.xxhash64("c"), chunks))
    pivot = (F.col("many") > chunk) & (F.pmod(F.xxhash64("c", F.lit(8)), F.col("many")) < PIVOTS)
    tiles = sets.withColumn("tile", F.explode(F.when(pivot, F.sequence(F.lit(0).cast("bigint"), chunks - 1)).otherwise(own)))
    tiles = tiles.withColumns({"side": F.lit(0).cast("bigint"), "asks": F.lit(1)})
    keys_of = ["cluster", "tile", "side"]
    links = written(_tiled(tiles, keys_of, _cluster_edges), "links")
    joined = components(links)

    # of cut clusters: what is outside the largest component is compared with everything in the cluster
    if sets.where(F.col("many") > chunk).take(1):
        big = sets.where(F.col("many") > chunk)
        named = big.select("cluster", "c").join(joined, F.col("c") == F.col("node"), "left").select(
            "cluster", "c", F.coalesce("root", "c").alias("root"))
        largest = named.groupBy("cluster", "root").agg(F.count("*").alias("n")).groupBy("cluster").agg(
            F.max_by("root", F.struct("n", "root")).alias("main"))
        outside = written(named.join(largest, "cluster").where("root <> main").select("cluster", "c"), "outside")
        left = outside.groupBy("cluster").agg(F.count("*").alias("left"))
        marked = big.join(left, "cluster").join(outside.select("c", F.lit(1).alias("asks")), "c", "left")
        marked = marked.withColumn("asks", F.coalesce("asks", F.lit(0)))
        sides = F.ceil(F.col("left") / chunk)
        here, there = F.pmod(F.xxhash64("c"), chunks), F.pmod(F.xxhash64("c", F.lit(9)), sides)
        zero = F.lit(0).cast("bigint")
        asked = marked.withColumn("asks", F.lit(0)).withColumn("tile", here).withColumn("side", F.explode(F.sequence(zero, sides - 1)))
        asks = marked.where("asks = 1").withColumn("side", there).withColumn("tile", F.explode(F.sequence(zero, chunks - 1)))
        more = written(_tiled(asked.unionByName(asks), keys_of, _cluster_edges), "links")
        joined = components(links.union(more))

    joined = written(joined, "joined")
    named = reps.join(joined, F.col("c") == F.col("node"), "left").select("c", "lo", "least_id", F.coalesce("root", "c").alias("root"))
    named = written(named, "named")
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = named.join(ids, "root").select("c", "lo", "root", "component_id")
    linked = members.join(labels, ["c", "lo"], "left")
    return linked.select("doc_id", F.col("key").alias("text_key"), F.col("n").alias("n_shingles"),
                         F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "root")


def one_of_each(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``df`` with one document of each component: the one of the smallest id, of repeated rows one, which all columns decide. Empty texts stay;
    of a component without any id, the row of the smallest text key stays."""
    found = near_duplicates(df, text, doc_id)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("text_key").alias("_key")))
    kept = found.where("n_shingles > 0").groupBy("root").agg(first.alias("kept")).select("kept.*")
    own = F.col(doc_id).cast("bigint")
    keyed = df.withColumns({"_key": text_key(F.col(text)), "_none": own.isNull(), "_id": F.coalesce(own, F.lit(0))})
    words = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    same = ["_none", "_id", "_key"]
    met = keyed.where(words).withColumn("_row", row_digest(df)).join(kept, same)
    met = met.withColumn("_nth", F.row_number().over(W.partitionBy(*same).orderBy("_row"))).where("_nth = 1")
    columns = [F.col(f"`{c}`") for c in df.columns]
    return met.select(*columns).union(keyed.where(~words).select(*columns))
