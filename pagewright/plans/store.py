"""Chunks to stored rows: union, first-wins deduplication, splitting, embedding, insert-only loading, search index."""

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagewright import rules, schema
from pagewright.functions.text import known, or_empty, strip
from pagewright.models import Embedder
from pagewright.operators import cells, lexical
from pagewright.operators.ordered import first_wins
from pagewright.operators.splitting import expand
from pagewright.session import FREED_SHUFFLES, remove, scratch, settings
from pagewright.sources.files import stored_table

KNOWLEDGE, COMMANDS = "knowledge", "commands"
POSTING_COLUMNS = ["id", "ord", "sub_index", "subsystem"]
CODEC = "zstd"                 # of all that a load writes
SLICE_POSTINGS = 4 << 20       # postings that are sorted at a time, at least
SLICES = 8                     # parts an index is sorted in, at most
SAMPLE_TEXTS = 2048            # texts whose terms place the cuts; loads of less than four times as many are sorted whole
BATCH_ROWS = 2048              # rows that a Python worker embeds at a time: whole texts are large rows


def stacked(*parts: DataFrame) -> DataFrame:
    """Union in list order: ``(list_no, ord)`` sorts like the parts laid one after the other."""
    whole = None
    for i, part in enumerate(parts):
        part = part.withColumn("list_no", F.lit(i))
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    return whole


def deduplicated(items: DataFrame, id_col: str) -> DataFrame:
    order = [c for c in ("list_no", "ord") if c in items.columns]
    return first_wins(items, [id_col], order)


def size_profile(items: DataFrame) -> DataFrame:
    """Count, mean and maximum size, and how many exceed the splitter's window."""
    size = F.length(or_empty(F.col("text")))
    return items.agg(F.count("*").alias("total"), F.avg(size).alias("avg_chars"), F.max(size).alias("max_chars"),
                     F.count_if(size > rules.SPLIT_MAX_CHARS).alias("oversized"))


def breakdown(items: DataFrame) -> DataFrame:
    """Counts by source and by type in one pass."""
    return (items.groupingSets([["source_doc"], ["content_type"]], "source_doc", "content_type")
            .agg(F.count("*").alias("n"), F.grouping("source_doc").alias("_by_type"))
            .select(F.when(F.col("_by_type") == 1, F.lit("type")).otherwise(F.lit("source")).alias("kind"),
                    F.coalesce("source_doc", "content_type").alias("name"), "n"))


def _column(items: DataFrame, name: str) -> Column:
    return or_empty(F.col(name).cast("string")) if name in items.columns else F.lit("")


def embed_text(items: DataFrame, body: str = "text") -> Column:
    """The text that is embedded and indexed: what is known about the item, a line each, then its body."""
    def line(prefix: str, value: Column) -> Column:
        return F.when(known(value).isNotNull(), F.concat(F.lit(prefix), value))

    caption = _column(items, "content_type") == "image_caption"
    page = _column(items, "page")
    subsystem = _column(items, "subsystem")
    return F.concat_ws(
        "\n",
        F.when(caption, F.lit("Image caption")),
        F.when(caption, line("Source: ", _column(items, "source_doc"))),
        F.when(caption & (page != "0"), line("Page: ", page)),
        line("FCP ", _column(items, "fcp_number")),
        F.when(subsystem != "UNKNOWN", line("Subsystem: ", subsystem)),
        line("Command: ", _column(items, "mnemonic")),
        line("CID: ", _column(items, "cid")),
        known(_column(items, "section_heading")),
        known(strip(_column(items, body))))


def metadata(items: DataFrame) -> list[Column]:
    """The scalar columns of a stored row; what an item lacks becomes empty, 0 or false."""
    has = set(items.columns)
    images = F.coalesce(F.size("images"), F.lit(0)) if "images" in has else F.lit(0)
    special = {
        "page": F.coalesce(F.col("page").cast("int"), F.lit(0)) if "page" in has else F.lit(0),
        "section_heading": F.substring(_column(items, "section_heading"), 1, rules.HEADING_CHARS),
        "is_sub_chunk": F.coalesce("is_sub_chunk", F.lit(False)) if "is_sub_chunk" in has else F.lit(False),
        "sub_index": F.coalesce(F.col("sub_index").cast("int"), F.lit(0)) if "sub_index" in has else F.lit(0),
        "has_images": images > 0,
        "image_count": F.greatest(images, F.lit(0)),
    }
    return [special.get(name, _column(items, name)).alias(name) for name in schema.METADATA]


def stored_rows(items: DataFrame, id_col: str, document_chars: int = rules.DOCUMENT_CHARS) -> DataFrame:
    """Items as stored, before embedding: id, order, body (its first ``document_chars`` characters, more than any piece
    of the splitter has), index text, metadata."""
    list_no = F.col("list_no").cast("bigint") if "list_no" in items.columns else F.lit(0).cast("bigint")
    place = list_no * F.lit(1 << 60) + F.col("ord").cast("bigint")
    return items.select(F.col(id_col).cast("string").alias("id"), place.alias("ord"),
                        F.substring(or_empty(F.col("text")), 1, document_chars).alias("document"),
                        embed_text(items).alias("embed_text"), *metadata(items))


def like_lengths(texts: list[str | None], size: int) -> Iterator[list[int]]:
    """Places of the texts in batches of ``size``, texts of like length together: a model pads a batch to its longest."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i] or ""))
    for i in range(0, len(order), size):
        yield order[i:i + size]


def task_gpu(spark: SparkSession):
    """A profile that gives each embedding task a GPU where the session's executors have some; None elsewhere."""
    if int(spark.conf.get("spark.executor.resource.gpu.amount", "0")) < 1:
        return None
    from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(1).resource("gpu", 1.0)).build


def embedded(rows: DataFrame, embedder: Embedder) -> DataFrame:
    """Rows with unit vectors; one model per task, batches of the embedder's size out of texts of like length."""
    out = T.StructType([*rows.schema, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    arrow_out = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("embed_text").to_pylist()
            found: list = [None] * len(texts)
            for places in like_lengths(texts, embedder.batch_size):
                for i, vector in zip(places, embedder.embed([texts[i] for i in places])):
                    found[i] = vector
            vectors = pa.array(found, arrow_out.field("embedding").type)
            columns = [column.cast(field.type) for column, field in zip(batch.columns, arrow_out)]
            yield pa.RecordBatch.from_arrays([*columns, vectors], schema=arrow_out)

    return rows.mapInArrow(run, out, profile=task_gpu(rows.sparkSession))


def prepared(items: DataFrame, id_col: str) -> DataFrame:
    """Deduplicated, split, flattened rows; the position of a piece in the list is its parent's, then its own."""
    return stored_rows(expand(deduplicated(items, id_col), id_col), id_col)


def without_given(rows: DataFrame) -> DataFrame:
    """``embed_text`` becomes null where the stored columns give it: everywhere but where a body or heading is stored cut."""
    odd = ~F.col("embed_text").eqNullSafe(embed_text(rows, "document"))
    return rows.withColumn("embed_text", F.when(odd, or_empty(F.col("embed_text"))))


def with_given(rows: DataFrame) -> DataFrame:
    """Rows of :func:`without_given` with their ``embed_text`` (empty where it was null). The one-element explode works it out once."""
    text = F.coalesce(F.col("embed_text"), embed_text(rows, "document"))
    return rows.select(*[c for c in rows.columns if c != "embed_text"], F.explode(F.array(text)).alias("embed_text"))


def _place(value: Column, cuts: list[str], first: int = 0) -> Column:
    """How many of the sorted cuts are at most ``value``, plus ``first``; by halves."""
    if not cuts:
        return F.lit(first)
    half = len(cuts) // 2
    return F.when(value < F.lit(cuts[half]), _place(value, cuts[:half], first)).otherwise(
        _place(value, cuts[half + 1:], first + half + 1))


LOADS = "load bigint, base bigint"


class Store:
    """Stored collections below one folder. Each load writes what it adds to folders of its own, ``<collection>/<part>/load=n``:
    ``rows`` (vectors, payload and metadata), ``postings`` (search index), ``terms`` and ``numbers`` (statistics of all
    loads up to it), ``ids``. ``items``, the payload of the index, is read from the files of ``rows``, without the vectors.
    A row in ``<collection>/loads`` written last makes a load count, so a load that fails halfway
    leaves nothing to be read, and index and rows always agree. ``base`` is the first load that still counts: a reset,
    refresh or merge starts a new one.

    Postings and terms lie sorted by term, a frequent term over several files, so a question reads its terms. Ids lie in buckets
    by their hash, as many as the session that began the collection had shuffle partitions: what is to be loaded
    is shuffled to them, and what is stored is not."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, collection: str, part: str) -> str:
        return os.path.join(self.folder, collection, part)

    def loads(self, collection: str) -> list[int]:
        """Numbers of the loads that count; as many as there were loads since the last reset, refresh or merge."""
        done = stored_table(self.spark, self.path(collection, "loads"), LOADS)
        if done is None:
            return []
        last = done.agg(F.max_by(F.struct("load", "base"), "load").alias("last")).first()["last"]
        return [] if last is None else [r["load"] for r in done.where(F.col("load") >= last["base"]).orderBy("load").collect()]

    def table(self, collection: str, part: str) -> DataFrame:
        counted = self.loads(collection)
        if not counted:
            raise ValueError(f"nothing was loaded into {collection}")
        if part == "items":
            return self._parts(collection, "rows", counted).select("id", "ord", "document", *schema.METADATA)
        found = self._parts(collection, part, counted)
        return found.drop("embed_text") if part == "rows" else found

    def _parts(self, collection: str, part: str, loads: list[int]) -> DataFrame:
        return self.spark.read.parquet(*[os.path.join(self.path(collection, part), f"load={n}") for n in loads])

    # ---- ids -----------------------------------------------------------------------------------------
    def _id_table(self, collection: str) -> tuple[str, int]:
        """(name in the session's catalog, buckets) of a collection's ids; the files are the store's, the catalog only learns of them."""
        marked = stored_table(self.spark, self.path(collection, "id_buckets"), "buckets int")
        if marked is None:
            buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            (self.spark.createDataFrame([(buckets,)], "buckets int").coalesce(1)
             .write.mode("overwrite").parquet(self.path(collection, "id_buckets")))
        else:
            buckets = marked.first()["buckets"]
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(collection, "ids"))
        place = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
        name = f"pagewright_ids_{hashlib.md5(place.encode()).hexdigest()}"
        quoted = place.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (id STRING, load BIGINT) USING parquet PARTITIONED BY (load) "
                       f"CLUSTERED BY (id) INTO {buckets} BUCKETS LOCATION '{quoted}'")
        return name, buckets

    def _ids(self, collection: str, loads: list[int]) -> DataFrame:
        if not loads:
            return self.spark.createDataFrame([], "id string")
        name, _ = self._id_table(collection)
        self.spark.catalog.recoverPartitions(name)      # other sessions may have loaded
        return self.spark.table(name).where(F.col("load").isin(loads)).select("id")

    def ids(self, collection: str) -> DataFrame:
        """Stored ids only; no rows before the first load."""
        return self._ids(collection, self.loads(collection))

    def pending(self, collection: str, rows: DataFrame) -> DataFrame:
        return rows.join(self.ids(collection), "id", "left_anti")

    # ---- loads ---------------------------------------------------------------------------------------
    def load(self, collection: str, rows: DataFrame, embedder: Embedder, reset: bool = False,
             refresh: bool = False) -> int:
        """Insert the rows whose id is not stored yet, and index them; rows added.

        ``reset`` drops what is stored first; ``refresh`` replaces stored rows of the same id by the given ones.
        """
        counted = [] if reset else self.loads(collection)
        refreshed = refresh and bool(counted)
        load = self._next(collection)

        def whole(df: DataFrame, part: str) -> DataFrame:
            if not refreshed:
                return df
            return df.unionByName(self.table(collection, part).join(given.select("id"), "id", "left_anti"))

        def index() -> tuple[DataFrame, list[str]]:
            texts = given if refreshed else self._parts(collection, "rows", [load])
            found = lexical.postings(lexical.tokenized(with_given(texts), POSTING_COLUMNS, F.col("embed_text")), POSTING_COLUMNS)
            return whole(found, "postings"), self._cuts(texts)

        batches = "spark.sql.execution.arrow.maxRecordsPerBatch"
        held = int(self.spark.conf.get(batches))
        small = {batches: str(min(held, BATCH_ROWS) if held > 0 else BATCH_ROWS)}
        with settings(self.spark, FREED_SHUFFLES | small), scratch(self.spark, "prepared") as prepared_at:
            given = rows if refreshed or not counted else self.pending(collection, rows)
            if refreshed:       # read three times; otherwise the stored rows are what the index is made of
                given.write.option("compression", CODEC).parquet(prepared_at)
                given = self.spark.read.schema(given.schema).parquet(prepared_at)
            new = embedded(given, embedder)
            self._write(collection, load, whole(new.drop("embed_text"), "rows") if refreshed else without_given(new), index,
                        self._terms(collection, counted[-1]) if counted and not refreshed else None)
        self._count(collection, load, counted[0] if counted and not refreshed else load)
        before = self._ids(collection, counted).count() if refreshed else 0
        return self._ids(collection, [load]).count() - before

    def merge_loads(self, collection: str) -> int:
        """Rewrite all loads that count as one, so scans open few files; loads merged. What is stored, its order and its index stay
        the same; readers see the old loads until the new one is counted. A clustering has to be built again. Not to be run beside a load."""
        counted = self.loads(collection)
        if len(counted) > 1:
            load = self._next(collection)
            rows = self.table(collection, "rows")
            with settings(self.spark, FREED_SHUFFLES):
                self._write(collection, load, rows, lambda: (
                    self.table(collection, "postings"), self._cuts(rows.withColumn("embed_text", F.lit(None).cast("string")))))
            self._count(collection, load, load)
        return len(counted)

    def _next(self, collection: str) -> int:
        done = stored_table(self.spark, self.path(collection, "loads"), LOADS)
        return 0 if done is None else done.agg(F.coalesce(F.max("load") + 1, F.lit(0)).alias("n")).first()["n"]

    def _count(self, collection: str, load: int, base: int) -> None:
        (self.spark.createDataFrame([(load, base)], LOADS).coalesce(1)
         .write.mode("append").parquet(self.path(collection, "loads")))

    def _write(self, collection: str, load: int, rows: DataFrame, index: Callable[[], tuple[DataFrame, list[str]]],
               earlier: DataFrame | None = None) -> None:
        """All parts of one load; the folder of a load that failed before is written over. ``index`` gives the postings, and
        the terms that cut them, once the rows are written. ``earlier`` are the term counts that the load's own add to."""
        def put(df: DataFrame, part: str) -> DataFrame:
            path = os.path.join(self.path(collection, part), f"load={load}")
            df.write.mode("overwrite").option("compression", CODEC).parquet(path)
            return self.spark.read.parquet(path)

        stored = put(rows, "rows")
        self._put_postings(collection, load, *index())
        counts = self._parts(collection, "postings", [load]).groupBy("term").agg(F.count("*").alias("df")).unionByName(
            stored.agg(F.lit("").alias("term"), F.count("*").alias("df")))
        if earlier is not None:
            counts = counts.unionByName(earlier).groupBy("term").agg(F.sum("df").alias("df"))
        put(counts.sort("term"), "terms")
        put(lexical.Stats.summed(self._terms(collection, load)), "numbers")
        name, buckets = self._id_table(collection)
        # one file a bucket; only this load's partition is written over
        self.spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (load = {load}) SELECT id FROM {{ids}}",
                       ids=stored.select("id").repartition(buckets, "id"))

    def _cuts(self, texts: DataFrame) -> list[str]:
        """Terms that cut an index of ``texts`` into slices of like size, by the terms of about ``SAMPLE_TEXTS`` of them. They
        decide how much is sorted at a time, not what the index holds."""
        every = texts.count() // SAMPLE_TEXTS
        if every < 4:
            return []
        with scratch(self.spark, "sampled-terms") as path:
            some = with_given(texts.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0))
            lexical.postings(lexical.tokenized(some, [], F.col("embed_text")), []).select("term").write.parquet(path)
            terms = self.spark.read.schema("term string").parquet(path)
            slices = min(SLICES, terms.count() * every // SLICE_POSTINGS)
            if slices < 2:
                return []
            firsts = terms.repartitionByRange(slices, "term").groupBy(F.spark_partition_id()).agg(F.min("term").alias("term"))
            return sorted(r["term"] for r in firsts.collect())[1:]

    def _put_postings(self, collection: str, load: int, postings: DataFrame, cuts: list[str]) -> None:
        """Postings sorted by term, one slice of terms after the other: what the sort shuffles is a slice, and what was
        written to be sorted goes slice by slice."""
        path = os.path.join(self.path(collection, "postings"), f"load={load}")
        with scratch(self.spark, "postings") as unsorted:
            # written first: ordering by range samples its input before it moves it; with a file open for each slice, as
            # tasks else sort, and spill, what they write
            with settings(self.spark, {"spark.sql.maxConcurrentOutputFileWriters": str(2 * len(cuts) + 2),
                                       "spark.sql.optimizer.plannedWrite.enabled": "false"}):
                postings.withColumn("slice", _place(F.col("term"), cuts)).write.partitionBy("slice").option(
                    "compression", CODEC).parquet(unsorted)
            remove(self.spark, path)
            for i in range(len(cuts) + 1):
                part = os.path.join(unsorted, f"slice={i}")
                rows = stored_table(self.spark, part, postings.schema)
                if rows is None:        # no term is of this slice
                    rows = self.spark.createDataFrame([], postings.schema)
                rows.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("append").option(
                    "compression", CODEC).parquet(path)
                remove(self.spark, part)

    def _terms(self, collection: str, load: int) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.path(collection, "terms"), f"load={load}"))

    def stats(self, collection: str) -> lexical.Stats:
        """Statistics of all loads that count, as the last of them wrote them: a question reads its terms and three numbers."""
        counted = self.loads(collection)
        if not counted:
            raise ValueError(f"nothing was loaded into {collection}")
        numbers = self.spark.read.parquet(os.path.join(self.path(collection, "numbers"), f"load={counted[-1]}"))
        return lexical.Stats(self._terms(collection, counted[-1]), numbers)

    # ---- approximate search ----------------------------------------------------------------------------
    def build_cells(self, collection: str, count: int, per_cell: int = cells.PER_CELL) -> None:
        """Cluster the vectors of all loads that count into ``count`` cells. Later loads are searched beside them, whole,
        until this is called again; a reset or refresh makes the cells of before it void."""
        counted = self.loads(collection)
        rows = self.table(collection, "rows")
        centres = cells.train(rows, "id", count, per_cell=per_cell)
        cells.write(rows, centres, os.path.join(self.path(collection, "cells"), f"upto={counted[-1]}"))
        (self.spark.createDataFrame([(counted[-1], counted[0])], LOADS).coalesce(1)
         .write.mode("append").parquet(self.path(collection, "clusterings")))

    def cell_index(self, collection: str) -> tuple[cells.CellIndex | None, DataFrame | None]:
        """(index of the newest clustering that still holds, rows of the loads after it); None where there is none."""
        counted = self.loads(collection)
        done = stored_table(self.spark, self.path(collection, "clusterings"), LOADS)
        last = None if done is None or not counted else done.where(F.col("base") == counted[0]).agg(F.max("load").alias("n")).first()["n"]
        if last is None:
            return None, None
        newer = [n for n in counted if n > last]
        index = cells.CellIndex(self.spark, os.path.join(self.path(collection, "cells"), f"upto={last}"))
        return index, self._parts(collection, "rows", newer) if newer else None

    def counts(self) -> dict[str, int]:
        return {name: self.ids(name).count() for name in (KNOWLEDGE, COMMANDS)}
