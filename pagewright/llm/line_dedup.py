"""Line deduplication: range-partitioned line hashes, first occurrences, keep bitmaps.

A line's key is the line without ASCII white space at its ends, A-Z in lower case. Every line whose key is long enough
becomes a narrow row: the key's hash, the document, the place of the line. Rows are range-partitioned by hash and sorted
inside each range by hash, then document (largest first), then place; one pass over the sorted rows sees how many
documents hold a key and which comes first. Only that document keeps its lines of the key, if enough documents hold it. What
goes back to the documents is no text: for each document that loses lines, a compressed bitmap of its lines, 64 to a
word, in which words that keep all their lines are left out. Texts are rebuilt where they stand by applying it.

A key that very many rows hold would make one long range. Such keys are found beforehand by a count that each task combines
before anything is shuffled; their number of documents and their first one are worked out likewise, and their rows are
cut into several ranges by document. What a row is told does not depend on whether its key was cut.

Null and empty texts are one empty line, which has no long key. Documents go by their id: rows that share one are one document, of
which every row keeps or loses a line alike. Rows without an id rank below all ids and are told apart by a hash of the whole text; those that
agree in it are one document. White space inside a line counts. Keys go by 128 bits of hash. An empty table gives no rows.
Columns of the input other than id and text are not looked at; their names may clash with any used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.llm.common import ascii_lower, text_key, written

LENGTH = 40
DOCUMENTS = 5
#: A key of more rows than this is cut into ranges of about as many.
RANGE_ROWS = 2_000
WHITE = " \t\n\x0b\x0c\r"

KEY = ["hash", "hash2"]
#: What names a document; ``twin`` is 0 but for rows without an id.
DOCUMENT = ["doc_id", "twin"]


def keyed(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, key, text): ``key`` names the text among rows of one id."""
    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_key(F.col(text)).alias("key"), F.col(text).alias("text"))


def long_lines(docs: DataFrame, length: int) -> DataFrame:
    """(hash, hash2, doc_id, twin, key, place), one row a line whose key has ``length`` code points or more."""
    lines = docs.select("doc_id", "key", F.posexplode(F.split(ascii_lower(F.col("text")), "\n", -1)).alias("place", "line"))
    # most short lines go before they are trimmed
    lines = lines.where(F.length("line") >= length).withColumn("line", F.btrim("line", F.lit(WHITE))).where(F.length("line") >= length)
    twin = F.when(F.col("doc_id").isNull(), F.col("key")).otherwise(F.lit(0).cast("bigint"))
    return lines.select(F.xxhash64("line").alias("hash"), F.xxhash64(F.lit(1), "line").alias("hash2"), "doc_id",
                        twin.alias("twin"), "key", "place")


def _heavy(lines: DataFrame, rows: int) -> DataFrame:
    """(hash, hash2, parts, documents, first) of the keys that more than ``rows`` rows hold; at most one for every ``rows`` rows."""
    many = written(lines.groupBy(*KEY).agg(F.count("*").alias("rows")).where(F.col("rows") > rows), "heavy-lines")
    holders = lines.join(many, KEY).select(*KEY, "rows", *DOCUMENT).distinct()
    held = holders.groupBy(*KEY).agg(F.max("rows").alias("rows"), F.count("*").alias("documents"), F.max(_rank()).alias("first"))
    return written(held.select(*KEY, F.ceil(F.col("rows") / rows).alias("parts"), "documents", "first"), "heavy-lines")


def _rank() -> Column:
    """Documents in order: those without an id, then by id."""
    return F.struct(F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("twin").alias("twin"))


def dropped_lines(lines: DataFrame, documents: int = DOCUMENTS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, key, place) of the lines to drop. ``lines`` should be written: it is read three times."""
    heavy = _heavy(lines, range_rows)
    part = F.pmod(F.xxhash64(*DOCUMENT), F.coalesce("parts", F.lit(1)))
    rows = lines.join(heavy, KEY, "left").withColumns({"part": part, "rank": _rank()})
    ranged = rows.repartitionByRange(*KEY, "part")
    range_ = W.partitionBy(*KEY, "part")
    sorted_ = range_.orderBy(F.desc("rank"), "place")
    fresh = F.when(F.col("rank") == F.lag("rank").over(sorted_), 0).otherwise(1)
    told = ranged.withColumns({"fresh": fresh, "leading": F.first("rank").over(sorted_)})
    held = F.coalesce("documents", F.sum("fresh").over(range_))
    first = F.coalesce("first", "leading")
    return told.withColumns({"held": held, "stays": F.col("rank") == first}).where((F.col("held") >= documents) & ~F.col("stays")).select(
        "doc_id", "key", "place")


def bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc_id, key, drops): one row a document that loses lines. ``drops`` lists (word, bits) in order: bit ``i`` of word
    ``w`` is line ``64 * w + i``, set where the line goes; words that keep all their lines are absent."""
    bit = F.expr("shiftleft(1L, place % 64)")
    words = dropped.groupBy("doc_id", "key", F.expr("place div 64").cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("drops"))


def _opened(drops: Column) -> Column:
    """The words of a bitmap up to its last one, absent ones as zeros: places can be looked up in it."""
    def run(entry: Column, i: Column) -> Column:
        before = F.coalesce(F.get(drops, i - 1)["word"], F.lit(-1))
        return F.concat(F.array_repeat(F.lit(0).cast("bigint"), entry["word"] - before - 1), F.array(entry["bits"]))

    return F.flatten(F.transform(drops, run))


def _kept(lines: Column, opened: Column) -> Column:
    def stays(line: Column, i: Column) -> Column:
        return F.getbit(F.coalesce(F.get(opened, F.floor(i / 64).cast("int")), F.lit(0).cast("bigint")), i % 64) == 0

    return F.filter(lines, stays)


def deduplicated(df: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, documents: int = DOCUMENTS,
                 range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, drops), one row a document: ``text`` without the lines it loses, ``drops`` the
    bitmap of those (null: none). Null texts come back as they are."""
    docs = keyed(df, text, doc_id)
    maps = written(bitmaps(dropped_lines(written(long_lines(docs, length), "lines"), documents, range_rows)), "bitmaps")
    maps = maps.withColumn("gone", F.aggregate("drops", F.lit(0), lambda n, entry: n + F.bit_count(entry["bits"]).cast("int")))
    maps = maps.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "drops", "gone", _opened(F.col("drops")).alias("opened"))
    met = docs.join(maps, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    # a line is a newline more
    count = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^\n]+", "")) + 1
    left = F.array_join(_kept(F.split("text", "\n", -1), F.col("opened")), "\n")
    return met.select("doc_id", F.when(F.col("gone") > 0, left).otherwise(F.col("text")).alias("text"), count.cast("bigint").alias("n_lines"),
                      F.coalesce("gone", F.lit(0)).cast("bigint").alias("n_dropped"), "drops")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256)."""
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
