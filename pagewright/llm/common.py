"""What the operators share: tables, written intermediates, and text keys."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from pagewright.session import materialize

#: ASCII white space, as a class body that Java, Python and RE2 read alike
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


#: Rows that a Python worker gets at a time while an intermediate is written: whole texts are large rows.
BATCH_ROWS = 1_000


@contextmanager
def _small_batches(spark: SparkSession):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if int(before) <= 0 or int(before) > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back: lineage ends there, and a lost executor costs one reread."""
    with _small_batches(df.sparkSession):
        return materialize(df, f"llm-{name}")


def release() -> None:
    """Give memory that is free back to the system: workers are used again, by tasks that need it elsewhere."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):             # another C library
        pass


def releasing(mapper: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``mapper`` of ``mapInArrow``, after which its worker gives free memory back."""
    @wraps(mapper)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from mapper(batches)
        release()

    return run


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    words = F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+")
    edge = F.when(F.element_at(words, 1) == "", 1).otherwise(0) + F.when(
        (F.size(words) > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)
    return (F.size(words) - edge).cast("bigint")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; null reads as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_key(text: Column) -> Column:
    """64-bit key of a whole text. With the document id it names a row; rows equal in both are the same document."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def row_digest(df: DataFrame) -> Column:
    """A number by which rows that differ in any column (maps are not read) sort alike in every run."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, MapType)])
