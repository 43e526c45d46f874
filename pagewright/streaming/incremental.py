"""Continuous loading: the same insert-only load, one micro-batch at a time."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.models import Embedder
from pagewright.operators.command_log import log_lines, parse_log
from pagewright.operators.ordered import number_rows
from pagewright.plans.store import COMMANDS, Store, prepared


def log_file_stream(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """New command-log files as rows of bytes."""
    return (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
            .option("pathGlobFilter", pattern).load(folder))


def load_log_stream(store: Store, folder: str, embedder: Embedder, checkpoint: str):
    """Load new log files until none is left, then stop; run it again, or on a schedule, to continue.

    A batch inserts and indexes the rows whose id is not stored; run again after a failure, it finds its ids and adds
    nothing. Files of a batch are in list order by name, their lines by place."""
    def batch(files: DataFrame, number: int) -> None:
        named = files.select(F.lit("TCH").alias("doc_key"),
                             F.regexp_extract("path", r"([^/]*)$", 1).alias("doc_filename"), "content")
        lines = log_lines(named)
        records = parse_log(lines, F.col("line")).withColumn("source_doc", F.col("doc_key")).drop("line", "doc_key")
        # later batches come after earlier ones in list order, later files of a batch after its earlier ones
        names = number_rows(named.select("doc_filename").distinct(), [], ["doc_filename"], F.substring("doc_filename", 1, 12), "file")
        placed = records.join(names, "doc_filename").withColumn(
            "ord", F.lit(number).cast("bigint") * F.lit(1 << 44) + F.col("file") * F.lit(1 << 32) + F.col("ord")).drop("file")
        store.load(COMMANDS, prepared(placed, "record_id"), embedder)

    stream = log_file_stream(store.spark, folder)
    return (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
