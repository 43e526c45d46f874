"""Captioning as a stateful stream: what became of a figure is state, kept by its file name.

A figure without a caption is tried again by each later run, ``attempts`` times in all. Captions, failures and counts survive in the
checkpoint, so a run that stops goes on where it was. Each picture is read once; it is kept in state only while its figure
waits for another attempt, for which its name alone is streamed.

Rows without a file name are left out; a figure that comes again after its caption, or after its last attempt, is not asked
for again, and one that comes again while it waits is tried as it came last. If a batch is lost before its commit, its figures are
asked for again: calls happen at least once, rows of outcomes are exact.
"""

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagewright.models import Captioner
from pagewright.sources.files import stored_table

OUTCOME = "fname string, attempt int, caption string, error string"
ATTEMPTS = 3
#: Pictures of one batch: what is asked for again when a batch is lost.
BATCH_FIGURES = 200
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FigureState(StatefulProcessor):
    """Asks the captioner for a figure, once a batch that names it, until it answers or ``attempts`` are spent."""

    def __init__(self, captioner: Captioner, attempts: int):
        self.captioner, self.attempts = captioner, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getValueState("told", "caption string, error string, attempts int")
        self.held = handle.getValueState("held", "content binary, prompt string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # a name may come more than once in a batch: the picture and prompt that sort first
        seen = None
        for frame in rows:
            for content, prompt in zip(frame["content"], frame["prompt"]):
                if content is not None:
                    row = (bytes(content), prompt or "")
                    seen = row if seen is None else min(seen, row)
        caption, _, spent = self.told.get() if self.told.exists() else (None, None, 0)
        if seen is None and self.held.exists():
            content, prompt = self.held.get()
            seen = (bytes(content), prompt)
        if seen is not None and caption is None and spent < self.attempts:
            yield self._ask(key[0], *seen, spent + 1)

    def _ask(self, fname: str, content: bytes, prompt: str, attempt: int) -> pd.DataFrame:
        caption = error = None
        try:
            caption = self.captioner(content, prompt)
        except Exception as reason:
            error = f"{type(reason).__name__}: {reason}"
        self.told.update((caption, error, attempt))
        if error is not None and attempt < self.attempts:
            self.held.update((content, prompt))
        else:
            self.held.clear()
        return pd.DataFrame({"fname": [fname], "attempt": [attempt], "caption": [caption], "error": [error]})

    def close(self) -> None:
        pass


def picture_stream(spark: SparkSession, folder: str, per_batch: int = BATCH_FIGURES) -> DataFrame:
    """New picture files of a folder as ``(fname, content)``, a bounded number a batch."""
    files = (spark.readStream.format("binaryFile")
             .schema("path string, modificationTime timestamp, length bigint, content binary")
             .option("maxFilesPerTrigger", per_batch).load(folder))
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("fname"), "content")


def start(pictures: DataFrame, prompts: DataFrame, captioner: Captioner, folder: str, attempts: int = ATTEMPTS):
    """A query that captions the streamed ``pictures(fname, content)`` that have a row in the written table
    ``prompts(fname, prompt)``, gives each failed figure of earlier runs one more attempt, and stops when all is done.
    ``folder`` takes outcomes, a folder a batch, the names to try again, a file set a run, and the checkpoint."""
    spark = pictures.sparkSession
    again = os.path.join(folder, "again")
    waiting = latest(outcomes(spark, folder)).where((F.col("error").isNotNull()) & (F.col("attempts") < attempts))
    waiting.select("fname").write.mode("append").parquet(again)
    retried = spark.readStream.schema("fname string").parquet(again).select(
        "fname", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("prompt"))
    asked = pictures.where("fname IS NOT NULL").join(prompts.select("fname", "prompt"), "fname")

    def save(batch: DataFrame, number: int) -> None:
        # a batch that runs again after a loss writes over what it left
        batch.write.mode("overwrite").parquet(os.path.join(folder, "outcomes", f"batch={number}"))

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    found = asked.select("fname", "content", "prompt").unionByName(retried).groupBy("fname").transformWithStateInPandas(
        FigureState(captioner, attempts), OUTCOME, "update", "none")
    return (found.writeStream.outputMode("update").foreachBatch(save)
            .option("checkpointLocation", os.path.join(folder, "checkpoint")).trigger(availableNow=True).start())


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Every attempt so far; no rows before the first batch."""
    found = stored_table(spark, os.path.join(folder, "outcomes"), OUTCOME)
    return spark.createDataFrame([], OUTCOME) if found is None else found


def latest(attempted: DataFrame) -> DataFrame:
    """``(fname, attempts, caption, error)``: the last attempt of each figure, combined inside tasks before it shuffles."""
    last = F.max_by(F.struct("caption", "error"), "attempt")
    return attempted.groupBy("fname").agg(F.max("attempt").alias("attempts"), last.alias("_l")).select("fname", "attempts", "_l.*")
