"""Session settings the jobs expect. On a cluster the caller's own settings win."""

import os
import re
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", **extra: str) -> SparkSession:
    """A local session for tests and the command line."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("pagewright")
    local = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    for key, value in {**SETTINGS, **local, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for written tables; a temporary one only where none is set and the master is local
    (tests): elsewhere executors would not see each other's files, so an unset folder is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


_open_scopes: list[list[str]] = []


@contextmanager
def intermediates(spark: SparkSession):
    """Tables that :func:`materialize` writes inside the block are removed at its end. What derives from them has to be
    consumed inside; without a block they stay, and the folder's owner removes them."""
    written: list[str] = []
    _open_scopes.append(written)
    try:
        yield
    finally:
        _open_scopes.remove(written)
        for path in written:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession, name: str):
    """A path below the shared folder for what only the block needs, removed at its end."""
    path = os.path.join(shared_dir(spark), f"{name}-{os.urandom(8).hex()}")
    try:
        yield path
    finally:
        remove(spark, path)


#: Drops the shuffle files of a query when it ends; else they lie until the driver collects its garbage.
FREED_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Settings of the session that hold inside the block."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used, removed with the innermost open block."""
    path = os.path.join(shared_dir(spark), f"{name}-{os.urandom(8).hex()}")
    if _open_scopes:
        _open_scopes[-1].append(path)
    return path


def materialize(df, name: str):
    """Write ``df`` below the shared folder and read it back: later stages restart from the written rows."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
