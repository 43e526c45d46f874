"""Parquet tables."""

import os

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder, in the splits Spark reads it in."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
