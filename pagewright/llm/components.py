"""Connected components of an edge table: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of undirected edges (a, b): ``root`` is the smallest node reachable. Nodes without an edge are absent.

    Each round hangs the larger neighbours of a node below its smallest (large star), then the smaller ones (small star);
    it ends when every node hangs directly below a root. Smallest neighbours are found by partial aggregation and met by
    a join that Spark may split, so a node with very many edges is no task of its own.
    """
    held = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not _settled(held):
        both = held.union(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        held = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    return held.select(F.col("a").alias("node"), F.col("b").alias("root")).union(held.select("b", "b").distinct())


def _settled(held: DataFrame) -> bool:
    """Whether no node hangs below two others, and no root below another."""
    many = held.groupBy("a").count().where("count > 1").limit(1)
    deep = held.join(held.select(F.col("a").alias("b")), "b", "left_semi").limit(1).select("a", F.lit(2).alias("count"))
    return not many.union(deep).take(1)
