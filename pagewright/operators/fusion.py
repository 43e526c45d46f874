"""Combining ranked lists."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright import rules
from pagewright.operators.ordered import first_wins, top_k


def fuse(lists: DataFrame, keys: list[str], id_col: str, payload: list[str], limit: int,
         k: int = rules.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ``lists(keys, list_no, rank, id, payload)``, rank 1-based.

    An id keeps the payload of the last list that holds it; ties keep the order of first appearance.
    """
    fused = lists.groupBy(*keys, id_col).agg(
        F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("rrf"),
        F.min(F.struct("list_no", "rank")).alias("_seen"),
        F.max_by(F.struct(*payload), "list_no").alias("_payload"))
    order = [F.round("rrf", 12).desc(), F.col("_seen")]
    return top_k(fused, keys, order, limit).select(*keys, "rank", id_col, "rrf", "_payload.*")


def put_in_front(front: DataFrame, back: DataFrame, keys: list[str], id_col: str, keep: int,
                 limit: int | None = None) -> DataFrame:
    """The first ``keep`` rows of ``front``, then ``back``, each id once at its first place."""
    columns = [c for c in back.columns]
    both = (front.where(F.col("rank") <= keep).select(*columns).withColumn("_list", F.lit(0))
            .unionByName(back.withColumn("_list", F.lit(1))))
    once = first_wins(both.withColumn("_at", F.struct("_list", "rank")), [*keys, id_col], ["_at"]).drop("rank")
    ceiling = limit if limit is not None else 2**31 - 1
    return top_k(once, keys, [F.col("_at")], ceiling).select(*columns)
