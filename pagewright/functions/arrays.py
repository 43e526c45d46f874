"""Lookups inside one row's arrays."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def running_starts(lengths: Column) -> Column:
    """Start offset of each element when elements of these lengths are laid end to end."""
    grown = F.aggregate(
        lengths,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("starts")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
    )
    return grown["starts"]


def last_at_or_before(offsets: Column, value: Column) -> Column:
    """How many of the ascending ``offsets`` are <= ``value``: a binary search, so cost grows with the log."""
    def step(found: Column, bit: Column) -> Column:
        jump = found + F.call_function("shiftleft", F.lit(1), bit)
        return F.when((jump <= F.size(offsets)) & (F.get(offsets, jump - 1) <= value), jump).otherwise(found)

    return F.aggregate(F.sequence(F.lit(29), F.lit(0), F.lit(-1)), F.lit(0), step)
