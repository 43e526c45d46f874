"""First match among many overlapping ranges, as tables.

Rules ``(lo, hi, ord, ...)`` claim whole numbers, both ends included; of the rules that claim a number the one of the smallest ``ord``, a
whole number, wins. All ends cut the line into elementary intervals. A rule covers a run of them, which splits into at most two
aligned blocks of each power-of-two size; a block keeps its best rule. The winner of an interval is the best of the
blocks that lie around it, one of each size. So work grows with rules times the logarithm of their number, however they overlap,
and numbers are looked up by the interval they fall into. Nothing of the rules is part of a plan.

Rules without an end, or whose ends are the wrong way round, claim nothing. Numbers without a rule, and null, get null.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators.lookup import asof
from pagewright.operators.ordered import blocks_of, number_rows
from pagewright.session import materialize

#: Numbers of a scanned segment.
WIDTH = 1 << 16


def _blocks(first: Column, end: Column, levels: Column | int) -> Column:
    """The aligned blocks (level, block), of levels up to ``levels``, that make up the intervals from ``first`` up to ``end``."""
    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
        a, b = F.call_function("shiftright", first + size - 1, level), F.call_function("shiftright", end, level)
        left, right = (a < b) & (a % 2 == 1), (a < b) & (b % 2 == 1)
        # what is left at a level loses its first block where that is odd, and its last where the end is; if both are one, once
        last = right & (b - 1 >= F.when(left, a + 1).otherwise(a))
        return F.array(*[F.when(taken, F.struct(level.alias("level"), block.alias("block"))) for taken, block in ((left, a), (last, b - 1))])

    levels = levels if isinstance(levels, Column) else F.lit(levels)
    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), levels), at)))


def intervals(rules: DataFrame, payload: list[str]) -> DataFrame:
    """(start, payload...): from each ``start`` on, up to the next, the winning rule's payload; null where none claims."""
    held = rules.where("lo <= hi").select(F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"), "ord",
                                          F.struct(*payload).alias("rule"))
    # one number a rule, in the order they win: the best of many is found by comparing numbers, without sorting rows
    held = materialize(number_rows(held, [], ["ord", "rule"], blocks_of(F.col("ord"), WIDTH), "place"), "rules")
    ends = held.select(F.explode(F.array("lo", F.col("hi") + 1)).alias("start")).distinct()
    numbered = materialize(number_rows(ends, [], ["start"], blocks_of(F.col("start"), WIDTH), "n"), "rule-ends").select("start", (F.col("n") - 1).alias("n"))
    levels = max(1, numbered.count()).bit_length()
    first, end = numbered.select(F.col("start").alias("lo"), F.col("n").alias("a")), numbered.select((F.col("start") - 1).alias("hi"), F.col("n").alias("b"))
    placed = held.select("lo", "hi", "place").join(first, "lo").join(end, "hi")
    # a rule has no block that is wider than itself
    height = F.length(F.bin(F.col("b") - F.col("a"))) - 1
    best = placed.select("place", F.explode(_blocks(F.col("a"), F.col("b"), height)).alias("at")).groupBy("at.level", "at.block").agg(
        F.min("place").alias("place"))
    around = numbered.select("start", F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda level: F.struct(
        level.alias("level"), F.call_function("shiftright", F.col("n"), level).alias("block")))).alias("at")).select("start", "at.*")
    won = around.join(best, ["level", "block"], "left").groupBy("start").agg(F.min("place").alias("place"))
    named = won.join(held.select("place", "rule"), "place", "left")
    return named.select("start", *[F.col("rule")[c].alias(c) for c in payload])


def first_match(rows: DataFrame, number: str, rules: DataFrame, payload: list[str]) -> DataFrame:
    """``rows`` with the payload of the rule that wins their ``number``."""
    cut = materialize(intervals(rules, payload), "rule-intervals").withColumn(number, F.col("start"))
    known, cut = (df.withColumn("_line", F.lit(0)) for df in (rows.where(F.col(number).isNotNull()), cut))
    found = asof(known, cut, ["_line"], number, "start", payload, "backward", segment_width=WIDTH)
    named = found.select(*rows.columns, *[F.col(f"hit_{c}").alias(c) for c in payload])
    rest = rows.where(F.col(number).isNull())
    for c in payload:
        rest = rest.withColumn(c, F.lit(None).cast(cut.schema[c].dataType))
    return named.unionByName(rest)
