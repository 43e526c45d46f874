"""Mixing sources to target weights: weighted fair queueing.

Each source's documents stand in shuffled order (by a digest of id and text), once for every pass its target allows. A copy's
virtual finish time is the source's words up to and including it, divided by the source's target. All copies are ranged
by finish time and taken from the front until the total budget is spent. Both running sums are cut into ranges that are
summed by themselves and carried on, so neither a source with a third of all rows nor the whole queue stands in one task.

Sources are ranked by code point, null last, and weigh 1, 2, 3, repeating. They share the words of all documents; no
target passes ``cap`` times its source, what is above is shared among the rest by weight until none is above.

Null and empty texts have size 0 and are never taken. Rows that agree in id and text are mixed each. Rows without an id
count like any others. An empty table gives no rows. Ties in finish time go by source, pass, digest, id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.llm.common import row_digest, text_key, word_count, written
from pagewright.operators.ordered import scan

WEIGHTS = (1, 2, 3)
CAP = 3
#: Rows of a range that is summed in one task, about.
RANGE_ROWS = 20_000


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) with rank (from 0), weight and target; one row a source. Ranks and levels run over all sources
    in one task: their number is taken to be one that a task can sort."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    # in order of the level at which a source is full, all before a place are full if the level there is below its own
    full = W.orderBy(F.col("source_size") / F.col("weight"), "rank")
    whole = W.partitionBy()
    held = F.coalesce(F.sum(cap * F.col("source_size")).over(full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(full.rowsBetween(0, W.unboundedFollowing))
    levels = ranked.withColumn("_level", (F.sum("source_size").over(whole) - held).cast("double") / rest)
    open_ = F.col("_level") * F.col("weight") <= cap * F.col("source_size")
    levels = levels.withColumn("_place", F.row_number().over(full)).withColumn("_open", open_)
    first = F.min(F.when(F.col("_open"), F.col("_place"))).over(whole)
    level = F.min_by("_level", F.when(F.col("_open"), F.col("_place"))).over(whole)
    target = F.when(F.col("_place") < first, (cap * F.col("source_size")).cast("double")).otherwise(level * F.col("weight"))
    return levels.withColumn("target", target).drop("_level", "_place", "_open")


def mix(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
        cap: int = CAP) -> DataFrame:
    """(doc_id, text_key, source, size, source_size, target, copies, taken), one row a document."""
    narrow = written(df.select(
        F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("text_key"), F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))).alias("shuffle"),
    ), "sizes")
    shared = written(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "targets")
    n = narrow.count()
    ranges = max(1, -(-n // RANGE_ROWS))
    placed = narrow.alias("d").join(shared.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "d.*", "s.source_size", "s.target", "s.rank",
        F.floor(F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("double") * ranges / 2**32).alias("segment"))
    order = ["shuffle", "doc_id", "text_key"]
    queued = written(scan(placed, ["rank"], order, "segment", running={"upto": F.col("size")}), "queued")

    passes = F.least(F.lit(cap), F.ceil(F.col("target") / F.col("source_size"))).cast("int")
    finish = ((F.col("turn") * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")).alias("finish")
    line = ["rank", "turn", "shuffle", "doc_id", "text_key", "upto"]
    copies = queued.where("size > 0 AND target > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), passes - 1)))
    copies = copies.select(finish, *line, "size").withColumn("range", F.floor(F.col("finish") * (3 * ranges)))
    budget = shared.agg(F.sum("source_size")).first()[0] or 0
    spent = scan(copies, [], ["finish", *line], "range", running={"spent": F.col("size")})
    end = spent.where(F.col("spent") <= budget).agg(F.max(F.struct("finish", *line)).alias("last")).first()["last"]
    if end is None:                               # no words at all
        taken = F.lit(0)
    else:
        kinds = dict(copies.dtypes)
        last = F.struct(*[F.lit(end[c]).cast(kinds[c]).alias(c) for c in ("finish", *line)])
        turns = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda turn: F.struct(
            ((turn * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")).alias("finish"), F.col("rank"),
            turn.alias("turn"), *[F.col(c) for c in line[2:]]))
        # a copy is taken if it does not stand after the last one that the budget holds
        taken = F.when((F.col("size") == 0) | (F.col("target") <= 0), 0).otherwise(
            F.size(F.filter(turns, lambda copy: (copy["turn"] < passes) & (copy <= last))))
    return queued.withColumn("copies", taken).select(
        "doc_id", "text_key", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


def mixed_documents(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """``df`` with each row as often as the mix takes it. Rows that agree in id and text share their copies in turn, in an
    order that all their columns decide."""
    shares = mix(df, text, doc_id, source, **how).groupBy("doc_id", "text_key").agg(
        F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0")
    shares = shares.select(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key"), "_copies", "_rows")
    keyed = df.withColumns({"_key": text_key(F.col(text)), "_row": row_digest(df)})
    met = keyed.join(shares, F.col(doc_id).eqNullSafe(F.col("_doc_id")) & (F.col("_key") == F.col("_text_key")))
    nth = F.row_number().over(W.partitionBy("_doc_id", "_text_key").orderBy("_row"))
    own = F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_nth") <= F.col("_copies") % F.col("_rows")).cast("int")
    rows = met.withColumn("_nth", nth).withColumn("_own", own.cast("int")).where("_own > 0")
    return rows.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_own")))).select(*[F.col(f"`{c}`") for c in df.columns])
