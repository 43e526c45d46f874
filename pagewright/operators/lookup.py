"""Lookups along an order: figure to chunk, offset to page."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.ordered import blocks_of, scan
from pagewright.session import materialize


def asof(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    on: str,
    tie: str,
    payload: list[str],
    direction: str = "forward",
    clamp: bool = False,
    segment_width: int = 4096,
) -> DataFrame:
    """Attach to each left row the nearest right row of the same ``by`` key along the integer column ``on``.

    ``forward`` takes the first right position at or after the left one, ``backward`` the last at or before it; among
    right rows of one position the smallest ``tie`` wins. ``clamp`` falls back to the right row with the largest
    position and ``tie`` (forward) or the first one (backward). A left row without a position gets the first right row.

    Both sides shrink to one row per position before anything else, so a position shared by many rows costs one row
    per task; the result is joined back on the position, where it is unique.
    """
    at = [*by, on]
    known = F.col(on).isNotNull()
    offered = right.where(known).select(*at, F.struct(*payload).alias("_row"), F.col(tie).alias("_tie"))
    asked = left.where(known).select(*at).distinct().withColumn("_asked", F.lit(True))
    line = materialize(offered.groupBy(*at).agg(F.min_by("_row", "_tie").alias("_first"), F.max_by("_row", "_tie").alias("_last"))
                       .join(asked, at, "full"), "positions")
    fill = {"_hit": F.col("_first")}
    filled = scan(line, by, [on], blocks_of(F.col(on), segment_width),
                  **({"upcoming": fill} if direction == "forward" else {"latest": fill}))
    edges = line.where(F.col("_first").isNotNull()).groupBy(*by).agg(
        F.max_by("_last", on).alias("_end"), F.min_by("_first", on).alias("_start"))
    hits = filled.where("_asked").select(*at, "_hit")
    found = left.join(hits, at, "left").join(edges, by, "left")
    spare = F.col("_end" if direction == "forward" else "_start") if clamp else F.lit(None)
    chosen = F.when(F.col(on).isNull(), F.col("_start")).otherwise(F.coalesce(F.col("_hit"), spare))
    return (found.withColumn("_chosen", chosen)
            .select(*[F.col(c) for c in left.columns], *[F.col("_chosen")[c].alias(f"hit_{c}") for c in payload]))


def figure_context(figures: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk that describes each figure: the first one on the figure's page or later, else the document's last."""
    paged = chunks.where((F.col("source_doc") != "") & (F.coalesce("page", F.lit(0)) != 0)).select(
        F.col("source_doc").alias("doc_key"), "page", "ord", "chunk_id", "doc_filename", "section_heading",
        "fcp_number", "subsystem", F.col("page").alias("chunk_page"))
    return asof(figures, paged, ["doc_key"], "page", "ord",
                ["chunk_id", "doc_filename", "section_heading", "fcp_number", "subsystem", "chunk_page"], clamp=True)
