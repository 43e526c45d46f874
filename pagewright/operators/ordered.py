"""Ordered operations that stay parallel when one key holds most of the rows.

A plain window over a key runs in one task per key. Here each key is cut into segments along its order: rows are
scanned inside a segment, one summary row per segment is carried across segments, and the two are joined back. The
summary is smaller than the data by the segment length.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEGMENT_ROWS = 65_536


def blocks_of(position: Column, size: int = SEGMENT_ROWS) -> Column:
    """Segment number of an integer position."""
    return F.floor(position / F.lit(size))


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    segment: Column | str,
    running: dict[str, Column] | None = None,
    latest: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
    upcoming: dict[str, Column] | None = None,
    after: dict[str, Column] | None = None,
) -> DataFrame:
    """Add ordered columns; ``segment`` must never fall along ``order`` inside a key. Given as the name of a column it
    is kept, and a second scan over it finds the rows already in place.

    ``running``  sum up to and including the row
    ``latest``   last non-null value up to and including the row; ``before``: up to the row before
    ``upcoming`` first non-null value from the row on; ``after``: from the next row on
    """
    running, latest, before = running or {}, latest or {}, before or {}
    upcoming, after = upcoming or {}, after or {}
    named = isinstance(segment, str)
    slot = segment if named else "_segment"
    cells = [*keys, slot]
    df = df if named else df.withColumn(slot, segment)
    place = F.struct(*order) if len(order) > 1 else F.col(order[0])
    descending = [F.col(c).desc() for c in order]

    fore = W.partitionBy(*cells).orderBy(*order)
    back = W.partitionBy(*cells).orderBy(*descending)
    upto, prior = (W.unboundedPreceding, 0), (W.unboundedPreceding, -1)
    local, totals, carry = {}, [], {}
    across, across_back = (W.partitionBy(*keys).orderBy(slot).rowsBetween(*prior),
                           W.partitionBy(*keys).orderBy(F.col(slot).desc()).rowsBetween(*prior))

    for name, value in running.items():
        local[name] = F.sum(value).over(fore.rowsBetween(*upto))
        totals.append(F.sum(value).alias(name))
        carry[name] = F.sum(name).over(across)
    for group, frame in ((latest, upto), (before, prior)):
        for name, value in group.items():
            local[name] = F.last(value, ignorenulls=True).over(fore.rowsBetween(*frame))
            totals.append(F.max_by(value, F.when(value.isNotNull(), place)).alias(name))
            carry[name] = F.last(name, ignorenulls=True).over(across)
    for group, frame in ((upcoming, upto), (after, prior)):
        for name, value in group.items():
            local[name] = F.last(value, ignorenulls=True).over(back.rowsBetween(*frame))
            totals.append(F.min_by(value, F.when(value.isNotNull(), place)).alias(name))
            carry[name] = F.last(name, ignorenulls=True).over(across_back)

    summary = df.groupBy(*cells).agg(*totals).select(*cells, *[c.alias(f"_c_{n}") for n, c in carry.items()])
    joined = df.withColumns(local).join(summary, cells, "left")
    merged = {
        name: (F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(f"_c_{name}"), F.lit(0)))
        if name in running else F.coalesce(F.col(name), F.col(f"_c_{name}"))
        for name in local
    }
    return joined.withColumns(merged).drop(*([] if named else [slot]), *[f"_c_{n}" for n in carry])


def number_rows(df: DataFrame, keys: list[str], order: list[str], segment: Column, name: str) -> DataFrame:
    """1-based position of each row inside its key."""
    return scan(df, keys, order, segment, running={name: F.lit(1).cast("bigint")})


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key, or of all rows; 1-based rank in ``name``. Tasks cut to ``k`` before the shuffle."""
    if not keys:
        df = df.orderBy(*order).limit(k)
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(name) <= k)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in list order."""
    return top_k(df, keys, [F.col(c) for c in order], 1, "_nth").drop("_nth")
