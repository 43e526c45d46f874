"""Matches of a pattern over the pages of a document, pages staying rows.

A document is its pages end to end, each after a newline. A pattern whose matches may cross page ends (a heading may
follow its number on the next page) is found without putting the document together: matches hold only characters of a
known class, so a page's text splits into what comes before its first other character, what comes after its last one, and
the middle. Matches in the middle are the page's own. The open end of one page, the pages that have no other character, and the
open start of the next are laid end to end, mostly a few lines, and searched as one.

A match opens a part that reaches to the next match. How many matches came before a page, and where each page starts, are
segmented scans over narrow rows; pages are then cut where matches start, and a part is put together from its pieces.
Only a part is ever one row.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import java, or_empty
from pagewright.operators.lookup import asof
from pagewright.operators.ordered import blocks_of, number_rows, scan
from pagewright.session import materialize

#: Pages of a scanned segment, and characters of one.
PAGES, CHARS = 4096, 1 << 20
#: A character that no class of a :class:`Pattern` may hold; it stands where a text goes on.
_EDGE = "|"


@dataclass(frozen=True)
class Pattern:
    """``regex``, and ``chars``, the body of a class of all characters that a match may hold. ``lines``: matches start and end
    with lines, so the whole line of any other character is out of reach."""

    regex: str
    chars: str
    lines: bool = False


def _found(text: Column, regex: str) -> tuple[Column, Column]:
    """(matches, what stands before, between and after them)."""
    return F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex, -1)


def _starts(df: DataFrame, text: str, regex: str, base: Column, keep: list[str]) -> DataFrame:
    """A row for each match in ``text``: ``start`` counted from ``base``, and ``head``, the match."""
    heads, gaps = _found(F.col(text), regex)
    held = df.withColumns({"_heads": heads, "_base": base}).where(F.size("_heads") > 0).withColumn("_gaps", gaps)
    rows = held.select(*keep, "_base", F.posexplode(F.arrays_zip(
        F.col("_heads").alias("head"), F.slice("_gaps", F.lit(1), F.size("_heads")).alias("gap"))).alias("_i", "_m"))
    order = rows.select(*keep, "_base", "_i", F.col("_m.head").alias("head"), F.length("_m.gap").cast("bigint").alias("_gap"),
                        F.length("_m.head").cast("bigint").alias("_head"))
    order = materialize(order, "match-order")       # a scan reads its input twice; texts are searched once
    # a match starts after the gaps up to it and the matches before it
    upto = scan(order, [*keep, "_base"], ["_i"], blocks_of(F.col("_i")), running={"_upto": F.col("_gap") + F.col("_head")})
    return upto.select(*keep, (F.col("_base") + F.col("_upto") - F.col("_head")).alias("start"), "head")


def _placed(pages: DataFrame, pattern: Pattern) -> DataFrame:
    """(doc_key, page, at, size, ahead, behind, mixed, text): the page after its newline, where it starts in the document, and how
    many characters at its ends a match might share with a neighbour."""
    inside = java(f"[{pattern.chars}]")
    flags, body = inside[:inside.index("[")], inside[inside.index("["):]
    rows = pages.select("doc_key", F.col("page").cast("bigint").alias("page"), F.concat(F.lit("\n"), or_empty(F.col("text"))).alias("text"))
    lead, trail = (F.regexp_extract(t, rf"{flags}\A{body}*+", 0) for t in (F.col("text"), F.reverse("text")))
    if pattern.lines:       # back to the end of the line before, on to the end of the line
        lead = F.regexp_extract(lead, r"(?s)\A.*\n", 0)
        trail = F.regexp_extract(trail, r"(?s)\A.*\n", 0)
    rows = rows.withColumns({"size": F.length("text").cast("bigint"), "mixed": F.col("text").rlike(rf"{flags}[^{body[1:]}"),
                             "ahead": F.length(lead).cast("bigint"), "behind": F.length(trail).cast("bigint")})
    return scan(rows, ["doc_key"], ["page"], blocks_of(F.col("page"), PAGES), running={
        "_end": F.col("size"), "_run": F.col("mixed").cast("bigint")}).withColumn("at", F.col("_end") - F.col("size")).drop("_end")


def matches(placed: DataFrame, pattern: Pattern) -> DataFrame:
    """(doc_key, start, head): all matches, ``start`` in the document."""
    regex = java(pattern.regex, multiline=True)
    middle = placed.where("mixed AND ahead + behind < size").select(
        "doc_key", (F.col("at") + F.col("ahead")).alias("base"),
        F.expr("substring(text, CAST(ahead + 1 AS int), CAST(size - ahead - behind AS int))").alias("part"))
    own = _starts(middle, "part", regex, F.col("base"), ["doc_key"])
    # open ends: those of equal number are neighbours
    def piece(run: Column, text: Column, at: Column, opens: bool, closes: bool) -> Column:
        return F.struct(run.alias("run"), text.alias("text"), at.alias("at"), F.lit(opens).alias("opens"), F.lit(closes).alias("closes"))

    run, text, at = F.col("_run"), F.col("text"), F.col("at")
    ends = F.array(piece(run - 1, F.expr("substring(text, 1, CAST(ahead AS int))"), at, False, True),
                   piece(run, F.expr("right(text, CAST(behind AS int))"), at + F.col("size") - F.col("behind"), True, False))
    pieces = placed.select("doc_key", F.explode(F.when(F.col("mixed"), ends).otherwise(
        F.array(piece(run, text, at, False, False)))).alias("p")).select("doc_key", "p.*")
    joined = pieces.groupBy("doc_key", "run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda p: p["text"]), "").alias("part"),
        F.min("at").alias("at"), F.max("opens").alias("opens"), F.max("closes").alias("closes"))
    edged = joined.select("doc_key", F.when(F.col("opens"), F.col("at") - 1).otherwise(F.col("at")).alias("base"), F.concat(
        F.when(F.col("opens"), F.lit(_EDGE)).otherwise(F.lit("")), "part", F.when(F.col("closes"), F.lit(_EDGE)).otherwise(F.lit(""))).alias("part"))
    return own.unionByName(_starts(edged, "part", regex, F.col("base"), ["doc_key"]))


def parts(pages: DataFrame, pattern: Pattern) -> DataFrame:
    """Pages ``(doc_key, page, text)``, pages dense, to ``(doc_key, nth, head, page, part)``: ``part`` is the text from the
    ``nth`` match (from 0) to the next, ``page`` the one it starts on. Text before the first match is in no part. A page without
    text is empty."""
    placed = materialize(_placed(pages, pattern), "page-places")
    slim = placed.select("doc_key", "page", "at", "size")
    numbered = number_rows(materialize(matches(placed, pattern), "match-starts"), ["doc_key"], ["start"], blocks_of(F.col("start"), CHARS), "nth")
    found = numbered.select("doc_key", "start", "head", (F.col("nth") - 1).alias("nth"))
    found = materialize(asof(found.withColumn("at", F.col("start")), slim.withColumn("page_at", F.col("at")), ["doc_key"], "at", "page",
                             ["page", "page_at"], "backward", segment_width=CHARS), "matches")
    cuts = found.groupBy("doc_key", F.col("hit_page").alias("page")).agg(
        F.array_sort(F.collect_list(F.struct((F.col("start") - F.col("hit_page_at")).alias("from"), "nth"))).alias("cuts"))
    rows = placed.select("doc_key", "page", "text", "size").join(cuts, ["doc_key", "page"], "left")
    last = F.element_at("cuts", -1)["nth"]
    rows = scan(rows, ["doc_key"], ["page"], blocks_of(F.col("page"), PAGES), before={"open": last})
    first = F.struct(F.lit(0).cast("bigint").alias("from"), F.coalesce("open", F.lit(-1).cast("bigint")).alias("nth"))
    held = F.concat(F.array(first), F.coalesce("cuts", F.array().cast("array<struct<from:bigint,nth:bigint>>")))
    rows = rows.withColumn("held", held)
    cut = F.transform("held", lambda c, i: F.struct(c["nth"].alias("nth"), F.substring(
        F.col("text"), (c["from"] + 1).cast("int"), (F.coalesce(F.get("held", i + 1)["from"], F.col("size")) - c["from"]).cast("int")).alias("text")))
    pieces = rows.select("doc_key", "page", F.explode(cut).alias("c")).select("doc_key", "page", "c.*").where("nth >= 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "")
    built = pieces.groupBy("doc_key", "nth").agg(text.alias("part"))
    heads = found.select("doc_key", "nth", "head", F.col("hit_page").cast("int").alias("page"))
    return built.join(heads, ["doc_key", "nth"]).select("doc_key", "nth", "head", "page", "part")
