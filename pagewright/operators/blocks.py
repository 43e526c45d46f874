"""Sections and procedure blocks: ordered pages or paragraphs become chunks.

Pages and paragraphs are rows, so one long document spreads over many tasks. What a chunk needs besides its text
(where it starts, its heading, its labels) is worked out on narrow rows without text; the text is shuffled to its
chunk last. A chunk is one row whatever its length, unless the caller asks for parts: ``part_rows`` pages a part, named
in the id, for texts that are too long for a cell.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright import rules, schema
from pagewright.functions.classify import (content_name, content_rank, first_rule_index, label_subsystem,
                                           procedure_number, range_name, rule_name, subsystem_of)
from pagewright.functions.text import extract, is_blank, java, matches, or_empty, strip, WHITESPACE
from pagewright.operators import spans
from pagewright.operators.ordered import blocks_of, first_wins, number_rows, scan
from pagewright.operators.splitting import pack_paragraphs
from pagewright.session import materialize

# a lead longer than any keyword shows every match across the heading
SPAN_CHARS = max(64, *(len(pattern) for _, pattern in rules.SUBSYSTEM_KEYWORDS))

# a signal cut by a page break: its word ends one page and its colon opens the next
_OPEN_PROCEDURE = r"\b(?:PROCEDURE|APPLICABILITY)\s*$|\b[56]\d{3}\s*$"
_OPEN_NOTE = r"\bNOTES?\s*$"


def no_images() -> Column:
    return F.array().cast(schema.IMAGES)


def _lead(text: Column) -> Column:
    """Opening characters of a text without a cut-off last word."""
    body = strip(text)
    return F.when(F.length(body) <= SPAN_CHARS, body).otherwise(
        F.regexp_replace(F.substring(body, 1, SPAN_CHARS), java(r"\w+$"), ""))


def page_features(pages: DataFrame) -> DataFrame:
    """What block building needs to know of each page, without its text."""
    text = F.col("text")
    # the number and colon are quick to look for and rare, the header around them is not
    numbered = matches(text, r"[56]\d{3}\s*:")
    header = numbered & matches(text, rules.BLOCK_HEADER, True)
    return pages.select(
        "doc_key", "page",
        F.when(header, F.struct(
            extract(text, rules.BLOCK_HEADER, 2, True).alias("number"),
            strip(extract(text, rules.BLOCK_HEADER, 0, True)).alias("heading"))).alias("header"),
        (numbered & matches(text, rules.BODY_PROBE)).alias("probe"),
        text.contains(rules.BLOCK_END).alias("is_end"),
        is_blank(text).alias("blank"),
        first_rule_index(text, rules.SUBSYSTEM_KEYWORDS).alias("rule"),
        content_rank(text).alias("rank"),
        F.when(matches(text, _OPEN_PROCEDURE, True), 0).when(matches(text, _OPEN_NOTE, True), 1).alias("open_rank"),
        strip(text).startswith(":").alias("colon"),
        F.nullif(procedure_number(text), F.lit("")).alias("own_number"),
        _lead(text).alias("lead"),
    )


def _part_of(row: Column, part_rows: int | None) -> Column:
    """Number of the part a row of a chunk belongs to; 0 for all where no parts are asked for."""
    return F.floor(row / part_rows) if part_rows else F.lit(0).cast("bigint")


def assign_blocks(features: DataFrame, index_first: Column | bool = True, segment_width: int = 4096,
                  part_rows: int | None = None) -> DataFrame:
    """Give each body page the page its block begins at, and the header in force.

    A block begins at the first page, after a page with the end mark, and at a header page unless only blank pages
    precede it in the block. Where ``index_first`` holds, pages before the first body page belong to the index.
    """
    opened = scan(
        features.withColumn("segment", blocks_of(F.col("page"), segment_width)), ["doc_key"], ["page"], "segment",
        running={"probes": F.col("probe").cast("int"), "row": F.lit(1)},
        before={"prev_end": F.col("is_end"), "filled_end": F.when(~F.col("blank"), F.col("is_end"))},
        after={"next_colon": F.when(~F.col("blank"), F.struct("colon", "page"))},
    )
    has_index = index_first if isinstance(index_first, Column) else F.lit(index_first)
    body = opened.where(~has_index | (F.col("probes") > 0))
    first_body = F.col("prev_end").isNull() | (has_index & F.col("probe") & (F.col("probes") == 1))
    begins = first_body | F.col("prev_end") | (F.col("header").isNotNull() & (F.col("filled_end") == F.lit(False)))
    placed = scan(
        body, ["doc_key"], ["page"], "segment",
        latest={"_block": F.when(begins, F.struct("page", "row")), "head": F.col("header")},
    )
    part = _part_of(F.col("row") - F.col("_block")["row"], part_rows)
    return placed.withColumns({"block": F.col("_block")["page"], "part": part}).drop("_block", "segment")


def describe_blocks(assigned: DataFrame, segment_width: int = 4096) -> DataFrame:
    """One row per block with text: its running number in the document, start page, heading and labels."""
    page, following = F.col("page"), F.col("next_colon")

    def colon_after(rank: int) -> Column:
        """First page whose colon completes a signal word that ended the page before it."""
        return F.min(F.when((F.col("open_rank") == rank) & following["colon"], following["page"]))

    grouped = assigned.groupBy("doc_key", "block").agg(
        F.coalesce(F.min(F.when(F.col("header").isNotNull(), page)), F.min("page")).alias("start"),
        F.max("page").alias("end"),
        F.max("part").alias("last_part"),
        F.max_by("head", "page").alias("head"),
        F.min("rule").alias("rule"),
        F.min("rank").alias("rank"),
        colon_after(0).alias("procedure_colon"),
        colon_after(1).alias("note_colon"),
        F.min_by("own_number", F.when(F.col("own_number").isNotNull(), page)).alias("own_number"),
        F.min_by("lead", F.when(~F.col("blank"), page)).alias("lead"),
        F.bool_or(~F.col("blank")).alias("filled"),
    ).where("filled")
    numbered = number_rows(grouped, ["doc_key"], ["block"], blocks_of(F.col("block"), segment_width), "nth")
    heading = or_empty(F.col("head")["heading"])
    number = F.coalesce(F.nullif(F.col("head")["number"], F.lit("")), F.col("own_number"), F.lit(""))
    rule = F.least(F.col("rule"), first_rule_index(F.concat(heading, F.lit(" "), F.col("lead")),
                                                   rules.SUBSYSTEM_KEYWORDS))
    cut = F.when(F.col("procedure_colon") <= F.col("end"), 0).when(F.col("note_colon") <= F.col("end"), 1)
    return numbered.select(
        "doc_key", "block", "start", "last_part", (F.col("nth") - 1).alias("nth"), heading.alias("section_heading"),
        number.alias("fcp_number"),
        F.coalesce(rule_name(rule, rules.SUBSYSTEM_KEYWORDS), range_name(number), F.lit("UNKNOWN")).alias("subsystem"),
        content_name(F.least(F.col("rank"), cut)).alias("content_type"),
    )


def _stripped(text: Column, part: Column, last_part: Column) -> Column:
    """Strip the whole chunk: its first part on the left, its last part on the right."""
    white = F.lit(WHITESPACE)
    text = F.when(part == 0, F.ltrim(text, white)).otherwise(text)
    return F.when(part == last_part, F.rtrim(text, white)).otherwise(text)


def _part_id(base: Column) -> Column:
    return F.when(F.col("part") > 0, F.concat(base, F.lit("_part"), F.col("part").cast("string"))).otherwise(base)


def procedure_blocks(pages: DataFrame, index_first: Column | bool = True, segment_width: int = 4096,
                     part_rows: int | None = None) -> DataFrame:
    """Pages ``(doc_key, page, text[, images])`` to chunks, one per procedure block, or per ``part_rows`` pages of one."""
    if "images" not in pages.columns:
        pages = pages.withColumn("images", no_images())
    features = materialize(page_features(pages), "page-features")
    assigned = materialize(assign_blocks(features, index_first, segment_width, part_rows), "block-pages")
    about = describe_blocks(assigned, segment_width)
    placed = assigned.select("doc_key", "page", "block", "part").join(about, ["doc_key", "block"])
    constants = ["nth", "start", "last_part", "section_heading", "fcp_number", "subsystem", "content_type"]
    rows = pages.select("doc_key", "page", "text", "images").join(placed, ["doc_key", "page"])
    grouped = rows.groupBy("doc_key", "block", "part").agg(
        F.array_sort(F.collect_list(F.struct("page", "text", "images"))).alias("_pages"),
        *[F.first(c).alias(c) for c in constants])
    text = F.array_join(F.transform("_pages", lambda p: p["text"]), "\n")
    base = F.concat_ws("", "doc_key", F.lit("_p"), "start", F.lit("_"), "nth")
    return grouped.select(
        _part_id(base).alias("chunk_id"), _stripped(text, F.col("part"), F.col("last_part")).alias("text"),
        F.col("doc_key").alias("source_doc"), "content_type", F.col("start").cast("int").alias("page"),
        "section_heading", "fcp_number", "subsystem",
        F.flatten(F.transform("_pages", lambda p: F.coalesce(p["images"], no_images()))).alias("images"),
        F.col("block").cast("bigint").alias("block"), F.col("part").cast("int").alias("part"))


def styled_sections(paragraphs: DataFrame, segment_rows: int = 65_536, part_rows: int | None = None) -> DataFrame:
    """Paragraphs ``(doc_key, ord, style, text)`` to chunks: a Heading style opens a section, the rest fills it.
    ``part_rows`` cuts a section into parts of so many paragraphs."""
    is_heading = F.coalesce(F.col("style"), F.lit("")).startswith("Heading")
    line = strip(or_empty(F.col("text")))
    marked = paragraphs.select("doc_key", "ord", line.alias("line"), is_heading.alias("is_heading"))
    fills = ~F.col("is_heading") & (F.col("line") != "")
    marked = marked.withColumn("segment", blocks_of(F.col("ord"), segment_rows))
    counted = scan(marked, ["doc_key"], ["ord"], "segment", running={"row": fills.cast("int")})
    placed = scan(counted, ["doc_key"], ["ord"], "segment", latest={
        "head": F.when(F.col("is_heading"), F.struct(F.col("ord").alias("at"), F.col("line").alias("heading"), "row"))})
    part = _part_of(F.col("row") - 1 - F.coalesce(F.col("head")["row"], F.lit(0)), part_rows)
    body = placed.where(fills).select(
        "doc_key", "ord", "line", part.alias("part"), F.coalesce(F.col("head")["at"], F.lit(-1)).alias("section"),
        F.coalesce(F.col("head")["heading"], F.lit("Preamble")).alias("section_heading"))
    body = materialize(body, "section-lines")
    about = body.groupBy("doc_key", "section").agg(
        F.first("section_heading").alias("section_heading"),
        F.min(first_rule_index(F.col("line"), rules.SUBSYSTEM_KEYWORDS)).alias("rule"),
        F.min_by(_lead(F.col("line")), "ord").alias("lead"),
        F.min_by(procedure_number(F.col("line")), F.when(procedure_number(F.col("line")) != "", F.col("ord")))
        .alias("own_number"))
    about = number_rows(about, ["doc_key"], ["section"], blocks_of(F.col("section"), segment_rows), "nth")
    opening = F.concat(F.col("section_heading"), F.lit(" "), F.col("lead"))
    number = F.coalesce(F.nullif(procedure_number(F.col("section_heading")), F.lit("")), F.col("own_number"), F.lit(""))
    rule = F.least(F.col("rule"), first_rule_index(opening, rules.SUBSYSTEM_KEYWORDS))
    about = about.select(
        "doc_key", "section", (F.col("nth") - 1).alias("nth"), number.alias("fcp_number"),
        F.coalesce(rule_name(rule, rules.SUBSYSTEM_KEYWORDS), range_name(number), F.lit("UNKNOWN")).alias("subsystem"))
    texts = body.groupBy("doc_key", "section", "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda p: p["line"]), "\n")
        .alias("text"), F.first("section_heading").alias("section_heading"))
    return texts.join(about, ["doc_key", "section"]).select(
        _part_id(F.format_string("%s_%04d", "doc_key", "nth")).alias("chunk_id"), "text",
        F.col("doc_key").alias("source_doc"), F.lit("section").alias("content_type"),
        F.lit(None).cast("int").alias("page"), "section_heading", "fcp_number", "subsystem",
        no_images().alias("images"), F.col("section").alias("block"), F.col("part").cast("int").alias("part"))


#: Characters of a numbered heading, which takes whole lines and may run over a page's end.
_HEADING = spans.Pattern(rules.NUMBERED_HEADING, r"\d.A-Z\s\-/(),", lines=True)
#: Characters of the anchor of an index row.
_INDEX_ROW = spans.Pattern(rules.INDEX_ROW, r"\d.A-Z\s&")


def numbered_spans(pages: DataFrame) -> DataFrame:
    """Pages ``(doc_key, page, text)`` to sections ``(doc_key, nth, section_heading, page, section)``.

    A heading may begin on one page and end on the next; pages stay rows, see :mod:`pagewright.operators.spans`. Text before
    the first heading is dropped; a heading with a short title ends the section before it and opens none.
    """
    found = spans.parts(pages, _HEADING)
    heading = strip(F.col("head"))
    title = F.regexp_replace(heading, java(r"^\d+(?:\.\d+)*\s+"), "")
    rows = found.select("doc_key", F.col("nth").cast("int").alias("nth"), heading.alias("section_heading"), "page",
                        strip(F.col("part")).alias("section"), title.alias("title"))
    return rows.where((F.length("title") >= 5) & F.col("section_heading").contains(" ")).drop("title")


def numbered_sections(pages: DataFrame) -> DataFrame:
    """Sections under numbered headings, packed into chunks."""
    packed = numbered_spans(pages).select(
        "doc_key", "nth", "section_heading", "page",
        F.posexplode(pack_paragraphs(F.col("section"))).alias("idx", "text"))
    return packed.select(
        F.concat_ws("", "doc_key", F.lit("_s"), "nth", F.lit("_c"), "idx").alias("chunk_id"), "text",
        F.col("doc_key").alias("source_doc"), F.lit("section").alias("content_type"), "page", "section_heading",
        F.lit("").alias("fcp_number"), subsystem_of(F.col("text")).alias("subsystem"), no_images().alias("images"),
        F.col("nth").cast("bigint").alias("block"), F.col("idx").alias("part"))


def index_pages(pages: DataFrame) -> DataFrame:
    """The pages before the first body page of each document, or all where there is none."""
    bodies = pages.where(matches(or_empty(F.col("text")), rules.BODY_PROBE)).groupBy("doc_key").agg(F.min("page").alias("_body"))
    found = pages.join(bodies, "doc_key", "left")
    return found.where(F.col("_body").isNull() | (F.col("page") < F.col("_body"))).drop("_body")


def index_entries(pages: DataFrame) -> DataFrame:
    """Index pages ``(doc_key, page, text)`` to one chunk per listed procedure; the first of a repeated id wins.

    A title is what lies between two row anchors, page ends or not.
    """
    found = spans.parts(pages, _INDEX_ROW)
    anchor = F.col("head")
    rows = found.select("doc_key", "nth", F.struct(
        *[F.regexp_extract(anchor, java(rules.INDEX_ROW), i).alias(name) for i, name in enumerate(("serial", "number", "label"), 1)],
        F.expr("substring(part, length(head) + 1)").alias("title")).alias("row"))
    row = F.col("row")
    title = F.btrim(F.regexp_replace(row["title"], java(r"\s+"), " "), F.lit(" .\n\t"))
    subsystem = label_subsystem(row["label"])
    entries = rows.select(
        F.format_string("%s_IDX_%03d_%s", F.col("doc_key"), row["serial"].cast("int"), row["number"]).alias("chunk_id"),
        F.concat(F.lit("FCP "), row["number"], F.lit(" — "), subsystem, F.lit(" — "), title).alias("text"),
        F.col("doc_key").alias("source_doc"), F.lit("toc_index").alias("content_type"), F.lit(1).alias("page"),
        F.lit("FCP Index").alias("section_heading"), row["number"].alias("fcp_number"), subsystem.alias("subsystem"),
        no_images().alias("images"), F.col("nth").cast("bigint").alias("block"), F.lit(0).alias("part"))
    return first_wins(entries, ["source_doc", "chunk_id"], ["block"])


def page_coverage(pages: DataFrame) -> DataFrame:
    """Text pages and image-only pages per document, with the flag that asks for OCR."""
    has_text = F.length(strip(or_empty(F.col("text")))) > rules.TEXT_PAGE_CHARS
    counted = pages.groupBy("doc_key").agg(F.count("*").alias("pages"), F.count_if(has_text).alias("text_pages"))
    image_only = F.col("pages") - F.col("text_pages")
    return counted.withColumn("image_only", image_only).withColumn(
        "needs_ocr", image_only > F.col("pages") * rules.OCR_WARN_SHARE)
