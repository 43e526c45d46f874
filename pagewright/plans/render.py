"""Results as text: context for the answer, citations, figure lists and command tables.

A question has at most a few results, so its context is put together in one group; a day's command table has no
bound and stays a distributed column of lines.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright import rules
from pagewright.functions.text import excerpt, known, or_empty, pad, strip
from pagewright.operators.ordered import first_wins, top_k

RULE = "─"


def _subsystem() -> Column:
    return F.when(~F.col("subsystem").isin("", "UNKNOWN"), F.col("subsystem"))


def _page() -> Column:
    return F.when(F.col("page") != 0, F.col("page").cast("string"))


def _number() -> Column:
    return F.when(known(F.col("fcp_number")).isNotNull(), F.concat(F.lit("FCP-"), "fcp_number"))


def _is_figure() -> Column:
    return F.col("content_type") == "image_caption"


def context(results: DataFrame) -> DataFrame:
    """``(qid, context)`` of results ``(qid, rank, document, metadata...)``."""
    header = F.concat(
        F.lit("[Source "), F.col("rank").cast("string"), F.lit(" | "), "source_doc",
        F.coalesce(F.concat(F.lit(" "), _number()), F.lit("")),
        F.coalesce(F.concat(F.lit(" · "), _subsystem()), F.lit("")),
        F.coalesce(F.concat(F.lit(" · page "), _page()), F.lit("")),
        F.lit(" · "), "content_type", F.lit("]"))
    body = F.substring(strip(F.col("document")), 1, rules.CONTEXT_CHARS)
    block = F.concat(header, F.lit("\n"), body)
    gap = "\n\n" + RULE * 50 + "\n\n"
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda x: x["block"])
    return results.groupBy("qid").agg(F.concat(F.lit("\n\n"), F.array_join(blocks, gap)).alias("context"))


def citations(results: DataFrame) -> DataFrame:
    """``(qid, nth, citation)``: pieces of one section share a citation, a figure has its own."""
    key = F.when(_is_figure(), F.struct(F.lit("IMG").alias("a"), F.col("image_file").alias("b"), F.lit("").alias("c"))
                 ).otherwise(F.struct(F.col("source_doc").alias("a"), F.col("fcp_number").alias("b"),
                                      F.substring("section_heading", 1, rules.CITATION_KEY_CHARS).alias("c")))
    once = first_wins(results.withColumn("_key", key), ["qid", "_key"], ["rank"])
    numbered = top_k(once, ["qid"], [F.col("rank")], 2**31 - 1, "nth")
    heading = F.when(F.col("section_heading") != "", F.concat(
        F.lit('"'), excerpt(F.col("section_heading"), rules.CITATION_HEADING_CHARS), F.lit('"')))
    line = F.concat_ws(
        " · ", F.concat(F.lit("["), F.col("nth").cast("string"), F.lit("]")), "source_doc", _number(), _subsystem(),
        F.concat(F.lit("p."), _page()), heading, F.when(_is_figure(), F.lit("🖼 diagram")))
    file_line = F.when(_is_figure() & (F.col("image_file") != ""), F.concat(F.lit("\n      📎 "), "image_file"))
    return numbered.select("qid", "nth", F.concat(F.lit("  "), line, or_empty(file_line)).alias("citation"))


def panel_sources(results: DataFrame) -> DataFrame:
    """``(qid, rank, line)`` as the interactive surface lists them: a figure and a text of one section both show."""
    key = F.struct("source_doc", "fcp_number",
                   F.substring("section_heading", 1, rules.CITATION_KEY_CHARS).alias("heading"), "image_file")
    once = first_wins(results.withColumn("_key", key), ["qid", "_key"], ["rank"])
    heading = F.translate(strip(F.col("section_heading")), "\n", " ")
    line = F.concat_ws(" · ", F.concat(F.lit("**"), "source_doc", F.lit("**")), _number(), _subsystem(),
                       F.concat(F.lit("p."), _page()), F.when(_is_figure(), F.lit("🖼 diagram")))
    tail = F.when(heading != "", F.concat(F.lit(" - *"), F.substring(heading, 1, 70), F.lit("*")))
    return once.select("qid", "rank", F.concat(line, or_empty(tail)).alias("line"))


def figure_files(results: DataFrame) -> DataFrame:
    """``(qid, image_file, rank)``: each figure once, at its best rank."""
    return (results.where(_is_figure() & (F.col("image_file") != ""))
            .groupBy("qid", "image_file").agg(F.min("rank").alias("rank")))


def figure_answers(results: DataFrame) -> DataFrame:
    """``(qid, answer)`` from the best caption of each question that has one."""
    best = first_wins(results.where(_is_figure()), ["qid"], ["rank"])
    place = F.concat("source_doc", F.coalesce(F.concat(F.lit(", page "), _page()), F.lit("")))
    return best.select("qid", F.concat(
        F.lit("Here is the figure matching your request (from "), place, F.lit("):\n\n"), strip(F.col("document")),
        F.lit("\n\n_The diagram is shown below._")).alias("answer"))


def source_label() -> Column:
    """Short label of a result, as evaluation reports show it."""
    return F.concat_ws(" · ", known(F.col("source_doc")), _number(), F.concat(F.lit("p."), _page()),
                       known(F.col("content_type")))


DAY_HEAD = f"{'#':<4}  {'Time':<10}  {'CID':<14}  {'Mnemonic':<40}  {'Orbit':<7}  Status"
RANKED_HEAD = f"{'#':<4}  {'CID':<14}  {'Mnemonic':<40}  {'Date':<12}  {'Time':<10}  Status"


def _cells(*cells: tuple[str, int]) -> Column:
    padded = [pad(F.col(name).cast("string"), width) if width else F.col(name) for name, width in cells]
    return F.concat_ws("  ", *padded)


def day_lines(listing: DataFrame) -> DataFrame:
    """``(nth, line)`` of a numbered day listing."""
    return listing.select("nth", _cells(("nth", 4), ("time", 10), ("cid", 14), ("mnemonic", 40), ("orbit_no", 7),
                                        ("status", 0)).alias("line"))


def ranked_lines(results: DataFrame) -> DataFrame:
    """``(qid, rank, line)`` of ranked command records."""
    return results.select("qid", "rank", _cells(("rank", 4), ("cid", 14), ("mnemonic", 40), ("date", 12),
                                                ("time", 10), ("status", 0)).alias("line"))
