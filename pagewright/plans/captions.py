"""Figures to captions: which are due, what the captioner is told, and where captions go."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright import rules
from pagewright.functions.imaging import base_name, image_name_parts, stem
from pagewright.functions.text import excerpt, known, or_empty, strip
from pagewright.models import CAPTION_REQUEST, Captioner
from pagewright.operators.blocks import no_images
from pagewright.operators.lookup import figure_context


def done_and_due(figures: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Figures with a stored caption, and figures without one."""
    return figures.join(state, "fname", "inner"), figures.join(state, "fname", "left_anti")


def with_context(figures: DataFrame, chunks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Figures with the chunk that describes them (``hit_*`` columns) and an excerpt of their page."""
    found = figure_context(figures, chunks)
    if pages is None:
        return found.withColumn("page_text", F.lit(""))
    text = excerpt(strip(F.col("text")), rules.PAGE_EXCERPT_CHARS)
    extracts = pages.select("doc_key", "page", text.alias("page_text"))
    return found.join(extracts, ["doc_key", "page"], "left").withColumn("page_text", or_empty(F.col("page_text")))


def context_lines() -> Column:
    """The labelled context lines of a figure with ``hit_*`` and ``page_text`` columns."""
    def line(label: str, value: Column) -> Column:
        return F.when(known(value.cast("string")).isNotNull(), F.concat(F.lit(label), value.cast("string")))

    text = F.concat_ws(
        "\n",
        line("Document  : ", F.col("hit_doc_filename")),
        line("Doc key   : ", F.when(F.col("hit_chunk_id").isNotNull(), F.col("doc_key"))),
        line("Page      : ", F.col("hit_chunk_page")),
        line("Section   : ", F.col("hit_section_heading")),
        line("FCP       : ", F.col("hit_fcp_number")),
        line("Subsystem : ", F.col("hit_subsystem")),
        line("\nSurrounding page text (excerpt):\n", F.col("page_text")))
    return F.when(text == "", F.lit("(no context available)")).otherwise(text)


def prompts(figures: DataFrame) -> DataFrame:
    return figures.withColumn("prompt", F.concat(
        F.lit("Context from source document:\n"), context_lines(), F.lit("\n\n" + CAPTION_REQUEST)))


def caption_figures(due: DataFrame, captioner: Captioner, limit: int | None = None) -> DataFrame:
    """``(fname, caption, error)``. A failed figure keeps its error and stays due. ``limit`` takes the first by name; only
    the names are ordered, so the figures stay spread over the tasks."""
    work = due.where(F.col("skip").isNull())
    if limit:
        work = work.join(work.select("fname").orderBy("fname").limit(limit), "fname", "left_semi")

    def part(frames):
        for frame in frames:
            rows = []
            for row in frame.itertuples():
                try:
                    rows.append((row.fname, captioner(row.content, row.prompt), None))
                except Exception as reason:
                    rows.append((row.fname, None, f"{type(reason).__name__}: {reason}"))
            yield pd.DataFrame(rows, columns=["fname", "caption", "error"])

    return work.select("fname", "content", "prompt").mapInPandas(
        part, "fname string, caption string, error string")


def caption_chunks(captioned: DataFrame, *more: str) -> DataFrame:
    """Captioned figures (``path``, ``caption``, name parts, ``hit_*``) to chunks beside the text chunks, with the
    columns named in ``more`` as they are."""
    return captioned.select(
        F.concat(F.lit("IMG_"), stem(F.col("path"))).alias("chunk_id"), F.col("caption").alias("text"),
        F.col("doc_key").alias("source_doc"), or_empty(F.col("hit_doc_filename")).alias("doc_filename"),
        F.lit("image_caption").alias("content_type"), "page",
        or_empty(F.col("hit_section_heading")).alias("section_heading"),
        or_empty(F.col("hit_fcp_number")).alias("fcp_number"),
        F.coalesce("hit_subsystem", F.lit("UNKNOWN")).alias("subsystem"),
        F.col("path").alias("image_file"), no_images().alias("images"), *more)


def write_back(chunks: DataFrame, state: DataFrame) -> DataFrame:
    """Chunks whose nested figures carry the stored captions. Figures are matched by file name in a join; a chunk with
    many figures is put together again from its own rows."""
    figures = chunks.where(F.size("images") > 0).select(
        "chunk_id", "ord", F.posexplode("images").alias("at", "image")).withColumn(
        "fname", base_name(F.col("image")["file"]))
    told = figures.join(state.select("fname", F.col("caption").alias("_new")), "fname", "left")
    image = F.struct(F.col("image")["file"].alias("file"), F.col("image")["page"].alias("page"),
                     F.col("image")["index_on_page"].alias("index_on_page"),
                     F.coalesce("_new", F.col("image")["caption"]).alias("caption"))
    nested = told.groupBy("chunk_id", "ord").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", image.alias("image")))), lambda x: x["image"])
        .alias("_images"))
    return (chunks.join(nested, ["chunk_id", "ord"], "left")
            .withColumn("images", F.coalesce("_images", "images")).drop("_images"))


def run_counts(done: DataFrame, due: DataFrame, results: DataFrame) -> DataFrame:
    """One row per outcome: done before, skipped, captioned now, failed."""
    outcome = (done.select(F.lit("done").alias("status"))
               .unionByName(due.where(F.col("skip").isNotNull()).select(F.lit("skipped").alias("status")))
               .unionByName(results.select(F.when(F.col("error").isNull(), F.lit("captioned"))
                                           .otherwise(F.lit("error")).alias("status"))))
    return outcome.groupBy("status").agg(F.count("*").alias("n"))


def captioned_total(state: DataFrame) -> DataFrame:
    """One row: figures with a caption that says something, over all runs."""
    return state.agg(F.count_if(F.coalesce("caption", F.lit("")) != "").alias("captioned"))


def named(figures: DataFrame) -> DataFrame:
    """Figure paths with the document, page and index their names tell."""
    return figures.select("*", image_name_parts(F.col("path")).alias("_n")).select("*", "_n.*").drop("_n")
