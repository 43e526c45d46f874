"""Documents to chunks and command records."""

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import blocks
from pagewright.sources import files as src
from pagewright.session import materialize
from pagewright.sources.pages import open_pdf, read_pages


def list_position(doc_ord: Column, body: bool, block: Column, part: Column) -> Column:
    """One BIGINT that sorts like the list: document, index before body, block, part."""
    return (doc_ord.cast("bigint") * F.lit(1 << 52) + F.lit(int(body)).cast("bigint") * F.lit(1 << 51)
            + (block.cast("bigint") + 1) * F.lit(1 << 20) + part.cast("bigint"))


def _finished(chunks: DataFrame, registry: DataFrame, body: bool) -> DataFrame:
    listed = registry.select(F.col("doc_key").alias("source_doc"), "doc_filename", "doc_ord")
    return chunks.join(F.broadcast(listed), "source_doc").withColumn(
        "ord", list_position(F.col("doc_ord"), body, F.col("block"), F.col("part"))).drop("doc_ord", "block", "part")


def document_chunks(spark: SparkSession, folder: str, registry: dict[str, str],
                    converter: Callable[[str], str | None] | None = None,
                    pages: DataFrame | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """(chunks, commands) of the registered files that exist. Keys decide the treatment: FCP has an index in front of
    its procedure bodies, MOR has numbered headings, TCH is the command log; other files go by their kind. Old Word
    files go through the caller's ``converter`` (path to the path of a DOCX, None if it cannot); without one they are
    left out. ``pages``: page rows of the PDF files where they are read already, see :func:`pdf_pages`."""
    listed = src.binary_files(spark, folder).where(F.col("doc_filename").isin(list(registry.values())))
    present = {r["doc_filename"] for r in listed.select("doc_filename").collect()}
    found: list[DataFrame] = []
    commands = None
    for doc_ord, (key, name) in enumerate(registry.items()):
        if name not in present:
            continue
        place, kind = folder, name.rsplit(".", 1)[-1].lower()
        if kind == "doc":
            made = converter(os.path.join(folder, name)) if converter else None
            if made is None:
                continue
            place, name, kind = os.path.dirname(made), os.path.basename(made), "docx"
        rows = src.registered(spark, place, {key: name})
        listed = spark.createDataFrame([(key, name, doc_ord)], "doc_key string, doc_filename string, doc_ord int")
        if key == "TCH":
            commands = src.read_log(spark, place, key, name)
        elif kind == "docx":
            found.append(_finished(blocks.styled_sections(src.read_docx(rows)), listed, True))
        elif kind == "pdf":
            if pages is None:
                pages = materialize(pdf_pages(spark, folder, registry), "pages")
            own = pages.where(F.col("doc_key") == key).select("doc_key", "page", "text", "images")
            if key == "MOR":
                found.append(_finished(blocks.numbered_sections(own), listed, True))
                continue
            if key == "FCP":
                found.append(_finished(blocks.index_entries(blocks.index_pages(own)), listed, False))
            found.append(_finished(blocks.procedure_blocks(own, key == "FCP"), listed, True))
    chunks = None
    for part in found:
        chunks = part if chunks is None else chunks.unionByName(part)
    return chunks, commands


def pdf_pages(spark: SparkSession, folder: str, registry: dict[str, str], opener: Callable = open_pdf) -> DataFrame | None:
    """Page rows of the registered PDF files that exist, text and pictures from one opening; None where there is none."""
    named = {key: name for key, name in registry.items() if name.lower().endswith(".pdf")}
    listed = src.binary_files(spark, folder).where(F.col("doc_filename").isin(list(named.values())))
    present = {r["doc_filename"] for r in listed.select("doc_filename").collect()}
    named = {key: name for key, name in named.items() if name in present}
    return read_pages(spark, folder, named, opener) if named else None


def per_document(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_doc").agg(F.count("*").alias("chunks"))
