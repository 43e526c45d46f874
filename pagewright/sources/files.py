"""File sources. Logs are read in byte ranges; other files are one binary row each, unpacked inside one task."""

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright import rules, schema
from pagewright.functions.imaging import base_name, extension, image_name_parts, pixel_size, skip_reason
from pagewright.functions.text import split_lines
from pagewright.session import materialize

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DOCX_ROWS = "doc_key string, doc_filename string, ord bigint, style string, text string"
_IMAGE_ROWS = "doc_key string, doc_filename string, file string, page int, index_on_page int, content binary"


def binary_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
            .withColumn("doc_filename", base_name(F.col("path"))))


def registered(spark: SparkSession, folder: str, registry: dict[str, str]) -> DataFrame:
    """Files of the registry ``{doc_key: filename}`` that exist, with key, list position and kind."""
    listing = spark.createDataFrame(
        [(i, key, name) for i, (key, name) in enumerate(registry.items())],
        "doc_ord int, doc_key string, doc_filename string")
    files = binary_files(spark, folder).where(F.col("doc_filename").isin(list(registry.values())))
    return files.join(F.broadcast(listing), "doc_filename").withColumn("kind", extension(F.col("doc_filename")))


def log_pieces(spark: SparkSession, path: str, doc_key: str) -> DataFrame:
    """Log files to lines ``(doc_key, doc_filename, ord, line)``; every byte is one character.

    Spark deals byte ranges of a file to tasks, each of which reads on to the line feed that ends its last line, so a log of
    any size is read by many. What lies between two line feeds is cut at the other line ends inside the task. ``ord`` is the
    number of a line in its file: its place in its range, after the lines of the ranges before it, whose counts are a
    first pass that writes a row for each range. A byte order mark at the start of a file is not part of its first line; a file that ends in a line
    end other than a line feed has one empty line more.
    """
    text = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"),
        F.explode(split_lines(F.concat(text, F.lit("\n")))).alias("line")).withColumn("_row", F.monotonically_increasing_id())
    ranges = lines.groupBy("_file", "_from").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_file").orderBy("_from").rowsBetween(W.unboundedPreceding, -1))
    # written: its size is known to the join
    starts = materialize(ranges.select("_file", "_from", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift")), "log-ranges")
    name = F.url_decode(F.regexp_replace(base_name(F.col("_file")), r"\+", "%2B"))
    return lines.join(starts, ["_file", "_from"]).select(
        F.lit(doc_key).alias("doc_key"), name.alias("doc_filename"), (F.col("_row") + F.col("_shift")).alias("ord"), "line")


def read_log(spark: SparkSession, folder: str, doc_key: str, name: str) -> DataFrame:
    """The command records of one log file."""
    from pagewright.operators.command_log import parse_log
    plain = re.sub(r"([\\\[\]{}*?])", r"\\\1", name)      # a path is a pattern otherwise
    lines = log_pieces(spark, posixpath.join(folder, plain), doc_key)
    return parse_log(lines, F.col("line")).withColumn("source_doc", F.col("doc_key")).drop("line", "doc_key")


def _docx_parts(data: bytes):
    archive = zipfile.ZipFile(io.BytesIO(data))
    styles = {}
    if "word/styles.xml" in archive.namelist():
        for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(f"{_W}style"):
            name = style.find(f"{_W}name")
            styles[style.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else None
            if style.get(f"{_W}default") == "1" and style.get(f"{_W}type") == "paragraph":
                styles[None] = styles[style.get(f"{_W}styleId")]
    return archive, styles


def _style_name(name: str | None) -> str:
    """Built-in names are stored in lower case but known by their capitalised form."""
    return "Heading" + name[7:] if (name or "").startswith("heading") else (name or "")


def _docx_paragraphs(data: bytes):
    """(style name, text) of the body's own paragraphs; tables are not read."""
    archive, styles = _docx_parts(data)
    body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    for paragraph in body.findall(f"{_W}p"):
        style = paragraph.find(f"{_W}pPr/{_W}pStyle")
        text = []
        for run in paragraph.iterfind("./*"):
            for node in ([run] if run.tag == f"{_W}r" else run.findall(f"{_W}r") if run.tag == f"{_W}hyperlink" else []):
                for item in node:
                    if item.tag == f"{_W}t":
                        text.append(item.text or "")
                    elif item.tag == f"{_W}tab":
                        text.append("\t")
                    elif item.tag in (f"{_W}br", f"{_W}cr"):
                        text.append("\n")
        key = style.get(f"{_W}val") if style is not None else None
        yield _style_name(styles.get(key, styles.get(None))), "".join(text)


def _docx_images(data: bytes):
    """(extension, bytes) of the images the document part refers to, in relationship order."""
    archive, _ = _docx_parts(data)
    rels = "word/_rels/document.xml.rels"
    if rels not in archive.namelist():
        return
    for rel in ElementTree.fromstring(archive.read(rels)):
        target = rel.get("Target", "")
        if "image" in target and rel.get("TargetMode") != "External":
            path = posixpath.normpath(posixpath.join("word", target)) if not target.startswith("/") else target[1:]
            if path in archive.namelist():
                yield target.rsplit(".", 1)[-1].lower(), archive.read(path)


def read_docx(files: DataFrame) -> DataFrame:
    """Word files to paragraph rows."""
    def part(frames):
        for frame in frames:
            for row in frame.itertuples():
                rows = [(row.doc_key, row.doc_filename, i, style, text)
                        for i, (style, text) in enumerate(_docx_paragraphs(row.content))]
                yield pd.DataFrame(rows, columns=["doc_key", "doc_filename", "ord", "style", "text"])

    return files.select("doc_key", "doc_filename", "content").mapInPandas(part, _DOCX_ROWS)


def read_docx_images(files: DataFrame) -> DataFrame:
    """Word files to image rows named ``KEY_imgNNN.ext``."""
    def part(frames):
        for frame in frames:
            for row in frame.itertuples():
                rows = [(row.doc_key, row.doc_filename, f"{row.doc_key}_img{i:03d}.{ext}", None, i, data)
                        for i, (ext, data) in enumerate(_docx_images(row.content))]
                out = pd.DataFrame(rows, columns=["doc_key", "doc_filename", "file", "page", "index_on_page", "content"])
                yield out.astype({"page": "Int32"})

    return files.select("doc_key", "doc_filename", "content").mapInPandas(part, _IMAGE_ROWS)


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Figure files with name parts, pixel sizes and the reason to skip them, if any."""
    files = binary_files(spark, folder)
    ext = extension(F.col("doc_filename"))
    readable = F.when(ext.isin(rules.RASTER_IMAGE_TYPES) & (F.col("length") >= rules.IMAGE_MIN_BYTES), F.col("content"))
    sized = files.select(
        F.col("doc_filename").alias("fname"), "path", "length", "content", ext.alias("ext"),
        image_name_parts(F.col("doc_filename")).alias("_name"), pixel_size(readable).alias("_size"))
    return sized.select(
        "fname", "path", "length", "content", "ext", "_name.*", "_size.*").withColumn(
        "skip", skip_reason(F.col("ext"), F.col("length"), F.col("width"), F.col("height")))


def read_json_array(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A JSON array file with a fixed schema; list order becomes ``ord``."""
    columns = [c for c in spark.createDataFrame([], ddl).columns if c != "ord"]
    rows = spark.read.schema(ddl).json(path, multiLine=True).select(*columns)
    return rows.withColumn("ord", F.monotonically_increasing_id())


def stored_table(spark: SparkSession, path: str, ddl: str | None = None) -> DataFrame | None:
    """A Parquet table, or None where nothing was stored yet."""
    reader = spark.read.schema(ddl) if ddl else spark.read
    try:
        return reader.parquet(path)
    except AnalysisException as reason:
        if reason.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Captions of earlier runs; no rows before the first."""
    found = stored_table(spark, path, schema.CAPTION_STATE)
    return spark.createDataFrame([], schema.CAPTION_STATE) if found is None else found
