"""Paged documents as a Spark data source: ranges of pages are dealt to tasks, text and pictures come from one opening.

``spark.read.format(page_source(opener).name())`` with the option ``paths`` (a JSON list) gives a row a page: ``path``, ``page``
(from 1), ``text``, ``pictures`` and ``error``. ``opener(bytes)`` is what knows the format: it returns a sequence of pages, each with
``text()`` and ``pictures()``, the latter an iterator of (position, extension, bytes). A file is opened once to count its pages,
and once for each range of ``rangePages`` pages.

A page that cannot be read is a row with its number and the error; a file that cannot be opened is one row without a
number. What was read of a page before it failed is kept. With the option ``pictures`` set to ``false`` pictures are not taken out.

Files are read with pyarrow's file systems (local, S3, GCS, HDFS), on the driver for counting and in tasks.
"""

import json
import posixpath
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_PAGES = 64
ROWS = ("path string, page int, text string, pictures array<struct<index_on_page:int,extension:string,content:binary>>, "
        "error string")


def read_bytes(path: str) -> bytes:
    from pyarrow import fs
    if "://" in path or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path)
    else:
        system, inner = fs.LocalFileSystem(), path
    with system.open_input_stream(inner) as stream:
        return stream.read()


class _Pdf:
    """A PDF file as a sequence of pages, by the optional pymupdf package."""

    def __init__(self, data: bytes):
        try:
            import fitz
        except ImportError as missing:
            raise RuntimeError("reading PDF files needs the optional package pymupdf on every worker") from missing
        self.document = fitz.open(stream=data, filetype="pdf")

    def __len__(self) -> int:
        return len(self.document)

    def __getitem__(self, i: int):
        return _PdfPage(self.document, self.document[i])


@dataclass
class _PdfPage:
    document: object
    page: object

    def text(self) -> str:
        return self.page.get_text("text")

    def pictures(self) -> Iterator[tuple[int, str, bytes]]:
        for i, info in enumerate(self.page.get_images(full=True)):
            try:
                image = self.document.extract_image(info[0])
            except Exception:                     # a damaged picture is left out, the page stays
                continue
            yield i, image["ext"], image["image"]


def open_pdf(data: bytes) -> _Pdf:
    return _Pdf(data)


@dataclass
class PageRange(InputPartition):
    path: str
    first: int
    last: int           # after the range
    error: str | None = None

    def __init__(self, path: str, first: int, last: int, error: str | None = None):
        super().__init__((path, first, last))
        self.path, self.first, self.last, self.error = path, first, last, error


def _said(reason: Exception) -> str:
    return f"{type(reason).__name__}: {reason}"


class PageReader(DataSourceReader):
    def __init__(self, opener: Callable, options: dict):
        self.opener, self.paths = opener, json.loads(options["paths"])
        # option names arrive in lower case
        self.size = int(options.get("rangePages", options.get("rangepages", RANGE_PAGES)))
        self.with_pictures = options.get("pictures", "true").lower() == "true"

    def partitions(self) -> list[PageRange]:
        found = []
        for path in self.paths:
            try:
                pages = len(self.opener(read_bytes(path)))
            except Exception as reason:
                found.append(PageRange(path, 0, 0, _said(reason)))
                continue
            found += [PageRange(path, i, min(i + self.size, pages)) for i in range(0, pages, self.size)]
        return found or [PageRange("", 0, 0)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        if partition.error:
            yield partition.path, None, None, [], partition.error
        if partition.first == partition.last:
            return
        document = self.opener(read_bytes(partition.path))
        for i in range(partition.first, partition.last):
            text, pictures, error = None, [], None
            try:
                page = document[i]
                text = page.text()
                if self.with_pictures:
                    for picture in page.pictures():
                        pictures.append(picture)
            except Exception as reason:
                error = _said(reason)
            yield partition.path, i + 1, text, pictures, error


def page_source(opener: Callable) -> type[DataSource]:
    """The data source of the files that ``opener`` opens."""

    class PageSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"pages_{getattr(opener, '__name__', 'of')}".lower()

        def schema(self) -> str:
            return ROWS

        def reader(self, schema) -> PageReader:
            return PageReader(opener, dict(self.options))

    return PageSource


def read_pages(spark: SparkSession, folder: str, registry: dict[str, str], opener: Callable = open_pdf, range_pages: int = RANGE_PAGES,
               pictures: bool = True, images_dir: str = "images") -> DataFrame:
    """Files of the registry ``{doc_key: filename}``, all of which exist, to page rows ``(doc_key, doc_filename, page, text, error, images,
    pictures)``: ``images`` names the pictures as stored rows do, ``pictures`` holds name, position and bytes of each. Pages that could not be
    read are there, with their error and without text."""
    source = page_source(opener)
    spark.dataSource.register(source)
    paths = {posixpath.join(folder, name): (key, name) for key, name in registry.items()}
    rows = (spark.read.format(source.name()).option("paths", json.dumps(list(paths))).option("rangePages", str(range_pages))
            .option("pictures", str(pictures).lower()).load())
    listed = spark.createDataFrame([(path, *named) for path, named in paths.items()], "path string, doc_key string, doc_filename string")
    rows = rows.join(F.broadcast(listed), "path")           # a row a registered file
    named = F.transform("pictures", lambda p: F.struct(
        F.format_string("%s_p%d_img%d.%s", F.col("doc_key"), F.col("page"), p["index_on_page"], p["extension"]).alias("file"),
        p["index_on_page"].alias("index_on_page"), p["content"].alias("content")))
    rows = rows.withColumn("pictures", named)
    images = F.transform("pictures", lambda p: F.struct(
        F.concat(F.lit(f"{images_dir}/"), p["file"]).alias("file"), F.col("page").alias("page"), p["index_on_page"].alias("index_on_page"),
        F.lit("").alias("caption")))
    return rows.select("doc_key", "doc_filename", "page", "text", "error", images.alias("images"), "pictures")


def page_images(pages: DataFrame) -> DataFrame:
    """Page rows to image rows named ``KEY_pP_imgI.ext``."""
    rows = pages.select("doc_key", "doc_filename", "page", F.explode("pictures").alias("p"))
    return rows.select("doc_key", "doc_filename", "p.file", "page", "p.index_on_page", "p.content")
