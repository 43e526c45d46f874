"""WARC archives and their capture history: external index merge.

Captures are written as WARC/1.1 records, one archive a task, each archive in order of URL key and time: a locally sorted
run. Of captures with equal payloads of at least ``LEAST_BYTES`` bytes, the one of the smallest id is the response and
the others are revisit records that refer to it and hold no body. The archives are then read back, record by record by
their lengths, into index entries. The runs are dealt to tasks by ranges of (URL key, time, id), and in each range a
loser tree merges them k ways, so that the ranges, one after the other, are the globally ordered history.

Null payloads are empty, null URLs give no target and the empty key. Rows that agree in id and payload are captures of
their own, all of the same type. Rows without an id are never the response that others refer to while one with an id
has the payload. A range holds about ``RANGE_ENTRIES`` index entries, whatever their key. An empty table writes nothing.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from pagewright.llm.common import written
from pagewright.session import shared_dir

LEAST_BYTES = 100
RANGE_ENTRIES = 20_000

END = "\r\n"
ID = "urn:capture:"

INDEX = ("url_key string, captured string, page_id bigint, run string, offset bigint, record_type string, "
         "payload_bytes bigint, payload_digest string, refers_to bigint")
_INDEX = pa.schema([("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("run", pa.string()),
                    ("offset", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def url_key(url: Column) -> Column:
    """Host labels in reverse, then the path: pages of a site stand together. Scheme and leading ``www.`` do not count."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(www\d*\.)?", "")
    host = F.regexp_extract(bare, r"^[^/?#]*", 0)
    path = F.substring(bare, F.length(host) + 1, F.length(bare))
    return F.when(bare == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path))


def _captures(df: DataFrame, page_id: str, url: str, payload: str, captured: Column) -> DataFrame:
    body = F.coalesce(F.col(payload), F.lit(""))
    return df.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), body.alias("body"),
        F.date_format(captured, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"))


def write(df: DataFrame, captured: Column, page_id: str = "page_id", url: str = "url", payload: str = "html") -> str:
    """Write one record a row; returns the folder of the archives (gzip)."""
    rows = _captures(df, page_id, url, payload, captured).withColumns(
        {"digest": F.sha2("body", 256), "bytes": F.octet_length("body").cast("bigint"), "url_key": url_key(F.col("url"))})
    long_ = rows.select("page_id", "digest", "bytes").where(F.col("bytes") >= LEAST_BYTES)
    first = long_.groupBy("digest").agg(F.min("page_id").alias("original"))
    revisits = long_.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("original")) & F.col("original").isNotNull())
    revisits = revisits.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "original").distinct()
    met = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")

    revisit = F.col("original").isNotNull()
    target = F.regexp_replace("url", r"[\x00-\x20\x7f]+", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes"),
                    F.lit(END + END))
    block = F.when(revisit, F.lit("")).otherwise(F.concat(http, F.col("body")))
    head = F.concat_ws(
        END, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit(f"WARC-Record-ID: <{ID}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.col("captured")),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), target)),
        F.concat(F.lit("WARC-URL-Key: "), F.regexp_replace("url_key", r"[\x00-\x20\x7f]+", "%20")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")), F.concat(F.lit("WARC-Payload-Length: "), F.col("bytes")),
        F.when(revisit, F.concat(F.lit(f"WARC-Refers-To: <{ID}"), F.col("original"), F.lit(">"))),
        F.when(revisit, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)))
    folder = os.path.join(shared_dir(df.sparkSession), f"warc-{os.urandom(8).hex()}")
    runs = met.sortWithinPartitions("url_key", "captured", "page_id")
    records = runs.select(F.concat(head, F.lit(END + END), block).alias("value"))
    records.write.option("lineSep", END + END).option("compression", "gzip").text(folder)
    return folder


def records(run: str, file) -> Iterator[tuple]:
    """Index entries of an archive that is open for reading, in its order."""
    offset = 0
    while line := file.readline():
        begin, fields = offset, {}
        offset += len(line)
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"no record at {begin} of {run}")
        while (line := file.readline()) not in (b"\r\n", b""):
            offset += len(line)
            name, _, value = line.partition(b":")
            fields[name.decode().lower()] = value.strip().decode()
        block = file.read(int(fields["content-length"]))
        offset += len(line) + len(block) + len(file.read(4))
        number = fields["warc-record-id"].removeprefix(f"<{ID}").removesuffix(">")
        kind, refers = fields["warc-type"], fields.get("warc-refers-to")
        if kind == "revisit":
            size, digest = int(fields["warc-payload-length"]), fields["warc-payload-digest"].removeprefix("sha256:")
        else:
            payload = block[block.index(b"\r\n\r\n") + 4:]
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        yield (fields.get("warc-url-key", ""), fields.get("warc-date", ""), int(number) if number else None, run, begin, kind,
               size, digest, int(refers.removeprefix(f"<{ID}").removesuffix(">")) if refers else None)


def index(spark, folder: str) -> DataFrame:
    """Index entries of the archives in ``folder``; a payload's length and digest are taken anew from what is stored."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                run = path.as_py().rsplit("/", 1)[-1]
                with gzip.open(io.BytesIO(content.as_buffer())) as file:
                    entries = list(records(run, file))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*entries, strict=True), _INDEX, strict=True)] if entries
                    else [pa.array([], f.type) for f in _INDEX], schema=_INDEX)

    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    except AnalysisException:                     # nothing was written
        return spark.createDataFrame([], INDEX)
    return files.mapInArrow(read, INDEX)


def loser_tree(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Merge sorted lists: each inner node keeps the loser of the match played there, so the next winner replays one path."""
    n = len(runs)
    if n == 0:
        return
    at = [0] * n

    def head(r: int) -> tuple:
        return (0, runs[r][at[r]], r) if at[r] < len(runs[r]) else (1, (), r)

    heads = [head(r) for r in range(n)]
    loser, winner = [0] * n, [0] * n + list(range(n))
    for node in range(n - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], loser[node] = (a, b) if heads[a] <= heads[b] else (b, a)
    best = winner[1] if n > 1 else 0
    while heads[best][0] == 0:
        yield heads[best][1]
        at[best] += 1
        heads[best] = head(best)
        node = (best + n) // 2
        while node:
            if heads[loser[node]] < heads[best]:
                best, loser[node] = loser[node], best
            node //= 2


def history(entries: DataFrame, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """Index entries in global order: ``part`` is the range, ``position`` the place in it. Ordered by URL key, time, id
    (none last), run and offset."""
    entries = written(entries, "index")
    parts = max(1, -(-entries.count() // range_entries))
    order = ["url_key", "captured", F.col("page_id").asc_nulls_last(), "run", "offset"]
    ranged = entries.repartitionByRange(parts, *order).sortWithinPartitions("run", *order[:3], "offset")
    names = _INDEX.names
    out = _INDEX.append(pa.field("part", pa.int32())).append(pa.field("position", pa.int64()))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = pa.Table.from_batches(list(batches), _INDEX)
        if not rows.num_rows:
            return
        columns = [rows.column(n).to_pylist() for n in ("url_key", "captured", "page_id", "run", "offset")]
        runs: dict[str, list[tuple]] = {}
        for place, (key, time, page, run, offset) in enumerate(zip(*columns, strict=True)):
            runs.setdefault(run, []).append((key, time, page is None, page or 0, run, offset, place))
        places = [entry[-1] for entry in loser_tree(list(runs.values()))]
        merged = rows.take(pa.array(places))
        part = TaskContext.get().partitionId()
        merged = merged.append_column(out.field("part"), pa.array([part] * len(places), pa.int32()))
        merged = merged.append_column(out.field("position"), pa.array(range(len(places)), pa.int64()))
        yield from merged.select([*names, "part", "position"]).combine_chunks().to_batches()

    return ranged.mapInArrow(merge, INDEX + ", part int, position bigint")


def capture_history(df: DataFrame, captured: Column, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write the rows as archives, read them back, and merge their indexes."""
    return history(index(df.sparkSession, write(df, captured, page_id, url, payload)))
