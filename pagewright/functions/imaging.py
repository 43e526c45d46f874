"""Figure files: names, the gate in front of captioning, and pixel sizes read from file headers."""

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright import rules
from pagewright.functions.text import java


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(?<=.)\.([^.]+)$", 1))


def image_name_parts(path: Column) -> Column:
    """struct(doc_key, page, idx) from ``KEY_p12_img0.png`` or ``KEY_img003.png``; other names are all key."""
    name = stem(path)
    paged, loose = java(rules.PAGE_IMAGE_NAME), java(rules.LOOSE_IMAGE_NAME)
    is_paged, is_loose = name.rlike(paged), name.rlike(loose)
    return F.struct(
        F.when(is_paged, F.regexp_extract(name, paged, 1)).when(is_loose, F.regexp_extract(name, loose, 1))
        .otherwise(name).alias("doc_key"),
        F.when(is_paged, F.regexp_extract(name, paged, 2).cast("int")).alias("page"),
        F.when(is_paged, F.regexp_extract(name, paged, 3).cast("int"))
        .when(is_loose, F.regexp_extract(name, loose, 2).cast("int")).otherwise(F.lit(0)).alias("idx"),
    )


def skip_reason(ext: Column, length: Column, width: Column, height: Column) -> Column:
    """Why a figure is not captioned, NULL when it is. Unknown pixel sizes count as unreadable."""
    small = rules.IMAGE_MIN_PIXELS
    dotted = F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(F.lit(""))
    return (
        F.when(ext.isin(rules.VECTOR_IMAGE_TYPES), F.format_string("unsupported vector format (%s)", dotted))
        .when(~ext.isin(rules.RASTER_IMAGE_TYPES), F.format_string("unsupported extension (%s)", dotted))
        .when(length < rules.IMAGE_MIN_BYTES, F.format_string("too small (%s bytes < %s)", F.format_number(length, 0),
                                                              F.lit(f"{rules.IMAGE_MIN_BYTES:,}")))
        .when(width.isNull() | height.isNull(), F.lit("could not open image"))
        .when((width < small) | (height < small), F.format_string("too small (%s×%s px)", width, height))
    )


def _size(data: bytes | None):
    """(width, height) from a PNG or JPEG header, else None."""
    if not data:
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5:at + 9])
            return width, height
        if marker == 0xFF or marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        at += 2 + struct.unpack(">H", data[at + 2:at + 4])[0]
    return None


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def pixel_size(content: pd.Series) -> pd.DataFrame:
    sizes = [_size(c) or (None, None) for c in content]
    return pd.DataFrame(sizes, columns=["width", "height"]).astype("Int32")
