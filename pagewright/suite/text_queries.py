"""Classifiers, tokens, captions, stored columns and figure files."""

from pyspark.sql import functions as F

from pagewright import rules, schema
from pagewright.functions import classify, imaging
from pagewright.functions.text import clean_caption
from pagewright.operators import blocks, lexical
from pagewright.plans import captions, store
from pagewright.suite import checks as c
from pagewright.suite.inputs import derived, given, sql


def classify_subsystem(spark, folder):
    rows = derived(spark, folder, "notices")
    return rows.select("p_partkey", classify.subsystem_of(F.col("text"), F.col("number")).alias("subsystem"))


def content_type(spark, folder):
    text = F.col("text")
    return derived(spark, folder, "signalled").select(
        "doc_id", classify.content_type_of(text).alias("content_type"), classify.procedure_number(text).alias("number"))


def index_documents(spark, folder):
    """Printed indexes of forty rows as one text each."""
    rows = derived(spark, folder, "index_rows")
    line = F.concat_ws("", F.col("serial"), F.lit(".  "), F.col("number"), F.lit(" \n "), F.col("label"), F.lit("  "),
                       F.col("p_name"), F.lit(" .\n"))
    texts = F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line"))))
    return rows.groupBy("volume").agg(F.array_join(F.transform(texts, lambda x: x["line"]), "").alias("text")).select(
        F.concat(F.lit("V"), F.col("volume").cast("string")).alias("doc_key"), "text")


def toc_parse(spark, folder):
    """Every line of an index is a page, so most anchors run over a page's end."""
    lines = index_documents(spark, folder).select("doc_key", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    rows = blocks.index_entries(lines)
    return rows.select("chunk_id", "text", "fcp_number", "subsystem")


def clean_captions(spark, folder):
    return derived(spark, folder, "captions").select("doc_id", clean_caption(F.col("text")).alias("text"))


def cleaned(x):
    for p in rules.CAPTION_PREFIXES:
        x = f"regexp_replace({x}, {c.quoted('(?i)' + p)}, '')"
    return c.strip(x)


def tokenize(spark, folder):
    rows = lexical.tokenized(given(spark, folder, "documents"), ["doc_id"], F.col("text"))
    return rows.select("doc_id", F.array_join("tokens", " ").alias("tokens"), "dl")


def embed_texts(spark, folder):
    items = derived(spark, folder, "items")
    return items.select("chunk_id", store.embed_text(items).alias("embed_text"))


def metadata_rows(spark, folder):
    items = derived(spark, folder, "items").drop("cid")
    images = F.when(F.col("ord") % 4 == 1, F.array(F.struct(F.col("image_file").alias("file")))).otherwise(F.array())
    items = items.withColumn("images", images)
    return store.stored_rows(items, "chunk_id").select("id", "document", *schema.METADATA)


def image_gate(spark, folder):
    rows = derived(spark, folder, "figure_files")
    reason = imaging.skip_reason(imaging.extension(F.col("path")), F.col("length"), F.col("width"), F.col("height"))
    return rows.select("ord", reason.alias("skip"))


def image_names(spark, folder):
    rows = derived(spark, folder, "figure_files")
    return rows.select("ord", imaging.image_name_parts(F.col("path")).alias("n")).select("ord", "n.*")


def image_sizes(spark, folder):
    """Picture headers written from the line items, read back."""
    rows = derived(spark, folder, "figure_files")
    def word(col):
        return F.lpad(F.hex(col), 8, "0")
    header = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), word(F.col("width")), word(F.col("height")),
                              F.lit("0806000000")))
    return rows.select("ord", imaging.pixel_size(header).alias("s")).select("ord", "s.*")


def caption_prompts(spark, folder):
    """What a captioner is told about each figure: the chunk it belongs to and its page's opening."""
    figures = derived(spark, folder, "figures")
    chunks = derived(spark, folder, "paged_chunks")
    pages = given(spark, folder, "documents").select(
        F.concat(F.lit("U"), (F.col("doc_id") % 160).cast("string")).alias("doc_key"),
        F.floor(F.col("doc_id") / 160).cast("int").alias("page"), "text")
    told = captions.with_context(figures, chunks, pages)
    return told.select("event_id", captions.context_lines().alias("context"))


def caption_rows(spark, folder):
    """Caption chunks of figure files."""
    files = captions.named(derived(spark, folder, "figure_files").select("ord", "path"))
    told = files.select("*", F.lit("doc.pdf").alias("hit_doc_filename"), F.lit(None).cast("string").alias("hit_section_heading"),
                        F.lit("5201").alias("hit_fcp_number"), F.lit(None).cast("string").alias("hit_subsystem"),
                        F.concat(F.lit("caption "), F.col("ord").cast("string")).alias("caption"))
    return captions.caption_chunks(told).drop("images")


_STEM = r"regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]+$', '')"
_PAGED, _LOOSE = c.quoted(rules.PAGE_IMAGE_NAME), c.quoted(rules.LOOSE_IMAGE_NAME)
_NAME = f"""CASE WHEN regexp_matches(stem, {_PAGED}) THEN regexp_extract(stem, {_PAGED}, 1)
    WHEN regexp_matches(stem, {_LOOSE}) THEN regexp_extract(stem, {_LOOSE}, 1) ELSE stem END"""
_PAGE = f"CASE WHEN regexp_matches(stem, {_PAGED}) THEN regexp_extract(stem, {_PAGED}, 2)::INT END"
_IDX = f"""CASE WHEN regexp_matches(stem, {_PAGED}) THEN regexp_extract(stem, {_PAGED}, 3)::INT
    WHEN regexp_matches(stem, {_LOOSE}) THEN regexp_extract(stem, {_LOOSE}, 2)::INT ELSE 0 END"""
_FILES = f"(SELECT *, {_STEM} AS stem, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM {sql('figure_files')})"


def _line(label, value):
    return f"CASE WHEN coalesce({value}, '') <> '' THEN {c.quoted(label)} || {value} END"


PROMPT_SQL = f"""
WITH f AS {sql('figures')}, ch AS {sql('paged_chunks')},
pg AS (SELECT 'U' || (doc_id % 160)::VARCHAR AS doc_key, (doc_id // 160)::INT AS page, text FROM documents),
firsts AS (SELECT source_doc, page, min(ord) AS o, max(ord) AS lo FROM ch WHERE page <> 0 GROUP BY ALL),
ends AS (SELECT source_doc, arg_max(lo, page) AS last_o, arg_min(o, page) AS first_o FROM firsts GROUP BY ALL),
hit AS (SELECT f.event_id, f.doc_key, f.page,
        CASE WHEN f.page IS NULL THEN ends.first_o ELSE coalesce(
            (SELECT arg_min(x.o, x.page) FROM firsts x WHERE x.source_doc = f.doc_key AND x.page >= f.page), ends.last_o)
        END AS o
        FROM f LEFT JOIN ends ON ends.source_doc = f.doc_key),
full_rows AS (SELECT h.event_id, h.doc_key, ch.*, coalesce(substring({c.strip('pg.text')}, 1, 600)
        || CASE WHEN length({c.strip('pg.text')}) > 600 THEN '...' ELSE '' END, '') AS page_text
        FROM hit h LEFT JOIN ch ON ch.ord = h.o LEFT JOIN pg ON pg.doc_key = h.doc_key AND pg.page = h.page)
SELECT event_id, CASE WHEN context = '' THEN '(no context available)' ELSE context END AS context FROM (
SELECT event_id, concat_ws(chr(10), {_line('Document  : ', 'doc_filename')}, {_line('Doc key   : ', 'source_doc')},
    {_line('Page      : ', 'page::VARCHAR')}, {_line('Section   : ', 'section_heading')},
    {_line('FCP       : ', 'fcp_number')}, {_line('Subsystem : ', 'subsystem')},
    CASE WHEN page_text <> '' THEN chr(10) || 'Surrounding page text (excerpt):' || chr(10) || page_text END) AS context
FROM full_rows)"""

_ORDERED = "(SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM (SELECT doc_id, " \
           f"{c.tokens('text')} AS l FROM documents))"

QUERIES = {
    "classify_subsystem": (classify_subsystem, f"""SELECT p_partkey, {c.subsystem('text', 'number')} AS subsystem
        FROM {sql('notices')}"""),
    "content_type": (content_type, f"""SELECT doc_id, {c.content_type('text')} AS content_type,
        regexp_extract(text, {c.quoted(c.spelled(rules.PROCEDURE_NUMBER))}, 1) AS number FROM {sql('signalled')}"""),
    "toc_parse": (toc_parse, f"""SELECT chunk_id, 'FCP ' || number || ' — ' || subsystem || ' — ' || p_name AS text,
        number::VARCHAR AS fcp_number, subsystem FROM (
        SELECT *, 'V' || volume || '_IDX_' || lpad(serial::VARCHAR, 3, '0') || '_' || number AS chunk_id,
        CASE label WHEN 'NEW' THEN 'UNKNOWN' WHEN 'TTC&XBAND' THEN 'TTC_XBAND' WHEN 'PAYLAOD' THEN 'PAYLOAD' ELSE label END
        AS subsystem FROM {sql('index_rows')})
        QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY p_partkey) = 1"""),
    "clean_captions": (clean_captions, f"SELECT doc_id, {cleaned('text')} AS text FROM {sql('captions')}"),
    "tokenize": (tokenize, f"SELECT doc_id, array_to_string(l, ' ') AS tokens, len(l)::INT AS dl FROM {_ORDERED}"),
    "embed_texts": (embed_texts, f"""SELECT chunk_id, concat_ws(chr(10),
        CASE WHEN content_type = 'image_caption' THEN 'Image caption' END,
        CASE WHEN content_type = 'image_caption' AND source_doc <> '' THEN 'Source: ' || source_doc END,
        CASE WHEN content_type = 'image_caption' AND page <> 0 THEN 'Page: ' || page END,
        {_line('FCP ', 'fcp_number')}, CASE WHEN subsystem <> 'UNKNOWN' THEN {_line('Subsystem: ', 'subsystem')} END,
        {_line('Command: ', 'mnemonic')}, {_line('CID: ', 'cid')}, nullif(section_heading, ''),
        nullif({c.strip('text')}, '')) AS embed_text FROM {sql('items')}"""),
    "metadata_rows": (metadata_rows, f"""SELECT chunk_id AS id, substring(text, 1, 8000) AS document, source_doc, doc_filename,
        content_type, coalesce(page, 0) AS page, substring(section_heading, 1, 400) AS section_heading, fcp_number, subsystem,
        false AS is_sub_chunk, '' AS parent_chunk_id, 0 AS sub_index, '' AS date, '' AS time, '' AS cid,
        coalesce(mnemonic, '') AS mnemonic, '' AS orbit_no, '' AS status, '' AS source_station, '' AS dest_station,
        ord % 4 = 1 AS has_images, CASE WHEN ord % 4 = 1 THEN 1 ELSE 0 END AS image_count, image_file
        FROM {sql('items')}"""),
    "image_gate": (image_gate, f"""SELECT ord, CASE WHEN ext IN ('wmf', 'emf') THEN 'unsupported vector format (.' || ext || ')'
        WHEN ext NOT IN ('jpg', 'jpeg', 'png') THEN 'unsupported extension (' || CASE WHEN ext <> '' THEN '.' || ext ELSE '' END
        || ')' WHEN length < 5000 THEN 'too small (' || format('{{:,}}', length) || ' bytes < 5,000)'
        WHEN width < 60 OR height < 60 THEN 'too small (' || width || '×' || height || ' px)' END AS skip FROM {_FILES}"""),
    "image_names": (image_names, f"SELECT ord, {_NAME} AS doc_key, {_PAGE} AS page, {_IDX} AS idx FROM {_FILES}"),
    "image_sizes": (image_sizes, f"SELECT ord, width, height FROM {sql('figure_files')}"),
    "caption_prompts": (caption_prompts, PROMPT_SQL),
    "caption_rows": (caption_rows, f"""SELECT 'IMG_' || stem AS chunk_id, 'caption ' || ord AS text, {_NAME} AS source_doc,
        'doc.pdf' AS doc_filename, 'image_caption' AS content_type, {_PAGE} AS page, '' AS section_heading,
        '5201' AS fcp_number, 'UNKNOWN' AS subsystem, path AS image_file FROM {_FILES}"""),
}
