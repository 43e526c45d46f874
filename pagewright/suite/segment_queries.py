"""Sections, blocks, packing, splitting and ordered lookups."""

from pyspark.sql import functions as F

from pagewright import rules
from pagewright.operators import blocks, lookup, ranges, splitting
from pagewright.plans import captions, store
from pagewright.models import HashingEmbedder
from pagewright.operators.ordered import first_wins
from pagewright.session import new_folder
from pagewright.suite import checks as c
from pagewright.suite.text_queries import cleaned
from pagewright.suite.inputs import derived, given, sql


def numbered_pages(spark, folder):
    """Documents whose lines are pages; every third page opens with a numbered heading."""
    lines = given(spark, folder, "documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("doc_key"),
                                                     F.posexplode(F.split("text", "\n")).alias("i", "line"))
    headed = F.concat((F.col("i") + 1).cast("string"), F.lit(" SECTION HEADING\n"), "line")
    return lines.select("doc_key", (F.col("i") + 1).alias("page"), F.when(F.col("i") % 3 == 0, headed).otherwise(F.col("line")).alias("text"))


def heading_sections(spark, folder):
    return blocks.numbered_spans(numbered_pages(spark, folder))


def heading_chunks(spark, folder):
    return blocks.numbered_sections(numbered_pages(spark, folder)).select("chunk_id", "text", "page", "subsystem")


_WHOLE = """SELECT 'D' || doc_id AS doc_key, chr(10) || array_to_string(list_transform(string_split(text, chr(10)),
    lambda l, i: CASE WHEN (i - 1) % 3 = 0 THEN i || ' SECTION HEADING' || chr(10) || l ELSE l END), chr(10)) AS whole,
    list_transform(string_split(text, chr(10)), lambda l, i: 1 + length(CASE WHEN (i - 1) % 3 = 0
    THEN i || ' SECTION HEADING' || chr(10) || l ELSE l END)) AS sizes FROM documents"""
_HEADING = c.quoted("(?m)" + rules.NUMBERED_HEADING)
SECTIONS = f"""
doc AS ({_WHOLE}),
cut AS (SELECT doc_key, sizes, regexp_extract_all(whole, {_HEADING}) AS heads, string_split_regex(whole, {_HEADING}) AS gaps
        FROM doc),
span AS (SELECT doc_key, sizes, unnest(range(len(heads))) AS nth, heads, gaps FROM cut),
located AS (SELECT doc_key, nth, {c.strip('heads[nth + 1]')} AS section_heading, heads[nth + 1] || gaps[nth + 2] AS body,
        list_sum(list_transform(heads[:nth], lambda h: length(h))) AS before_heads,
        list_sum(list_transform(gaps[:nth + 1], lambda g: length(g))) AS before_gaps, sizes FROM span),
section AS (SELECT doc_key, nth::INT AS nth, section_heading, {c.strip('body')} AS section,
        len(list_filter(range(len(sizes)), lambda i: coalesce(list_sum(sizes[:i]), 0)
            <= coalesce(before_heads, 0) + coalesce(before_gaps, 0)))::INT AS page
        FROM located WHERE contains(section_heading, ' ')
        AND length(regexp_replace(section_heading, '^[0-9.]+\\s+', '')) >= 5)"""

# paragraphs packed below 1000 characters, over rows part(id, text)
PACK = f"""
line AS (SELECT id, i, {c.strip('l')} AS p FROM (SELECT id, generate_subscripts(ls, 1) AS i, unnest(ls) AS l
         FROM (SELECT id, string_split(text, chr(10)) AS ls FROM part)) WHERE {c.strip('l')} <> ''),
para AS (SELECT id, p, row_number() OVER (PARTITION BY id ORDER BY i) AS n FROM line),
walk AS (SELECT id, n, p, 0 AS chunk, CASE WHEN length(p) < 1000 THEN length(p) + 1 ELSE length(p) END AS held
         FROM para WHERE n = 1
         UNION ALL
         SELECT para.id, para.n, para.p, CASE WHEN walk.held + length(para.p) < 1000 THEN chunk ELSE chunk + 1 END,
                CASE WHEN walk.held + length(para.p) < 1000 THEN held + 1 + length(para.p) ELSE length(para.p) END
         FROM walk JOIN para ON para.id = walk.id AND para.n = walk.n + 1),
packed AS (SELECT id, chunk::INT AS idx, string_agg(p, chr(10) ORDER BY n) AS text FROM walk GROUP BY id, chunk)"""

# overlapping windows over rows part(id, text)
_WINDOW = "substring(text, (pos + 201)::INT, 1300)"
_MARKS = [(". ", r"\. "), (".' || chr(10) || '", r"\.\n"), ("' || chr(10) || chr(10) || '", r"\n\n"),
          ("' || chr(10) || '", r"\n"), (" ", " ")]
_CUT = "CASE " + " ".join(
    f"WHEN contains({_WINDOW}, '{m}') THEN pos + 200 + length(regexp_extract({_WINDOW}, '(?s)^(.*){r}', 1)) + length('{m}')"
    for m, r in _MARKS) + " ELSE pos + 1500 END"
SPLIT = f"""
piece AS (SELECT id, text, 0::BIGINT AS pos, 0 AS k FROM part WHERE length(text) > 1500
          UNION ALL SELECT id, text, greatest(pos + 1, cut - 200), k + 1 FROM (SELECT *, {_CUT} AS cut FROM piece
          WHERE length(text) - pos > 1500)),
ended AS (SELECT id, k, {c.strip('substring(text, (pos + 1)::INT, (upto - pos)::INT)')} AS text FROM (SELECT *,
          CASE WHEN length(text) - pos > 1500 THEN {_CUT} ELSE length(text) END AS upto FROM piece)),
kept AS (SELECT id, text, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY id) AS parts
         FROM ended WHERE text <> ''),
expanded AS (SELECT id AS parent, CASE WHEN parts > 1 THEN id || '_sub' || i ELSE id END AS id, text, parts > 1 AS is_sub_chunk,
         CASE WHEN parts > 1 THEN id ELSE '' END AS parent_chunk_id, i::INT AS sub_index FROM kept
         UNION ALL SELECT id, id, text, false, '', 0 FROM part WHERE length(text) <= 1500)"""


def paragraph_pack(spark, folder):
    return given(spark, folder, "documents").select(
        "doc_id", F.posexplode(splitting.pack_paragraphs(F.col("text"))).alias("idx", "text"))


def split_documents(spark, folder):
    docs = given(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    return splitting.expand(docs, "chunk_id")


def split_captions(spark, folder):
    """Captions are cleaned before they are measured and split."""
    rows = derived(spark, folder, "captions").select(
        F.col("doc_id").cast("string").alias("chunk_id"), "text", F.lit("image_caption").alias("content_type"))
    return splitting.expand(rows, "chunk_id").select("chunk_id", "text", "sub_index")


def split_neighbours(spark, folder):
    docs = given(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    pieces = splitting.expand(docs, "chunk_id", links=True).where("is_sub_chunk")
    return pieces.select("parent_chunk_id", "sub_index", "chunk_id", "previous_id", "next_id")


def block_sessions(spark, folder):
    """Documents as manual pages, a figure on each: index pages first, then procedure blocks with their figures."""
    figure = F.struct(F.concat(F.lit("P"), F.col("page").cast("string"), F.lit(".png")).alias("file"), F.col("page").alias("page"),
                      F.lit(0).alias("index_on_page"), F.lit("").alias("caption"))
    rows = blocks.procedure_blocks(derived(spark, folder, "manual_pages").withColumn("images", F.array(figure)))
    figures = F.array_join(F.transform("images", lambda i: i["file"]), ",").alias("figures")
    return rows.select("chunk_id", "text", "source_doc", "content_type", "page", "section_heading", "fcp_number", "subsystem", figures)


_HEADER = c.quoted("(?i)" + rules.BLOCK_HEADER)
BLOCKS_SQL = f"""
WITH p AS (SELECT *, regexp_matches(text, {_HEADER}) AS header, contains(text, 'END OF PROCEDURE') AS is_end,
           {c.strip('text')} = '' AS blank FROM {sql('manual_pages')}),
b AS (SELECT * FROM p JOIN (SELECT doc_key, min(page) AS body FROM p WHERE {c.has('text', rules.BODY_PROBE)} GROUP BY 1)
      USING (doc_key) WHERE page >= body),
o AS (SELECT *, lag(is_end) OVER w AS prev_end,
      last_value(CASE WHEN NOT blank THEN is_end END IGNORE NULLS) OVER (PARTITION BY doc_key ORDER BY page
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS filled_end FROM b WINDOW w AS (PARTITION BY doc_key ORDER BY page)),
g AS (SELECT *, sum(CASE WHEN prev_end IS NULL OR prev_end OR (header AND filled_end = false) THEN 1 ELSE 0 END)
      OVER (PARTITION BY doc_key ORDER BY page) AS block,
      last_value(CASE WHEN header THEN {c.strip(f'regexp_extract(text, {_HEADER}, 0)')} END IGNORE NULLS)
          OVER (PARTITION BY doc_key ORDER BY page) AS heading,
      last_value(CASE WHEN header THEN regexp_extract(text, {_HEADER}, 2) END IGNORE NULLS)
          OVER (PARTITION BY doc_key ORDER BY page) AS number FROM o),
t AS (SELECT doc_key, block, {c.strip("string_agg(text, chr(10) ORDER BY page)")} AS text,
      coalesce(min(CASE WHEN header THEN page END), min(page)) AS page, arg_max(heading, page) AS section_heading,
      arg_max(number, page) AS number, string_agg('P' || page || '.png', ',' ORDER BY page) AS figures FROM g GROUP BY doc_key, block),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY block) - 1 AS nth FROM t WHERE text <> '')
SELECT doc_key || '_p' || page || '_' || nth AS chunk_id, text, doc_key AS source_doc, {c.content_type('text')} AS content_type,
       page, coalesce(section_heading, '') AS section_heading,
       coalesce(nullif(number, ''), regexp_extract(text, {c.quoted(c.spelled(rules.PROCEDURE_NUMBER))}, 1)) AS fcp_number,
       {c.subsystem("(coalesce(section_heading, '') || ' ' || text)",
                    f"coalesce(nullif(number, ''), regexp_extract(text, {c.quoted(c.spelled(rules.PROCEDURE_NUMBER))}, 1))")} AS subsystem, figures
FROM n"""


def style_sections(spark, folder):
    """Conversations as styled paragraphs."""
    rows = blocks.styled_sections(derived(spark, folder, "paragraphs"))
    return rows.select("chunk_id", "text", "section_heading", "fcp_number", "subsystem")


STYLE_SQL = f"""
WITH p AS (SELECT *, {c.strip('text')} AS line, style LIKE 'Heading%' AS is_heading FROM {sql('paragraphs')}),
g AS (SELECT *, count(*) FILTER (is_heading) OVER (PARTITION BY doc_key ORDER BY ord) AS section,
      coalesce(last_value(CASE WHEN is_heading THEN line END IGNORE NULLS) OVER (PARTITION BY doc_key ORDER BY ord), 'Preamble')
      AS section_heading FROM p),
t AS (SELECT doc_key, section, any_value(section_heading) AS section_heading, string_agg(line, chr(10) ORDER BY ord) AS text
      FROM g WHERE NOT is_heading AND line <> '' GROUP BY doc_key, section),
n AS (SELECT *, section_heading || ' ' || text AS full_text, row_number() OVER (PARTITION BY doc_key ORDER BY section) - 1 AS nth
      FROM t)
SELECT doc_key || '_' || lpad(nth::VARCHAR, 4, '0') AS chunk_id, text, section_heading,
       regexp_extract(full_text, {c.quoted(c.spelled(rules.PROCEDURE_NUMBER))}, 1) AS fcp_number,
       {c.subsystem('full_text', f"regexp_extract(full_text, {c.quoted(c.spelled(rules.PROCEDURE_NUMBER))}, 1)")} AS subsystem FROM n"""


def page_coverage(spark, folder):
    return blocks.page_coverage(derived(spark, folder, "manual_pages"))


def nearest_forward(spark, folder):
    """Events as figures, orders as chunks: the first chunk on the figure's page or later, else the last one."""
    found = lookup.figure_context(derived(spark, folder, "figures"), derived(spark, folder, "paged_chunks"))
    return found.select("event_id", F.col("hit_chunk_id").alias("chunk_id"))


NEAREST_SQL = f"""
WITH f AS {sql('figures')}, firsts AS (SELECT source_doc, page, min(ord) AS o, max(ord) AS lo FROM {sql('paged_chunks')}
     WHERE page <> 0 GROUP BY ALL),
ends AS (SELECT source_doc, arg_max(lo, page) AS last_o, arg_min(o, page) AS first_o FROM firsts GROUP BY ALL),
hit AS (SELECT f.event_id, f.page, f.doc_key, x.o FROM f ASOF LEFT JOIN firsts x ON f.doc_key = x.source_doc AND f.page <= x.page)
SELECT event_id, 'O' || CASE WHEN page IS NULL THEN first_o ELSE coalesce(o, last_o) END AS chunk_id
FROM hit LEFT JOIN ends ON ends.source_doc = hit.doc_key"""


def rule_ranges(spark, folder):
    """Orders as overlapping ranges of numbers, line items as numbers: the first order whose range holds each."""
    rules = given(spark, folder, "orders").select(
        (F.col("o_orderkey") * 37 % 50_000).alias("lo"), (F.col("o_orderkey") * 37 % 50_000 + F.col("o_custkey") * 11 % 900).alias("hi"),
        F.col("o_orderkey").alias("ord"), "o_orderkey", "o_orderpriority")
    numbers = given(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 31 % 60_000).alias("number"))
    return ranges.first_match(numbers, "number", rules, ["o_orderkey", "o_orderpriority"])


def page_of_offset(spark, folder):
    """Line items as offsets into orders laid out per customer: the last order at or before each offset."""
    starts = given(spark, folder, "orders").select(
        (F.col("o_custkey") % 100).alias("doc"), (F.col("o_orderkey") * 13 % 90_000).alias("at"),
        F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("page"))
    wanted = given(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_suppkey") % 100).alias("doc"), (F.col("l_partkey") * 31 % 91_000).alias("at"))
    found = lookup.asof(wanted, starts, ["doc"], "at", "ord", ["page"], direction="backward")
    return found.select("l_orderkey", "l_linenumber", "at", F.col("hit_page").alias("page"))


def caption_writeback(spark, folder):
    """Orders as chunks whose nested figures are their line items; captions come from the parts."""
    items = given(spark, folder, "lineitem").select(
        "l_orderkey", F.struct(
            F.concat(F.lit("images/P"), F.col("l_partkey").cast("string"), F.lit(".png")).alias("file"),
            F.col("l_linenumber").alias("page"), F.col("l_linenumber").alias("index_on_page"), F.lit("").alias("caption"))
        .alias("image"))
    chunks = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("image")).alias("images")).select(
        F.col("l_orderkey").cast("string").alias("chunk_id"), F.col("l_orderkey").alias("ord"), "images")
    state = given(spark, folder, "part").where("p_size > 15").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("fname"), F.col("p_name").alias("caption"))
    told = captions.write_back(chunks, state)
    return told.select("chunk_id", F.array_join(F.transform(
        "images", lambda i: F.concat(i["file"], F.lit("="), i["caption"])), ";").alias("figures"))


def dedup_first(spark, folder):
    docs = given(spark, folder, "documents").withColumn("text_key", F.md5("text"))
    return first_wins(docs, ["text_key"], ["doc_id"]).select("text_key", "doc_id", "source")


def _stored(spark, folder):
    """Labels loaded as knowledge, benchmark passages as commands."""
    held = store.Store(spark, new_folder(spark, "store"))
    for collection, name, key in ((store.KNOWLEDGE, "labels", "doc_id"), (store.COMMANDS, "benchmark", "item_id")):
        rows = given(spark, folder, name)
        text = F.col("text") if "text" in rows.columns else F.col(key).cast("string")
        rows = rows.select(F.col(key).cast("string").alias("chunk_id"), F.col(key).alias("ord"), text.alias("text"))
        held.load(collection, store.prepared(rows, "chunk_id"), HashingEmbedder(8))
    return held


def incremental_pending(spark, folder):
    """Documents that a store of the labelled ones does not hold."""
    docs = given(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("id"), "source")
    return _stored(spark, folder).pending(store.KNOWLEDGE, docs)


def store_counts(spark, folder):
    return spark.createDataFrame(list(_stored(spark, folder).counts().items()), "collection string, n bigint")


def captioned_total(spark, folder):
    """Documents as caption state; every third one failed to say anything."""
    told = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("text"))
    state = given(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("fname"), told.alias("caption"))
    return captions.captioned_total(state)


def caption_resume(spark, folder):
    """Figures already captioned, due and skipped, counted; labels are the stored state."""
    figures = given(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("fname"), F.when(F.col("n_chars") < 1000, F.lit("too small")).alias("skip"))
    state = given(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("fname"),
                                                  F.lit("known").alias("caption"))
    done, due = captions.done_and_due(figures, state)
    results = due.where("skip is null").select("fname", F.when(F.col("fname").endswith("7"), "timeout").alias("error"))
    return captions.run_counts(done, due, results)


def union_sources(spark, folder):
    """Documents and benchmark passages as one list, first of each text kept, in list order."""
    docs = given(spark, folder, "documents").select(F.md5("text").alias("chunk_id"), "text", F.col("doc_id").alias("ord"), "lang")
    passages = given(spark, folder, "benchmark").select(F.md5("text").alias("chunk_id"), "text", F.col("item_id").alias("ord"))
    return store.deduplicated(store.stacked(docs, passages), "chunk_id").select("chunk_id", "list_no", "ord", "lang")


def size_profile(spark, folder):
    return store.size_profile(given(spark, folder, "documents"))


def size_breakdown(spark, folder):
    return store.breakdown(given(spark, folder, "documents").select(
        F.col("source").alias("source_doc"), F.col("lang").alias("content_type")))


QUERIES = {
    "heading_sections": (heading_sections, f"WITH {SECTIONS} SELECT doc_key, nth, section_heading, page, section FROM section"),
    "heading_chunks": (heading_chunks, f"""WITH RECURSIVE {SECTIONS}, part AS (SELECT doc_key || '_s' || nth AS id, section AS text
        FROM section), {PACK} SELECT packed.id || '_c' || idx AS chunk_id, packed.text, page,
        coalesce({c.keyword_case('packed.text', rules.SUBSYSTEM_KEYWORDS)}, 'UNKNOWN') AS subsystem
        FROM packed JOIN section ON packed.id = doc_key || '_s' || nth"""),
    "paragraph_pack": (paragraph_pack, f"""WITH RECURSIVE part AS (SELECT doc_id AS id, text FROM documents), {PACK}
        SELECT id AS doc_id, idx, text FROM packed"""),
    "split_documents": (split_documents, f"""WITH RECURSIVE part AS (SELECT doc_id::VARCHAR AS id, text FROM documents), {SPLIT}
        SELECT id AS chunk_id, text, is_sub_chunk, parent_chunk_id, sub_index FROM expanded"""),
    "split_captions": (split_captions, f"""WITH RECURSIVE part AS (SELECT doc_id::VARCHAR AS id, {cleaned('text')} AS text
        FROM {sql('captions')}), {SPLIT} SELECT id AS chunk_id, text, sub_index FROM expanded"""),
    "split_neighbours": (split_neighbours, f"""WITH RECURSIVE part AS (SELECT doc_id::VARCHAR AS id, text FROM documents), {SPLIT}
        SELECT parent_chunk_id, sub_index, id AS chunk_id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id
        FROM expanded WHERE is_sub_chunk WINDOW w AS (PARTITION BY parent_chunk_id ORDER BY sub_index)"""),
    "block_sessions": (block_sessions, BLOCKS_SQL),
    "style_sections": (style_sections, STYLE_SQL),
    "page_coverage": (page_coverage, f"""SELECT doc_key, pages, text_pages, pages - text_pages AS image_only,
        pages - text_pages > pages * 0.3 AS needs_ocr FROM (SELECT doc_key, count(*) AS pages,
        count(*) FILTER (length({c.strip('text')}) > 50) AS text_pages FROM {sql('manual_pages')} GROUP BY doc_key)"""),
    "nearest_forward": (nearest_forward, NEAREST_SQL),
    "rule_ranges": (rule_ranges, """WITH r AS (SELECT o_orderkey * 37 % 50000 AS lo, o_orderkey * 37 % 50000 + o_custkey * 11 % 900 AS hi,
        o_orderkey, o_orderpriority FROM orders), n AS (SELECT l_orderkey, l_linenumber, l_partkey * 31 % 60000 AS number FROM lineitem),
        w AS (SELECT number, min(o_orderkey) AS o_orderkey FROM (SELECT DISTINCT number FROM n) JOIN r ON number BETWEEN lo AND hi GROUP BY number)
        SELECT n.*, w.o_orderkey, o.o_orderpriority FROM n LEFT JOIN w USING (number) LEFT JOIN orders o ON o.o_orderkey = w.o_orderkey"""),
    "page_of_offset": (page_of_offset, """WITH starts AS (SELECT o_custkey % 100 AS doc, o_orderkey * 13 % 90000 AS at,
        min(o_orderkey) AS page FROM orders GROUP BY ALL), wanted AS (SELECT l_orderkey, l_linenumber, l_suppkey % 100 AS doc,
        l_partkey * 31 % 91000 AS at FROM lineitem)
        SELECT l_orderkey, l_linenumber, w.at, s.page FROM wanted w ASOF LEFT JOIN starts s ON w.doc = s.doc AND w.at >= s.at"""),
    "caption_writeback": (caption_writeback, """SELECT l_orderkey::VARCHAR AS chunk_id, string_agg('images/P' || l_partkey || '.png='
        || CASE WHEN p_size > 15 THEN p_name ELSE '' END, ';'
        ORDER BY 'images/P' || l_partkey || '.png', l_linenumber) AS figures
        FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey"""),
    "dedup_first": (dedup_first, """SELECT md5(text) AS text_key, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source
        FROM documents GROUP BY text"""),
    "incremental_pending": (incremental_pending, """SELECT doc_id::VARCHAR AS id, source FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""),
    "store_counts": (store_counts, """SELECT 'knowledge' AS collection, count(DISTINCT doc_id) AS n FROM labels
        UNION ALL SELECT 'commands', count(DISTINCT item_id) FROM benchmark"""),
    "captioned_total": (captioned_total, "SELECT count(*) FILTER (doc_id % 3 = 1 AND text <> '') AS captioned FROM documents"),
    "caption_resume": (caption_resume, """SELECT CASE WHEN l.doc_id IS NOT NULL THEN 'done' WHEN n_chars < 1000 THEN 'skipped'
        WHEN d.doc_id % 10 = 7 THEN 'error' ELSE 'captioned' END AS status, count(*) AS n
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1"""),
    "union_sources": (union_sources, """SELECT md5(text) AS chunk_id, list_no, ord, lang FROM (
        SELECT text, 0 AS list_no, doc_id AS ord, lang FROM documents UNION ALL BY NAME
        SELECT text, 1 AS list_no, item_id AS ord FROM benchmark)
        QUALIFY row_number() OVER (PARTITION BY text ORDER BY list_no, ord) = 1"""),
    "size_profile": (size_profile, """SELECT count(*) AS total, avg(length(text)) AS avg_chars, max(length(text))::INT AS max_chars,
        count(*) FILTER (length(text) > 1500) AS oversized FROM documents"""),
    "size_breakdown": (size_breakdown, """SELECT 'source' AS kind, source AS name, count(*) AS n FROM documents GROUP BY source
        UNION ALL SELECT 'type', lang, count(*) FROM documents GROUP BY lang"""),
}
