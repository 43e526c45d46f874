"""Inputs the registered queries work on, derived from the given tables.

The tables hold general text and events; each input below recasts one of them as the material an operator expects
(log lines, manual pages, figure files, questions). The text is SQL that both engines read, so a query and its check
start from the same rows; the operators under test appear in neither.
"""

from pyspark.sql import DataFrame, SparkSession

from pagewright.sources.tables import table

TABLES = ("documents", "conversations", "orders", "part", "events", "lineitem")

INPUTS = {
    # events as parsed command records
    "commands": """
        SELECT event_id AS ord, CAST(CAST(ts AS DATE) AS STRING) AS date,
               substring(CAST(ts AS STRING), 12, 8) AS time,
               CASE event_type WHEN 'view' THEN 'OBCS' WHEN 'click' THEN 'TTCS' WHEN 'purchase' THEN 'PLDA'
                    WHEN 'signup' THEN 'DTGS' ELSE 'ZZZZ' END || CAST(user_id + 100 AS STRING) AS cid,
               upper(event_type) || ' COMMAND ' || CAST(user_id % 10 AS STRING) AS mnemonic,
               lpad(CAST(user_id AS STRING), 5, '0') AS orbit_no,
               CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'EXEC' END AS status,
               'STN' || CAST(user_id % 4 AS STRING) AS source_station, 'SC01' AS dest_station,
               CASE event_type WHEN 'view' THEN 'OBC' WHEN 'click' THEN 'TTC_XBAND' WHEN 'purchase' THEN 'PAYLOAD'
                    WHEN 'signup' THEN 'DTG' ELSE 'UNKNOWN' END AS subsystem
        FROM {events}""",
    # events as the raw fields of log rows
    "log_fields": """
        SELECT event_id,
               lpad(CAST(event_id % 10000 AS STRING), CASE WHEN event_id % 7 = 3 THEN 5 ELSE 4 END, '0') AS sl_no,
               CASE WHEN user_id % 5 = 0 THEN '----' ELSE 'C-' || CAST(user_id AS STRING) END AS code,
               CASE WHEN user_id % 11 = 0 THEN '----' ELSE
                    CASE event_type WHEN 'view' THEN 'OBCS' WHEN 'click' THEN 'TTCS' WHEN 'purchase' THEN 'PLDA'
                    WHEN 'signup' THEN 'DTGS' ELSE 'ZZZZ' END || CAST(user_id + 100 AS STRING) END AS cid,
               upper(event_type) || ' COMMAND ' || CAST(user_id AS STRING) AS mnemonic,
               replace(substring(CAST(ts AS STRING), 1, 10), '-', ' ') || ' ' || substring(CAST(ts AS STRING), 12, 8)
                    || ':' || lpad(CAST(event_id % 1000 AS STRING), 3, '0') AS command_time,
               CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN props || chr(7) || chr(233) ELSE '' END AS command_data,
               CAST(CAST(floor(value) AS BIGINT) AS STRING) AS data_cmd_value,
               lpad(CAST(user_id AS STRING), 5, '0') AS orbit_no,
               CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'EXEC' END AS status,
               'STN' || CAST(user_id % 4 AS STRING) AS source_station, 'SC01' AS dest_station
        FROM {events}""",
    # orders as questions
    "questions": """
        SELECT CAST(o_orderkey AS STRING) AS qid, CASE o_orderkey % 16
            WHEN 0 THEN 'What commands were uplinked on ' || CAST(CAST(o_orderdate AS DATE) AS STRING) || '?'
            WHEN 1 THEN 'Commands of ' || replace(CAST(CAST(o_orderdate + INTERVAL '9000' DAY AS DATE) AS STRING), '-', '/')
            WHEN 2 THEN 'list ' || replace(CAST(CAST(o_orderdate + INTERVAL '9000' DAY AS DATE) AS STRING), '-', ' ')
            WHEN 3 THEN 'status of OBCS' || CAST(1000 + o_custkey % 9000 AS STRING)
            WHEN 4 THEN 'orbit ' || CAST(o_custkey AS STRING) || ' commands'
            WHEN 5 THEN 'show the Telecommand  log of customer ' || CAST(o_custkey AS STRING)
            WHEN 6 THEN 'which FCP-' || CAST(5200 + o_custkey % 900 AS STRING) || ' switches the payload motor'
            WHEN 7 THEN 'block diagram of the star sensor ' || CAST(o_custkey AS STRING)
            WHEN 8 THEN 'How  to reset the gyro of order ' || CAST(o_orderkey AS STRING)
            WHEN 9 THEN 'Provide the flow-chart of battery ' || o_orderpriority
            WHEN 10 THEN 'TCH entries ' || o_orderstatus
            WHEN 11 THEN 'powering the X-band receiver ' || o_orderpriority
            WHEN 12 THEN 'plain command of ' || CAST(o_orderdate AS STRING)
            WHEN 13 THEN 'latch valve ' || CAST(o_totalprice AS STRING)
            WHEN 14 THEN 'steps for SSR and wde ' || o_orderpriority
            ELSE 'what happened in order ' || CAST(o_orderkey AS STRING) END AS question
        FROM {orders}""",
    # parts as short headed texts with a procedure number
    "notices": """
        SELECT p_partkey, CAST(5000 + p_partkey % 1300 AS STRING) AS number,
               p_name || ' ' || CASE p_partkey % 23 WHEN 0 THEN 'obc' WHEN 1 THEN 'AOCS and OBC' WHEN 2 THEN 'Gyro'
                    WHEN 3 THEN 'star sensor' WHEN 4 THEN 'WDE' WHEN 5 THEN 'HGA' WHEN 6 THEN 'latch valve'
                    WHEN 7 THEN 'dc-dc' WHEN 8 THEN 'X-band' WHEN 9 THEN 'SUIT' WHEN 10 THEN 'ssr'
                    WHEN 11 THEN 'xOBCx' WHEN 12 THEN 'velc cover' ELSE '' END || ' ' || p_brand AS text
        FROM {part}""",
    # documents with signals of the content types
    "signalled": """
        SELECT doc_id, source, lang, text || CASE doc_id % 11 WHEN 0 THEN ' PROCEDURE : x' WHEN 1 THEN ' notes: y'
                    WHEN 2 THEN ' 5201: z' WHEN 3 THEN ' step 5201001 ' WHEN 4 THEN ' Applicability: all'
                    WHEN 5 THEN ' end of procedure' WHEN 6 THEN ' see 6123 ' WHEN 7 THEN ' note : 61234' ELSE '' END AS text
        FROM {documents}""",
    # parts as rows of printed indexes of forty rows; serials and numbers repeat inside an index
    "index_rows": """
        SELECT CAST(floor(p_partkey / 40) AS BIGINT) AS volume, p_partkey,
               p_partkey % 37 + 1 AS serial, 5200 + p_partkey % 37 AS number,
               CASE p_partkey % 6 WHEN 0 THEN 'OBC' WHEN 1 THEN 'TTC&XBAND' WHEN 2 THEN 'PAYLAOD' WHEN 3 THEN 'WHEEL'
                    WHEN 4 THEN 'ODHS' ELSE 'NEW' END AS label, p_name
        FROM {part}""",
    # documents as pages of the manuals of their source
    "manual_pages": """
        SELECT source AS doc_key, CAST(doc_id AS INT) AS page, CASE
            WHEN doc_id % 11 = 5 THEN ' '
            WHEN doc_id % 7 = 3 THEN 'OBC - ' || CAST(5200 + doc_id % 99 AS STRING) || ' : TITLE ' || CAST(doc_id AS STRING)
                 || chr(10) || text
            WHEN doc_id % 5 = 4 THEN text || chr(10) || 'END OF PROCEDURE'
            WHEN doc_id % 13 = 6 THEN 'NOTES: see hga ' || text
            ELSE text END AS text
        FROM {documents}""",
    # conversations as styled paragraphs of a few documents
    "paragraphs": """
        SELECT 'C' || CAST(conv_id % 7 AS STRING) AS doc_key, conv_id * 1000 + turn AS ord,
               CASE WHEN role = 'system' OR turn % 5 = 2 THEN 'Heading 1' ELSE 'Normal' END AS style,
               CASE WHEN turn % 9 = 3 THEN ' ' WHEN turn % 4 = 1 THEN text || ' twta 5' || CAST(100 + conv_id % 900 AS STRING)
                    ELSE text END AS text
        FROM {conversations}""",
    # documents whose every third line follows a numbered heading
    "captions": """
        SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Image  Caption: Caption : ' || text WHEN 1 THEN 'figure 12. ' || text
                    WHEN 2 THEN 'Fig.3: ' || text WHEN 3 THEN 'Captioning ' || text WHEN 4 THEN 'FIGURE 4: Fig. 5. ' || text
                    ELSE text END AS text
        FROM {documents}""",
    # documents and their labels as items with every kind of metadata
    "items": """
        SELECT d.doc_id AS ord, 'K' || CAST(d.doc_id AS STRING) AS chunk_id, d.text AS text,
               CASE d.doc_id % 3 WHEN 0 THEN 'FCP' WHEN 1 THEN 'MOR' ELSE '' END AS source_doc,
               d.source || '.pdf' AS doc_filename,
               CASE WHEN d.doc_id % 4 = 1 THEN 'image_caption' ELSE 'section' END AS content_type,
               CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE CAST(d.doc_id % 50 AS INT) END AS page,
               CASE WHEN d.doc_id % 6 = 0 THEN '' ELSE d.text END AS section_heading,
               CASE WHEN l.quality = 1 THEN CAST(5000 + d.doc_id % 1000 AS STRING) ELSE '' END AS fcp_number,
               CASE WHEN l.toxic = 1 THEN 'UNKNOWN' WHEN l.toxic = 0 THEN 'OBC' ELSE '' END AS subsystem,
               CASE WHEN d.doc_id % 8 = 0 THEN 'CMD ' || d.lang END AS mnemonic,
               CASE WHEN d.doc_id % 8 = 1 THEN 'OBCS' || CAST(d.doc_id AS STRING) END AS cid,
               'img/' || CAST(d.doc_id AS STRING) || '.png' AS image_file
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    # short lists of documents as the ranked results of questions, ten to a question
    "results": """
        SELECT CAST(CAST(floor(doc_id / 10) AS BIGINT) AS STRING) AS qid, CAST(doc_id % 10 + 1 AS INT) AS rank,
               'K' || CAST(doc_id AS STRING) AS id, text AS document,
               CASE doc_id % 3 WHEN 0 THEN 'FCP' WHEN 1 THEN 'MOR' ELSE 'TCH' END AS source_doc,
               CASE WHEN doc_id % 4 = 1 THEN 'image_caption' ELSE 'section' END AS content_type,
               CASE WHEN doc_id % 5 = 0 THEN 0 ELSE CAST(doc_id % 50 AS INT) END AS page,
               CASE WHEN doc_id % 6 = 0 THEN '' ELSE text END AS section_heading,
               CASE WHEN doc_id % 2 = 0 THEN '5201' ELSE '' END AS fcp_number,
               CASE doc_id % 3 WHEN 0 THEN 'OBC' WHEN 1 THEN 'UNKNOWN' ELSE '' END AS subsystem,
               CASE WHEN doc_id % 4 = 1 THEN 'img/' || CAST(doc_id % 3 AS STRING) || '.png' ELSE '' END AS image_file
        FROM {documents}""",
    # line items as figure files
    "figure_files": """
        SELECT l_orderkey * 8 + l_linenumber AS ord,
               CASE l_partkey % 4 WHEN 0 THEN 'images/OPS_MANUAL_img' || lpad(CAST(l_linenumber AS STRING), 3, '0')
                    WHEN 1 THEN 'images/logo' ELSE 'images/MOR_p' || CAST(l_orderkey % 500 AS STRING) || '_img'
                    || CAST(l_linenumber AS STRING) END
               || CASE l_suppkey % 6 WHEN 0 THEN '.wmf' WHEN 1 THEN '.gif' WHEN 2 THEN '.JPG' WHEN 3 THEN '' ELSE '.png' END
               AS path, CAST(floor(l_extendedprice / 8) AS BIGINT) AS length, CAST(floor(l_quantity) * 5 AS INT) AS width,
               CAST(l_partkey % 300 AS INT) AS height
        FROM {lineitem}""",
    # events as figures and orders as chunks of one page range per document
    "figures": """
        SELECT event_id, 'U' || CAST(user_id % 160 AS STRING) AS doc_key,
               CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(event_id % 400 AS INT) END AS page
        FROM {events}""",
    "paged_chunks": """
        SELECT o_orderkey AS ord, 'O' || CAST(o_orderkey AS STRING) AS chunk_id,
               'U' || CAST(o_custkey % 150 AS STRING) AS source_doc, o_orderpriority AS doc_filename,
               CAST(o_orderkey * 7 % 380 AS INT) AS page, 'S' || CAST(o_custkey AS STRING) AS section_heading,
               CASE WHEN o_orderkey % 3 = 0 THEN '5201' ELSE '' END AS fcp_number,
               CASE WHEN o_orderkey % 2 = 0 THEN 'OBC' ELSE 'UNKNOWN' END AS subsystem
        FROM {orders}""",
}


def given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return table(spark, folder, name)


def derived(spark: SparkSession, folder: str, name: str, **narrowed: DataFrame) -> DataFrame:
    """One of the inputs as a DataFrame; ``narrowed`` tables stand in for the whole ones where a filter is known."""
    text = INPUTS[name]
    used = {t: narrowed[t] if t in narrowed else given(spark, folder, t)
            for t in (*TABLES, "labels", "embeddings", "benchmark") if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def sql(name: str) -> str:
    """The same input as a subquery for the check."""
    text = INPUTS[name]
    for t in (*TABLES, "labels", "embeddings", "benchmark"):
        text = text.replace(f"{{{t}}}", t)
    return f"({text})"
