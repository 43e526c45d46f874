"""Search, fusion, boosts, citations and evaluation."""

from pyspark.sql import functions as F

from pagewright.functions.classify import procedure_number, subsystem_of
from pagewright.models import HashingEmbedder
from pagewright.operators import cells, fusion, lexical, vectors
from pagewright.plans import evaluate, render
from pagewright.plans.ask import Retriever, evaluating
from pagewright.plans.labelled import LABELLED
from pagewright.plans.store import COMMANDS, KNOWLEDGE, Store, prepared, stored_rows
from pagewright.session import materialize, new_folder
from pagewright.suite import checks as c
from pagewright.suite.command_queries import DAY
from pagewright.suite.inputs import derived, given, sql

QUESTION = "the license of this and that v1.0 data"
OTHER = "und die lizenz der daten the"
K = 10
CELLS, PROBES = 32, 20


def corpus(spark, folder):
    """Documents with their tokens, tokenized once and written."""
    return materialize(lexical.tokenized(given(spark, folder, "documents"), ["doc_id", "lang"], F.col("text")), "tokens")


def _question_vectors(spark, folder, keys):
    rows = given(spark, folder, "embeddings").where(F.col("vec_id").isin(keys)).select("vec_id", "embedding").collect()
    return {r["vec_id"]: tuple(r["embedding"]) for r in rows}


def term_stats(spark, folder):
    stats = lexical.Stats.counted(corpus(spark, folder))
    return stats.terms.select("term", "df", F.round("idf", 6).alias("idf"))


def corpus_stats(spark, folder):
    stats = lexical.Stats.counted(corpus(spark, folder))
    return stats.corpus(spark).select("n", F.round("avgdl", 6).alias("avgdl"))


def _bm25(spark, folder, question, k):
    return lexical.best(lexical.score_question(corpus(spark, folder), question), [], k, ["doc_id"])


def bm25_topk(spark, folder):
    return _bm25(spark, folder, QUESTION, K).select("doc_id", "rank", F.round("score", 6).alias("score"))


def bm25_postfilter(spark, folder):
    """Thirty candidates, of which those in the wanted language stay, at most ten."""
    scored = lexical.score_question(corpus(spark, folder), QUESTION)
    kept = lexical.best(scored, [], K, ["doc_id"], F.col("lang").isin("en", "UNKNOWN", ""), F.lit(True))
    return kept.select("doc_id", "rank", F.round("score", 6).alias("score"))


def _benchmark_results(spark, folder):
    rows = corpus(spark, folder)
    asked = given(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return lexical.batch_best(rows, asked, ["doc_id"], lexical.Stats.counted(rows), K)


def bm25_batch(spark, folder):
    return _benchmark_results(spark, folder).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


def _search(spark, folder, searches):
    return vectors.search(given(spark, folder, "embeddings"), searches, "vec_id", ["vec_id"])


def vector_topk(spark, folder):
    v = _question_vectors(spark, folder, [0])
    return _search(spark, folder, [vectors.Search("q", v[0], K)]).select("vec_id", "rank", F.round("score", 6).alias("score"))


def vector_topk_filtered(spark, folder):
    v = _question_vectors(spark, folder, [0])
    return _search(spark, folder, [vectors.Search("q", v[0], K, "label", ("1", "3"))]).select(
        "vec_id", "rank", F.round("score", 6).alias("score"))


def vector_batch(spark, folder):
    """The mean direction of every label against all vectors, and against its own label's, in one pass."""
    rows = given(spark, folder, "embeddings")
    width = rows.select(F.size("embedding").alias("n")).first()["n"]
    means = rows.groupBy("label").agg(F.array(*[F.avg(F.col("embedding")[i].cast("double")) for i in range(width)])
                                      .alias("mean")).collect()
    searches = []
    for r in means:
        length = sum(x * x for x in r["mean"]) ** 0.5
        direction = tuple(x / length for x in r["mean"])
        searches += [vectors.Search(f"all {r['label']}", direction, K),
                     vectors.Search(f"own {r['label']}", direction, K, "label", (str(r["label"]),))]
    return _search(spark, folder, searches).select("list_key", "vec_id", "rank", F.round("score", 6).alias("score"))


def _label_means(spark, folder):
    """A search for the mean direction of every label."""
    rows = given(spark, folder, "embeddings")
    width = rows.select(F.size("embedding").alias("n")).first()["n"]
    means = rows.groupBy("label").agg(F.array(*[F.avg(F.col("embedding")[i].cast("double")) for i in range(width)]).alias("mean"))
    searches = []
    for r in means.collect():
        length = sum(x * x for x in r["mean"]) ** 0.5
        searches.append(vectors.Search(f"all {r['label']}", tuple(x / length for x in r["mean"]), K))
    return searches


def _cell_index(spark, folder):
    rows, path = given(spark, folder, "embeddings"), new_folder(spark, "cells")
    cells.write(rows, cells.train(rows, "vec_id", CELLS), path)
    return cells.CellIndex(spark, path)


def vector_cells(spark, folder):
    """Approximate search: the mean direction of every label in its nearest cells."""
    found = _cell_index(spark, folder).search(_label_means(spark, folder), "vec_id", ["vec_id"], PROBES)
    return found.select("list_key", "vec_id", "rank", F.round("score", 6).alias("score"))


def vector_cells_exact(spark, folder):
    """The same directions, cells read as far as their bounds ask for."""
    found = _cell_index(spark, folder).search_exact(_label_means(spark, folder), "vec_id", ["vec_id"], PROBES)
    return found.select("list_key", "vec_id", "rank", F.round("score", 6).alias("score"))


def _two_lists(spark, folder):
    rows = corpus(spark, folder)
    stats = lexical.Stats.counted(rows)
    lists = [lexical.best(lexical.score_question(rows, q, stats), [], 2 * K, ["doc_id"]).withColumn("list_no", F.lit(i))
             for i, q in enumerate((QUESTION, OTHER))]
    return lists[0].unionByName(lists[1]).withColumn("origin", F.col("list_no")).withColumn("qid", F.lit("q"))


def rrf_fuse(spark, folder):
    fused = fusion.fuse(_two_lists(spark, folder), ["qid"], "doc_id", ["origin", "score"], 2 * K)
    return fused.select("doc_id", "rank", F.round("rrf", 9).alias("rrf"), "origin", F.round("score", 6).alias("score"))


def _hybrid(spark, folder, boosts):
    v = _question_vectors(spark, folder, [0])
    docs = given(spark, folder, "documents")
    vecs = given(spark, folder, "embeddings").select("vec_id", "embedding", "label").withColumn("doc_id", F.col("vec_id"))
    searches = [vectors.Search("all", v[0], 2 * K)] + ([vectors.Search("image", v[0], 3, "label", ("2",)),
                                                        vectors.Search("procedure", v[0], 3, "label", ("5",))] if boosts else [])
    found = vectors.search(vecs, searches, "doc_id", ["doc_id"]).withColumn("qid", F.lit("q"))
    lists = (found.where("list_key = 'all'").select("qid", "doc_id", "rank", "score").withColumn("list_no", F.lit(0))
             .unionByName(_bm25(spark, folder, QUESTION, 2 * K).select(F.lit("q").alias("qid"), "doc_id", "rank", "score")
                          .withColumn("list_no", F.lit(1))))
    merged = fusion.fuse(lists.withColumn("origin", F.col("list_no")), ["qid"], "doc_id", ["origin", "score"], K)
    merged = merged.select("qid", "rank", "doc_id", "origin", "score")
    for kind in ("image", "procedure") if boosts else ():
        front = found.where(F.col("list_key") == kind).withColumn("origin", F.lit(0))
        merged = fusion.put_in_front(front, merged, ["qid"], "doc_id", 2)
    return merged.join(docs.select("doc_id", "lang"), "doc_id").select(
        "doc_id", "rank", "origin", F.round("score", 6).alias("score"), "lang")


def hybrid_search(spark, folder):
    return _hybrid(spark, folder, False)


def boost_prepend(spark, folder):
    return _hybrid(spark, folder, True)


def built_store(spark, folder):
    """Documents and events loaded into a new store: split, embedded, indexed."""
    store = Store(spark, new_folder(spark, "store"))
    docs = derived(spark, folder, "manual_pages").select(
        F.concat(F.lit("D"), F.col("page").cast("string")).alias("chunk_id"), "text", F.col("page").cast("bigint").alias("ord"),
        F.when(F.col("page") % 4 == 0, "FCP").otherwise("MOR").alias("source_doc"), F.lit("section").alias("content_type"), "page",
        subsystem_of(F.col("text")).alias("subsystem"), procedure_number(F.col("text")).alias("fcp_number"))
    records = derived(spark, folder, "commands").withColumns({
        "record_id": F.concat(F.lit("TCH_"), F.col("ord").cast("string")), "source_doc": F.lit("TCH"),
        "text": F.concat_ws(" ", "mnemonic", "cid", "date", "status")})
    embedder = HashingEmbedder(64)
    store.load(KNOWLEDGE, prepared(docs, "chunk_id"), embedder)
    store.load(COMMANDS, prepared(records, "record_id"), embedder)
    return Retriever(store, embedder)


def store_two_loads(spark, folder):
    """Documents stored by two loads, searched by one question over the index of both."""
    store = Store(spark, new_folder(spark, "store"))
    docs = given(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("ord"), "text")
    for odd in (0, 1):
        store.load(KNOWLEDGE, stored_rows(docs.where(F.col("ord") % 2 == odd), "chunk_id"), HashingEmbedder(8))
    asked = spark.createDataFrame([("q", QUESTION)], "qid string, question string")
    scored = lexical.candidates(store.table(KNOWLEDGE, "postings"), asked, ["id", "ord"], store.stats(KNOWLEDGE), K)
    return lexical.best(scored, ["qid"], K, ["ord"]).select(F.col("ord").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


def labelled_retrieval(spark, folder):
    """The default questions and two about the log, through routing, both searches, fusion and boosts."""
    asked = [{"qid": c["id"], "question": c["q"]} for c in LABELLED]
    asked += [{"qid": "day", "question": f"commands on {DAY}"}, {"qid": "records", "question": "uplinked ERROR COMMAND 7"}]
    _, results = built_store(spark, folder).retrieve(asked, evaluating())
    return results.select("qid", "rank", "id", "list_no", F.round("score", 6).alias("score"), "source_doc", "fcp_number")


def source_citations(spark, folder):
    return render.citations(derived(spark, folder, "results"))


def panel_sources(spark, folder):
    return render.panel_sources(derived(spark, folder, "results"))


def distinct_images(spark, folder):
    return render.figure_files(derived(spark, folder, "results"))


def context_build(spark, folder):
    return render.context(derived(spark, folder, "results"))


def figure_answers(spark, folder):
    return render.figure_answers(derived(spark, folder, "results"))


def source_labels(spark, folder):
    return derived(spark, folder, "results").select("id", render.source_label().alias("label"))


def ranked_lines(spark, folder):
    """Command records as the ranked answer table, ten to a question."""
    rows = derived(spark, folder, "commands").withColumn("qid", F.floor(F.col("ord") / 10).cast("string"))
    return render.ranked_lines(rows.withColumn("rank", (F.col("ord") % 10 + 1).cast("int")))


def _labelled(spark, folder):
    """Benchmark passages as questions; a document is right when it holds the whole passage, or when it is German and holds
    one of the clauses of it."""
    text = F.col("text")
    empty = F.create_map().cast("map<string,string>")
    german = F.create_map(F.lit("lang"), F.lit(" DE "))
    condition = "array<struct<meta:map<string,string>,text_contains:string,text_contains_any:array<string>>>"
    accept = F.array(
        F.struct(empty.alias("meta"), text.alias("text_contains"),
                 F.lit(None).cast("array<string>").alias("text_contains_any")),
        F.struct(german.alias("meta"), F.lit(None).cast("string").alias("text_contains"),
                 F.filter(F.split(text, "[.,] *"), lambda clause: clause != "").alias("text_contains_any")))
    return given(spark, folder, "benchmark").select(
        F.col("item_id").cast("string").alias("id"), text.alias("q"), F.lit("").alias("note"), accept.cast(condition).alias("accept"))


def _ranks(spark, folder):
    results = _benchmark_results(spark, folder).withColumn("qid", F.col("qid").cast("string"))
    docs = given(spark, folder, "documents").select("doc_id", "text", "lang")
    return evaluate.first_relevant(results.join(docs, "doc_id"), _labelled(spark, folder), "text", ["lang"])


def eval_relevance(spark, folder):
    rows = evaluate.with_hits(_ranks(spark, folder))
    return rows.withColumn("rr", F.round("rr", 6))


def eval_metrics(spark, folder):
    total = evaluate.totals(evaluate.with_hits(_ranks(spark, folder)))
    return total.select("n", *[F.round(x, 6).alias(x) for x in ("hit1", "hit3", "hit5", "hit10", "mrr")],
                        F.array_join("misses", ",").alias("misses"))


_CORPUS = "corpus AS (SELECT doc_id AS id, text FROM documents)"


def _one(question):
    return c.bm25_scores(f"SELECT 'q' AS qid, {c.quoted(question)} AS question")


def _ranked(question, limit, name="ranked"):
    return f"""{name} AS (SELECT id AS doc_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id)::INT AS rank
        FROM scored WHERE score > 0 QUALIFY rank <= {limit})"""


_DOT = "list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _nearest(where, limit, name):
    return f"""{name} AS (SELECT e.vec_id AS doc_id, {_DOT} AS score, row_number() OVER (ORDER BY round({_DOT}, 9) DESC, e.vec_id)::INT
        AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {where} QUALIFY rank <= {limit})"""


def _fusion(lists, limit):
    """``fused`` from ``lists(list_no, doc_id, rank, score)``."""
    return f"""fused AS (SELECT *, row_number() OVER (ORDER BY round(rrf, 12) DESC, seen)::INT AS rank FROM (
        SELECT doc_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min((list_no, rank)) AS seen, max(list_no)::INT AS origin,
        arg_max(score, list_no) AS score FROM ({lists}) GROUP BY doc_id) QUALIFY rank <= {limit})"""


_HYBRID = f"""{_CORPUS}, {_one(QUESTION)}, {_ranked(QUESTION, 20)}, {_nearest('true', 20, 'sem')}, """ + _fusion(
    "SELECT 0 AS list_no, doc_id, rank, score FROM sem UNION ALL SELECT 1, doc_id, rank, score FROM ranked", K)

_BATCH = f"""WITH {_CORPUS}, {c.bm25_scores('SELECT item_id AS qid, text AS question FROM benchmark')},
    best AS (SELECT qid, id AS doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id)::INT AS rank
    FROM scored WHERE score > 0 QUALIFY rank <= 10)"""

_RANKS = f"""{_BATCH}, hits AS (SELECT qid, min(rank) AS rank FROM best JOIN documents d USING (doc_id)
    JOIN benchmark b ON b.item_id = qid WHERE contains(lower(d.text), lower(b.text)) OR (d.lang = 'de'
        AND len(list_filter(string_split_regex(b.text, '[.,] *'), lambda x: x <> '' AND contains(lower(d.text), lower(x)))) > 0) GROUP BY qid),
    rows_ AS (SELECT item_id::VARCHAR AS id, coalesce(rank, 0)::INT AS rank FROM benchmark LEFT JOIN hits ON qid = item_id),
    flags AS (SELECT id, rank, (rank = 1)::INT AS hit1, (rank BETWEEN 1 AND 3)::INT AS hit3, (rank BETWEEN 1 AND 5)::INT AS hit5,
    (rank >= 1)::INT AS hit10, CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0.0::DOUBLE END AS rr FROM rows_)"""

_SUBSYSTEM = "CASE WHEN subsystem NOT IN ('', 'UNKNOWN') THEN subsystem END"
_CITED = f"""WITH r AS {sql('results')}, k AS (SELECT *, CASE WHEN content_type = 'image_caption' THEN 'IMG' || chr(1) || image_file
    ELSE source_doc || chr(1) || fcp_number || chr(1) || substring(section_heading, 1, 40) END AS key FROM r),
    once AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY qid, key ORDER BY rank) = 1),
    n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank)::INT AS nth FROM once)"""
_HEADING = c.strip("section_heading")

QUERIES = {
    "term_stats": (term_stats, f"WITH {_CORPUS}, {c.BM25} SELECT term, df, round(idf, 6) AS idf FROM idf"),
    "corpus_stats": (corpus_stats, f"WITH {_CORPUS}, {c.BM25} SELECT n, round(avgdl, 6) AS avgdl FROM stat"),
    "bm25_topk": (bm25_topk, f"""WITH {_CORPUS}, {_one(QUESTION)}, {_ranked(QUESTION, K)}
        SELECT doc_id, rank, round(score, 6) AS score FROM ranked"""),
    "store_two_loads": (store_two_loads, f"""WITH {_CORPUS}, {_one(QUESTION)}, {_ranked(QUESTION, K)}
        SELECT doc_id, rank, round(score, 6) AS score FROM ranked"""),
    "bm25_postfilter": (bm25_postfilter, f"""WITH {_CORPUS}, {_one(QUESTION)}, {_ranked(QUESTION, 3 * K)}
        SELECT doc_id, row_number() OVER (ORDER BY r.rank)::INT AS rank, round(score, 6) AS score
        FROM ranked r JOIN documents USING (doc_id) WHERE lang = 'en' QUALIFY row_number() OVER (ORDER BY r.rank) <= {K}"""),
    "bm25_batch": (bm25_batch, f"{_BATCH} SELECT qid, doc_id, rank, round(score, 6) AS score FROM best"),
    "vector_topk": (vector_topk, f"""WITH {_nearest('true', K, 'v')}
        SELECT doc_id AS vec_id, rank, round(score, 6) AS score FROM v"""),
    "vector_topk_filtered": (vector_topk_filtered, f"""WITH {_nearest('e.label IN (1, 3)', K, 'v')}
        SELECT doc_id AS vec_id, rank, round(score, 6) AS score FROM v"""),
    "vector_batch": (vector_batch, f"""WITH cell AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM (SELECT label, embedding,
        unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i),
        mean AS (SELECT label, list(x ORDER BY i) AS m FROM cell GROUP BY label),
        q AS (SELECT label, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS embedding FROM mean),
        pairs AS (SELECT 'all ' || q.label AS list_key, vec_id, {_DOT} AS score FROM embeddings e, q
        UNION ALL SELECT 'own ' || q.label, vec_id, {_DOT} FROM embeddings e JOIN q USING (label))
        SELECT list_key, vec_id, row_number() OVER (PARTITION BY list_key ORDER BY round(score, 9) DESC, vec_id)::INT AS rank,
        round(score, 6) AS score FROM pairs QUALIFY rank <= {K}"""),
    "vector_cells": (vector_cells, None),
    "vector_cells_exact": (vector_cells_exact, f"""WITH cell AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM (SELECT label, embedding,
        unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i),
        mean AS (SELECT label, list(x ORDER BY i) AS m FROM cell GROUP BY label),
        q AS (SELECT label, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS embedding FROM mean),
        pairs AS (SELECT 'all ' || q.label AS list_key, vec_id, {_DOT} AS score FROM embeddings e, q)
        SELECT list_key, vec_id, row_number() OVER (PARTITION BY list_key ORDER BY round(score, 9) DESC, vec_id)::INT AS rank,
        round(score, 6) AS score FROM pairs QUALIFY rank <= {K}"""),
    "rrf_fuse": (rrf_fuse, f"""WITH {_CORPUS}, {c.bm25_scores(f"SELECT 0 AS qid, {c.quoted(QUESTION)} AS question UNION ALL SELECT 1, {c.quoted(OTHER)}")},
        lists AS (SELECT qid AS list_no, id AS doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id)::INT
        AS rank FROM scored WHERE score > 0 QUALIFY rank <= {2 * K}), {_fusion('FROM lists', 2 * K)}
        SELECT doc_id, rank, round(rrf, 9) AS rrf, origin, round(score, 6) AS score FROM fused"""),
    "hybrid_search": (hybrid_search, f"""WITH {_HYBRID}
        SELECT doc_id, rank, origin, round(score, 6) AS score, lang FROM fused JOIN documents USING (doc_id)"""),
    "boost_prepend": (boost_prepend, f"""WITH {_HYBRID}, {_nearest('e.label = 2', 2, 'img')}, {_nearest('e.label = 5', 2, 'pro')},
        every AS (SELECT 0 AS part, rank, doc_id, 0 AS origin, score FROM pro UNION ALL SELECT 1, rank, doc_id, 0, score FROM img
        UNION ALL SELECT 2, rank, doc_id, origin, score FROM fused),
        once AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY part, rank) = 1)
        SELECT doc_id, row_number() OVER (ORDER BY part, once.rank)::INT AS rank, origin, round(score, 6) AS score, lang
        FROM once JOIN documents USING (doc_id)"""),
    "labelled_retrieval": (labelled_retrieval, None),
    "source_citations": (source_citations, f"""{_CITED} SELECT qid, nth, '  ' || concat_ws(' · ', '[' || nth || ']', source_doc,
        CASE WHEN fcp_number <> '' THEN 'FCP-' || fcp_number END, {_SUBSYSTEM}, CASE WHEN page <> 0 THEN 'p.' || page END,
        CASE WHEN section_heading <> '' THEN '"' || substring(section_heading, 1, 55) || CASE WHEN length(section_heading) > 55
        THEN '...' ELSE '' END || '"' END, CASE WHEN content_type = 'image_caption' THEN '🖼 diagram' END)
        || CASE WHEN image_file <> '' THEN chr(10) || '      📎 ' || image_file ELSE '' END AS citation FROM n"""),
    "panel_sources": (panel_sources, f"""SELECT qid, rank, concat_ws(' · ', '**' || source_doc || '**',
        CASE WHEN fcp_number <> '' THEN 'FCP-' || fcp_number END, {_SUBSYSTEM}, CASE WHEN page <> 0 THEN 'p.' || page END,
        CASE WHEN content_type = 'image_caption' THEN '🖼 diagram' END) || CASE WHEN {_HEADING} <> '' THEN ' - *' ||
        substring(replace({_HEADING}, chr(10), ' '), 1, 70) || '*' ELSE '' END AS line FROM {sql('results')}
        QUALIFY row_number() OVER (PARTITION BY qid, source_doc, fcp_number, substring(section_heading, 1, 40), image_file
        ORDER BY rank) = 1"""),
    "distinct_images": (distinct_images, f"""SELECT qid, image_file, min(rank) AS rank FROM {sql('results')}
        WHERE content_type = 'image_caption' GROUP BY ALL"""),
    "context_build": (context_build, f"""SELECT qid, chr(10) || chr(10) || string_agg('[Source ' || rank || ' | ' || source_doc
        || CASE WHEN fcp_number <> '' THEN ' FCP-' || fcp_number ELSE '' END || coalesce(' · ' || {_SUBSYSTEM}, '')
        || CASE WHEN page <> 0 THEN ' · page ' || page ELSE '' END || ' · ' || content_type || ']' || chr(10)
        || substring({c.strip('document')}, 1, 2000), chr(10) || chr(10) || repeat('─', 50) || chr(10) || chr(10) ORDER BY rank)
        AS context FROM {sql('results')} GROUP BY qid"""),
    "figure_answers": (figure_answers, f"""SELECT qid, 'Here is the figure matching your request (from ' || source_doc ||
        CASE WHEN page <> 0 THEN ', page ' || page ELSE '' END || '):' || chr(10) || chr(10) || {c.strip('document')} || chr(10)
        || chr(10) || '_The diagram is shown below._' AS answer FROM {sql('results')} WHERE content_type = 'image_caption'
        QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) = 1"""),
    "source_labels": (source_labels, f"""SELECT id, concat_ws(' · ', source_doc, CASE WHEN fcp_number <> '' THEN 'FCP-' || fcp_number
        END, CASE WHEN page <> 0 THEN 'p.' || page END, content_type) AS label FROM {sql('results')}"""),
    "ranked_lines": (ranked_lines, f"""SELECT floor(ord / 10)::BIGINT::VARCHAR AS qid, (ord % 10 + 1)::INT AS rank,
        rpad((ord % 10 + 1)::VARCHAR, 4, ' ') || '  ' || rpad(cid, 14, ' ') || '  ' || rpad(mnemonic, 40, ' ') || '  '
        || rpad(date, 12, ' ') || '  ' || rpad(time, 10, ' ') || '  ' || status AS line FROM {sql('commands')}"""),
    "eval_relevance": (eval_relevance, f"{_RANKS} SELECT id, rank, hit1, hit3, hit5, hit10, round(rr, 6) AS rr FROM flags"),
    "eval_metrics": (eval_metrics, f"""{_RANKS} SELECT count(*) AS n, round(avg(hit1), 6) AS hit1, round(avg(hit3), 6) AS hit3,
        round(avg(hit5), 6) AS hit5, round(avg(hit10), 6) AS hit10, round(avg(rr), 6) AS mrr,
        coalesce(string_agg(CASE WHEN rank = 0 THEN id END, ',' ORDER BY id), '') AS misses FROM flags"""),
}
