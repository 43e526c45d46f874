"""Labelled questions to Hit@k and MRR."""

import html
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import rules, schema
from pagewright.functions.text import strip
from pagewright.operators.ordered import first_wins
from pagewright.operators.substrings import with_held
from pagewright.plans.ask import Retriever, ask, evaluating
from pagewright.plans.render import source_label
from pagewright.session import materialize

HIT_RANKS = [1, 3, 5]


def cases_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Cases ``[{id, q, note, accept: [{field: value, text_contains, text_contains_any}]}]``."""
    with open(path, encoding="utf-8") as source:
        return cases(spark, json.load(source))


def cases(spark: SparkSession, listed: list[dict]) -> DataFrame:
    special = ("text_contains", "text_contains_any")
    rows = [(str(c["id"]), c["q"], c.get("note", ""), [
        ({k: str(v) for k, v in cond.items() if k not in special}, cond.get("text_contains"),
         cond.get("text_contains_any")) for cond in c["accept"]], place) for place, c in enumerate(listed)]
    return spark.createDataFrame(rows, schema.CASES)


def metadata_map(columns: list[str]) -> Column:
    """Metadata columns as one map of strings."""
    return F.map_from_arrays(F.array(*[F.lit(c) for c in columns]),
                             F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def is_relevant(accept: Column, held: Column, meta: Column) -> Column:
    """Any condition whose every key holds: substrings of the text, or equal metadata apart from case and blanks. ``held``
    lists those of the substrings, in lower case, that the text holds."""
    def same(key: Column, value: Column) -> Column:
        own = F.coalesce(F.try_element_at(meta, key), F.lit(""))
        return F.lower(strip(own)) == F.lower(strip(value))

    def holds(c: Column) -> Column:
        return (
            F.forall(F.map_entries(c["meta"]), lambda e: same(e["key"], e["value"]))
            & (c["text_contains"].isNull() | F.array_contains(held, F.lower(c["text_contains"])))
            & (c["text_contains_any"].isNull() | F.exists(c["text_contains_any"], lambda v: F.array_contains(held, F.lower(v)))))

    return F.exists(accept, holds)


def wanted_substrings(labelled: DataFrame) -> DataFrame:
    """All substrings that some condition asks for, in lower case."""
    conditions = labelled.select(F.explode("accept").alias("c"))
    own = F.concat(F.array("c.text_contains"), F.coalesce("c.text_contains_any", F.array().cast("array<string>")))
    return conditions.select(F.explode(own).alias("phrase")).where("phrase IS NOT NULL").select(F.lower("phrase").alias("phrase")).distinct()


def first_relevant(results: DataFrame, labelled: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """``(id, rank)``: best rank of a relevant result of each case, 0 for a miss. ``results`` are keyed by ``qid``. Each
    result's text is read once, for the substrings of all cases."""
    lowered = results.withColumn("_low", F.lower(F.col(text)))
    found = with_held(lowered, "_low", wanted_substrings(labelled), "_held").drop("_low")
    judged = found.join(labelled.select(F.col("id").alias("qid"), "accept"), "qid")
    hits = judged.where(is_relevant(F.col("accept"), F.col("_held"), metadata_map(columns))).groupBy("qid").agg(
        F.min("rank").alias("rank"))
    return labelled.select("id").join(hits.withColumnRenamed("qid", "id"), "id", "left").select(
        "id", F.coalesce("rank", F.lit(0)).alias("rank"))


def with_hits(ranks: DataFrame) -> DataFrame:
    """Hit flags and reciprocal rank. ``hit10`` counts any hit of the pool."""
    rank = F.col("rank")
    flags = {f"hit{k}": F.when(rank.between(1, k), 1).otherwise(0) for k in HIT_RANKS}
    return ranks.withColumns({**flags, "hit10": F.when(rank >= 1, 1).otherwise(0),
                              "rr": F.when(rank > 0, 1.0 / rank).otherwise(F.lit(0.0))})


def totals(rows: DataFrame) -> DataFrame:
    """One row: number of cases, hit rates, MRR, missed ids in list order (``ord``, else by id). No cases give zeros."""
    place = F.col("ord") if "ord" in rows.columns else F.lit(0)
    missed = F.collect_list(F.when(F.col("rank") == 0, F.struct(place.alias("ord"), F.col("id").cast("string").alias("id"))))
    rates = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("hit1", "hit3", "hit5", "hit10")]
    return rows.agg(F.count("*").alias("n"), *rates, F.coalesce(F.avg("rr"), F.lit(0.0)).alias("mrr"),
                    F.transform(F.array_sort(missed), lambda m: m["id"]).alias("misses"))


def evaluate(retriever: Retriever, labelled: DataFrame, pool: int = rules.EVAL_POOL) -> DataFrame:
    """Evaluation rows of all cases, in list order by ``ord``; none for an empty set."""
    questions = [{"qid": r["id"], "question": r["q"]} for r in labelled.select("id", "q").collect()]
    plan, results = retriever.retrieve(questions, evaluating(pool))
    if results is None:
        results = retriever.spark.createDataFrame([], "qid string, rank int, document string, " + ", ".join(f"{c} string" for c in schema.METADATA))
    results = materialize(results, "evaluated")
    routes = retriever.spark.createDataFrame([(p["qid"], p["route"]) for p in plan], "id string, route string")
    ranks = with_hits(first_relevant(results, labelled, "document", schema.METADATA))
    top = first_wins(results, ["qid"], ["rank"]).select(F.col("qid").alias("id"), source_label().alias("top_source"))
    return (ranks.join(routes, "id").join(top, "id", "left")
            .join(labelled.select("id", F.col("q").alias("question"), "note", "ord"), "id")
            .withColumn("top_source", F.coalesce("top_source", F.lit(""))))


def answers(retriever: Retriever, rows: list, generator) -> list[dict]:
    """Answers beside the evaluation rows, for reading."""
    return [{**r, "answer": ask(retriever, r["question"], generator=generator).text} for r in rows]


# ---- reports: as long as the labelled set ---------------------------------------------------------------
def report_text(rows: list[dict], total: dict) -> str:
    line = "{:<13} {:<10} {:<5} {:<4} {:<4} {:<4} {}"
    out = [line.format("id", "route", "rank", "H@1", "H@3", "H@5", "top source"), "-" * 92]
    for r in rows:
        missed = "" if 1 <= r["rank"] <= 5 else "  ⚠ miss@5"
        out.append(line.format(r["id"], r["route"], r["rank"] or "-", r["hit1"], r["hit3"], r["hit5"],
                               r["top_source"][:40] + missed))
    out += ["-" * 92, f"  Questions      : {total['n']}"]
    out += [f"  Hit@{k:<11}: {total[f'hit{k}'] * 100:5.1f}%" for k in (1, 3, 5, 10)]
    out.append(f"  MRR            : {total['mrr']:.3f}")
    if total["misses"]:
        out.append(f"  Missed         : {', '.join(total['misses'])}")
    return "\n".join(out)


def report_json(rows: list[dict], total: dict) -> str:
    return json.dumps({"aggregate": total, "per_question": rows}, indent=2, ensure_ascii=False)


def report_html(rows: list[dict], total: dict) -> str:
    def cells(tag: str, values) -> str:
        return "<tr>" + "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in values) + "</tr>"

    heads = ["ID", "Question", "Route", "Rank", "H@1", "H@3", "H@5", "Top source", "Expected"]
    body = [cells("td", [r["id"], r["question"], r["route"], r["rank"] or "miss",
                         *("✓" if r[f"hit{k}"] else "" for k in HIT_RANKS), r["top_source"], r["note"]]) for r in rows]
    figures = " · ".join([*(f"Hit@{k} {total[f'hit{k}'] * 100:.0f}%" for k in (1, 3, 5, 10)),
                          f"MRR {total['mrr']:.3f}", f"{total['n']} questions"])
    return ("<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>Retrieval evaluation</title>"
            "<style>body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}"
            "td,th{border:1px solid #ccc;padding:4px 8px;text-align:left}</style></head><body>"
            f"<h1>Retrieval evaluation</h1><p>{html.escape(figures)}</p>"
            f"<table>{cells('th', heads)}{''.join(body)}</table></body></html>")
