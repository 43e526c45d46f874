"""Questions to ranked sources and answers.

All questions of a call are answered by the same few jobs: one pass over the stored vectors for every semantic and
boost search together, one join of the question terms with the postings, and windows per question.
"""

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright import rules
from pagewright.functions.intents import question_date, route, wants_image, wants_procedure
from pagewright.functions.classify import question_subsystem
from pagewright.functions.text import pad, tokens
from pagewright.models import Embedder, Generator
from pagewright.operators import command_log, fusion, lexical, vectors
from pagewright.operators.ordered import top_k
from pagewright.plans import render
from pagewright.session import materialize
from pagewright.plans.store import COMMANDS, KNOWLEDGE, Store

RANKED = "qid string, rank int, id string, list_no int, score double"


@dataclass(frozen=True)
class Policy:
    """How many candidates each list gives, how many survive fusion, and how strict the subsystem filter is."""

    per_list: int
    final: int
    strict_subsystem: bool = False      # only the subsystem itself, or untagged rows too
    cut_after_boost: int | None = None  # results kept after the boosts
    day_limit: int | None = None        # rows of a day listing; with a limit, list order instead of time order


def answering(top_k: int = rules.FINAL_K) -> Policy:
    return Policy(per_list=2 * top_k, final=top_k)


def evaluating(pool: int = rules.EVAL_POOL) -> Policy:
    return Policy(per_list=pool, final=pool, strict_subsystem=True, cut_after_boost=pool, day_limit=pool)


def understood(questions: DataFrame) -> DataFrame:
    """Questions ``(qid, question[, hint])`` with route, day, subsystem and intents."""
    q = F.col("question")
    hint = F.nullif(F.col("hint"), F.lit("")) if "hint" in questions.columns else F.lit(None)
    return questions.select(
        "qid", "question", route(q).alias("route"), question_date(q).alias("day"),
        F.coalesce(hint, question_subsystem(q)).alias("subsystem"),
        wants_image(q).alias("image"), wants_procedure(q).alias("procedure"))


#: Values that reach a scan as a filter; more are matched by a join, so the driver never holds what all questions ask for.
PUSHED = 1000


def narrowed(table: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``table`` whose ``column`` is among those of ``wanted``."""
    values = wanted.select(column).distinct()
    few = values.limit(PUSHED + 1).collect()
    if len(few) <= PUSHED:
        return table.where(F.col(column).isin([r[0] for r in few]))
    return table.join(values, column, "left_semi")


class Retriever:
    """Search over a :class:`Store` with the embedder it was built with. With ``probes``, vectors are searched in that many
    cells of the store's clustering (:meth:`Store.build_cells`), approximately; otherwise, and where nothing was clustered, exactly."""

    def __init__(self, store: Store, embedder: Embedder, probes: int | None = None):
        self.store, self.embedder, self.spark, self.probes = store, embedder, store.spark, probes

    # ---- candidate lists -----------------------------------------------------------------------------
    def _semantic(self, collection: str, wanted: list[vectors.Search]) -> DataFrame:
        order = ["ord", "sub_index"]
        index, newer = self.store.cell_index(collection) if self.probes else (None, None)
        if index is None:
            found = vectors.search(self.store.table(collection, "rows"), wanted, "id", order)
        else:
            found = index.search(wanted, "id", order, self.probes)
            if newer is not None:
                found = vectors.merged([found, vectors.search(newer, wanted, "id", order)], wanted, order)
        parts = F.split("list_key", "\\|", 2)
        return found.select(parts[1].alias("qid"), parts[0].alias("kind"), "rank", "id", "score")

    def _lexical(self, collection: str, asked: DataFrame, k: int) -> DataFrame:
        """``asked(qid, question, subsystem)``; a subsystem filters after over-fetching, untagged rows stay."""
        keep = ["id", "ord", "sub_index", "tag"]
        # the questions' own terms reach the scan, whose files are sorted by term
        terms = asked.select(F.explode(tokens(F.col("question"))).alias("term"))
        found = narrowed(self.store.table(collection, "postings").withColumnRenamed("subsystem", "tag"), "term", terms)
        wide = k * rules.POSTFILTER_FACTOR
        scored = lexical.candidates(found, asked.select("qid", "question"), keep, self.store.stats(collection), wide)
        scored = scored.join(asked.select("qid", "subsystem"), "qid")
        fits = F.col("tag").isin("UNKNOWN", "") | (F.col("tag") == F.col("subsystem"))
        ranked = lexical.best(scored, ["qid"], k, ["ord", "sub_index"], fits, F.col("subsystem").isNotNull())
        return ranked.select("qid", "rank", "id", "score")

    def _fused(self, semantic: DataFrame, bm25: DataFrame, limit: int) -> DataFrame:
        lists = (semantic.select("qid", "rank", "id", "score").withColumn("list_no", F.lit(0))
                 .unionByName(bm25.withColumn("list_no", F.lit(1))))
        lists = lists.withColumn("origin", F.col("list_no"))
        fused = fusion.fuse(lists, ["qid"], "id", ["origin", "score"], limit)
        return fused.select("qid", "rank", "id", F.col("origin").alias("list_no"), "score")

    # ---- routes --------------------------------------------------------------------------------------
    def _knowledge(self, plan: list, policy: Policy) -> DataFrame:
        embedded = self.embedder.embed([p["question"] for p in plan])
        wanted = []
        for p, vector in zip(plan, embedded):
            v = tuple(float(x) for x in vector)
            tagged = (p["subsystem"],) if policy.strict_subsystem else (p["subsystem"], "UNKNOWN", "")
            if p["subsystem"]:
                wanted.append(vectors.Search(f"tagged|{p['qid']}", v, policy.per_list, "subsystem", tagged))
            wanted.append(vectors.Search(f"all|{p['qid']}", v, policy.per_list))
            if p["image"]:
                wanted.append(vectors.Search(f"image|{p['qid']}", v, rules.BOOST_FETCH, "content_type",
                                             ("image_caption",)))
            if p["procedure"]:
                wanted.append(vectors.Search(f"procedure|{p['qid']}", v, rules.BOOST_FETCH, "source_doc", ("FCP",)))
        # at most k rows per question; written, so the vectors are passed over once
        lists = materialize(self._semantic(KNOWLEDGE, wanted), "vector-hits")
        tagged, every = lists.where("kind = 'tagged'"), lists.where("kind = 'all'")
        semantic = tagged.unionByName(every.join(tagged.select("qid").distinct(), "qid", "left_anti"))
        asked = self.spark.createDataFrame([(p["qid"], p["question"], p["subsystem"]) for p in plan],
                                           "qid string, question string, subsystem string")
        merged = self._fused(semantic, self._lexical(KNOWLEDGE, asked, policy.per_list), policy.final)
        for kind in ("image", "procedure"):
            front = lists.where(F.col("kind") == kind).withColumn("list_no", F.lit(0))
            if any(p[kind] for p in plan):
                merged = fusion.put_in_front(front, merged, ["qid"], "id", rules.BOOST_KEEP, policy.cut_after_boost)
        return merged

    def _records(self, plan: list, policy: Policy) -> DataFrame:
        embedded = self.embedder.embed([p["question"] for p in plan])
        wanted = [vectors.Search(f"all|{p['qid']}", tuple(float(x) for x in v), policy.per_list)
                  for p, v in zip(plan, embedded)]
        asked = self.spark.createDataFrame([(p["qid"], p["question"], None) for p in plan],
                                           "qid string, question string, subsystem string")
        return self._fused(self._semantic(COMMANDS, wanted), self._lexical(COMMANDS, asked, policy.per_list),
                           policy.final)

    def _days(self, plan: list, policy: Policy) -> DataFrame:
        """Every record of the days asked for; cut in list order where the policy says so."""
        days = self.spark.createDataFrame([(p["qid"], p["day"]) for p in plan], "qid string, date string")
        rows = self.store.table(COMMANDS, "rows").where(F.col("date").isin([p["day"] for p in plan]))
        found = rows.join(F.broadcast(days), "date").select("qid", "id", "ord", "sub_index")
        ranked = top_k(found, ["qid"], [F.col("ord"), F.col("sub_index")], policy.day_limit, "rank")
        return ranked.select("qid", "rank", "id", F.lit(0).alias("list_no"), F.lit(1.0).alias("score"))

    # ---- surfaces ------------------------------------------------------------------------------------
    def plan(self, questions: list[dict]) -> list:
        """What each question asks for; the list is as long as the caller's."""
        rows = [(str(q["qid"]), q["question"], q.get("hint")) for q in questions]
        asked = self.spark.createDataFrame(rows, "qid string, question string, hint string")
        return [r.asDict() for r in understood(asked).collect()]

    def retrieve(self, questions: list[dict], policy: Policy) -> tuple[list, DataFrame]:
        """(plan, results): results ``(qid, rank, id, score, document, metadata...)`` of all questions.

        Day questions without a limit are whole tables, see :meth:`day`; given together with others they are an error
        rather than left out.
        """
        plan = self.plan(questions)
        if not policy.day_limit and (left := [p["qid"] for p in plan if p["route"] == COMMANDS and p["day"]]):
            raise ValueError(f"questions for a whole day go to day(): {', '.join(left)}")
        ranked = {KNOWLEDGE: [p for p in plan if p["route"] == KNOWLEDGE],
                  COMMANDS: [p for p in plan if p["route"] == COMMANDS and not p["day"]]}
        days = [p for p in plan if p["route"] == COMMANDS and p["day"]] if policy.day_limit else []
        parts = []
        if ranked[KNOWLEDGE]:
            parts.append(self._details(KNOWLEDGE, self._knowledge(ranked[KNOWLEDGE], policy)))
        if ranked[COMMANDS]:
            parts.append(self._details(COMMANDS, self._records(ranked[COMMANDS], policy)))
        if days:
            parts.append(self._details(COMMANDS, self._days(days, policy)))
        results = parts[0] if parts else None
        for part in parts[1:]:
            results = results.unionByName(part)
        return plan, results

    def _details(self, collection: str, ranked: DataFrame) -> DataFrame:
        """Bodies and metadata of ranked ids: stored rows for vector hits, index payload for lexical hits. The ranking is
        written once, a few rows a question; its ids reach the scans."""
        ranked = materialize(ranked, "ranked")
        stored = narrowed(self.store.table(collection, "rows").drop("ord", "embedding"), "id", ranked)
        indexed = narrowed(self.store.table(collection, "items").drop("ord"), "id", ranked)
        return (ranked.where("list_no = 0").join(stored, "id")
                .unionByName(ranked.where("list_no = 1").join(indexed, "id")))

    def ready(self) -> dict[str, int]:
        """Load the model once and count what is stored."""
        self.embedder.embed(["warm up"])
        return self.store.counts()

    def day(self, day: str) -> DataFrame:
        """All records of a day in time order, numbered."""
        return command_log.on_day(self.store.table(COMMANDS, "rows"), day)


@dataclass
class Answer:
    """``text`` for short answers; ``table`` for a day's commands, which may be large and stays distributed."""

    question: str
    route: str
    text: str
    results: DataFrame | None = None
    table: DataFrame | None = None
    images: list[str] = field(default_factory=list)

    def sources(self) -> str:
        if self.results is None:
            return ""
        rows = render.citations(self.results).orderBy("nth").select("citation").collect()
        return "\n".join(r["citation"] for r in rows)


def _day_summary(listing: DataFrame, day: str) -> str | None:
    by_subsystem = command_log.counter(listing, "subsystem").collect()
    if not by_subsystem:
        return None
    total = sum(r["n"] for r in by_subsystem)
    shares = ", ".join(f"{r['n']} {r['subsystem']}" for r in by_subsystem)
    by_mnemonic = command_log.counter(listing, "mnemonic").withColumn("line", F.concat(
        F.lit("  "), pad(F.col("n").cast("string"), 3, right=True), F.lit(" ×  "), F.col("mnemonic")))
    lines = [r["line"] for r in by_mnemonic.collect()]      # one a mnemonic
    return "\n".join([f"**{total} commands uplinked on {day}**  ({shares})\n", "Unique commands (count × mnemonic):", *lines])


def ask(retriever: Retriever, question: str, top_k: int = rules.FINAL_K, subsystem: str | None = None,
        generator: Generator | None = None) -> Answer:
    """Route, search, rank, answer."""
    [asked] = retriever.plan([{"qid": "q", "question": question, "hint": subsystem}])
    if asked["route"] == COMMANDS and asked["day"]:
        listing = retriever.day(asked["day"])
        summary = _day_summary(listing, asked["day"])
        if summary is None:
            return Answer(question, COMMANDS, f"No commands found for {asked['day']}.")
        return Answer(question, COMMANDS, summary, table=listing)
    _, results = retriever.retrieve([{"qid": "q", "question": question, "hint": subsystem}], answering(top_k))
    # at most k rows and four boosted ones, from which several short texts derive
    results = retriever.spark.createDataFrame(results.collect(), results.schema)
    if asked["route"] == COMMANDS:
        lines = render.ranked_lines(results).orderBy("rank").collect()
        if not lines:
            return Answer(question, COMMANDS, "No matching command records found.")
        table = [f"Commands matching: **{question}**\n", render.RANKED_HEAD, render.RULE * 90]
        return Answer(question, COMMANDS, "\n".join(table + [r["line"] for r in lines]), results)
    if results.isEmpty():
        return Answer(question, KNOWLEDGE, "No relevant documents found.")
    images = [r["image_file"] for r in render.figure_files(results).orderBy("rank").collect()]
    figure = render.figure_answers(results).first() if asked["image"] else None
    if figure:
        return Answer(question, KNOWLEDGE, figure["answer"], results, images=images)
    context = render.context(results).first()["context"]
    return Answer(question, KNOWLEDGE, generate(generator, question, context), results, images=images)


def generate(generator: Generator | None, question: str, context: str) -> str:
    """The generator's answer; sources stay useful when it fails."""
    if generator is None:
        return "[No answer model configured] The most relevant sources are listed below."
    try:
        return generator(question, context)
    except Exception as reason:
        return (f"[Generation unavailable - {type(reason).__name__}] Retrieval succeeded but the model gave no answer. "
                "The most relevant sources are listed below.")


def panel_answer(retriever: Retriever, question: str, top_k: int = rules.FINAL_K, subsystem: str | None = None,
                 generator: Generator | None = None) -> dict:
    """What an interactive surface shows: a command table, an answer with sources and figures, or an error."""
    try:
        answer = ask(retriever, question, top_k, subsystem, generator)
    except Exception as reason:
        return {"type": "error", "message": str(reason)}
    if answer.table is not None:
        return {"type": "commands", "summary": answer.text, "rows": command_log.table_view(answer.table.orderBy("nth")),
                "top_mnemonics": command_log.counter(answer.table, "mnemonic").limit(5)}
    return {"type": "knowledge", "answer": answer.text, "sources": answer.results, "images": answer.images}


def panel_figures(images: list[str], shown: int = 3) -> tuple[list[str], int]:
    """The figures to show, first those that exist on this machine, and how many more there are."""
    present = [path for path in images if os.path.exists(path)]
    return present[:shown], max(0, len(present) - shown)
