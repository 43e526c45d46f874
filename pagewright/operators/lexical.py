"""BM25 over distinct tokens: index tables, scoring of one question in place, scoring of many by join."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright import rules
from pagewright.functions.text import tokens
from pagewright.operators.ordered import top_k
from pagewright.session import materialize

SEED_FACTOR = 100     # texts per wanted result that the seed terms may bring
_SLACK = 1e-6         # scores are compared after rounding, so the bar is set a little lower
_TEXTS = ""      # no token is empty, so the count of this mark is the number of texts


def tokenized(corpus: DataFrame, keep: list[str], text: Column) -> DataFrame:
    """(kept columns, tokens, dl). The one-element explode keeps the tokens from being worked out again wherever a
    later step mentions them."""
    return corpus.select(*keep, F.explode(F.array(tokens(text))).alias("tokens")).withColumn("dl", F.size("tokens"))


def postings(rows: DataFrame, keep: list[str]) -> DataFrame:
    return rows.select(*keep, "dl", F.explode("tokens").alias("term"))


def term_counts(rows: DataFrame) -> DataFrame:
    """Texts per term, and the number of texts under the mark: everything BM25 needs from one pass.

    Counts are combined inside each task before they shuffle, so a term in every text costs one row per task.
    """
    marked = F.concat(F.array(F.lit(_TEXTS)), F.col("tokens"))
    return rows.select(F.explode(marked).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _raw_idf(texts: Column) -> Column:
    return F.log(texts - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


class Stats:
    """Corpus size, mean length and the idf of every term.

    Built from a written table of term counts, so the texts are tokenized once however many numbers derive from it.
    Only three numbers reach the driver; ``numbers``, written by an earlier call of :meth:`summed`, save their passes.
    """

    def __init__(self, counts: DataFrame, numbers: DataFrame | None = None):
        row = (self.summed(counts) if numbers is None else numbers).first()
        self.n = row["n"]
        self.avgdl = row["total"] / row["n"] if row["n"] else 0.0
        self.floor = float((row["mean"] or 0.0) * rules.BM25_EPSILON)
        floor, raw = F.lit(self.floor), _raw_idf(F.lit(self.n))
        self.terms = counts.where(F.col("term") != _TEXTS).select("term", "df", F.when(raw < 0, floor).otherwise(raw).alias("idf"))

    @staticmethod
    def summed(counts: DataFrame) -> DataFrame:
        """One row ``(n, total, mean)``: texts, terms of all texts, mean of the terms' raw idf."""
        is_mark = F.col("term") == _TEXTS
        texts = counts.where(is_mark).agg(F.coalesce(F.max("df"), F.lit(0)).alias("n")).first()["n"]
        # a text's token count is its number of distinct terms, so document frequencies add up to all lengths
        return counts.where(~is_mark).agg(
            F.lit(texts).cast("bigint").alias("n"), F.coalesce(F.sum("df"), F.lit(0)).alias("total"),
            F.avg(_raw_idf(F.lit(texts))).alias("mean"))

    @classmethod
    def counted(cls, rows: DataFrame) -> "Stats":
        return cls(materialize(term_counts(rows), "term-counts"))

    def corpus(self, spark) -> DataFrame:
        return spark.createDataFrame([(self.n, float(self.avgdl))], "n bigint, avgdl double")


def length_weight(dl: Column, avgdl: Column) -> Column:
    """Weight of one occurrence in a text of this length (a distinct token occurs once)."""
    k1, b = rules.BM25_K1, rules.BM25_B
    return F.lit(k1 + 1) / (F.lit(1.0) + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / avgdl))


def score_question(rows: DataFrame, question: str, stats: Stats | None = None) -> DataFrame:
    """Positive scores for one question. Each text is scored inside its row; nothing but the term counts shuffles.

    The weights fetched are those of the question's own terms.
    """
    stats = stats or Stats.counted(rows)
    asked = tokens(F.lit(question))
    weights = {r["term"]: r["idf"] for r in stats.terms.where(F.array_contains(asked, F.col("term"))).collect()}
    if not weights:
        return rows.limit(0).drop("tokens", "dl").withColumn("score", F.lit(0.0))
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    shared = F.array_intersect(F.array(*[F.lit(t) for t in weights]), F.col("tokens"))
    total = F.aggregate(shared, F.lit(0.0), lambda acc, t: acc + weight[t])
    scored = rows.withColumn("score", total * length_weight(F.col("dl"), F.lit(stats.avgdl)))
    return scored.drop("tokens", "dl").where("score > 0")


def score_questions(found: DataFrame, questions: DataFrame, keep: list[str], stats: Stats) -> DataFrame:
    """All positive scores (qid, kept columns, score) of ``questions(qid, question)`` over ``postings`` rows.

    Every text that shares a term with a question gets a row, so common terms make this as large as questions times
    texts: use :func:`candidates` where only the best are wanted.
    """
    weighted = _asked(questions, stats).select("qid", "term", "idf")
    return _weigh(found.join(weighted, "term"), keep, stats).select("qid", *keep, "score").where("score > 0")


def _asked(questions: DataFrame, stats: Stats) -> DataFrame:
    terms = questions.select("qid", F.explode(tokens(F.col("question"))).alias("term"))
    return terms.join(stats.terms, "term")


def _weigh(matched: DataFrame, keep: list[str], stats: Stats) -> DataFrame:
    """A text's terms come from one task, so its sum is complete before it shuffles."""
    summed = matched.groupBy("qid", *keep, "dl").agg(F.sum("idf").alias("idf"))
    return summed.withColumn("score", F.col("idf") * length_weight(F.col("dl"), F.lit(stats.avgdl)))


BLOCK_TEXTS = 4096    # texts of a block, about


def blocked(found: DataFrame, keep: list[str], stats: Stats) -> DataFrame:
    """Postings ``(kept columns, dl, term)`` in blocks ``(term, least_dl, texts)`` of texts of like length, so that the shortest of a
    block bounds what any of its texts can score. A term in very many texts is cut by a hash of the text, too."""
    sized = found.join(stats.terms.select("term", "df"), "term")
    # a quarter of a doubling a band
    band, part = F.floor(4 * F.log2(F.col("dl"))), F.pmod(F.xxhash64(keep[0]), F.ceil(F.col("df") / BLOCK_TEXTS))
    return sized.groupBy("term", band.alias("_band"), part.alias("_part")).agg(
        F.min("dl").alias("least_dl"), F.collect_list(F.struct(*keep, "dl")).alias("texts")).drop("_band", "_part")


class Blocks:
    """Blocked postings (written, sorted by term) as :func:`candidates` reads them: blocks whose shortest text stays below
    a question's bar are dropped before their texts are unpacked."""

    def __init__(self, rows: DataFrame, avgdl: float):
        self.rows, self.avgdl = rows, avgdl

    def read(self, terms: DataFrame) -> DataFrame:
        """Texts of ``terms(qid, term, idf, needed)``, ``needed`` being the least length weight that can reach the bar."""
        met = self.rows.join(terms, "term").where(length_weight(F.col("least_dl"), F.lit(self.avgdl)) >= F.col("needed"))
        rest = [c for c in terms.columns if c not in ("term", "needed")]
        return met.select("term", *rest, F.explode("texts").alias("_t")).select("term", *rest, "_t.*")


def candidates(found: "DataFrame | Blocks", questions: DataFrame, keep: list[str], stats: Stats, k: int) -> DataFrame:
    """Positive scores of every text that can be among a question's best ``k``; ``keep[0]`` identifies a text.

    The rarest terms of a question alone give ``k`` texts whose scores the best must reach. Terms that together stay
    below that bar cannot lift a text over it, so only the other, rarer terms name candidates; the common ones are added
    to candidates afterwards. The result holds the exact best ``k``. Where weights can be negative, so that a sum of
    terms is no upper bound, every text is scored instead.
    """
    def read(terms: DataFrame) -> DataFrame:
        if isinstance(found, Blocks):
            return found.read(terms if "needed" in terms.columns else terms.withColumn("needed", F.lit(0.0)))
        return found.join(terms.drop("needed"), "term")

    asked = materialize(_asked(questions, stats), "question-terms")
    if stats.floor < 0:
        matched = read(asked.select("qid", "term", "idf"))
        return _weigh(matched, keep, stats).select("qid", *keep, "score").where("score > 0")
    per_question = W.partitionBy("qid")      # as many rows as the question has terms
    rare_first = per_question.orderBy("df", "term").rowsBetween(W.unboundedPreceding, -1)
    seeds = asked.withColumn("_before", F.coalesce(F.sum("df").over(rare_first), F.lit(0))).where(
        F.col("_before") < SEED_FACTOR * k)
    bar = _reached(_weigh(read(seeds.select("qid", "term", "idf")), keep, stats), k)
    cheap_first = per_question.orderBy("idf", "term").rowsBetween(W.unboundedPreceding, 0)
    heaviest = length_weight(F.lit(1), F.lit(stats.avgdl))
    common = F.sum("idf").over(cheap_first) * heaviest < F.coalesce("bar", F.lit(0.0))
    # a text that holds all of a question's terms still has to be short enough
    needed = F.coalesce("bar", F.lit(0.0)) / F.greatest(F.sum("idf").over(per_question), F.lit(1e-300)) * (1 - _SLACK)
    split = materialize(asked.join(bar, "qid", "left").withColumns({"common": common, "needed": needed}), "weighed-terms")
    rest = split.groupBy("qid").agg(F.sum(F.when(F.col("common"), F.col("idf")).otherwise(0.0)).alias("rest"),
                                    F.coalesce(F.max("bar"), F.lit(0.0)).alias("bar"))
    named = _weigh(read(split.where(~F.col("common")).select("qid", "term", "idf", "needed")), keep, stats)
    weight = length_weight(F.col("dl"), F.lit(stats.avgdl))
    reach = (F.col("idf") + F.col("rest")) * weight
    named = materialize(named.join(rest, "qid").where(reach >= F.col("bar")).drop("bar"), "named-texts")
    # what the rarer terms alone reach is a higher bar for the common ones to lift a text over
    raised = _reached(named, k)
    able = named.join(raised, "qid").where(reach >= F.col("bar")).select("qid", *keep, "dl", "idf")
    able = materialize(able, "candidates")
    text_id = keep[0]
    commons = split.where("common").select("qid", "term", F.col("idf").alias("more"))
    # of a term that several questions ask for, the lowest need decides
    more_needed = F.greatest("needed", F.coalesce("raised", F.lit(0.0)) / F.greatest("whole", F.lit(1e-300)) * (1 - _SLACK))
    sums = asked.groupBy("qid").agg(F.sum("idf").alias("whole")).join(raised.withColumnRenamed("bar", "raised"), "qid")
    asking = split.where("common").join(sums, "qid").groupBy("term").agg(F.min(more_needed).alias("needed"))
    held = read(asking).select(text_id, "term")
    more = (able.select("qid", text_id).join(held, text_id).join(commons, ["qid", "term"])
            .groupBy("qid", text_id).agg(F.sum("more").alias("more")))
    whole = F.col("idf") + F.coalesce("more", F.lit(0.0))
    return able.join(more, ["qid", text_id], "left").select("qid", *keep, (whole * weight).alias("score")).where("score > 0")


TASK_PAIRS = 1 << 19  # pairs of a question and a text that a task holds at once, about


def batch_best(rows: DataFrame, questions: DataFrame, keep: list[str], stats: Stats, k: int) -> DataFrame:
    """Best ``k`` of each of ``questions(qid, question)`` over ``tokenized`` rows without postings; ``keep[0]`` identifies a text.

    Texts are dealt to as many tasks as texts times questions ask for, so what a task holds does not grow with the table. A text's
    terms stay together: its scores are complete where they are summed, and only the best of each task shuffle. The right way
    for questions of frequent terms, where :func:`candidates` names most texts of most questions.
    """
    asked = materialize(_asked(questions, stats).select("qid", "term", "idf"), "question-terms")
    pairs = stats.n * asked.select("qid").distinct().count()
    dealt = rows.repartition(max(1, -(-pairs // TASK_PAIRS)), keep[0])
    scored = _weigh(postings(dealt, keep).join(F.broadcast(asked), "term"), keep, stats)
    return best(scored.select("qid", *keep, "score").where("score > 0"), ["qid"], k, keep)


def _reached(scored: DataFrame, k: int) -> DataFrame:
    """(qid, bar): what the best ``k`` of a question reach at least, nothing while there are fewer."""
    held = top_k(scored.select("qid", "score"), ["qid"], [F.col("score").desc()], k)
    return held.groupBy("qid").agg(
        F.when(F.count("*") == k, F.min("score") - _SLACK).otherwise(F.lit(0.0)).alias("bar"))


def best(scored: DataFrame, keys: list[str], k: int, order: list[str], post: Column | None = None,
         filtered: Column | None = None) -> DataFrame:
    """Top ``k`` per key by score, ties by the ``order`` columns, rank in ``rank``.

    With ``post``, keys with ``filtered`` true take three times as many and drop those that fail ``post`` afterwards,
    which can leave fewer than ``k``.
    """
    order = [F.round("score", 9).desc(), *order]
    if post is None:
        return top_k(scored, keys, order, k)
    wide = top_k(scored, keys, order, k * rules.POSTFILTER_FACTOR, "_wide")
    kept = wide.where(F.when(filtered, post).otherwise(F.col("_wide") <= k))
    return top_k(kept, keys, [F.col("_wide")], k).drop("_wide")
