"""Language identification of mixed texts.

A document is a mixture: each of its words comes from one language, with the document's proportions as the weights, and
a word's likelihood in a language is the product over its character n-grams. Expectation-maximisation estimates the
proportions. Languages are then taken in order of their proportions for as long as the likelihood, re-estimated over
those taken, gains more than the penalty for one more; what is left is the document's language set.

The n-gram counts are learned from rows whose crc32(id) mod 4 is not 2: about ``per_language`` labelled rows of each of
the ``languages`` labels that most of them have (ties by code point), by a digest of id and text; whole texts; rows that agree in
language, id and text count once. Both numbers are documented bounds of the sample: the model stops growing with the corpus, and a column full of
dirty labels does not fill the driver. Of each language the ``GRAMS`` most frequent are kept. A prediction reads the text alone.

Null texts, and texts without a letter, are ``und`` with score 0. So is every text where nothing could be learned. Equal
proportions go to the language first by code point. Repeated rows are predicted each. Texts are read whole; one holds
as many numbers in its worker as it has distinct words times languages.

``told`` says whether a text holds anything to tell a language by: a letter. A text in a language that has no labelled rows is told like any other.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.llm.common import release, releasing, text_key

UNKNOWN = "und"
GRAM = 3
PER_LANGUAGE = 2000
#: Grams kept of each language: its most frequent, ties by code point.
GRAMS = 50_000
#: Labels that are learned.
LANGUAGES = 1024
SMOOTHING = 0.1
STEPS = 30
SETTLED = 1e-3
#: Penalty in log-likelihood for each further language, times the logarithm of the number of words.
PENALTY = 2.0
#: Words whose likelihoods a task keeps, the numbers they may take, and the longest kept; the store is emptied when full,
#: which costs time only.
KEPT = 200_000
KEPT_CELLS = 4_000_000
KEPT_CHARS = 40

RUN = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Runs of letters in lower case."""
    found = RUN.findall(text.lower())
    if text.isascii():
        return found
    return [w for w in (x if x.isalpha() else "".join(filter(str.isalpha, x)) for x in found) if w]


def grams(word: str) -> list[str]:
    held = f" {word} "
    return [held[i:i + GRAM] for i in range(len(held) - GRAM + 1)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    """What grams add to the log-likelihood of one never seen (``unseen``, by language): gram ``i`` adds ``gains`` in
    ``columns``, both from ``starts[i]`` to ``starts[i + 1]``."""

    languages: list[str]
    rows: dict[str, int]
    starts: np.ndarray
    columns: np.ndarray
    gains: np.ndarray
    unseen: np.ndarray

    def likelihoods(self, found: list[str]) -> np.ndarray:
        """Of each word a row: likelihoods by language, the best set to 1."""
        width, rows = len(self.languages), self.rows.get
        out = np.empty((len(found), width))
        step = max(1, KEPT_CELLS // (8 * width))
        for first in range(0, len(found), step):
            lists = [grams(w) for w in found[first:first + step]]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            held = np.fromiter((rows(g, -1) for one in lists for g in one), np.int64)
            word = np.repeat(np.arange(len(lists)), sizes)[held >= 0]
            held = held[held >= 0]
            many = self.starts[held + 1] - self.starts[held]
            entry = np.repeat(self.starts[held] - np.cumsum(many) + many, many) + np.arange(many.sum())
            cells = np.repeat(word, many) * width + self.columns[entry]
            sums = np.bincount(cells, self.gains[entry], len(lists) * width).reshape(-1, width) + sizes[:, None] * self.unseen
            out[first:first + len(lists)] = np.exp(sums - sums.max(axis=1, keepdims=True))
        return out


class Words:
    """A model, and the likelihoods of words met before. It lives as long as a task."""

    def __init__(self, model: Model):
        self.model, self.kept = model, {}
        self.most = min(KEPT, KEPT_CELLS // max(1, len(model.languages)))
        self.held = np.empty((0, len(model.languages)))

    def likelihoods(self, found: list[str]) -> np.ndarray:
        """As of the model, for distinct words."""
        if len(self.kept) + len(found) > self.most:
            self.kept.clear()
        if len(found) > self.most or any(len(w) > KEPT_CHARS for w in found):
            return self.model.likelihoods(found)
        new = [w for w in found if w not in self.kept]
        if new:
            first = len(self.kept)
            if first + len(new) > len(self.held):
                more = np.empty((min(self.most, 2 * (first + len(new))), self.held.shape[1]))
                more[:first] = self.held[:first]
                self.held = more
            self.held[first:first + len(new)] = self.model.likelihoods(new)
            self.kept.update(zip(new, range(first, first + len(new)), strict=True))
        return self.held[np.fromiter(map(self.kept.__getitem__, found), np.int64, len(found))]


def learn(df: DataFrame, text: str = "text", language: str = "lang", doc_id: str = "doc_id", per_language: int = PER_LANGUAGE,
          languages: int = LANGUAGES, most_grams: int | None = GRAMS) -> Model:
    """Count the grams of the learning rows by language; ``most_grams`` None keeps all of them."""
    rows = df.where(F.col(language).isNotNull() & ~held_out(F.col(doc_id)))
    rows = rows.where(F.col(text).isNotNull()).select(
        F.col(language).alias("_lang"), F.col(doc_id).cast("string").alias("_id"), text_key(F.col(text)).alias("_key"), F.col(text).alias("_text"))
    labels = rows.select("_lang", "_id", "_key").distinct().groupBy("_lang").count()
    counts = labels.orderBy(F.desc("count"), "_lang").limit(languages).collect()
    if len(counts) == languages:
        rows = rows.where(F.col("_lang").isin([r["_lang"] for r in counts]))
    # shares by language are literals: a shuffle by language would put a common one into one task
    shares = [x for r in counts if r["count"] > per_language for x in (F.lit(r["_lang"]), F.lit(per_language / r["count"]))]
    draw = F.pmod(F.xxhash64("_id", "_key", F.lit(4)), F.lit(2**31)) / 2**31
    if shares:
        rows = rows.where(draw < F.coalesce(F.try_element_at(F.create_map(*shares), F.col("_lang")), F.lit(1.0)))
    drawn = rows.dropDuplicates(["_lang", "_id", "_key"])

    @releasing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, held in zip(batch.column("_lang").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                tally = found.setdefault(lang, Counter())
                for word, n in Counter(words(held)).items():
                    for gram in grams(word):
                        tally[gram] += n
            cells = [(lang, gram, n) for lang, tally in found.items() for gram, n in tally.items()]
            if cells:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*cells, strict=True)], ["lang", "gram", "n"])

    tallied = drawn.select("_lang", "_text").mapInArrow(count, "lang string, gram string, n bigint")
    summed = tallied.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    if most_grams is not None:                    # cut in the tasks: the driver gets no more than it keeps
        by_count = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
        summed = summed.withColumn("_nth", F.row_number().over(by_count)).where(F.col("_nth") <= most_grams).drop("_nth")
    held = summed.toArrow()
    return modelled(held.column("lang").to_pylist(), held.column("gram").to_pylist(), held.column("n").to_numpy().astype(float))


def modelled(langs: list[str], names: list[str], n: np.ndarray) -> Model:
    """The model of gram counts: a row each of language, gram, count."""
    languages, known = sorted(set(langs)), sorted(set(names))
    rows, place = {gram: i for i, gram in enumerate(known)}, {lang: i for i, lang in enumerate(languages)}
    row = np.fromiter(map(rows.__getitem__, names), np.int64, len(names))
    column = np.fromiter(map(place.__getitem__, langs), np.int32, len(langs))
    order = np.lexsort((column, row))
    row, column, n = row[order], column[order], n[order]
    starts = np.searchsorted(row, np.arange(len(known) + 1))
    total = np.bincount(column, n, len(languages)) + SMOOTHING * (len(known) + 1)
    return Model(languages, rows, starts, column, np.log((n + SMOOTHING) / SMOOTHING), np.log(SMOOTHING / total))


def estimate(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of ``n`` words with likelihoods ``p``."""
    share, total = np.full(p.shape[1], 1.0 / p.shape[1]), n.sum()
    if p.shape[1] == 1:
        return share, float(n @ np.log(np.maximum(p[:, 0], 1e-300)))
    for _ in range(STEPS):
        each = np.maximum(p @ share, 1e-300)
        new = share * (p.T @ (n / each)) / total
        moved = np.abs(new - share).max()
        share = new
        if moved < SETTLED:
            break
    return share, float(n @ np.log(np.maximum(p @ share, 1e-300)))


def infer(text: str | None, model: Model | Words) -> dict[str, float]:
    """Languages of a text and their proportions, largest first; empty where there is none."""
    return explained(text, model)[0]


def explained(text: str | None, model: Model | Words) -> tuple[dict[str, float], bool]:
    """``infer``, and whether the text is told."""
    tally = Counter(words(text)) if text else {}
    languages = model.languages if isinstance(model, Model) else model.model.languages
    if not tally or not languages:
        return {}, bool(tally)
    n = np.fromiter(tally.values(), float, len(tally))
    p = model.likelihoods(list(tally))
    share, _ = estimate(p, n)
    order = np.argsort(-share, kind="stable")
    penalty = PENALTY * np.log(1 + n.sum())
    kept, best = estimate(p[:, order[:1]], n)
    for size in range(2, len(order) + 1):
        share, value = estimate(p[:, order[:size]], n)
        if value - best <= penalty:
            break
        kept, best = share, value
    ranked = sorted(zip(kept.tolist(), (languages[i] for i in order), strict=False), key=lambda x: (-x[0], x[1]))
    return {language: proportion for proportion, language in ranked}, True


def proportions(text: Column, model: Model) -> Column:
    """(languages, told): an array of (language, proportion), largest first. The model is sent to the tasks once."""
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast(model)
    cell = pa.struct([("language", pa.string()), ("proportion", pa.float64())])

    @F.arrow_udf("struct<languages:array<struct<language:string,proportion:double>>,told:boolean>")
    def inferred(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Words(shared.value)
        for texts in batches:
            found = [explained(t.as_py(), model) for t in texts]
            languages = pa.array([[{"language": k, "proportion": v} for k, v in x.items()] for x, _ in found], pa.list_(cell))
            yield pa.StructArray.from_arrays([languages, pa.array([told for _, told in found], pa.bool_())], ["languages", "told"])
        del model
        release()

    return inferred(text)


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``languages`` (the set, with proportions), ``lang_pred``, ``score`` (the largest proportion), ``told``."""
    found = df.withColumn("_found", proportions(F.col(text), model))
    found = found.withColumns({"languages": F.col("_found.languages"), "told": F.col("_found.told")}).drop("_found")
    top = F.try_element_at("languages", F.lit(1))
    return found.withColumns({"lang_pred": F.coalesce(top["language"], F.lit(UNKNOWN)), "score": F.coalesce(top["proportion"], F.lit(0.0))})
