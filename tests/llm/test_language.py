"""Language identification: held-out accuracy, mixtures, odd texts."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import language
from tests.llm.tables import documents, empty


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs, language.learn(docs)).where(language.held_out(F.col("doc_id")))
    right, total = found.where("lang_pred = lang").count(), found.count()
    assert total > 100 and right / total >= 0.97
    assert found.where("score < 0 OR score > 1").count() == 0


def test_mixtures(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn(docs)
    by = {}
    for row in docs.where("n_chars > 2000").orderBy("doc_id").collect():
        by.setdefault(row["lang"], row["text"][:2000])
    both = language.infer(by["en"] + "\n" + by["fr"], model)
    assert set(both) == {"en", "fr"} and all(0.3 < p < 0.7 for p in both.values())
    alone = language.infer(by["de"], model)
    assert max(alone, key=alone.get) == "de" and alone["de"] > 0.9


def test_odd_texts(spark):
    docs = documents(spark)
    found = {(r["doc_id"], r["text"]): r for r in language.identify(docs, language.learn(docs)).collect()}
    for (_, text), row in found.items():
        letters = any(c.isalpha() for c in text or "")
        assert row["lang_pred"] == ("en" if letters else "und") and (row["score"] > 0) == letters
    nothing = language.learn(empty(spark))
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(empty(spark), nothing).count() == 0


def test_learning_leaves_held_out_rows_alone(spark):
    rows = [(i, "aaa bbb" if i % 2 else "ccc ddd", "x" if i % 2 else "y") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    other = docs.withColumn("text", F.when(language.held_out(F.col("doc_id")), "zzz").otherwise(F.col("text")))
    a, b = language.learn(docs), language.learn(other)
    assert a.rows == b.rows and np.array_equal(a.gains, b.gains) and np.array_equal(a.unseen, b.unseen)


def test_rows_without_ids_are_drawn_one_by_one(spark):
    schema = "doc_id bigint, text string, lang string"
    rows = [(None, f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]}", "x") for i in range(600)]
    rows += [(1, "same same", "y")] * 600
    model = language.learn(spark.createDataFrame(rows, schema), per_language=60)
    assert model.languages == ["x", "y"]
    counts = np.exp(model.gains) * language.SMOOTHING - language.SMOOTHING
    starts = sum(counts[model.starts[i]] for gram, i in model.rows.items() if gram.startswith(" w"))
    assert 30 <= starts <= 90 and round(counts[model.starts[model.rows["sam"]]]) == 2


def test_any_number_of_labels(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = [f"{a}{b}{a}{b}{b}{a}" for a in letters for b in letters if a != b] + [f"{a}{b}{b}{b}{a}{a}" for a in letters for b in letters if a != b]
    rows = [(4 * i + j, f"{own[i]} {own[i]} common words", f"label{i:04}") for i in range(1000) for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.learn(docs)
    assert len(model.languages) == 1000
    found = language.identify(docs, model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) >= 0.97 * len(found)
    few = language.learn(docs.union(docs.where("lang = 'label0007'").selectExpr("doc_id + 10000", "text", "lang")), languages=5)
    assert "label0007" in few.languages and len(few.languages) == 5


def brute_proportions(found, model):
    """The mixture word by word in plain Python, over all languages."""
    held = {}
    for gram, i in model.rows.items():
        for at in range(model.starts[i], model.starts[i + 1]):
            held[gram, model.columns[at]] = model.gains[at]
    k = len(model.languages)
    logs = [[sum(model.unseen[c] + held.get((g, c), 0.0) for g in language.grams(w)) for c in range(k)] for w in found]
    p = [[math.exp(x - max(row)) for x in row] for row in logs]
    share = [1 / k] * k
    for _ in range(language.STEPS):
        new = [0.0] * k
        for row in p:
            each = sum(a * b for a, b in zip(row, share))
            for c in range(k):
                new[c] += share[c] * row[c] / each / len(p)
        moved, share = max(abs(a - b) for a, b in zip(new, share)), new
        if moved < language.SETTLED:
            break
    return share, sum(math.log(sum(a * b for a, b in zip(row, share))) for row in p), p


def test_agrees_with_plain_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.learn(docs)
    store = language.Words(model)
    for row in docs.where("length(text) BETWEEN 30 AND 3000").orderBy("doc_id").limit(25).collect():
        found = language.words(row["text"])
        share, value, p = brute_proportions(found, model)
        tally = Counter(found)
        n = np.fromiter(tally.values(), float, len(tally))
        ours, best = language.estimate(store.likelihoods(list(tally)), n)
        assert np.allclose(ours, share, atol=1e-6) and abs(best - value) < 1e-6 * max(1, abs(value))
        # the set: in order of proportions, as long as one more gains over the penalty
        order, taken, so_far = sorted(range(len(share)), key=lambda c: -share[c]), 0, None
        for size in range(1, len(share) + 1):
            value = language.estimate(np.array([[w[c] for c in order[:size]] for w in p]), np.ones(len(p)))[1]
            if so_far is not None and value - so_far <= language.PENALTY * math.log(1 + len(found)):
                break
            taken, so_far = size, value
        assert set(language.infer(row["text"], store)) == {model.languages[c] for c in order[:taken]}


def test_no_letters_no_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn(docs)
    foreign = "это совсем другой язык и его никто здесь не учил "
    told = {text: language.explained(text, model)[1] for text in (foreign * 50, foreign, "это", "...", "12 34", "", None)}
    assert told == {foreign * 50: True, foreign: True, "это": True, "...": False, "12 34": False, "": False, None: False}
    assert language.identify(docs, model).where("NOT told").count() == 0


def test_pipeline_keeps_texts_where_no_language_is_known(spark):
    docs = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.known_language(spark, docs, "").collect()
    letters = [r for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")]
    assert len(kept) == len(letters) > 0
    rows = [(i, "one two three", "en") for i in range(40)] + [(100, "это совсем другой язык " * 10, None)]
    mixed = spark.createDataFrame([(*r, "s", 0) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r["doc_id"] for r in corpus_pipeline.known_language(spark, mixed, "").collect()} == {*range(40), 100}


def test_proportions_add_up():
    p = np.random.default_rng(2).random((50, 4))
    share, _ = language.estimate(p, np.ones(50))
    assert abs(share.sum() - 1) < 1e-9
