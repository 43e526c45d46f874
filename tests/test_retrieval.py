"""Search, fusion and lookups against brute force."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.models import HashingEmbedder
from pagewright.operators import fusion, lexical, lookup, ordered, vectors
from pagewright.plans import store
from pagewright.session import intermediates, shared_dir
from tests.test_text import brute_tokens

TEXTS = ["obc switch on", "obc switch off procedure", "the star sensor", "the the a/b", "", "obc", "wheel wde the",
         "switch on obc", "the obc", "the end"]


def brute_bm25(texts, question):
    docs = [brute_tokens(t) for t in texts]
    n, avgdl = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for t in d:
            df[t] = df.get(t, 0) + 1
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: floor if v < 0 else v for t, v in raw.items()}
    return [sum(idf.get(q, 0) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for q in brute_tokens(question) if q in d)
            for d in docs]


@pytest.fixture(scope="module")
def corpus(spark):
    return lexical.tokenized(spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string"), ["id"], F.col("text"))


@pytest.mark.parametrize("question", ["switch on OBC", "the", "nothing known", "a/b the wheel"])
def test_bm25_in_row_and_by_join(spark, corpus, question):
    stats = lexical.Stats.counted(corpus)
    expected = {i: s for i, s in enumerate(brute_bm25(TEXTS, question)) if s > 0}
    single = {r["id"]: r["score"] for r in lexical.score_question(corpus, question, stats).collect()}
    asked = spark.createDataFrame([("q", question)], "qid string, question string")
    joined = {r["id"]: r["score"] for r in
              lexical.score_questions(lexical.postings(corpus, ["id"]), asked, ["id"], stats).collect()}
    assert single == pytest.approx(expected) and joined == pytest.approx(expected)


def test_empty_corpus(spark):
    rows = lexical.tokenized(spark.createDataFrame([], "id int, text string"), ["id"], F.col("text"))
    assert lexical.score_question(rows, "x").count() == 0


def test_postfilter_takes_three_times_k_first(spark):
    rows = spark.createDataFrame([("q", i, 10.0 - i, "A" if i in (1, 7) else "B") for i in range(9)],
                                 "qid string, ord int, score double, tag string")
    kept = lexical.best(rows, ["qid"], 2, ["ord"], F.col("tag") == "A", F.lit(True))
    assert [(r["ord"], r["rank"]) for r in kept.orderBy("rank").collect()] == [(1, 1)]
    free = lexical.best(rows, ["qid"], 2, ["ord"], F.col("tag") == "A", F.lit(False))
    assert [r["ord"] for r in free.orderBy("rank").collect()] == [0, 1]


def test_vector_search_matches_numpy_with_ties_and_filters(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8)).astype(np.float32)
    data = np.vstack([base, base[:20]])          # copies tie
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    rows = [(f"v{i}", i, [float(x) for x in v], "A" if i % 3 else "B") for i, v in enumerate(data)]
    store = spark.createDataFrame(rows, "id string, ord bigint, embedding array<float>, tag string").repartition(6)
    queries = [tuple(float(x) for x in data[j]) for j in range(5)]
    searches = [vectors.Search(f"s{j}", q, 3 + j, *(("tag", ("A",)) if j % 2 else ())) for j, q in enumerate(queries)]
    monkeypatch.setattr(vectors, "QUERY_BYTES", 3 * 64)
    got = vectors.search(store, searches, "id", ["ord"]).collect()
    for j, s in enumerate(searches):
        scores = np.round(data.astype(float) @ np.array(s.vector), 9)
        allowed = [i for i in range(len(data)) if not s.column or i % 3]
        best = sorted(allowed, key=lambda i: (-scores[i], i))[:s.k]
        assert [r["ord"] for r in sorted((r for r in got if r["list_key"] == s.key), key=lambda r: r["rank"])] == best


def test_vectors_of_another_width_are_refused(spark):
    store = spark.createDataFrame([("a", 1, [1.0, 0.0])], "id string, ord bigint, embedding array<float>")
    with pytest.raises(Exception, match="differ in width"):
        vectors.search(store, [vectors.Search("s", (1.0, 0.0, 0.0), 1)], "id", ["ord"]).collect()


def test_fusion(spark):
    lists = [("q", 0, 1, "a", "v"), ("q", 0, 2, "b", "v"), ("q", 1, 1, "c", "l"), ("q", 1, 2, "a", "l")]
    df = spark.createDataFrame(lists, "qid string, list_no int, rank int, id string, origin string")
    rows = fusion.fuse(df, ["qid"], "id", ["origin"], 5).orderBy("rank").collect()
    assert [(r["id"], r["origin"]) for r in rows] == [("a", "l"), ("c", "l"), ("b", "v")]
    assert rows[0]["rrf"] == pytest.approx(1 / 61 + 1 / 62)
    only = fusion.fuse(df.where("list_no = 1"), ["qid"], "id", ["origin"], 1).collect()
    assert [r["id"] for r in only] == ["c"]


def test_fusion_order_of_lists_only_breaks_ties(spark):
    rng = random.Random(2)
    ids = [f"d{i}" for i in range(12)]
    first, second = rng.sample(ids, 8), rng.sample(ids, 8)

    def scores(one, two):
        rows = [("q", n, i + 1, d) for n, ranked in enumerate((one, two)) for i, d in enumerate(ranked)]
        df = spark.createDataFrame(rows, "qid string, list_no int, rank int, id string")
        return {r["id"]: round(r["rrf"], 12) for r in fusion.fuse(df, ["qid"], "id", ["list_no"], 99).select("id", "rrf").collect()}

    assert scores(first, second) == scores(second, first)


def test_put_in_front(spark):
    schema = "qid string, rank int, id string"
    front = spark.createDataFrame([("q", 1, "x"), ("q", 2, "b"), ("q", 3, "y")], schema)
    back = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("q", 3, "c"), ("p", 1, "z")], schema)
    rows = fusion.put_in_front(front, back, ["qid"], "id", 2).orderBy("qid", "rank").collect()
    assert [tuple(r) for r in rows] == [("p", 1, "z"), ("q", 1, "x"), ("q", 2, "b"), ("q", 3, "a"), ("q", 4, "c")]
    assert fusion.put_in_front(front, back, ["qid"], "id", 2, 3).where("qid = 'q'").count() == 3


@pytest.mark.parametrize("width", [2, 5, 4096])
def test_nearest_chunk(spark, width):
    rng = random.Random(width)
    chunks = [(i, rng.choice("AB"), rng.choice([None, 0, 2, 3, 5, 8, 8, 13])) for i in range(25)]
    figures = [(i, rng.choice("ABC"), rng.choice([None, *range(1, 16)])) for i in range(60)]
    right = spark.createDataFrame(chunks, "ord int, doc string, page int").where("coalesce(page, 0) <> 0")
    left = spark.createDataFrame(figures, "fid int, doc string, page int")
    got = {r["fid"]: r["hit_ord"] for r in lookup.asof(
        left, right, ["doc"], "page", "ord", ["ord"], clamp=True, segment_width=width).collect()}
    assert len(got) == len(figures)
    for fid, doc, page in figures:
        own = sorted((p, o) for o, d, p in chunks if d == doc and p)
        later = [o for p, o in own if page is not None and p >= page]
        expected = None if not own else own[0][1] if page is None else later[0] if later else own[-1][1]
        assert got[fid] == expected


def test_backward_lookup(spark):
    right = spark.createDataFrame([("A", 0, 1), ("A", 7, 2)], "doc string, at int, page int")
    left = spark.createDataFrame([("A", x) for x in (-1, 0, 6, 7, 900)], "doc string, at int")
    rows = lookup.asof(left, right, ["doc"], "at", "page", ["page"], "backward", segment_width=3).orderBy("at").collect()
    assert [r["hit_page"] for r in rows] == [None, 1, 1, 2, 2]


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_segmented_scan_equals_plain_order(spark, size):
    rng = random.Random(size)
    rows = [(rng.choice("AAAB"), i, rng.choice([None, 1, 2])) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(5)
    got = ordered.scan(df, ["k"], ["i"], ordered.blocks_of(F.col("i"), size), running={"run": F.coalesce("v", F.lit(0))},
                       latest={"last": F.col("v")}, before={"prior": F.col("v")}, upcoming={"next": F.col("v")},
                       after={"later": F.col("v")}).collect()
    for r in got:
        mine = [(i, v) for k, i, v in rows if k == r["k"]]
        past = [v for i, v in mine if i <= r["i"]]
        def last(vs):
            return next((v for v in reversed(vs) if v is not None), None)
        def first(vs):
            return next((v for v in vs if v is not None), None)
        assert r["run"] == sum(v or 0 for v in past) and r["last"] == last(past)
        assert r["prior"] == last([v for i, v in mine if i < r["i"]])
        assert r["next"] == first([v for i, v in mine if i >= r["i"]])
        assert r["later"] == first([v for i, v in mine if i > r["i"]])


def test_first_wins_is_idempotent_and_keeps_list_order(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "id string, ord int")
    once = ordered.first_wins(df, ["id"], ["ord"])
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 2)]
    assert sorted(map(tuple, ordered.first_wins(once, ["id"], ["ord"]).collect())) == [("a", 1), ("b", 2)]


@pytest.mark.parametrize("k", [1, 3, 8])
def test_candidates_hold_the_exact_best(spark, monkeypatch, k):
    monkeypatch.setattr(lexical, "SEED_FACTOR", 1)
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=rng.randint(1, 25))) for _ in range(150)]
    rows = lexical.tokenized(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), ["id"], F.col("text"))
    asked = {f"q{i}": " ".join(rng.sample(vocabulary, 6)) for i in range(8)}
    questions = spark.createDataFrame(list(asked.items()), "qid string, question string")
    stats = lexical.Stats.counted(rows)
    assert stats.floor >= 0
    scored = lexical.candidates(lexical.postings(rows, ["id"]), questions, ["id"], stats, k).persist()
    got = lexical.best(scored, ["qid"], k, ["id"]).collect()
    for qid, question in asked.items():
        scores = brute_bm25(texts, question)
        expected = sorted((i for i, s in enumerate(scores) if s > 0), key=lambda i: (-round(scores[i], 9), i))[:k]
        assert [r["id"] for r in sorted((r for r in got if r["qid"] == qid), key=lambda r: r["rank"])] == expected
    if k == 1:
        assert scored.count() < lexical.score_questions(lexical.postings(rows, ["id"]), questions, ["id"], stats).count()


@pytest.mark.parametrize("k", [1, 4])
def test_blocks_hold_the_exact_best_and_are_skipped(spark, monkeypatch, k):
    monkeypatch.setattr(lexical, "SEED_FACTOR", 1)
    monkeypatch.setattr(lexical, "BLOCK_TEXTS", 16)
    rng = random.Random(10 + k)
    vocabulary = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(200)], k=rng.choice([2, 4, 8, 30, 120, 400]))) for _ in range(400)]
    asked = {f"q{i}": " ".join(rng.sample(vocabulary[:60], 5)) for i in range(6)}
    texts += [question for question in asked.values() for _ in range(k)]       # short texts that hold all terms set a high bar
    rows = lexical.tokenized(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), ["id"], F.col("text"))
    questions = spark.createDataFrame(list(asked.items()), "qid string, question string")
    stats = lexical.Stats.counted(rows)
    assert stats.floor >= 0
    blocks = lexical.blocked(lexical.postings(rows, ["id"]), ["id"], stats).persist()
    assert blocks.select(F.explode("texts")).count() == lexical.postings(rows, ["id"]).count()
    read, whole = [], []

    class Counting(lexical.Blocks):
        def read(self, terms):
            met = self.rows.join(terms, "term")
            whole.append(met.count())
            read.append(met.where(lexical.length_weight(F.col("least_dl"), F.lit(self.avgdl)) >= F.col("needed")).count())
            return super().read(terms)

    got = lexical.best(lexical.candidates(Counting(blocks, stats.avgdl), questions, ["id"], stats, k), ["qid"], k, ["id"]).collect()
    for qid, question in asked.items():
        scores = brute_bm25(texts, question)
        expected = sorted((i for i, s in enumerate(scores) if s > 0), key=lambda i: (-round(scores[i], 9), i))[:k]
        assert [r["id"] for r in sorted((r for r in got if r["qid"] == qid), key=lambda r: r["rank"])] == expected
    # the first read seeds the bar; after it blocks of long texts are left alone
    assert read[0] == whole[0] and all(a < b for a, b in zip(read[1:], whole[1:]))


def test_a_batch_of_questions_is_scored_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TASK_PAIRS", 100)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = ["", *(" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=rng.choice([2, 8, 30, 120]))) for _ in range(199))]
    asked = {f"q{i}": " ".join(rng.sample(vocabulary, 6)) for i in range(5)} | {"none": "nothing of it"}
    rows = lexical.tokenized(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), ["id"], F.col("text"))
    found = lexical.batch_best(rows, spark.createDataFrame(list(asked.items()), "qid string, question string"), ["id"],
                               lexical.Stats.counted(rows), 7)
    got = found.collect()
    for qid, question in asked.items():
        scores = brute_bm25(texts, question)
        expected = sorted((i for i, s in enumerate(scores) if s > 0), key=lambda i: (-round(scores[i], 9), i))[:7]
        mine = sorted((r for r in got if r["qid"] == qid), key=lambda r: r["rank"])
        assert [r["id"] for r in mine] == expected
        assert all(abs(r["score"] - scores[r["id"]]) < 1e-9 for r in mine)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id#" in plan and ", 10), REPARTITION_BY_NUM" in plan     # 200 texts and five questions with known terms


def test_a_hot_key_spreads_over_tasks(spark):
    rows = spark.range(20_000).withColumn("k", F.lit("hot"))
    done = ordered.number_rows(rows, ["k"], ["id"], ordered.blocks_of(F.col("id"), 500), "n")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in done.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 20_000 and len(sizes) > 1 and max(sizes) < 12_000
    assert done.where("n <> id + 1").count() == 0


def test_intermediates_are_removed_with_their_scope(spark):
    folder = shared_dir(spark)
    before = set(os.listdir(folder))
    with intermediates(spark):
        rows = lexical.tokenized(spark.createDataFrame([(1, "a b"), (2, "b")], "id int, text string"), ["id"], F.col("text"))
        asked = spark.createDataFrame([("q", "b")], "qid string, question string")
        scored = lexical.candidates(lexical.postings(rows, ["id"]), asked, ["id"], lexical.Stats.counted(rows), 1)
        scored.count()
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before


def test_texts_of_like_length_share_a_batch(spark):
    rng = random.Random(9)
    texts = ["w " * rng.choice([1, 3, 40, 400]) + str(i) for i in range(300)] + [None, ""]

    class Padded(HashingEmbedder):
        batch_size = 16

    plain = HashingEmbedder(32).embed(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, embed_text string").coalesce(1)
    found = store.embedded(rows, Padded(32)).orderBy("i").collect()
    assert [r["embed_text"] for r in found] == texts and np.array_equal(np.array([r["embedding"] for r in found], np.float32), plain)

    def padding(batches):
        return sum(len(b) * max(len(texts[i] or "") for i in b) - sum(len(texts[i] or "") for i in b) for b in batches)

    given = [list(range(i, min(i + 16, len(texts)))) for i in range(0, len(texts), 16)]
    assert padding(store.like_lengths(texts, 16)) < 0.2 * padding(given)
    assert store.task_gpu(spark) is None
