"""Exact top-k against brute force; the forest's recall and distances."""

import math
import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from pagewright.llm import exact_topk, hash_forest, vectors_in_tiles

SCHEMA = "vec_id bigint, embedding array<double>, score string, id string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def odd_rows():
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(120)]                      # a common vector
    rows += [(600, None), (601, [1.0, None]), (602, [math.nan] * 6), (603, [math.inf] * 6), (604, []), (605, [0.0] * 6),
             (None, [1.0] * 6), (606, [0.5, 0.5]), rows[20], rows[20]]
    return rows


def brute(rows, modulus, k, key, usable):
    held = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and usable(v)}
    out = set()
    for q, a in held:
        if q % modulus == 0:
            best = sorted((key(a, b), i) for i, b in held if i != q)[:k]
            out |= {(q, rank, i, s) for rank, (s, i) in enumerate(best, 1)}
    return out


def fine(v):
    return all(x is not None and math.isfinite(x) for x in v)


def test_top_k_is_exact(spark):
    rows = odd_rows()

    def product(a, b):
        return -sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a, b, strict=False))

    found = exact_topk.top_k(table(spark, rows), F.col("id") % 20 == 0, 20, block_rows=7, shard_rows=40)
    assert {(r[0], r[1], r[2], -r[3]) for r in found.collect()} == brute(rows, 20, 20, product, fine)


def test_tiny_negative_and_huge_components(spark):
    rows = [(0, [-1e-19, 1.0]), (1, [1.0, 0.0]), (2, [-5e-324, -0.0]), (3, [1e307, -1.0]), (4, [-1e307, 1e-300]), (5, [2.0**60, -2.0**60]),
            (20, [1e307, 1e307]), (40, [3e306, -0.5])]

    def product(a, b):
        exact = sum(math.floor(64 * Fraction(x)) * math.floor(64 * Fraction(y)) for x, y in zip(a, b, strict=True))
        return -max(-exact_topk.LONG, min(exact_topk.LONG, exact))

    found = exact_topk.top_k(table(spark, rows), F.col("id") % 20 == 0, 20, block_rows=2, shard_rows=3)
    assert {(r[0], r[1], r[2], -r[3]) for r in found.collect()} == brute(rows, 20, 20, product, fine)


def test_products_beyond_doubles():
    q, v = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 1.0], [2.0**30, 1.0], [-(2.0**40), 0.0]])
    assert exact_topk.products(q, v).tolist() == [[2**60 + 1, 2**63 - 1, -(2**63 - 1)]]


def test_fewer_rows_than_asked_for(spark):
    found = exact_topk.top_k(table(spark, [(0, [1.0]), (1, [2.0])]), F.col("id") % 20 == 0, 20).collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 64 * 128)]
    none = table(spark, [(0, [1.0])]).where("false")
    assert exact_topk.top_k(none, F.col("id") % 20 == 0, 20).count() == 0
    assert hash_forest.nearest(none, F.col("id") % 20 == 0, 10).count() == 0


def test_forest_that_gathers_all_is_exact(spark):
    rows = odd_rows()

    def distance(a, b):
        n = max(len(a), len(b))
        a, b = np.array([*a, *[0.0] * (n - len(a))]), np.array([*b, *[0.0] * (n - len(b))])
        return round(float(np.sqrt(((a - b) ** 2).sum())), 12)

    found = hash_forest.nearest(table(spark, rows), F.col("id") % 100 == 0, 10, per_hit=10_000, block_rows=3, shard_rows=50)
    wanted = brute(rows, 100, 10, distance, lambda v: fine(v) and any(v))
    assert {(r[0], r[1], r[2], round(r[3], 12)) for r in found.collect()} == wanted


def test_forest_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = {(r[0], r[2]) for r in hash_forest.nearest(vectors, F.col("id") % 100 == 0, 10).collect()}
    held = {r[0]: np.array(r[1], float) for r in vectors.select("vec_id", "embedding").collect()}
    ids, points = np.array(list(held)), np.array(list(held.values()))
    right = total = 0
    for q in ids[ids % 100 == 0]:
        distance = np.sqrt(((points - held[q]) ** 2).sum(axis=1))
        best = [i for i in ids[np.lexsort((ids, distance))] if i != q][:10]
        right += sum((q, i) in found for i in best)
        total += 10
    assert right / total >= 0.9


def test_ascent_stops_when_enough():
    rng = np.random.default_rng(1)
    v = rng.standard_normal((500, 8))
    found = hash_forest.candidates(v[:20], v, trees=8, wanted=40)
    assert all(i in places for i, places in enumerate(found))
    assert np.mean([len(places) for places in found]) < 200


def test_selection_keeps_ties_by_id():
    keys, ids = np.array([1, 1, 0, 1, 1]), np.array([9, 3, 8, 1, 5])
    assert ids[vectors_in_tiles.first(keys, ids, 3)].tolist() == [8, 1, 3]
