"""Centroid clustering against a plain version."""

import hashlib
import math
import random

import numpy as np

from pagewright.llm import centroids

SCHEMA = "vec_id bigint, embedding array<double>, v string, cluster int"


def plain(rows, k=8, rounds=10):
    def good(v):
        return v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)

    kept = [(i, [math.floor(x * 1024) if abs(x) < 2**53 else int(x) * 1024 for x in v], v) for i, v in rows if good(v)]
    drawn = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))
    at = [v for _, v, _ in drawn[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(at))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v, _ in kept]
        for c in range(len(at)):
            mine = [v for o, (_, v, _) in zip(own, kept) if o == c]
            if mine:
                at[c] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *nearest(v)) for i, v, _ in kept]
    inertia = [sum(d for _, d, c in found if c == n) for n in range(len(at))]

    def fits(x):
        return x if x < 2**63 else None

    return sorted(((i, c, fits(d), fits(inertia[c]), fits(sum(inertia)), hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest())
                   for i, d, c in found), key=repr)


def clustered(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    found = centroids.clusters(df, **how).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(r) for r in found.collect()), key=repr)


def grouped(n, seed=1, spread=0.05):
    draw = random.Random(seed)
    middles = [[draw.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    return [(i, [m + draw.gauss(0, spread) for m in middles[i % 6]]) for i in range(n)]


def test_groups_ties_and_repeats(spark):
    rows = grouped(150)
    rows += [(7, rows[7][1])] * 3 + [(None, rows[9][1]), (-4, [0.5] * 64), (500, [-0.0001] * 64)]
    assert clustered(spark, rows) == plain(rows)


def test_vectors_that_take_no_part(spark):
    rows = grouped(20) + [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [None] + [1.0] * 63), (105, [math.nan] + [1.0] * 63),
                          (106, [math.inf] * 64)]
    assert clustered(spark, rows) == plain(rows)
    assert clustered(spark, rows[20:]) == []
    assert clustered(spark, []) == []
    assert clustered(spark, rows[:3]) == plain(rows[:3])


def test_large_components_stay_exact(spark):
    rows = grouped(30) + [(200, [3000.5] * 64), (201, [1e6] + [0.1] * 63), (202, [1e6 + 1] + [-0.1] * 63), (203, [1e300] * 64), (204, [-1.7e308] * 64)]
    assert clustered(spark, rows) == plain(rows)


def test_curve_visits_neighbours():
    grid = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    keys = centroids.curve_keys(grid)
    assert len(set(keys)) == 512
    path = grid[sorted(range(512), key=keys.__getitem__)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_boxes_lose_no_nearest_centroid():
    draw = np.random.default_rng(5)
    for _ in range(200):
        c = draw.integers(-50, 50, (12, 4)).astype(float)
        v = draw.integers(-50, 50, 4) + draw.integers(-9, 9, (20, 4)).astype(float)
        near = centroids.candidates(v.min(axis=0), v.max(axis=0), c)
        own = ((v[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert set(own) <= set(near)


def test_boxes_pass_over_centroids(spark):
    df = spark.createDataFrame([(i, v) for i, v in grouped(3000)], "vec_id bigint, embedding array<double>")
    found = centroids.clusters(df).agg({"candidates": "avg"}).first()[0]
    assert found < 4
