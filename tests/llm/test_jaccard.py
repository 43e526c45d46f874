"""Near duplicates against all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import components, count_tree, jaccard
from tests.llm.tables import documents, edited, empty, prose


def grams(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            root[top(j)] = top(i)
    least = {}
    for i, (number, _) in enumerate(rows):
        if number is not None:
            least[top(i)] = min(number, least.get(top(i), number))
    order = lambda x: tuple((y is not None, y or 0) for y in x)
    return sorted(((n, len(sets[i]), least.get(top(i)) if sets[i] else n) for i, (n, _) in enumerate(rows)), key=order)


def found(docs, **how):
    order = lambda x: tuple((y is not None, y or 0) for y in x)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs, **how).collect()), key=order)


def near_copies():
    rng, texts = random.Random(8), []
    passage = prose(77, 30)
    for g in range(12):
        base = prose(100 + g, rng.randrange(8, 160))
        texts += [base, base] + [edited(base, 1000 * g + e, 1 + e % 4) for e in range(rng.randrange(1, 9))] + [f"{passage} {prose(500 + g, 40)}"]
    chain = prose(900, 120).split()
    texts += [" ".join(chain[i:i + 90]) for i in range(0, 30, 3)]
    return texts


@pytest.mark.parametrize("chunk", [jaccard.CHUNK, 3])
def test_agrees_with_all_pairs(spark, chunk):
    docs = documents(spark, near_copies())
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert found(docs, chunk=chunk) == brute(rows)


def test_empty_table(spark):
    assert jaccard.near_duplicates(empty(spark)).count() == 0 and jaccard.one_of_each(empty(spark)).count() == 0


def test_one_of_each_component_stays(spark):
    docs = documents(spark, near_copies())
    kept = jaccard.one_of_each(docs).collect()
    wanted = {c for n, size, c in found(docs) if size and c is not None}
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None and grams(r["text"])) == sorted(wanted)
    assert len([r for r in kept if not grams(r["text"])]) == len([r for r in docs.collect() if not grams(r["text"])])
    assert len([r for r in kept if r["doc_id"] is None and r["text"]]) == 1


def test_reruns_keep_the_same_row_of_equal_ones(spark):
    text = prose(5, 40)
    docs = spark.createDataFrame([(1, text, c) for c in "abcdef"] + [(2, text, "z")], "doc_id bigint, text string, source string")
    assert len({jaccard.one_of_each(docs.repartition(n)).collect()[0] for n in (1, 3, 5)}) == 1


@settings(max_examples=100, deadline=None)
@given(st.integers(2, 60), st.integers(0, 10**6))
def test_the_bound_never_loses_a_pair(m, seed):
    rng = np.random.default_rng(seed)
    base = rng.choice(2**62, 40, replace=False).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(1, 40), replace=False), rng.choice(2**62, rng.integers(0, 4)).astype(np.uint64)])) for _ in range(m)]
    points, sizes = [jaccard.counts_of(s) for s in sets], np.array([len(s) for s in sets])

    def linked(i, j):
        return bool(count_tree.enough(len(np.intersect1d(sets[i], sets[j])), sizes[i], sizes[j]))

    def parts(edges):
        root = list(range(m))
        for a, b in edges:
            a, b = root[a], root[b]
            root = [a if r == b else r for r in root]
        return [[i for i in range(m) if root[i] == r] for r in sorted(set(root))]

    exact = [(i, j) for i, j in combinations(range(m), 2) if linked(i, j)]
    assert sorted(parts(count_tree.link(points, sizes, linked))) == sorted(parts(exact))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}
