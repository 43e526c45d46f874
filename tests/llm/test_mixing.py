"""Weighted fair queueing against a plain queue."""

import hashlib
import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from pagewright.llm import mixing
from tests.llm.tables import documents, empty


def levels(sizes: dict) -> dict:
    """Targets by pouring out the budget until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weights, free = {s: i % 3 + 1 for i, s in enumerate(order)}, set(order)
    budget, out = Fraction(sum(sizes.values())), {}
    while free:
        level = budget / sum(weights[s] for s in free)
        full = {s for s in free if level * weights[s] > 3 * sizes[s]}
        if not full:
            return {**out, **{s: level * weights[s] for s in free}}
        out |= {s: Fraction(3 * sizes[s]) for s in full}
        budget -= sum(3 * sizes[s] for s in full)
        free -= full
    return out


def brute(rows):
    """(doc_id, size, source_size, target, taken), by one sorted queue."""
    import re
    docs = sorted(((hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest(), i is not None, i or 0, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
                   for i, t, s in rows), key=lambda d: d[:3])
    sizes = {}
    for *_, s, n in docs:
        sizes[s] = sizes.get(s, 0) + n
    targets, upto, queue = levels(sizes), dict.fromkeys(sizes, 0), []
    rank = {s: i for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    for place, (_, _, _, s, n) in enumerate(docs):
        upto[s] += n
        if n and targets[s]:
            for turn in range(min(3, math.ceil(targets[s] / sizes[s]))):
                queue.append(((turn * sizes[s] + upto[s]) / float(targets[s]), rank[s], turn, place, n))
    budget, taken = sum(sizes.values()), [0] * len(docs)
    for *_, place, n in sorted(queue):
        if n > budget:
            break
        budget -= n
        taken[place] += n
    return sorted((i if known else -1, n, sizes[s], round(float(targets[s]), 6), taken[p]) for p, (_, known, i, s, n) in enumerate(docs))


def found(docs):
    rows = mixing.mix(docs).collect()
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in rows)


def test_agrees_with_one_queue(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randrange(1, 60) for _ in range(rng.randrange(0, 80))), rng.choice(["a", "a", "a", "b", "é", None, "z"])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = found(docs)
    assert got == brute(rows) and got == found(docs.repartition(7))
    assert all(t <= 3 * n for _, n, _, _, t in got)


def test_odd_rows(spark):
    docs = documents(spark)
    rows = found(docs)
    assert len(rows) == docs.count() and all(t <= 3 * n for _, n, _, _, t in rows)
    assert found(empty(spark)) == []
    wordless = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id bigint, text string, source string")
    assert [r[4] for r in found(wordless)] == [0, 0]


def test_documents_are_repeated_as_taken(spark):
    docs = documents(spark)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    copies = {(r["doc_id"], r["text_key"]): r["n"] for r in mixing.mix(docs).groupBy("doc_id", "text_key").agg(F.sum("copies").alias("n")).collect()}
    assert mixed.count() == sum(copies.values())


def test_rows_without_an_id_are_spread_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    rng = random.Random(6)
    rows = [(None if i % 10 else i, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 30))), rng.choice("aab")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    seen = []
    real = mixing.scan

    def watched(df, keys, order, segment, **how):
        seen.append(df.groupBy(segment).count().orderBy("count").collect())
        return real(df, keys, order, segment, **how)

    monkeypatch.setattr(mixing, "scan", watched)
    got = found(docs)
    assert all(len(ranges) >= 10 and ranges[-1]["count"] < 100 for ranges in seen)
    assert got == brute(rows) and got == found(docs.repartition(5))


def test_reruns_keep_the_same_rows(spark):
    rows = [(1, "a b c", s) for s in "abcdefgh"] + [(None, "d e", s) for s in "xyz"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    runs = [sorted(map(tuple, mixing.mixed_documents(docs.repartition(n)).collect()), key=str) for n in (1, 4, 7)]
    assert runs[0] == runs[1] == runs[2]
