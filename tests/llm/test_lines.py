"""Line deduplication against a plain version."""

import hashlib
import random
from collections import defaultdict

from pagewright.llm import line_dedup

SCHEMA = "doc_id bigint, text string, hash string, place int"


def plain(rows, length=40, documents=5):
    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)

    def owner(doc_id, text):
        return (True, doc_id, "") if doc_id is not None else (False, 0, text or "")

    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= length:
                holders[key(line)].add(owner(doc_id, text))
    many = {k for k, who in holders.items() if len(who) >= documents}
    last = {k: max(d for named, d, _ in holders[k] if named) for k in many if any(named for named, _, _ in holders[k])}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        stays = [line for line in lines if not (key(line) in last and last[key(line)] != doc_id)]
        out.append((doc_id, len(lines), len(lines) - len(stays), hashlib.sha256("\n".join(stays).encode()).hexdigest()))
    return sorted(out, key=repr)


def digests(spark, rows, **how):
    df = spark.createDataFrame([(*row, "x", 1) for row in rows], SCHEMA)
    return sorted((tuple(r) for r in line_dedup.digest(line_dedup.deduplicated(df, **how)).collect()), key=repr)


COMMON = "a line that many documents hold, of forty characters"
OTHER = "Ünïcode line that very many documents hold in common"


def test_random_texts(spark):
    draw = random.Random(3)
    pool = [COMMON, OTHER, COMMON.upper() + " \t", "  " + OTHER, "short", "", "a" * 39, "b" * 40, "b" * 40 + "\r", *("unique %d" % i * 6 for i in range(9))]
    rows = [(i * 7 % 101, "\n".join(draw.choices(pool, k=draw.randrange(0, 90)))) for i in range(101)]
    assert digests(spark, rows) == plain(rows)
    assert digests(spark, rows, range_rows=3) == plain(rows)             # every key is cut
    assert digests(spark, rows, length=5, documents=2, range_rows=10) == plain(rows, 5, 2)


def test_odd_rows(spark):
    long_text = "\n".join([COMMON, *(f"line {i} of a very long text, which is its own" for i in range(20_000)), COMMON])
    rows = [(1, None), (2, ""), (3, "\n"), (4, COMMON), (4, COMMON), (4, "x\n" + COMMON), (5, COMMON + "\n" + COMMON), (6, "\n\n" + COMMON + "\n"), (7, long_text),
            (8, COMMON), (None, "y\n" + COMMON), (None, None), (9, "z" * 500_000)]
    assert digests(spark, rows) == plain(rows)
    assert digests(spark, rows, range_rows=2) == plain(rows)


def test_four_documents_keep_their_lines(spark):
    rows = [(i, COMMON + "\nown") for i in range(4)] + [(3, COMMON)] * 5
    assert all(gone == 0 for _, _, gone, _ in digests(spark, rows))
    assert sum(gone for _, _, gone, _ in digests(spark, [*rows, (9, COMMON)])) == 9


def test_rows_without_an_id_are_told_apart_by_text(spark):
    rows = [(None, f"{COMMON}\n{i}") for i in range(6)]
    assert sorted(gone for _, _, gone, _ in digests(spark, rows)) == [0, 1, 1, 1, 1, 1]
    assert sorted(gone for _, _, gone, _ in digests(spark, [*rows, (-5, COMMON)])) == [0, 1, 1, 1, 1, 1, 1]
    assert sorted(gone for _, _, gone, _ in digests(spark, [(None, COMMON)] * 9)) == [0] * 9


def test_bitmaps(spark):
    dropped = spark.createDataFrame([(1, 5, 0), (1, 5, 63), (1, 5, 200), (2, 5, 64), (None, 5, 1)], "doc_id bigint, key bigint, place int")
    found = {r.doc_id: [tuple(e) for e in r.drops] for r in line_dedup.bitmaps(dropped).collect()}
    assert found == {1: [(0, 1 - (1 << 63)), (3, 1 << 8)], 2: [(1, 1)], None: [(0, 2)]}


def test_empty_table_and_no_python(spark):
    assert digests(spark, []) == []
    rows = spark.createDataFrame([(1, COMMON)], "doc_id bigint, text string")
    plan = line_dedup.deduplicated(rows)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
