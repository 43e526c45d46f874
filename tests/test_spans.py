"""Matches over page rows against a search of the whole text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pagewright.operators import blocks, spans

BITS = ["1 GENERAL SCOPE", "2.1", "TITLE CAPS", "\n", "\n\n", "text here", "3", "7.", "5201", "OBC", " ", "X ABC DEFGH", "|", "(A)",
        "12. 5201 OBC Title of it", "lower", ".", "\t", "4 EFGH, IJ/K\nMORE", "é", " "]


def whole(pages, regex):
    """(nth, match, page, part) of the pages laid end to end."""
    text, at = "", []
    for page in pages:
        at.append(len(text))
        text += "\n" + (page or "")
    found = list(re.finditer(regex, text, re.M))
    ends = [m.start() for m in found[1:]] + [len(text)]
    return [(i, m.group(0), max(n for n, start in enumerate(at, 1) if start <= m.start()), text[m.start():end]) for i, (m, end) in enumerate(zip(found, ends))]


@pytest.mark.parametrize("pattern", [blocks._HEADING, blocks._INDEX_ROW])
@pytest.mark.parametrize("pages,chars", [(4096, 1 << 20), (2, 5)])
def test_agrees_with_the_whole_text(spark, monkeypatch, pattern, pages, chars):
    monkeypatch.setattr(spans, "PAGES", pages)
    monkeypatch.setattr(spans, "CHARS", chars)
    rng = random.Random(5)
    docs = {f"D{d}": ["".join(rng.choice(BITS) + rng.choice(["\n", " ", "\n", ""]) for _ in range(rng.randrange(0, 7))) for _ in range(rng.randrange(1, 9))]
            for d in range(60)}
    docs["none"], docs["blank"] = [None, "1 GENERAL SCOPE", None], ["", "", "\n"]
    rows = [(key, i, text) for key, held in docs.items() for i, text in enumerate(held, 1)]
    df = spark.createDataFrame(rows, "doc_key string, page int, text string").repartition(3)
    got = {}
    for r in spans.parts(df, pattern).orderBy("doc_key", "nth").collect():
        got.setdefault(r["doc_key"], []).append((r["nth"], r["head"], r["page"], r["part"]))
    assert sum(map(len, got.values())) > 30
    for key, held in docs.items():
        assert got.get(key, []) == whole(held, pattern.regex), held


def test_a_document_of_many_pages(spark):
    """100,000 pages, half of them blank; every tenth pair opens a section whose title is on the next page."""
    n = F.col("id")
    text = F.when(n % 20 == 0, F.concat(F.lit("rest of it\n"), (n / 20 + 1).cast("int").cast("string"))).when(
        n % 20 == 1, F.lit("SECTION TITLE\nbody")).when(n % 2 == 0, F.lit("")).otherwise(F.lit("more text"))
    pages = spark.range(0, 100_000, 1, 16).select(F.lit("BIG").alias("doc_key"), (n + 1).cast("int").alias("page"), text.alias("text"))
    found = blocks.numbered_spans(pages)
    row = found.agg(F.count("*").alias("n"), F.min("page").alias("first"), F.max("page").alias("last"), F.max(F.length("section")).alias("most"),
                    F.countDistinct("nth").alias("nths")).first()
    assert tuple(row)[:3] == (5000, 1, 99_981) and row["nths"] == 5000 and row["most"] < 200
    assert found.where("nth = 7").first()["section"].startswith("8\nSECTION TITLE\nbody\n")


def test_a_text_is_searched_once(spark):
    """What a scan reads twice is written before it: its plan starts from the matches, not from the texts."""
    df = spark.createDataFrame([("d", "a 1 b 22 c", 0), ("e", "333", 5)], "doc_key string, part string, base bigint")
    found = spans._starts(df, "part", "[0-9]+", F.col("base"), ["doc_key"])
    assert sorted(map(tuple, found.collect())) == [("d", 2, "1"), ("d", 6, "22"), ("e", 5, "333")]
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
