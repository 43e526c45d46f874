"""Blocks, sections, packer and splitter against small sequential models."""

import functools
import random
import re

import pytest
from pyspark.sql import functions as F

from pagewright import rules
from pagewright.operators import blocks, splitting

HEADER = re.compile(rules.BLOCK_HEADER, re.I)


def model_blocks(pages):
    """(start page, number, heading, text) of one document's blocks that hold text, page by page."""
    groups, head = [], ("", "")
    for page, text in pages:
        header = HEADER.search(text)
        current = groups[-1] if groups and not groups[-1]["ended"] else None
        if current is None or (header and "".join(current["texts"]).strip()):
            current = {"start": page, "texts": [], "head": head}
            groups.append(current)
        elif header:
            current["start"] = page
        if header:
            current["head"] = head = (header[2], header[0].strip())
        current["texts"].append(text)
        current["ended"] = rules.BLOCK_END in text
    whole = [(g["start"], *g["head"], "\n".join(g["texts"]).strip()) for g in groups]
    return [g for g in whole if g[-1]]


def random_pages(seed, n):
    rng = random.Random(seed)
    kinds = ["plain words", "  \n", "OBC - 5201: SWITCH ON\nbody", "intro\nobc5203 : reset it", "x END OF PROCEDURE",
             "AOCS 5001: A\nEND OF PROCEDURE", "NOTES\n", ": colon first", "see 6123 now", "PROCEDURE", "STAR SENSOR"]
    return [(p, rng.choice(kinds)) for p in range(1, n + 1)]


@pytest.mark.parametrize("width", [3, 4096])
def test_procedure_blocks_match_the_page_by_page_model(spark, width):
    docs = {f"D{i}": random_pages(i, 60) for i in range(8)}
    pages = spark.createDataFrame([(d, p, t) for d, ps in docs.items() for p, t in ps],
                                  "doc_key string, page int, text string").repartition(5)
    got = {}
    for r in blocks.procedure_blocks(pages, False, width).collect():
        got.setdefault(r["source_doc"], {})[r["chunk_id"]] = (
            r["page"], r["fcp_number"], r["section_heading"], r["text"], r["subsystem"], r["content_type"])
    for doc, rows in docs.items():
        expected = {}
        for nth, (start, number, heading, text) in enumerate(model_blocks(rows)):
            own = re.search(rules.PROCEDURE_NUMBER, text)
            number = number or (own[1] if own else "")
            sub = next((n for n, p in rules.SUBSYSTEM_KEYWORDS if re.search(p, f"{heading} {text}", re.I)), None)
            if sub is None and number:
                sub = next((n for lo, hi, n in rules.SUBSYSTEM_RANGES if lo <= int(number) <= hi), None)
            kind = ("procedure" if any(re.search(p, text, re.I) for p in rules.PROCEDURE_SIGNALS_ANY_CASE)
                    or any(re.search(p, text) for p in rules.PROCEDURE_SIGNALS)
                    else "note" if re.search(rules.NOTE_SIGNAL, text, re.I) else "section")
            expected[f"{doc}_p{start}_{nth}"] = (start, number, heading, text, sub or "UNKNOWN", kind)
        assert got[doc] == expected


def test_index_pages_come_before_the_first_body_page(spark):
    pages = [(1, "1. 5201 OBC ON .\n2. 5203 TTC&XBAND"), (2, "reset\n2. 5203 TTC&XBAND again\n63. 6006 \n PAYLAOD P."),
             (3, "OBC 5201: SWITCH ON"), (4, "more END OF PROCEDURE"), (5, "obc 5203: x")]
    docs = spark.createDataFrame([("FCP", p, t) for p, t in pages], "doc_key string, page int, text string")
    rows = blocks.index_entries(blocks.index_pages(docs)).orderBy("block").collect()
    assert [(r["chunk_id"], r["text"]) for r in rows] == [
        ("FCP_IDX_001_5201", "FCP 5201 — OBC — ON"), ("FCP_IDX_002_5203", "FCP 5203 — TTC_XBAND — reset"),
        ("FCP_IDX_063_6006", "FCP 6006 — PAYLOAD — P")]
    body = blocks.procedure_blocks(docs)
    assert sorted(r["chunk_id"] for r in body.collect()) == ["FCP_p3_0", "FCP_p5_1"]
    none = spark.createDataFrame([("FCP", 1, "no body here")], "doc_key string, page int, text string")
    assert blocks.procedure_blocks(none).count() == 0


def test_images_follow_their_pages_and_merge_forward(spark):
    pages = spark.createDataFrame([("D", 1, "  ", [("a.png", 1, 0, "")]), ("D", 2, "OBC 5201: x", [("b.png", 2, 0, "")]),
                                   ("D", 3, " ", None)],
                                  "doc_key string, page int, text string, "
                                  "images array<struct<file:string,page:int,index_on_page:int,caption:string>>")
    [row] = blocks.procedure_blocks(pages, False).collect()
    assert (row["page"], [i["file"] for i in row["images"]], row["text"]) == (2, ["a.png", "b.png"], "OBC 5201: x")


def test_long_blocks_continue_in_parts_where_asked_for(spark):
    pages = spark.createDataFrame([("D", p, f"page {p}" + (" SSR" if p == 8 else "")) for p in range(1, 9)],
                                  "doc_key string, page int, text string")
    [whole] = blocks.procedure_blocks(pages, False).collect()
    rows = blocks.procedure_blocks(pages, False, part_rows=3).orderBy("part").collect()
    assert whole["chunk_id"] == "D_p1_0" and whole["text"] == "\n".join(r["text"] for r in rows)
    assert "\n".join(r["text"] for r in rows) == "\n".join(f"page {p}" + (" SSR" if p == 8 else "") for p in range(1, 9))
    assert [r["chunk_id"] for r in rows] == ["D_p1_0", "D_p1_0_part1", "D_p1_0_part2"]
    assert {r["subsystem"] for r in rows} == {"ODHS"}


def test_styled_sections(spark):
    rows = [("H", None, "  first "), ("H", "Normal", ""), ("H", "Heading 1", "STAR"), ("H", "Heading 2", " Two "),
            ("H", "Normal", "SENSOR 5412"), ("H", None, "b"), ("H", "Heading 1", "empty"), ("H", "Heading 1", "OBC 6001"),
            ("H", "Normal", "z")]
    df = spark.createDataFrame([(d, i, s, t) for i, (d, s, t) in enumerate(rows)],
                               "doc_key string, ord bigint, style string, text string")
    for rows_per in (2, 1000):
        got = blocks.styled_sections(df, rows_per).orderBy("chunk_id").collect()
        assert [(r["chunk_id"], r["section_heading"], r["text"], r["fcp_number"], r["subsystem"]) for r in got] == [
            ("H_0000", "Preamble", "first", "", "UNKNOWN"), ("H_0001", "Two", "SENSOR 5412\nb", "5412", "SENSOR"),
            ("H_0002", "OBC 6001", "z", "6001", "OBC")]


def model_pack(text, size=1000):
    def put(packs, paragraph):
        # an opened pack counts the line end in front of its first paragraph unless it was opened by overflow
        fits = packs and packs[-1][0] + len(paragraph) < size
        if fits:
            return packs[:-1] + [(packs[-1][0] + 1 + len(paragraph), packs[-1][1] + [paragraph])]
        return packs + [(len(paragraph) + (not packs and len(paragraph) < size), [paragraph])]

    lines = [line.strip() for line in text.split("\n") if line.strip()]
    return ["\n".join(held) for _, held in functools.reduce(put, lines, [])]


def test_packer(spark):
    texts = ["a" * n for n in (998, 999, 1000, 1001)] + ["\n".join(["x" * 333] * 7), "", " \n ", "b\n" + "c" * 1200 + "\nd",
                                                         "é" * 500 + "\n" + "y" * 498, "k" * 499 + "\n" + "l" * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(splitting.pack_paragraphs(F.col("t"))).collect()]
    assert got == [model_pack(t) for t in texts]


def test_numbered_sections(spark):
    pages = ["intro text\n1 GENERAL SCOPE\nalpha beta\n", "gamma\n\n 1.1 TWO LINES\nHEAD (A)\nOBC text", "2 ABC DE\nrest\n3 ABCD\nx",
             "4\nNEWLINE ONLY"]
    docs = spark.createDataFrame([("MOR", i + 1, t) for i, t in enumerate(pages)], "doc_key string, page int, text string")
    got = blocks.numbered_sections(docs).orderBy("block", "part").collect()
    assert [(r["chunk_id"], r["text"], r["page"], r["section_heading"]) for r in got] == [
        ("MOR_s0_c0", "1 GENERAL SCOPE\nalpha beta\ngamma", 1, "1 GENERAL SCOPE"),
        ("MOR_s1_c0", "1.1 TWO LINES\nHEAD (A)\nOBC text", 2, "1.1 TWO LINES\nHEAD (A)"),
        # a title of four letters opens no section; one on the next line does
        ("MOR_s2_c0", "2 ABC DE\nrest\n3 ABCD\nx", 3, "2 ABC DE"),
        ("MOR_s3_c0", "4\nNEWLINE ONLY", 4, "4\nNEWLINE ONLY")]


def model_split(text, size=1500, overlap=200):
    def windows(at):
        if at + size >= len(text):
            return [(at, len(text))]
        marks = [m for m in rules.SPLIT_SEPARATORS if m in text[at + overlap:at + size]]
        end = text.rindex(marks[0], at + overlap, at + size) + len(marks[0]) if marks else at + size
        return [(at, end), *windows(max(at + 1, end - overlap))]

    if len(text) <= size:
        return [text]
    return [piece for a, b in windows(0) if (piece := text[a:b].strip())]


def test_splitter_and_expansion(spark):
    rng = random.Random(3)
    words = ["lorem", "ipsum.", "dolor\n", "sit.\n", "\n\n", "amet", "😀é"]
    texts = ["a" * 1500, "a" * 1501, "b " * 900, "c" * 200 + ". " + "d" * 1700, " " * 2000, "x" * 1499 + "   ",
             " ".join(rng.choice(words) for _ in range(2500)), "😀" * 1501]
    df = spark.createDataFrame([(f"k{i}", t, "section", i) for i, t in enumerate(texts)],
                               "chunk_id string, text string, content_type string, ord int")
    rows = splitting.expand(df, "chunk_id").orderBy("ord", "sub_index").collect()
    expected = []
    for i, t in enumerate(texts):
        parts = model_split(t)
        expected += ([(f"k{i}", parts[0], False, "", 0)] if len(parts) == 1 else
                     [(f"k{i}_sub{j}", p, True, f"k{i}", j) for j, p in enumerate(parts)])
    assert [(r["chunk_id"], r["text"], r["is_sub_chunk"], r["parent_chunk_id"], r["sub_index"]) for r in rows] == expected
    near = splitting.neighbours(spark.createDataFrame(rows), "chunk_id").where("parent_chunk_id = 'k2'")
    assert near.orderBy("sub_index").first()["next_id"] == "k2_sub1"


def test_links_follow_from_places(spark):
    df = spark.createDataFrame([("a", "x " * 2000), ("b", "short"), ("c", "y. " * 1500)], "chunk_id string, text string")
    linked = splitting.expand(df, "chunk_id", links=True).where("is_sub_chunk").select("parent_chunk_id", "sub_index", "chunk_id", "previous_id", "next_id")
    joined = splitting.neighbours(splitting.expand(df, "chunk_id"), "chunk_id").select(*linked.columns)
    assert sorted(linked.collect(), key=str) == sorted(joined.collect(), key=str)
    assert "Join" not in linked._jdf.queryExecution().toString()


def test_splitter_invariants():
    rng = random.Random(5)
    for _ in range(40):
        text = "".join(rng.choice("ab .\n") for _ in range(rng.randint(1501, 6000)))
        spans = list(splitting.piece_spans(text, 1500, 200))
        assert all(0 < b - a <= 1500 for a, b in spans)
        assert all(x[0] < y[0] and y[0] <= x[1] for x, y in zip(spans, spans[1:]))
        assert spans[0][0] == 0 and spans[-1][1] == len(text)


def test_captions_lose_their_lead_in_before_the_length_test(spark):
    df = spark.createDataFrame([("i", "Caption: " + "w" * 1495, "image_caption")],
                               "chunk_id string, text string, content_type string")
    [row] = splitting.expand(df, "chunk_id").collect()
    assert row["text"] == "w" * 1495 and not row["is_sub_chunk"]


def test_page_coverage(spark):
    df = spark.createDataFrame([("D", "x" * 51), ("D", "x" * 50), ("E", "y" * 60)], "doc_key string, text string")
    assert [tuple(r) for r in blocks.page_coverage(df).orderBy("doc_key").collect()] == [
        ("D", 2, 1, 1, True), ("E", 1, 1, 0, False)]


def test_splitter_memory_does_not_grow_with_the_batch(spark):
    """Python gets texts a hundred rows at a time, and takes no more beside a text than its spans."""
    import tracemalloc

    text = "some words of a text. " * 100_000
    tracemalloc.start()
    spans = splitting.piece_spans(text, 1500, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(spans) > 1500 and peak < len(text) / 2
    df = spark.createDataFrame([("k", text)], "chunk_id string, text string")
    plan = splitting.expand(df, "chunk_id", links=True)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
