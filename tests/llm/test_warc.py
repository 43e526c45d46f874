"""Archives and their merged history."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.llm import warc

LONG = "é<p>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
ROWS = [(3, "http://www.a.com/x", LONG), (1, "https://b.org/y?q=1", LONG), (2, None, LONG), (4, "http://a.com/x", None), (5, "", ""),
        (6, "http://a.com/z", "x" * 99), (7, "http://a.com/z", "x" * 99), (8, "http://c.com/ü \r\nX: y", "z" * 100),
        (9, "http://c.com/", "z" * 100), (10, "http://c.com/", "plain"), (10, "http://c.com/", "plain"), (None, "http://n.com", "z" * 100),
        (None, "http://n.com", "only" * 50)]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id bigint, url string, html string, digest string, run string")


def captured():
    return F.timestamp_seconds(F.coalesce(F.col("page_id"), F.lit(0)) + 10)


def test_round_trip(spark):
    found = warc.capture_history(pages(spark), captured()).collect()
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in found)
    wanted = []
    for number, _, html in ROWS:
        raw = (html or "").encode()
        equal = [i for i, _, other in ROWS if i is not None and (other or "") == (html or "")]
        first = min(equal, default=None) if len(raw) >= 100 else None
        again = first is not None and first != number
        wanted.append((number or 0, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else 0))
    assert got == sorted(wanted)


def test_history_is_in_global_order(spark):
    rows = [(i, f"http://h{i % 7}.com/{i % 3}", f"body {i}") for i in range(500)]
    parts = [warc.index(spark, warc.write(pages(spark, rows[i::3]), captured())) for i in range(3)]
    entries = parts[0].union(parts[1]).union(parts[2])
    assert entries.select("run").distinct().count() == 3
    found = warc.history(entries, range_entries=60).orderBy("part", "position").collect()
    keys = [(r["url_key"], r["captured"], r["page_id"]) for r in found]
    assert len(keys) == 500 and keys == sorted(keys) and len({r["part"] for r in found}) > 1
    assert found[0]["url_key"].startswith("com,h0)/")


def test_empty_table(spark):
    assert warc.capture_history(pages(spark).where("false"), captured()).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree_merges(lists):
    runs = [[(x, r) for x in sorted(one)] for r, one in enumerate(lists)]
    assert list(warc.loser_tree(runs)) == sorted(x for run in runs for x in run)
