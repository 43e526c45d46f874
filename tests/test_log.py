import random
import re

import pytest
from pyspark.sql import functions as F

from pagewright import rules
from pagewright.operators import command_log
from pagewright.plans import render
from pagewright.sources.files import log_pieces, read_log

LINES = [
    b"0001 | 12AB | OBCS2370 | OBC-1 SWITCH ON | 2026 06 09 04:15:22:123 | 00 FF | 12 | 00066 | EXEC | STN1 | SC01 |",
    b"0002 | ---- | ---- | DUMMY COMMAND X | 2026 06 09 04:15:22:003 | a\x07\xe9 | x|y | 066 | EXEC | STN1 | SC01 | more",
    b"00003 | 12AB | OBCS2370 | OBC-1 SWITCH ON | 2026 06 09 04:15:22:123 | 00 | 12 | 00066 | EXEC | STN1 | SC01 |",
    b" 0004 | A-1 | TTCS12 | TX ON NOW PLEASE | 2026 06 09 01:00:00:000 |  | 1 | 123456 | FAIL | S | D |",
    b"header",
    b"0005 | 1 | DTGS9 | short | 2026 06 09 01:00:00:000 |  | 1 | 123 | FAIL | S | D |",
]


def records(spark, content):
    files = spark.createDataFrame([("TCH", "log.txt", bytearray(content))],
                                  "doc_key string, doc_filename string, content binary")
    lines = command_log.log_lines(files)
    return command_log.parse_log(lines, F.col("line"))


@pytest.fixture
def small_ranges(spark):
    """Byte ranges far below a file's size."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
            if spark.conf.get(k, None) is not None}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(key, held[key]) if key in held else spark.conf.unset(key)


def test_byte_ranges_give_the_same_lines(spark, tmp_path, small_ranges):
    rng = random.Random(3)
    bodies = [b"", b"a", b"0001 | x", b"\xe9\xff latin", b" " * 9, b"long " * 30]
    ends = [b"\n", b"\n", b"\r\n", b"\r", b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e", b"\x85", b"\n\n"]
    held = {f"log {i}.txt": b"".join(rng.choice(bodies) + rng.choice(ends) for _ in range(60)) + rng.choice([b"", b"last", b"\r"]) for i in range(4)}
    held |= {"empty.txt": b"", "one+1%.txt": b"\n", "crlf.txt": b"x\r\n" * 40}
    for name, content in held.items():
        (tmp_path / name).write_bytes(content)
    pieces = log_pieces(spark, str(tmp_path), "TCH")
    assert pieces.rdd.getNumPartitions() > 20
    got = {}
    for r in pieces.orderBy("doc_filename", "ord").collect():
        got.setdefault(r["doc_filename"], []).append((r["ord"], r["line"]))
    for name, content in held.items():
        closed = content if not content or content.endswith(b"\n") else content + b"\n"
        assert got.get(name, []) == list(enumerate(closed.decode("latin-1").splitlines())), name


def test_a_log_is_parsed_in_byte_ranges(spark, tmp_path, small_ranges):
    (tmp_path / "log[1].txt").write_bytes(b"\r\n".join(LINES * 30))
    (tmp_path / "log1.txt").write_bytes(b"not asked for")
    rows = read_log(spark, str(tmp_path), "TCH", "log[1].txt").orderBy("ord").collect()
    assert [r["record_id"] for r in rows] == ["TCH_0001", "TCH_0002", "TCH_0004"] * 30
    assert [r["ord"] for r in rows[:4]] == [0, 1, 3, 6]


def test_rows_of_another_form_are_dropped_and_fields_taken(spark):
    rows = records(spark, b"\r\n".join(LINES[:3]) + b"\x85" + b"\x0c".join(LINES[3:])).orderBy("ord").collect()
    expected = [m.groups() for line in LINES if (m := re.match(rules.LOG_ROW, line.decode("latin-1"), re.S))]
    assert len(rows) == len(expected) == 3
    for row, groups in zip(rows, expected):
        values = [g.strip() for g in groups]
        values[5] = "".join(c if " " <= c <= "~" else f"\\x{ord(c):02x}" for c in groups[5]).strip()
        assert [row[f] for f in command_log.FIELDS] == values
    first = rows[0]
    assert (first["record_id"], first["date"], first["time"], first["milliseconds"], first["subsystem"]) == (
        "TCH_0001", "2026-06-09", "04:15:22", "123", "OBC")
    assert first["text"] == ("Command OBC-1 SWITCH ON (CID: OBCS2370) was uplinked on 2026-06-09 at 04:15:22 UTC from "
                             "STN1 to SC01. Orbit number: 00066. Status: EXEC. Subsystem: OBC.")
    assert rows[1]["command_data"] == "a\\x07\\xe9"


def test_day_listing_is_in_time_then_list_order(spark):
    rows = records(spark, b"\n".join(LINES))
    listing = command_log.on_day(rows, "2026-06-09")
    assert [(r["nth"], r["record_id"]) for r in listing.orderBy("nth").collect()] == [
        (1, "TCH_0004"), (2, "TCH_0001"), (3, "TCH_0002")]
    assert command_log.on_day(rows, "2026-06-10").count() == 0
    line = render.day_lines(listing).where("nth = 2").first()["line"]
    assert line == f"{2:<4}  {'04:15:22':<10}  {'OBCS2370':<14}  {'OBC-1 SWITCH ON':<40}  {'00066':<7}  EXEC"
    assert [tuple(r) for r in command_log.counter(rows, "status").collect()] == [("EXEC", 2), ("FAIL", 1)]
    assert command_log.table_view(rows).columns[0] == "Time"
