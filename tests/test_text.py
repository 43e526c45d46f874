import re

from pyspark.sql import functions as F

from pagewright.functions import classify, intents, text
from pagewright.functions.arrays import last_at_or_before, running_starts


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_strip_takes_all_white_space(spark):
    values = ["\x1f a ", " x\n", "", " \t "]
    assert column(spark, values, text.strip) == [v.strip() for v in values]


def test_split_lines_like_a_text_reader(spark):
    values = ["a\r\nb", "a\x85b\x0cc\n", "one", "a\x1cb\x1fc", "\n\n"]
    assert column(spark, values, text.split_lines) == [v.splitlines() for v in values]


def test_escape_unprintable(spark):
    assert column(spark, ["00 FF", "a\x07é", "\xff"], text.escape_unprintable) == ["00 FF", "a\\x07\\xe9", "\\xff"]


def test_clean_caption(spark):
    values = ["Image Caption: Caption: Figure 3: x", "Captioning y", "Fig. 2. z", "plain"]
    assert column(spark, values, text.clean_caption) == ["x", "ing y", "z", "plain"]


def brute_tokens(value):
    low = value.lower()
    found = re.findall(r"[a-z0-9]+(?:[/\.][a-z0-9]+)+", low) + re.findall(r"[a-z0-9_\-]+", low)
    return list(dict.fromkeys(found))


def test_tokens(spark):
    values = ["L1/L2 DC-DC-11 OBCS2370", "TT&C v1.0 v1.0", "- a-b _ école x/y.z/ q..r", "", "a/b/c/d e/.f"]
    assert column(spark, values, text.tokens) == [brute_tokens(v) for v in values]


def test_subsystem_rules(spark):
    values = ["OBC", "AOCS and obc", "gyro", "STAR SENSOR", "wde", "hga", "latch valve", "DC-DC", "twta", "SUIT", "ssr",
              "nothing", "xOBCx"]
    expected = ["OBC", "OBC", "DTG", "SENSOR", "WHEEL", "MECHANISM", "PROPULSION", "POWER", "TTC_XBAND", "PAYLOAD",
                "ODHS", "UNKNOWN", "UNKNOWN"]
    assert column(spark, values, lambda c: classify.subsystem_of(c)) == expected


def test_number_ranges(spark):
    values = ["6230", "5999", "5050", "5299", "", "x"]
    assert column(spark, values, lambda c: classify.subsystem_of(F.lit(""), c)) == [
        "PAYLOAD", "UNKNOWN", "AOCS", "OBC", "UNKNOWN", "UNKNOWN"]


def test_question_rules_differ_from_stored_rules(spark):
    values = ["payload motor", "dc dc converter", "x.band", "SUIT", "receiver"]
    assert column(spark, values, classify.question_subsystem) == ["PAYLOAD", "POWER", "TTC_XBAND", None, "TTC_XBAND"]


def test_content_type(spark):
    values = ["PROCEDURE :", "notes: x", "NOTE: 5201: y", "applicability:", "step 5201001", "text", "end of procedure"]
    assert column(spark, values, classify.content_type_of) == [
        "procedure", "note", "procedure", "procedure", "procedure", "section", "procedure"]


def test_procedure_number(spark):
    assert column(spark, ["a 5201 6000", "45201", "7001", "x6123:"], classify.procedure_number) == ["5201", "", "", ""]


def test_cid_and_label(spark):
    assert column(spark, ["obcs2370", "TTCS1", "----", "ZZZ"], classify.cid_subsystem) == [
        "OBC", "TTC_XBAND", "UNKNOWN", "UNKNOWN"]
    assert column(spark, ["PAYLAOD", "TTC&XBAND", "NO"], classify.label_subsystem) == ["PAYLOAD", "TTC_XBAND", "UNKNOWN"]


def test_route(spark):
    log = ["on 2026-06-09?", "on 2026/06/09", "on 2026 06 09", "2026-02-31", "FCP5201", "was it uplinked", "orbit 66",
           "telecommand log", "TCH file", "OBCS2370"]
    prose = ["FCP-5201", "plain command", "2026-13-01", "tch", "orbits 66", "1999-01-01"]
    assert column(spark, log + prose, intents.route) == ["commands"] * len(log) + ["knowledge"] * len(prose)


def test_question_date(spark):
    values = ["on 2026/06 09?", "2026-02-31", "2026-6-9", "none"]
    assert column(spark, values, intents.question_date) == ["2026-06-09", "2026-02-31", None, None]


def test_intents(spark):
    assert column(spark, ["flow chart", "a Plot", "charts"], intents.wants_image) == [True, True, False]
    assert column(spark, ["How  to do", "powering", "steps", "stepping"], intents.wants_procedure) == [
        True, True, True, False]


def test_array_lookups(spark):
    row = spark.range(1).select(
        running_starts(F.array(F.lit(3), F.lit(4), F.lit(0))),
        *[last_at_or_before(F.array(F.lit(0), F.lit(3), F.lit(7)), F.lit(x)) for x in (-1, 0, 2, 3, 7, 99)]).first()
    assert list(row) == [[0, 3, 7], 0, 1, 1, 2, 3, 3]


def test_texts_without_compounds_are_not_searched_for_them(monkeypatch):
    from pagewright import models

    plain, compound = ["A plain text. And more / of it.", "", None], ["a/b c"]
    embedder = models.HashingEmbedder(16)
    expected = embedder.embed(plain)
    assert (embedder.embed(compound) != embedder.embed(["a b c"])).any()
    monkeypatch.setattr(models, "COMPOUND_TOKEN", "(")      # no pattern: searching for it is an error
    assert (embedder.embed(plain) == expected).all()
