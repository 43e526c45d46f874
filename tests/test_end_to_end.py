"""Files to answers: extraction, captions, store, questions, evaluation, streaming, command line."""

import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from pagewright import cli
from pagewright.models import HashingEmbedder
from pagewright.plans import captions, evaluate as ev, ingest, render
from pagewright.plans import store as st
from pagewright.plans.ask import Retriever, answering, ask, evaluating, panel_answer
from pagewright.sources import files as src
from pagewright.sources import sinks
from pagewright.streaming.incremental import load_log_stream

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(path, paragraphs):
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' if s else
                   f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for s, t in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r>"
                                        f"</w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/>'
                                      f"</w:style></w:styles>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/'
                   'relationships"><Relationship Id="r" Type="t" Target="media/image1.PNG"/></Relationships>')
        z.writestr("word/media/image1.PNG", b"\x89PNG")


def png(width, height, size=6000):
    return (b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", width, height) + b"\x08\x06\x00\x00\x00").ljust(size, b"\0")


LOG = "\n".join(
    f"{i:04d} | 12AB | OBCS2370 | {name} | 2026 06 09 0{h}:15:22:123 | 00 FF | 12 | 00066 | EXEC | STN1 | SC01 |"
    for i, (name, h) in enumerate([("OBC-1 SWITCH ON", 5), ("OBC-1 SWITCH OFF", 4), ("OBC-1 SWITCH ON", 6)], 1))


@pytest.fixture(scope="module")
def site(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("site")
    docx(folder / "ops.docx", [("", "Preamble text about thrusters"), ("H1", "OBC operations"), ("", "Switching the OBC on 5201"),
                               ("H1", "Payload guidelines"), ("", "Keep the payload sequencer busy. " * 80)])
    (folder / "log.txt").write_bytes((LOG + "\nheader row\n").encode("latin-1"))
    return folder


@pytest.fixture(scope="module")
def built(spark, site, tmp_path_factory):
    chunks, commands = ingest.document_chunks(spark, str(site), {"OPS_MANUAL": "ops.docx", "TCH": "log.txt", "MOR": "gone.pdf"})
    pages = spark.createDataFrame([("FCP", 1, "OBC - 5201: SWITCH ON OBC\nsend OBCS2370\nEND OF PROCEDURE"),
                                   ("FCP", 2, "OBC 5203: SYSTEM RESET\nreset"), ("FCP", 3, "AOCS-5001: GYRO x")],
                                  "doc_key string, page int, text string")
    from pagewright.operators.blocks import procedure_blocks
    fcp = procedure_blocks(pages, False).withColumn("ord", F.lit(1 << 40) + F.col("page")).drop("block", "part").withColumn(
        "doc_filename", F.lit("fcp.pdf"))
    caption = spark.createDataFrame([("IMG_MOR_p2_img0", "Caption: master recovery flow diagram", "MOR", "m.pdf", "image_caption", 2,
                                      "", "", "UNKNOWN", "images/MOR_p2_img0.png", 1)],
                                    "chunk_id string, text string, source_doc string, doc_filename string, content_type string, "
                                    "page int, section_heading string, fcp_number string, subsystem string, image_file string, ord bigint")
    store = st.Store(spark, str(tmp_path_factory.mktemp("store")))
    embedder = HashingEmbedder(128)
    knowledge = st.prepared(st.stacked(chunks.unionByName(fcp), caption), "chunk_id")
    added = store.load(st.KNOWLEDGE, knowledge, embedder)
    records = st.prepared(commands, "record_id")
    store.load(st.COMMANDS, records, embedder)
    return store, embedder, knowledge, added


def test_extraction(spark, site):
    chunks, commands = ingest.document_chunks(spark, str(site), {"OPS_MANUAL": "ops.docx", "TCH": "log.txt", "MOR": "gone.pdf"})
    rows = chunks.orderBy("ord").collect()
    assert [(r["chunk_id"], r["section_heading"], r["subsystem"]) for r in rows] == [
        ("OPS_MANUAL_0000", "Preamble", "UNKNOWN"), ("OPS_MANUAL_0001", "OBC operations", "OBC"),
        ("OPS_MANUAL_0002", "Payload guidelines", "UNKNOWN")]
    assert rows[1]["fcp_number"] == "5201" and rows[0]["doc_filename"] == "ops.docx"
    assert commands.count() == 3 and commands.first()["source_doc"] == "TCH"
    assert [tuple(r) for r in ingest.per_document(chunks).collect()] == [("OPS_MANUAL", 3)]


def test_docx_images(spark, site, tmp_path):
    images = src.read_docx_images(src.registered(spark, str(site), {"OPS_MANUAL": "ops.docx"}))
    sinks.write_files(images, str(tmp_path / "images"))
    assert (tmp_path / "images" / "OPS_MANUAL_img000.png").read_bytes() == b"\x89PNG"


def test_loading_again_adds_nothing(built):
    store, embedder, knowledge, added = built
    ids = {r["id"] for r in store.ids(st.KNOWLEDGE).collect()}
    assert added == len(ids) and "OPS_MANUAL_0002_sub0" in ids
    assert store.load(st.KNOWLEDGE, knowledge, embedder) == 0
    assert store.pending(st.KNOWLEDGE, knowledge).count() == 0
    assert store.counts() == {"knowledge": added, "commands": 3}


def test_day_question(built):
    store, embedder, *_ = built
    answer = ask(Retriever(store, embedder), "What commands were uplinked on 2026-06-09?")
    assert answer.text.split("\n") == ["**3 commands uplinked on 2026-06-09**  (3 OBC)", "", "Unique commands (count × mnemonic):",
                                        "    2 ×  OBC-1 SWITCH ON", "    1 ×  OBC-1 SWITCH OFF"]
    lines = [r["line"] for r in render.day_lines(answer.table).orderBy("nth").collect()]
    assert lines[0].startswith("1     04:15:22    OBCS2370        OBC-1 SWITCH OFF")
    assert ask(Retriever(store, embedder), "commands on 2026-02-31").text == "No commands found for 2026-02-31."
    panel = panel_answer(Retriever(store, embedder), "What commands were uplinked on 2026-06-09?")
    assert [r["Time"] for r in panel["rows"].collect()] == ["04:15:22", "05:15:22", "06:15:22"]
    assert tuple(panel["top_mnemonics"].first()) == ("OBC-1 SWITCH ON", 2)


def test_ranked_record_question(built):
    store, embedder, *_ = built
    answer = ask(Retriever(store, embedder), "was SWITCH OFF uplinked", top_k=2)
    assert answer.route == "commands" and "OBC-1 SWITCH OFF" in answer.text.split("\n")[4]
    assert answer.results.count() == 2


def test_procedure_question_puts_procedures_first(built):
    store, embedder, *_ = built
    answer = ask(Retriever(store, embedder), "OBC system reset procedure", top_k=2, generator=lambda q, c: f"A:{c[:10]!r}")
    first = answer.results.orderBy("rank").first()
    assert first["fcp_number"] == "5203" and answer.text.startswith("A:")
    assert answer.results.count() <= 6 and "FCP-5203" in answer.sources()


def test_figure_question_answers_from_the_caption(built):
    store, embedder, *_ = built
    answer = ask(Retriever(store, embedder), "show the recovery flow diagram")
    assert "master recovery flow diagram" in answer.text and "(from MOR, page 2)" in answer.text
    assert answer.images == ["images/MOR_p2_img0.png"] and "🖼 diagram" in answer.sources()


def test_failing_generator_keeps_sources(built):
    store, embedder, *_ = built
    def broken(question, context):
        raise RuntimeError("gpu")
    answer = ask(Retriever(store, embedder), "safety logics", generator=broken)
    assert "RuntimeError" in answer.text and answer.results.count() > 0
    assert panel_answer(None, "x")["type"] == "error"


def test_unmatched_subsystem_falls_back_to_all(built):
    store, embedder, *_ = built
    retriever = Retriever(store, embedder)
    _, strict = retriever.retrieve([{"qid": "w", "question": "the wheel", "hint": "WHEEL"}], evaluating(3))
    assert strict.count() > 0
    _, loose = retriever.retrieve([{"qid": "w|1", "question": "the wheel", "hint": "WHEEL"}], answering(3))
    assert {r["subsystem"] for r in loose.collect()} <= {"UNKNOWN", "WHEEL"}


def test_evaluation(spark, built, tmp_path):
    store, embedder, *_ = built
    listed = [{"id": "reset", "q": "OBC system reset procedure", "accept": [{"fcp_number": "5203"}], "note": "n"},
              {"id": "day", "q": "commands on 2026-06-09", "accept": [{"date": " 2026-06-09 "}]},
              {"id": "none", "q": "recovery", "accept": [{"text_contains_any": ["absent", "missing"]}]},
              {"id": "fig", "q": "recovery diagram", "accept": [{"content_type": "IMAGE_CAPTION", "source_doc": "mor"},
                                                                {"text_contains": "nope"}]}]
    path = tmp_path / "cases.json"
    path.write_text(json.dumps(listed))
    frame = ev.evaluate(Retriever(store, embedder), ev.cases_from_json(spark, str(path))).persist()
    rows = {r["id"]: r.asDict() for r in frame.collect()}
    assert {k: r["rank"] for k, r in rows.items()} == {"reset": 1, "day": 1, "none": 0, "fig": 1}
    assert rows["day"]["route"] == "commands" and rows["fig"]["top_source"] == "MOR · p.2 · image_caption"
    total = ev.totals(frame).first().asDict()
    assert [r["id"] for r in sorted(rows.values(), key=lambda r: r["ord"])] == ["reset", "day", "none", "fig"]
    assert total["misses"] == ["none"] and total["hit1"] == 0.75 and total["mrr"] == 0.75
    assert "Hit@1" in ev.report_text(list(rows.values()), total)
    assert json.loads(ev.report_json(list(rows.values()), total))["aggregate"]["n"] == 4
    assert "<table>" in ev.report_html(list(rows.values()), total)


def test_published_arithmetic(spark):
    ranks = spark.createDataFrame([(f"q{i}", 2 if i == 7 else 1) for i in range(15)], "id string, rank int")
    total = ev.totals(ev.with_hits(ranks)).first()
    assert round(total["hit1"], 3) == 0.933 and total["hit3"] == total["hit5"] == 1.0 and round(total["mrr"], 3) == 0.967
    empty = ev.totals(ev.with_hits(ranks.limit(0))).first()
    assert (empty["n"], empty["hit1"], empty["mrr"], empty["misses"]) == (0, 0.0, 0.0, [])


def test_captioning(spark, tmp_path):
    folder = tmp_path / "images"
    folder.mkdir()
    for name, data in {"MOR_p3_img0.png": png(80, 80), "MOR_p9_img1.png": png(80, 20), "MOR_p1_img0.wmf": b"x" * 9000,
                       "OPS_MANUAL_img001.png": png(100, 100), "MOR_p4_img0.png": b"x" * 6000, "MOR_p5_img2.png": png(90, 90)}.items():
        (folder / name).write_bytes(data)
    chunks = spark.createDataFrame(
        [(1, "a", "MOR", "m.pdf", 2, "H2", "", "OBC", [("images/MOR_p3_img0.png", 3, 0, "")]),
         (2, "b", "MOR", "m.pdf", 5, "H5", "5201", "AOCS", []), (3, "c", "OPS_MANUAL", "o.docx", None, "x", "", "OBC", [])],
        "ord bigint, chunk_id string, source_doc string, doc_filename string, page int, section_heading string, fcp_number string, "
        "subsystem string, images array<struct<file:string,page:int,index_on_page:int,caption:string>>")
    pages = spark.createDataFrame([("MOR", 3, "p" * 700)], "doc_key string, page int, text string")
    figures = captions.with_context(src.read_images(spark, str(folder)), chunks, pages)
    state = spark.createDataFrame([("MOR_p5_img2.png", "old")], "fname string, caption string")
    done, due = captions.done_and_due(figures, state)
    due = captions.prompts(due)
    skips = {r["fname"]: r["skip"] for r in due.collect()}
    assert skips == {"MOR_p3_img0.png": None, "OPS_MANUAL_img001.png": None, "MOR_p9_img1.png": "too small (80×20 px)",
                     "MOR_p1_img0.wmf": "unsupported vector format (.wmf)", "MOR_p4_img0.png": "could not open image"}
    told = {r["fname"]: r["prompt"] for r in due.collect()}
    assert "Section   : H5" in told["MOR_p3_img0.png"] and "p" * 600 + "..." in told["MOR_p3_img0.png"]
    assert "(no context available)" in told["OPS_MANUAL_img001.png"]

    def captioner(content, prompt):
        if b"d" == content[23:24]:
            raise ValueError("bad")
        return f"seen {len(content)}"

    results = captions.caption_figures(due, captioner)
    assert {(r["fname"], r["caption"], r["error"]) for r in results.collect()} == {
        ("MOR_p3_img0.png", "seen 6000", None), ("OPS_MANUAL_img001.png", None, "ValueError: bad")}
    assert captions.caption_figures(due, captioner, 1).count() == 1
    assert dict(map(tuple, captions.run_counts(done, due, results).collect())) == {
        "done": 1, "skipped": 3, "captioned": 1, "error": 1}
    stored = state.unionByName(results.where("error is null").select("fname", "caption"))
    rows = {r["chunk_id"]: r for r in captions.caption_chunks(figures.join(stored, "fname")).collect()}
    assert rows["IMG_MOR_p5_img2"]["subsystem"] == "AOCS" and rows["IMG_MOR_p3_img0"]["page"] == 3
    back = {r["chunk_id"]: r["images"] for r in captions.write_back(chunks, stored).collect()}
    assert back["a"][0]["caption"] == "seen 6000" and back["b"] == []


def test_state_and_json_sources(spark, tmp_path):
    assert src.read_state(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "c.json").write_text(json.dumps([{"fname": "b", "caption": "é"}, {"fname": "a", "caption": ""}]), encoding="utf-8")
    rows = src.read_json_array(spark, str(tmp_path / "c.json"), "fname string, caption string").orderBy("ord").collect()
    assert [(r["fname"], r["caption"]) for r in rows] == [("b", "é"), ("a", "")]


def test_log_stream_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_bytes(LOG.encode())
    store = st.Store(spark, str(tmp_path / "store"))

    def run():
        load_log_stream(store, str(tmp_path / "in"), HashingEmbedder(16), str(tmp_path / "cp")).awaitTermination()
        return store.ids(st.COMMANDS).count()

    assert run() == 3
    (tmp_path / "in" / "two.txt").write_bytes((LOG + "\n" + LOG.split("\n")[0].replace("0001", "0009")).encode())
    assert run() == 4
    found = ask(Retriever(store, HashingEmbedder(16)), "was SWITCH OFF uplinked", top_k=9)
    assert found.results.count() == 4             # streamed rows are indexed too


def test_files_of_one_batch_keep_their_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, mark in (("b.txt", "0007"), ("a.txt", "0001")):
        (tmp_path / "in" / name).write_bytes(LOG.replace("0001", mark).encode())
    store = st.Store(spark, str(tmp_path / "store"))
    load_log_stream(store, str(tmp_path / "in"), HashingEmbedder(16), str(tmp_path / "cp")).awaitTermination()
    rows = store.table(st.COMMANDS, "rows").select("id", "ord").collect()
    assert len({r["ord"] for r in rows}) == len(rows)


def test_index_holds_what_earlier_loads_stored(spark, tmp_path):
    store = st.Store(spark, str(tmp_path / "store"))

    def load(*texts):
        df = spark.createDataFrame([(i, t.split()[0], t) for i, t in enumerate(texts)], "ord bigint, chunk_id string, text string")
        return store.load(st.KNOWLEDGE, st.prepared(df, "chunk_id"), HashingEmbedder(8))

    assert load("a1 firstword shared", "a2 other shared") == 2 and load("b1 secondword shared") == 1
    stats = store.stats(st.KNOWLEDGE)
    assert stats.n == 3 and {r["df"] for r in stats.terms.where("term = 'shared'").collect()} == {3}
    retriever = Retriever(store, HashingEmbedder(8))
    for word, wanted in (("firstword", "a1"), ("secondword", "b1")):
        assert wanted in {r["id"] for r in ask(retriever, f"what is {word}").results.where("list_no = 1").collect()}
    scans = retriever._lexical(st.KNOWLEDGE, spark.createDataFrame([("q", "firstword", None)], "qid string, question string, subsystem string"), 5)
    assert scans.count() == 1


def test_command_line_settings(spark, tmp_path):
    state = {"k": 5, "sources": True, "subsystem": None}
    assert cli.chat_setting("a question", state) is None
    cli.chat_setting(":k 7", state), cli.chat_setting(":sources off", state), cli.chat_setting(":sub obc", state)
    assert state == {"k": 7, "sources": False, "subsystem": "OBC"}
    assert "Usage" in cli.chat_setting(":k x", state) and ":exit" in cli.chat_setting(":help", state)
    args = cli.parser().parse_args(["ask", "q", "--k", "3", "--subsystem", "OBC", "--no-sources"])
    assert (args.k, args.subsystem, args.sources) == (3, "OBC", False)
    sinks.append_audit(spark, str(tmp_path / "audit"), "q", 5, None)
    sinks.append_audit(spark, str(tmp_path / "audit"), "r", 5, "OBC")
    assert {r["line"] for r in spark.read.json(str(tmp_path / "audit")).collect()} == {
        "QUERY | k=5 sub=None | q", "QUERY | k=5 sub=OBC | r"}


def test_command_line_build_and_ask(spark, site, tmp_path, capsys, monkeypatch):
    registry = tmp_path / "registry.json"
    registry.write_text(json.dumps({"OPS_MANUAL": "ops.docx", "TCH": "log.txt"}))
    work = ["--work", str(tmp_path / "work")]
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    cli.main([*work, "extract", str(site), "--registry", str(registry)])
    cli.main([*work, "build"])
    cli.main([*work, "ask", "What commands were uplinked on 2026-06-09?", "--csv", str(tmp_path / "csv")])
    out = capsys.readouterr().out
    assert "**3 commands uplinked on 2026-06-09**" in out and "OBC-1 SWITCH OFF" in out
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3


def test_refresh_replaces_stored_rows(spark, tmp_path):
    store = st.Store(spark, str(tmp_path / "store"))
    def rows(*items):
        df = spark.createDataFrame([(i, f"c{i}", t) for i, t in items], "ord bigint, chunk_id string, text string")
        return st.prepared(df, "chunk_id")
    assert store.load("k", rows((1, "one"), (2, "two")), HashingEmbedder(8)) == 2
    assert store.load("k", rows((2, "changed"), (3, "three")), HashingEmbedder(8)) == 1
    assert {r["document"] for r in store.table("k", "rows").collect()} == {"one", "two", "three"}
    store.load("k", rows((2, "changed")), HashingEmbedder(8), refresh=True)
    assert {r["document"] for r in store.table("k", "rows").collect()} == {"one", "changed", "three"}
    store.load("k", rows((9, "only")), HashingEmbedder(8), reset=True)
    assert [r["id"] for r in store.ids("k").collect()] == ["c9"]


def test_default_questions_route_as_expected(spark):
    from pagewright.functions.intents import route
    from pagewright.plans.labelled import LABELLED
    df = ev.cases(spark, LABELLED)
    assert {r["id"] for r in df.where(route(F.col("q")) == "commands").collect()} == {"cmds_date"} and df.count() == 15


def test_panel_figures(tmp_path):
    from pagewright.plans.ask import panel_figures
    paths = [str(tmp_path / f"{i}.png") for i in range(5)]
    for path in paths[:4]:
        open(path, "wb").close()
    assert panel_figures(paths) == (paths[:3], 1)
