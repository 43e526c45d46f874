"""Loads of a store: bucketed ids, statistics written once a load, loads merged into one."""

import os
import struct
import time
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from pagewright import cli, schema, session
from pagewright.models import HashingEmbedder
from pagewright.operators import lexical
from pagewright.plans import ask as asking, store as st
from pagewright.plans.ask import Retriever, ask


def pieces(spark, *items):
    df = spark.createDataFrame([(i, f"c{i}", t) for i, t in items], "ord bigint, chunk_id string, text string")
    return st.prepared(df, "chunk_id")


def two_loads(spark, folder):
    store = st.Store(spark, str(folder))
    assert store.load(st.KNOWLEDGE, pieces(spark, (1, "alpha shared"), (2, "beta shared")), HashingEmbedder(8)) == 2
    assert store.load(st.KNOWLEDGE, pieces(spark, (2, "beta again"), (3, "gamma shared alpha")), HashingEmbedder(8)) == 1
    return store


def test_what_is_stored_is_not_shuffled_to_find_new_ids(spark, tmp_path):
    store = two_loads(spark, tmp_path / "store's")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pending = store.pending(st.KNOWLEDGE, pieces(spark, (3, "x"), (4, "y")).select("id"))
        assert [r["id"] for r in pending.collect()] == ["c4"]
        stored = spark.table(store._id_table(st.KNOWLEDGE)[0])
        given = spark.range(4).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"))
        joined = given.join(stored.where("load in (0, 1)").select("id"), "id", "left_anti")
        text = joined._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange") == 1 and "SortMergeJoin" in text and "PartitionFilters" in text, text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_buckets_hold_when_a_later_session_has_other_settings(spark, tmp_path):
    store = two_loads(spark, tmp_path / "store")
    name, buckets = store._id_table(st.KNOWLEDGE)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.sql(f"DROP TABLE {name}")      # what a new session's catalog knows; the files stay
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        later = st.Store(spark, str(tmp_path / "store"))
        assert later._id_table(st.KNOWLEDGE) == (name, buckets) and buckets != 7
        assert later.load(st.KNOWLEDGE, pieces(spark, (1, "x"), (3, "y"), (5, "five")), HashingEmbedder(8)) == 1
        assert sorted(r["id"] for r in later.ids(st.KNOWLEDGE).collect()) == ["c1", "c2", "c3", "c5"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_statistics_of_each_load_are_those_of_all_texts(spark, tmp_path):
    store = two_loads(spark, tmp_path / "store")
    stored, counted = store.stats(st.KNOWLEDGE), lexical.Stats.counted(
        lexical.tokenized(store.table(st.KNOWLEDGE, "rows"), ["id"], F.col("document")))
    assert (stored.n, stored.avgdl) == (counted.n, counted.avgdl) and stored.n == 3
    assert abs(stored.floor - counted.floor) < 1e-12      # a sum in another order
    idf = F.round("idf", 9)
    assert sorted(map(tuple, stored.terms.select("term", "df", idf).collect())) == sorted(
        map(tuple, counted.terms.select("term", "df", idf).collect()))


def test_merged_loads_hold_the_same(spark, tmp_path):
    store = two_loads(spark, tmp_path / "store")
    retriever = Retriever(store, HashingEmbedder(8))

    def seen():
        results = ask(retriever, "what is gamma alpha").results
        return (sorted(map(tuple, results.select("rank", "id", "list_no", F.round("score", 9)).collect())),
                sorted(map(tuple, store.table(st.KNOWLEDGE, "postings").select("id", "term").collect())),
                sorted(map(tuple, store.stats(st.KNOWLEDGE).terms.collect())), store.counts()[st.KNOWLEDGE])

    before = seen()
    assert store.merge_loads(st.KNOWLEDGE) == 2 and len(store.loads(st.KNOWLEDGE)) == 1
    assert seen() == before
    assert store.merge_loads(st.KNOWLEDGE) == 1 and store.merge_loads("nothing") == 0
    assert store.load(st.KNOWLEDGE, pieces(spark, (1, "x"), (9, "nine")), HashingEmbedder(8)) == 1
    assert store.stats(st.KNOWLEDGE).n == 4


def test_a_load_keeps_one_copy_and_nothing_beside_the_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    store = st.Store(spark, str(tmp_path / "store"))
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def kept():
        """Files beside the store's, and shuffle files."""
        beside = [p for p in tmp_path.rglob("*.parquet") if Path(store.folder) not in p.parents]
        return {*beside, *(p for d in folders for p in Path(d).rglob("shuffle_*.data"))}

    before = kept()
    store.load(st.KNOWLEDGE, pieces(spark, *[(i, f"word{i} shared " + os.urandom(600).hex()) for i in range(400)]), HashingEmbedder(8))
    deadline = time.time() + 20      # Spark drops shuffle files beside its other work
    while time.time() < deadline and any(p.stat().st_size > 100_000 for p in kept() - before):
        time.sleep(0.5)
    left = kept() - before
    assert not [p for p in left if p.suffix == ".parquet"], left
    assert not [p for p in left if p.suffix == ".data" and p.stat().st_size > 100_000], left
    bodies = [p.parent.parent.name for p in Path(store.folder).rglob("*.parquet") if "document" in pq.read_schema(p).names]
    assert set(bodies) == {"rows"}
    payload = store.table(st.KNOWLEDGE, "items")
    assert payload.columns == ["id", "ord", "document", *schema.METADATA] and payload.count() == 400


def index_of(spark, folder, items, **how):
    store = st.Store(spark, str(folder))
    store.load(st.KNOWLEDGE, pieces(spark, *items), HashingEmbedder(8), **how)
    return store


def test_an_index_sorted_in_slices_is_the_same(spark, tmp_path, monkeypatch):
    items = [(i, " ".join(f"w{(i * k) % 97:02d}" for k in range(1, 9)) + " shared") for i in range(200)]
    whole = index_of(spark, tmp_path / "whole", items)
    monkeypatch.setattr(st, "SAMPLE_TEXTS", 10)
    monkeypatch.setattr(st, "SLICE_POSTINGS", 100)
    written = []
    monkeypatch.setattr(st.Store, "_cuts", lambda self, texts, f=st.Store._cuts: written.append(f(self, texts)) or written[-1])
    sliced = index_of(spark, tmp_path / "sliced", items)
    assert 1 < len(written[0]) + 1 <= st.SLICES and written[0] == sorted(set(written[0]))
    rows = ["term", *st.POSTING_COLUMNS, "dl"]
    for part, columns in (("postings", rows), ("terms", ["term", "df"]), ("numbers", ["n", "total"]), ("rows", ["id", "document"])):
        a, b = (sorted(map(tuple, s.table(st.KNOWLEDGE, part).select(*columns).collect())) for s in (whole, sliced))
        assert a == b and a, part
    ends = sorted((t["term"][0], t["term"][-1]) for p in Path(sliced.folder).rglob("postings/load=0/*.parquet")
                  if (t := pq.read_table(p).to_pydict())["term"] == sorted(t["term"]) and t["term"])
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:])) and len(ends) >= len(written[0]) + 1
    assert sliced.load(st.KNOWLEDGE, pieces(spark, (1, "x"), (900, "late w01")), HashingEmbedder(8)) == 1
    before = sorted(map(tuple, sliced.table(st.KNOWLEDGE, "postings").select(*rows).collect()))
    assert sliced.merge_loads(st.KNOWLEDGE) == 2
    assert sorted(map(tuple, sliced.table(st.KNOWLEDGE, "postings").select(*rows).collect())) == before


def test_texts_that_the_stored_columns_do_not_give_are_indexed_whole(spark, tmp_path):
    long = "start " + "x" * 9000 + " tail"
    items = spark.createDataFrame([(1, "a", long, "head"), (2, "b", "  plain  ", "h" * 450 + " lastword"), (3, "c", "", "")],
                                  "ord bigint, chunk_id string, text string, section_heading string")
    rows = st.stored_rows(items, "chunk_id")
    rows = rows.unionByName(rows.where("id = 'c'").withColumns({"id": F.lit("d"), "embed_text": F.lit(None).cast("string")}))
    rows = rows.unionByName(rows.where("id = 'a'").withColumns({"id": F.lit("e"), "embed_text": F.lit("of another maker")}))
    store = st.Store(spark, str(tmp_path / "store"))
    assert store.load(st.KNOWLEDGE, rows, HashingEmbedder(8)) == 5
    want = lexical.postings(lexical.tokenized(rows, ["id"], F.col("embed_text")), ["id"]).select("id", "dl", "term")
    got = store.table(st.KNOWLEDGE, "postings").select("id", "dl", "term")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "embed_text" not in store.table(st.KNOWLEDGE, "rows").columns
    assert store.load(st.KNOWLEDGE, rows.withColumn("embed_text", F.lit("fresh")), HashingEmbedder(8), refresh=True) == 0
    assert {r["term"] for r in store.table(st.KNOWLEDGE, "postings").collect()} == {"fresh"}


def test_many_wanted_values_are_joined(spark, monkeypatch):
    table, wanted = spark.range(50).selectExpr("cast(id as string) AS id"), spark.range(0, 60, 5).selectExpr("cast(id as string) AS id")
    few = sorted(r["id"] for r in asking.narrowed(table, "id", wanted.union(wanted)).collect())
    monkeypatch.setattr(asking, "PUSHED", 3)
    assert sorted(r["id"] for r in asking.narrowed(table, "id", wanted.union(wanted)).collect()) == few and len(few) == 10


def _vision(content, prompt):
    if len(content) == 7000:
        raise OSError("busy")
    return f"seen {len(content)}"


def test_command_line_captions_go_on_from_run_to_run(spark, tmp_path, monkeypatch, capsys):
    work = tmp_path / "work"
    (work / "images").mkdir(parents=True)
    head = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 300, 300)
    for name, size in (("MOR_p5_img0.png", 6000), ("MOR_p5_img1.png", 7000), ("MOR_p5_img2.png", 40)):
        (work / "images" / name).write_bytes(head + b"\0" * (size - len(head)))
    spark.createDataFrame(
        [("a", 0, "MOR", "m.pdf", "section", 5, "Head", None, "OBC", [("MOR_p5_img0.png", 5, 0, None)])],
        "chunk_id string, ord bigint, source_doc string, doc_filename string, content_type string, page int, section_heading string, "
        "fcp_number string, subsystem string, images array<struct<file:string,page:int,index_on_page:int,caption:string>>"
    ).write.parquet(str(work / "chunks"))
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    monkeypatch.setattr(cli, "local_vision", lambda: _vision)
    for _ in range(2):
        cli.main(["--work", str(work), "caption"])
    out = capsys.readouterr().out
    assert "captioned" in out and "error" in out and "skipped" in out
    assert [tuple(r) for r in spark.read.parquet(str(work / "caption_state")).select("fname", "caption").collect()] == [
        ("MOR_p5_img0.png", "seen 6000")]
    [chunk] = spark.read.parquet(str(work / "image_captions")).collect()
    assert chunk["text"] == "seen 6000" and chunk["section_heading"] == "Head"
    attempts = spark.read.parquet(str(work / "caption_runs" / "outcomes")).groupBy("fname").count().collect()
    assert {r["fname"]: r["count"] for r in attempts} == {"MOR_p5_img0.png": 1, "MOR_p5_img1.png": 2}
