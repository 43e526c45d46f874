"""Vector cells: recall, pruning, exactness, loads."""

import numpy as np
import pytest

from pagewright.models import HashingEmbedder
from pagewright.operators import cells, vectors
from pagewright.plans import store as st
from pagewright.plans.ask import Retriever, answering

FOLDER = "/root/testdata/sf0.1"


def grouped(n=4000, width=16, groups=40, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, width))
    v = middle[rng.integers(0, groups, n)] + 0.35 * rng.normal(size=(n, width))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def table(spark, data, tag=lambda i: "AB"[i % 2]):
    rows = [(f"r{i}", i, tag(i), v.tolist()) for i, v in enumerate(data)] + [("none", -1, "A", None)]
    return spark.createDataFrame(rows, "id string, ord bigint, tag string, embedding array<float>")


def best(data, q, k, allowed=None):
    scores = np.round(data.astype(float) @ np.array(q), 9)
    order = [i for i in np.lexsort((np.arange(len(data)), -scores)) if allowed is None or allowed(i)][:k]
    return [(f"r{i}", scores[i]) for i in order]


def lists(found):
    out = {}
    for r in found.orderBy("list_key", "rank").collect():
        out.setdefault(r["list_key"], []).append((r["id"], r["score"]))
    return out


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    data, path = grouped(), str(tmp_path_factory.mktemp("cells"))
    rows = table(spark, data)
    cells.write(rows, cells.train(rows, "id", 40), path)
    return data, cells.CellIndex(spark, path), path


def test_few_cells_find_nearly_all(index):
    data, held, _ = index
    searches = [vectors.Search(f"q{i}", tuple(map(float, data[i])), 10) for i in range(0, 4000, 40)]
    found = lists(held.search(searches, "id", ["ord"], probes=6))
    right = sum(len({a for a, _ in found[s.key]} & {a for a, _ in best(data, s.vector, 10)}) for s in searches)
    assert right >= 0.9 * 10 * len(searches)
    assert held.share(searches, 6) < 0.3


def test_only_named_cells_are_read(index):
    data, held, _ = index
    searches = held._probed([vectors.Search("q", tuple(map(float, data[0])), 5)], 3)
    plan = vectors.search(held.read(searches), searches, "id", ["ord"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    assert held.read(searches).select("cell").distinct().count() == 3


def test_bounds_make_it_exact(index):
    data, held, _ = index
    searches = [vectors.Search(f"q{i}", tuple(map(float, data[i])), 3 + i % 7) for i in range(0, 4000, 200)]
    searches += [vectors.Search("filtered", tuple(map(float, data[7])), 5, "tag", ("B",)), vectors.Search("none", tuple(map(float, data[7])), 5, "tag", ("Z",))]
    found = lists(held.search_exact(searches, "id", ["ord"], probes=1))
    for s in searches:
        allowed = None if not s.column else (lambda i: i % 2 == 1) if s.allowed == ("B",) else (lambda i: False)
        assert found.get(s.key, []) == [(a, pytest.approx(b)) for a, b in best(data, s.vector, s.k, allowed)]


def test_a_short_filtered_list_goes_over_all_cells(index):
    data, held, _ = index
    q = tuple(map(float, data[3]))
    found = lists(held.search([vectors.Search("all", q, 4), vectors.Search("rare", q, 4000, "tag", ("B",))], "id", ["ord"], probes=2))
    assert found["rare"] == [(a, pytest.approx(b)) for a, b in best(data, q, 4000, lambda i: i % 2 == 1)]
    assert len(found["all"]) == 4


def test_every_row_is_assigned_and_reruns_agree(spark, index):
    data, held, path = index
    assert held.rows.count() == 4001 and held.rows.where("cell = -1").count() == 1 and held.sizes.sum() == 4000
    again = cells.train(table(spark, data).repartition(5), "id", 40)
    assert np.array_equal(again, cells.train(table(spark, data).repartition(3), "id", 40))


def test_odd_tables(spark, tmp_path):
    empty = table(spark, np.zeros((0, 4), np.float32))
    cells.write(empty, cells.train(empty, "id", 8), str(tmp_path / "a"))
    held = cells.CellIndex(spark, str(tmp_path / "a"))
    search = [vectors.Search("q", (1.0, 0.0, 0.0, 0.0), 3)]
    assert held.search(search, "id", ["ord"], 2).count() == 0 and held.search_exact(search, "id", ["ord"], 2).count() == 0
    same = np.tile(np.array([[1, 0, 0, 0]], np.float32), (30, 1))
    rows = table(spark, same)
    cells.write(rows, cells.train(rows, "id", 8), str(tmp_path / "b"))
    held = cells.CellIndex(spark, str(tmp_path / "b"))
    assert [a for a, _ in lists(held.search(search, "id", ["ord"], 1))["q"]] == ["r0", "r1", "r2"]


def test_recall_over_the_given_table(spark, tmp_path):
    """The given vectors have next to no structure: most cells have to be read for this recall."""
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    cells.write(rows, cells.train(rows, "vec_id", 32), str(tmp_path / "c"))
    held = cells.CellIndex(spark, str(tmp_path / "c"))
    data = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.collect()}
    searches = [vectors.Search(str(i), tuple(data[i]), 10) for i in sorted(data)[::20]]
    exact = {}
    for r in vectors.search(rows, searches, "vec_id", ["vec_id"]).collect():
        exact.setdefault(r["list_key"], set()).add(r["vec_id"])
    shares = {}
    for probes in (4, 12, 20):
        hit = sum(r["vec_id"] in exact[r["list_key"]] for r in held.search(searches, "vec_id", ["vec_id"], probes).collect())
        shares[probes] = (hit / sum(map(len, exact.values())), held.share(searches, probes))
    print(shares)
    assert shares[20][0] >= 0.9


def test_store_searches_cells_and_later_loads(spark, tmp_path):
    store, embedder = st.Store(spark, str(tmp_path / "store")), HashingEmbedder(32)
    words = ["valve", "pump", "tank", "line", "gauge", "filter", "motor", "relay"]

    def load(first, n, **how):
        rows = [(i, f"c{i}", f"{words[i % 8]} {words[i % 7]} number {i}", "UNKNOWN") for i in range(first, first + n)]
        df = spark.createDataFrame(rows, "ord bigint, chunk_id string, text string, subsystem string")
        return store.load(st.KNOWLEDGE, st.prepared(df, "chunk_id"), embedder, **how)

    def ids(retriever):
        _, found = retriever.retrieve([{"qid": "q", "question": "relay pump number 77"}], answering(4))
        return [r["id"] for r in found.orderBy("rank").collect()]

    load(0, 60)
    exact, near = Retriever(store, embedder), Retriever(store, embedder, probes=6)
    assert store.cell_index(st.KNOWLEDGE) == (None, None) and ids(near) == ids(exact)
    store.build_cells(st.KNOWLEDGE, 6)
    index, newer = store.cell_index(st.KNOWLEDGE)
    assert newer is None and index.sizes.sum() == 60 and ids(near) == ids(exact)
    load(60, 30)
    index, newer = store.cell_index(st.KNOWLEDGE)
    assert newer.count() == 30 and ids(near) == ids(exact) and "c77" in ids(near)
    store.build_cells(st.KNOWLEDGE, 6)
    assert store.cell_index(st.KNOWLEDGE)[0].sizes.sum() == 90 and ids(near) == ids(exact)
    load(0, 5, reset=True)
    assert store.cell_index(st.KNOWLEDGE) == (None, None) and ids(near) == ids(exact)
