"""The page data source, with an opener of its own: pages end in form feeds, ``<name>`` is a picture."""

import re
import uuid

import pytest

from pagewright import cli
from pagewright.plans import ingest
from pagewright.sources import pages


def opener_of(log):
    class Page:
        def __init__(self, body):
            self.body = body

        def text(self):
            if "BROKEN" in self.body:
                raise ValueError("damaged page")
            return re.sub(r"<\w+>", "", self.body)

        def pictures(self):
            for i, name in enumerate(re.findall(r"<(\w+)>", self.body)):
                if name == "lost":
                    raise OSError("damaged picture")
                yield i, "png", name.encode()

    class Document(list):
        pass

    def paper(data):
        (log / uuid.uuid4().hex).write_bytes(data[:1])
        if data.startswith(b"not"):
            raise RuntimeError("no paper")
        return Document(map(Page, data.decode().split("\f")[:-1]))

    return paper


@pytest.fixture
def site(tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "in").mkdir()
    bodies = [f"page {i}\n" + ("1 GENERAL\n" if i == 3 else "SCOPE OF IT\nbody" if i == 4 else "BROKEN" if i == 7 else "<one><two>" if i == 8 else "<one><lost>" if i == 9 else "")
              for i in range(1, 11)]
    (tmp_path / "in" / "m.pdf").write_text("\f".join(bodies) + "\f")
    (tmp_path / "in" / "e.pdf").write_text("")
    (tmp_path / "in" / "x.pdf").write_text("not a document")
    return tmp_path


def test_one_opening_a_range(spark, site):
    found = pages.read_pages(spark, str(site / "in"), {"MOR": "m.pdf", "E": "e.pdf", "X": "x.pdf"}, opener_of(site / "log"), range_pages=4)
    rows = {(r["doc_key"], r["page"]): r for r in found.collect()}
    # three files are counted, and the ranges 1-4, 5-8 and 9-10 of one are read
    assert len(list((site / "log").iterdir())) == 3 + 3
    assert set(rows) == {("MOR", i) for i in range(1, 11)} | {("X", None)}
    assert rows["MOR", 7]["error"] == "ValueError: damaged page" and rows["MOR", 7]["text"] is None
    assert rows["X", None]["error"] == "RuntimeError: no paper" and rows["X", None]["pictures"] == []
    assert [(p["file"], bytes(p["content"])) for p in rows["MOR", 8]["pictures"]] == [("MOR_p8_img0.png", b"one"), ("MOR_p8_img1.png", b"two")]
    assert [i["file"] for i in rows["MOR", 8]["images"]] == ["images/MOR_p8_img0.png", "images/MOR_p8_img1.png"]
    # what was read before the damage stays
    assert rows["MOR", 9]["error"] == "OSError: damaged picture" and len(rows["MOR", 9]["pictures"]) == 1 and rows["MOR", 9]["text"] == "page 9\n"
    assert rows["MOR", 1]["error"] is None and rows["MOR", 1]["text"] == "page 1\n"


def test_ranges_are_partitions(spark, site):
    found = pages.read_pages(spark, str(site / "in"), {"MOR": "m.pdf"}, opener_of(site / "log"), range_pages=3, pictures=False)
    assert found.rdd.getNumPartitions() == 4
    assert found.where("size(pictures) > 0").count() == 0 and found.where("error IS NOT NULL").count() == 1


def test_pages_to_images_and_sections(spark, site):
    found = pages.read_pages(spark, str(site / "in"), {"MOR": "m.pdf"}, opener_of(site / "log"), range_pages=2)
    images = [tuple(r) for r in pages.page_images(found).select("file", "page", "index_on_page").orderBy("file").collect()]
    assert images == [("MOR_p8_img0.png", 8, 0), ("MOR_p8_img1.png", 8, 1), ("MOR_p9_img0.png", 9, 0)]
    chunks, _ = ingest.document_chunks(spark, str(site / "in"), {"MOR": "m.pdf", "GONE": "gone.pdf"}, pages=found)
    [chunk] = chunks.collect()
    assert (chunk["section_heading"], chunk["page"]) == ("1 GENERAL", 3) and chunk["text"].startswith("1 GENERAL\npage 4\nSCOPE OF IT\nbody\npage 5")
    assert ingest.pdf_pages(spark, str(site / "in"), {"GONE": "gone.pdf"}) is None


def test_a_second_extract_changes_nothing(spark, site, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "pdf_pages", lambda spark, folder, registry: ingest.pdf_pages(spark, folder, registry, opener_of(site / "log")))
    (site / "registry.json").write_text('{"MOR": "m.pdf"}')
    work = tmp_path / "work"
    for _ in range(2):
        cli.main(["--work", str(work), "extract", str(site / "in"), "--registry", str(site / "registry.json")])
        assert spark.read.parquet(str(work / "pages")).count() == 10
        assert sorted(p.name for p in (work / "images").iterdir()) == ["MOR_p8_img0.png", "MOR_p8_img1.png", "MOR_p9_img0.png"]
