import json
import zipfile
from io import BytesIO

import numpy as np
import pytest

from foliospark.codecs import bzz, container, iff, layers
from foliospark.codecs import raster as R
from foliospark.functions import text as T
from foliospark.sinks import files, jobs, markup
from foliospark.sources import documents as D
from foliospark.sources import images, lazy
from foliospark.streaming import progressive

ZONES = [dict(zip(("zone_id", "parent_id", "kind", "x", "y", "w", "h", "text"), z, strict=True)) for z in ((0, None, "page", 0, 0, 90, 60, "Hello W<rld"), (1, 0, "line", 10, 20, 70, 20, "Hello W<rld"), (2, 1, "word", 10, 20, 30, 20, "Hello"), (3, 1, "word", 50, 20, 30, 20, "W<rld"))]


@pytest.fixture(scope="module")
def img():
    y, x = np.mgrid[0:60, 0:90]
    a = np.stack([200 + 30 * np.sin(x / 20), 210 + 20 * np.cos(y / 30), 230 + 0 * x], axis=2).astype(np.uint8)
    a[20:30, 20:60] = 0
    return a


@pytest.fixture(scope="module")
def folder(tmp_path_factory, img):
    t = tmp_path_factory.mktemp("docs")

    def page():
        f = R.encode_page(img, profile="archival", dpi=100)
        f.children += [iff.Chunk("TXTz", bzz.encode(layers.write_text("Hello W<rld", ZONES, 60))), iff.Chunk("ANTz", bzz.encode(b'(zoom 120) (maparea "#2" "" (rect 1 2 30 10))')), iff.Chunk("METa", b'(metadata (title "T"))')]
        return f

    marks = container.write_bookmarks([{"node_id": 0, "parent_id": None, "sibling_ord": 0, "title": "One", "url": "#1"}, {"node_id": 1, "parent_id": 0, "sibling_ord": 0, "title": "Two", "url": "#2"}])
    (t / "a.djvu").write_bytes(container.bundle([("page", "p1", page()), ("page", "p2", page())], marks))
    (t / "b.djvu").write_bytes(iff.emit(page()))
    (t / "bad.djvu").write_bytes(b"junk" * 6)
    (t / "x.PNG").write_bytes(R.write_png(img))
    return t


def test_tables(spark, folder):
    f = D.files(spark, str(folder), "*.djvu")
    counts = {n: getattr(D, n)(f).where("error is null").count() for n in ("chunks", "components", "pages", "texts", "zones", "bookmarks", "annotations", "mapareas", "metadata")}
    assert counts == {"chunks": 47 - 1 + 3, "components": 2, "pages": 3, "texts": 3, "zones": 12, "bookmarks": 2, "annotations": 3, "mapareas": 3, "metadata": 2}
    assert D.pages(f).where("error is not null").count() == 1
    assert {r["text"] for r in D.texts(f).where("error is null").collect()} == {"Hello W<rld"}
    paragraphs = D.texts(f).where("error is null").select(T.reflow("text").alias("p")).selectExpr("p[0].text t").distinct().collect()
    assert [r["t"] for r in paragraphs] == ["Hello W<rld"]


def test_ranged_pages(spark, folder):
    f = D.files(spark, str(folder), "*.djvu")
    index = D.pages(f).where("error is null and page_index = 1")
    row = D.page_bytes(f, index).collect()[0]
    assert bytes(row["page"])[:4] == b"FORM"
    spark.dataSource.register(lazy.PageSource)
    own = [[r["path"], r["page_index"], r["byte_start"], r["byte_end"]] for r in index.collect()]
    got = spark.read.format("document_pages").option("index", json.dumps(own)).load().collect()
    assert bytes(got[0]["page"]) == bytes(row["page"])


def test_indirect(spark, folder, tmp_path):
    (tmp_path / "book.djvu").write_bytes(container.index_file([("page", "b.djvu"), ("page", "none.djvu"), ("page", "../up.djvu")]))
    parts = D.with_parts(D.files(spark, str(tmp_path)), D.files(spark, str(folder), "*.djvu").selectExpr(f"replace(path, '{folder}', '{tmp_path}') path", "content"))
    assert {(r["comp_id"], r["error"] is None) for r in parts.collect()} == {("b.djvu", True), ("none.djvu", False), ("../up.djvu", False)}


def test_exports(spark, folder):
    f = D.files(spark, str(folder), "a.djvu")
    out = {k: bytes(jobs.export(f, k, 100).collect()[0]["file"]) for k in ("pdf", "epub", "tiff", "cbz")}
    assert out["pdf"].startswith(b"%PDF-1.4") and out["pdf"].count(b"/Type /Page ") == 2 and b"/Outlines" in out["pdf"] and b"/Subtype /Link" in out["pdf"]
    names = zipfile.ZipFile(BytesIO(out["epub"])).namelist()
    assert names[0] == "mimetype" and "OEBPS/page_0002.xhtml" in names
    assert zipfile.ZipFile(BytesIO(out["cbz"])).namelist() == ["page_0001.png", "page_0002.png"]
    assert out["tiff"][:4] == b"II*\0"
    assert {r["error"] for r in jobs.render(f, 50).collect()} == {None}


def test_text_exports(spark, folder):
    f = D.files(spark, str(folder), "b.djvu")
    hocr, alto, js, plain = (jobs.text_export(f, k).collect()[0]["text"] for k in ("hocr", "alto", "json", "plain"))
    assert 'id="word_0_1" title="bbox 50 20 80 40">W&lt;rld<' in hocr and 'CONTENT="W&lt;rld"' in alto and plain == "Hello W<rld"
    assert [w["t"] for w in json.loads(js)] == ["Hello", "W<rld"]
    text, zones = markup.read_hocr(hocr, 90, 60)
    assert text == "Hello W<rld" and [z["kind"] for z in zones] == ["page", "line", "word", "word"]


def test_scaling_by_dpi():
    page = {"width": 90, "height": 60, "dpi": 100}
    fit, w, h = markup.scaled(ZONES, page, 200)
    assert (w, h, fit[3]["x"]) == (180, 120, 100)
    assert markup.scaled(ZONES, {**page, "dpi": 0}, 200)[1:] == (90, 60)


def test_blank_page_for_failure():
    assert files.pdf([{"width": 10, "height": 10, "dpi": 0, "rgb": None}]).count(b"/Type /Page ") == 1
    assert [files.page_number(u) for u in ("#3", "#+3", "#page3", "#page_3", "#page=3", "#x", "http://a#3")] == [3, 3, 3, 3, 3, None, None]


def test_png_files(spark, folder):
    r = images.png_files(spark, str(folder)).collect()
    assert [(x["w"], x["h"], x["error"]) for x in r] == [(90, 60, None)]


def test_progressive_stream_equals_batch(spark, folder, tmp_path, img):
    chunks = container.read((folder / "a.djvu").read_bytes()).pages[0].all("BG44")
    kind = "doc_id long, page_index int, ordinal int, data binary"
    spark.createDataFrame([(1, 0, i, bytes(c)) for i, c in enumerate(chunks)][::-1], kind).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    q = progressive.refinements(stream).writeStream.format("memory").queryName("frames").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("select * from frames order by ordinal").collect()
    assert len(rows) == len(chunks)
    assert bytes(rows[-1]["png"]) == R.write_png(R.wavelet_layer(chunks))
