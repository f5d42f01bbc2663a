import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.cli import main
from foliospark.codecs import container, iff, iw44, raster
from foliospark.functions import numeric, text
from foliospark.operators import lookup, outline, recognition
from foliospark.operators.shared import running_sum
from foliospark.sources import documents as D


def a_page(profile="archival", **more):
    rng = np.random.default_rng(5)
    img = np.full((90, 70, 3), 235, np.uint8) - rng.integers(0, 9, (90, 70, 3)).astype(np.uint8)
    img[20:30, 10:40], img[50:58, 30:60] = (200, 20, 10), (0, 0, 90)
    return raster.encode_page(img, profile=profile, dpi=100, **more)


def test_regions_and_strips_are_cuts_of_the_whole():
    for profile in ("lossless", "quality", "archival"):
        page = container.read(iff.emit(a_page(profile))).pages[0]
        whole = raster.render(page)
        for box in ((0, 0, 70, 90), (5, 17, 31, 22), (60, 80, 40, 40), (69, 89, 1, 1)):
            x, y, w, h = box
            assert (raster.render(page, region=box) == whole[y : y + h, x : x + w]).all()
        assert (np.concatenate(list(raster.render_rows(page, 16))) == whole).all()
        small = raster.render(page, 35, 45)
        assert (raster.render(page, 35, 45, region=(3, 4, 20, 20)) == small[4:24, 3:23]).all()
        assert raster.is_bilevel(page) == (profile == "lossless")


def test_thumbnails_and_layers_that_are_not_read(spark):
    img = np.full((20, 30, 3), 128, np.uint8)
    form = a_page("lossless")
    small = iff.form("DJVU", *form.children, *[iff.Chunk("TH44", c) for c in iw44.encode(img)])
    photo = iff.form("DJVU", *form.children, iff.Chunk("BGjp", b"\xff\xd8"))
    files = spark.createDataFrame([("a", iff.emit(small)), ("b", iff.emit(form)), ("c", iff.emit(photo))], "path string, content binary")
    got = D.thumbnails(files).collect()
    assert [(r["path"], r["width"], r["height"]) for r in got] == [("a", 30, 20)]
    page = container.read(iff.emit(photo)).pages[0]
    with pytest.raises(ValueError, match="unsupported layer BGjp"):
        raster.render(page)
    assert raster.render(page, permissive=True).shape == (90, 70, 3) and not raster.is_bilevel(page)


def test_full_blocks_take_the_nearest_ring():
    rng = np.random.default_rng(1)
    rgb = rng.integers(140, 255, (30, 42, 3)).astype(np.uint8)
    rgb[3:24, 6:36] = 0
    mask, back = raster.segment(rgb, subsample=3)
    for by in range(10):
        for bx in range(14):
            for r in range(15):
                ring = [(y, x) for y in range(30) for x in range(42) if max(abs(y // 3 - by), abs(x // 3 - bx)) == r and not mask[y, x]]
                if ring:
                    assert back[by, bx].tolist() == [sum(int(rgb[y, x, c]) for y, x in ring) // len(ring) for c in range(3)]
                    break


def test_indirect_documents_are_put_together(spark):
    page = iff.emit(a_page("lossless"))
    index = iff.emit(iff.form("DJVM", iff.Chunk("DIRM", container.write_directory([container.Entry("page", "p1.djvu", None, len(page)), container.Entry("page", "p2.djvu", None, len(page))], bundled=False))))
    files = spark.createDataFrame([("d/index.djvu", index), ("e/index.djvu", index)], "path string, content binary")
    parts = spark.createDataFrame([("d/p1.djvu", page), ("d/p2.djvu", page), ("e/p1.djvu", page)], "path string, content binary")
    got = {r["path"]: r for r in D.assembled(files, parts).collect()}
    assert len(container.read(bytes(got["d/index.djvu"]["content"])).pages) == 2 and got["d/index.djvu"]["error"] is None
    assert got["e/index.djvu"]["content"] is None and "p2.djvu" in got["e/index.djvu"]["error"]


def test_recognisers_by_name(tmp_path, capsys):
    (tmp_path / "a.djvu").write_bytes(iff.emit(a_page("lossless")))
    assert main(["ocr", str(tmp_path / "a.djvu"), "--backend", "tesseract"]) == 1 and "not available" in capsys.readouterr().err
    with pytest.raises(ValueError, match="unknown"):
        recognition.backend("x")


def test_trees_of_any_depth_and_many_siblings(spark):
    chain = spark.range(3000).select(F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    assert {r["node_id"]: r["descendants"] for r in outline.subtree_sizes(chain).collect()} == {i: 2999 - i for i in range(3000)}
    loop = spark.createDataFrame([(1, 2), (2, 1)], "node_id long, parent_id long")
    with pytest.raises(ValueError, match="cycle"):
        outline.subtree_sizes(loop)
    many = spark.range(100).selectExpr("id node_id", "cast(null as long) parent_id", "id sibling_ord")
    got = {r["node_id"]: (r["prev_id"], r["next_id"]) for r in outline.sibling_links(many, span=7).collect()}
    assert got == {i: (i - 1 if i else None, i + 1 if i < 99 else None) for i in range(100)}
    sums = running_sum(many.withColumn("o", F.lit(None).cast("string")), ["o"], "sibling_ord", F.col("node_id"), "before", span=9).collect()
    assert {r["node_id"]: r["before"] for r in sums} == {i: i * (i - 1) // 2 for i in range(100)}


def test_widths_and_estimates(spark):
    words = ["aA (x)", "漢字 ab", "😀ꓐꔀᎠꦀ", "", "\t-–—"]
    df = spark.createDataFrame([(w,) for w in words], "t string").select("t", text.text_width("t").alias("w"))
    assert {r["t"]: r["w"] for r in df.collect()} == {w: sum(map(text.char_width, w)) for w in words}
    assert text.char_width("😀") == 556 and text.char_width("漢") == 1000
    row = spark.range(1).select(numeric.symbol_bytes(F.lit(9), F.lit(4)).alias("a"), numeric.refined_bytes(F.lit(9), F.lit(300)).alias("b")).first()
    assert tuple(row) == (11, 9)


def test_refinement_totals(spark):
    m = np.ones((6, 7), np.uint8)
    rows = [(1, 0, m), (1, 1, m[:, :6]), (1, 2, np.eye(8, dtype=np.uint8)), (1, 3, m[:2, :2]), (2, 0, m)]
    df = spark.createDataFrame([(d, i, x.shape[1], x.shape[0], np.packbits(x, axis=1).tobytes()) for d, i, x in rows], "doc_id int, sym_idx int, w int, h int, data binary")
    got = {r["doc_id"]: tuple(r)[1:] for r in lookup.refinement_totals(df, 2, 0.1).collect()}
    assert got == {1: (4, 3, 2, 1, 5 + 1 + 0 - (6 + 3)), 2: (1, 1, 0, 0, 0)}
