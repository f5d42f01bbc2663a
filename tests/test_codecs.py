import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.codecs import bzz, container, g4, iff, iw44, jb2, layers, zp
from foliospark.codecs import raster as R

RNG = np.random.default_rng(5)


def mask(h, w, p=0.4):
    return (RNG.random((h, w)) < p).astype(np.uint8)


def test_zp_tables():
    assert len(zp.P) == len(zp.M) == len(zp.UP) == len(zp.DOWN) == 251
    assert (zp.P[0], zp.P[3], zp.P[250], zp.UP[0], zp.DOWN[0], zp.M[83]) == (0x8000, 0x6BBD, 0x481A, 84, 145, 0)
    assert all(0 <= s < 251 for s in zp.UP + zp.DOWN)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 5)), max_size=600))
def test_zp_roundtrip(steps):
    enc, ctx = zp.Encoder(), bytearray(4)
    for bit, kind in steps:
        enc.raw(bit) if kind == 4 else enc.raw_wavelet(bit) if kind == 5 else enc.bit(int(bit), ctx, kind)
    dec, ctx = zp.Decoder(enc.finish()), bytearray(4)
    assert [dec.raw() if k == 4 else dec.raw_wavelet() if k == 5 else dec.bit(ctx, k) for _, k in steps] == [int(b) for b, _ in steps]


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=2000))
def test_bzz_roundtrip(data):
    assert bzz.decode(bzz.encode(data)) == data


def test_bzz_long_run_and_errors():
    data = b"ab" * 5000 + bytes(range(256)) * 4
    assert bzz.decode(bzz.encode(data)) == data
    with pytest.raises(ValueError):
        bzz.decode(b"")


def test_jb2_roundtrips():
    for _ in range(20):
        m = mask(RNG.integers(1, 65), RNG.integers(1, 65), RNG.random())
        assert (jb2.decode(jb2.encode(m, tile=17)) == m).all()
        page, marks = jb2.decode(jb2.encode_symbols(m), indexed=True)
        assert (page == m).all() and ((marks >= 0) == (m > 0)).all()
    shared = [jb2.cropped(mask(9, 7, 0.6)) for _ in range(4)]
    assert all((a == b).all() for a, b in zip(shared, jb2.decode_dictionary(jb2.encode_dictionary(shared)), strict=True))
    page = np.zeros((50, 60), np.uint8)
    for i, s in enumerate(shared):
        page[3 : 3 + s.shape[0], 2 + 14 * i : 2 + 14 * i + s.shape[1]] |= s
    data = jb2.encode_symbols(page, shared)
    assert (jb2.decode(data, shared) == page).all()
    with pytest.raises(ValueError):
        jb2.decode(data)


def test_jb2_refinement():
    own, ref, s = mask(12, 10), mask(9, 13), jb2.Stream()
    s.refined(10, 12, ref, own)
    assert (jb2.Stream(s.zp.finish()).refined(10, 12, ref) == own).all()


def test_jb2_numbers():
    s = jb2.Stream()
    values = [0, 1, -1, 5, 262142, -262143, 1000, -77]
    for v in values:
        s.number("n", -262143, 262142, v)
    r = jb2.Stream(s.zp.finish())
    assert [r.number("n", -262143, 262142) for _ in values] == values


def test_components_are_eight_connected():
    m = np.array([[1, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 1]], np.uint8)
    parts = jb2.components(m)
    assert [(x, y, p.sum()) for x, y, p in parts] == [(0, 0, 3), (3, 2, 1)]


def test_lossy_copy():
    a = mask(12, 12, 0.9)
    a[0] = a[-1] = 1
    a[:, 0] = a[:, -1] = 1
    b = a.copy()
    b[5, 5] ^= 1
    page = np.zeros((14, 40), np.uint8)
    page[1:13, 1:13], page[1:13, 20:32] = a, b
    assert (jb2.decode(jb2.encode_symbols(page, lossy=0.05)) != page).sum() <= 1
    assert (jb2.decode(jb2.encode_symbols(page)) == page).all()


def test_g4_roundtrip_and_vertical_mode():
    for _ in range(20):
        m = mask(RNG.integers(1, 40), RNG.integers(1, 70), RNG.random())
        assert (g4.decode(g4.encode(m)) == m).all()
    # One row by runs of 3 white and 2 black of 8, then a row of V0 codes only: the same row again.
    bits = "001" + g4.CODES[0][3] + g4.CODES[1][2] + "1" + "1" * 3
    data = bytes([0, 8, 0, 2]) + int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert g4.decode(data).tolist() == [[0, 0, 0, 1, 1, 0, 0, 0]] * 2


def test_palette():
    colors = [(1, 2, 3), (255, 0, 7)]
    assert g4.decode_palette(g4.encode_palette(colors, [0, -1, 300])) == (colors, [0, -1, 300])
    with pytest.raises(ValueError):
        g4.decode_palette(b"\x01\0\0")


def test_wavelet_transform_is_exact():
    for h, w in ((1, 1), (2, 3), (5, 7), (33, 64), (70, 45)):
        s = RNG.integers(-8000, 8000, (h, w)).astype(np.int32)
        p = iw44.Plane(w, h)
        p.blocks = iw44._blocks(iw44.transform(s))
        assert (p.samples() == s).all()


def psnr(a, b):
    return 10 * np.log10(255**2 / max(((a.astype(float) - b) ** 2).mean(), 1e-9))


def test_wavelet_quality_grows():
    y, x = np.mgrid[0:60, 0:80]
    img = np.stack([128 + 90 * np.sin(x / 9), 128 + 80 * np.cos(y / 11), (x + y) % 200], axis=2).astype(np.uint8)
    chunks = iw44.encode(img)
    quality = [psnr(img, iw44.decode(chunks[:k])) for k in (2, 6, 10)]
    assert quality[0] <= quality[1] < quality[2] and quality[2] > 35
    assert iw44.decode(chunks, 2).shape == (30, 40, 3)
    gray = iw44.encode(img[:, :, :1], gray=True)
    assert psnr(img[:, :, :1], iw44.decode(gray)[:, :, :1]) > 38
    with pytest.raises(ValueError):
        iw44.decode(chunks[1:])


def test_iff_roundtrip_and_errors():
    root = iff.form("DJVM", iff.Chunk("DIRM", b"abc"), iff.form("DJVU", iff.Chunk("INFO", b"0123456789"), iff.Chunk("X   ", b"")))
    data = iff.emit(root)
    assert iff.emit(iff.parse(data)) == data and iff.parse(data[4:]).kind == "DJVM"
    assert [c.id for _, _, c in iff.walk(iff.parse(data))] == ["DIRM", "FORM", "INFO", "X   "]
    for bad in (b"", b"AT&TFORM", b"XXXXFORM\0\0\0\4DJVU....", data[:26]):
        with pytest.raises(ValueError):
            iff.parse_strict(bad)


def test_info():
    assert container.read_info(container.write_info(181, 240, 100, 2.2, "cw90")) == {"width": 181, "height": 240, "dpi": 100, "gamma": 2.2, "rotation": "cw90"}
    assert container.read_info(bytes([0, 181, 0, 240, 24, 0, 100, 0, 0, 2]))["gamma"] == 2.2
    with pytest.raises(ValueError):
        container.read_info(b"123")


def page_form(n=0, **more):
    return iff.form("DJVU", iff.Chunk("INFO", container.write_info(100 + n, 200, 300)), *[iff.Chunk(k, v) for k, v in more.items()])


def test_bundle_merge_split():
    shared = iff.form("DJVI", iff.Chunk("Djbz", b"dictionary"))
    book = container.bundle([("shared", "d.iff", shared), ("page", "a", page_form(1, INCL=b"d.iff ")), ("page", "b", page_form(2))])
    doc = container.read(book)
    assert [p.info["width"] for p in doc.pages] == [101, 102] and doc.pages[0].shared == b"dictionary" and doc.pages[1].shared is None
    assert all(book[e.offset : e.offset + 4] == b"FORM" for e in doc.directory.entries)
    both = container.read(container.merge([book, book]))
    assert [p.info["width"] for p in both.pages] == [101, 102, 101, 102] and both.pages[2].shared == b"dictionary"
    part = container.read(container.split(container.merge([book, book]), 2, 4))
    assert [p.info["width"] for p in part.pages] == [101, 102] and part.pages[0].shared == b"dictionary"
    for bad in (lambda: container.merge([]), lambda: container.split(book, 5, 6), lambda: container.read(iff.emit(iff.form("DJVU")))):
        with pytest.raises(ValueError):
            bad()


def test_indirect_document():
    index = container.index_file([("page", "a.djvu"), ("shared", "d.iff")])
    store = {"a.djvu": iff.emit(page_form(3, INCL=b"d.iff")), "d.iff": iff.emit(iff.form("DJVI", iff.Chunk("Djbz", b"x1")))}
    doc = container.read(index, store.__getitem__)
    assert not doc.bundled and doc.pages[0].shared == b"x1"
    with pytest.raises(ValueError):
        container.read(index)


def test_corrupt_directory_gives_made_up_pages():
    d = container.read_directory(bytes([0x81, 0, 2]) + bytes(8) + b"\0\0")
    assert d.synthetic and [e.id for e in d.entries] == ["p0000", "p0001"]


def test_edits():
    book = container.bundle([("page", "a", page_form(1, TXTa=b"\0\0\2hi\1")), ("page", "b", page_form(2))])
    changed = container.put_layer(book, 0, "TXT", bzz.encode(b"\0\0\3you\1"))
    assert [c.id for c in container.read(changed).pages[0].chunks] == ["INFO", "TXTz"]
    assert container.put_layer(book, 1, "ANT", b"") == book
    assert container.read(container.put_layer(changed, 0, "TXT", b"")).pages[0].first("TXTz") is None
    marked = container.put_bookmarks(book, [{"node_id": 0, "parent_id": None, "sibling_ord": 0, "title": "T", "url": "#1"}])
    assert container.read(marked).bookmarks[0]["title"] == "T"


def test_bookmark_trees():
    rows, n = [], 0
    for p in range(2):
        top = n
        rows.append({"node_id": n, "parent_id": None, "sibling_ord": p, "title": f"Part {p}", "url": ""})
        n += 1
        for c in range(3 if p == 0 else 0):
            rows.append({"node_id": n, "parent_id": top, "sibling_ord": c, "title": f"Ch {c} é", "url": f"#{c}"})
            n += 1
    got = container.read_bookmarks(container.write_bookmarks(rows))
    assert len(got) == 5 and [(r["node_id"], r["parent_id"], r["depth"]) for r in got] == [(0, None, 0), (1, 0, 1), (2, 0, 1), (3, 0, 1), (4, None, 0)]


def zone(i, parent, kind, x, y, w, h, text):
    return {"zone_id": i, "parent_id": parent, "kind": kind, "x": x, "y": y, "w": w, "h": h, "text": text}


def test_text_layer():
    text = "Hello World é x"
    zones = [zone(0, None, "page", 0, 0, 200, 300, text), zone(1, 0, "line", 10, 20, 100, 30, "Hello World"), zone(2, 1, "word", 10, 20, 40, 30, "Hello"), zone(3, 1, "word", 60, 22, 40, 28, "World"), zone(4, 0, "line", 12, 70, 90, 25, "é x")]
    data = layers.write_text(text, zones, 300)
    assert layers.read_text(data, 300) == (text, zones)
    assert layers.read_text(b"\0\0\2hi\1", 10) == ("hi", [])
    with pytest.raises(ValueError):
        layers.read_text(b"\0\0\x09hi", 10)


def test_clip_keeps_characters_whole():
    assert layers.clip("aéb".encode(), 2, 1) == "é" and layers.clip(b"abc", 1, 99) == "bc"


def test_annotations_roundtrip():
    text = '; note\n(background #ff00aa) (zoom 150) (mode color) (foo 1) (maparea "http://x" "d\\"q" (rect 1 2 3 4) (xor) (hilite #00ff00)) (maparea "" "" (poly 1 2 3 4 5 6))'
    page, areas = layers.read_annotations(text)
    assert page == {"background": (255, 0, 170), "zoom": 150, "mode": "color"} and areas[0]["description"] == 'd"q'
    assert layers.read_annotations(layers.write_annotations(page, areas)) == (page, areas)
    with pytest.raises(ValueError):
        layers.read_annotations('(maparea "u" "" (blob 1 2))')
    with pytest.raises(ValueError):
        layers.parse_expressions("(" * 100)


def test_metadata():
    m = layers.read_metadata(b'(metadata (Title "x") (date "1999") (DESCRIPTION "s") (foo "a") (foo "b") (title "y"))')
    assert (m["title"], m["year"], m["subject"], m["extra"]) == ("y", "1999", "s", [("foo", "a"), ("foo", "b")])
    assert layers.read_metadata(layers.write_metadata(m)) == m and layers.write_metadata({}) == b""


def test_compressed_chunk_wins_even_if_empty():
    assert layers.unpack(b"", b"plain") is None and layers.unpack(None, b"plain") == b"plain" and layers.unpack(bzz.encode(b"z"), b"p") == b"z"


def test_raster_helpers():
    img = RNG.integers(0, 256, (7, 9, 3)).astype(np.uint8)
    assert (R.read_png(R.write_png(img)) == img).all() and (R.read_png(R.write_png(img[:, :, 0]))[:, :, 1] == img[:, :, 0]).all()
    assert R.half(img).shape == (4, 5, 3) and R.turn(img, "cw90").shape == (9, 7, 3) and (R.turn(R.turn(img, "cw90"), "ccw90") == img).all()
    assert (R.area_mean(img, 9, 7) == img).all() and (R.bilinear(img, 9, 7) == img).all() and np.abs(R.lanczos(img, 9, 7).astype(int) - img).max() == 0
    m = np.zeros((5, 5), np.uint8)
    m[2, 2] = 1
    assert R.dilate(m).sum() == 5 and R.pool_any(m).tolist() == [[1, 0], [0, 0]]
    assert R.write_pbm(m)[:7] == b"P4\n5 5\n" and R.write_ppm(img)[:11] == b"P6\n9 7\n255\n"
    assert [R.subsample_for(s) for s in (1, 0.5, 0.375, 0.25, 0.1, 0)] == [1, 2, 4, 4, 8, 1]
    assert R.luma(np.array([[[255, 255, 255]]], np.uint8))[0, 0] == 255


def test_segmentation():
    img = np.full((30, 40, 3), 200, np.uint8)
    img[5:10, 5:20] = 10
    m, back = R.segment(img, subsample=5)
    assert m.sum() == 75 and (back == 200).all()
    assert R.segment(img, threshold=0)[0].sum() == 0
    local = R.sauvola(R.luma(img), 9)
    assert local[7, 10] == 1 and local[25, 35] == 0


def test_page_profiles():
    img = np.full((40, 60, 3), 230, np.uint8)
    img[5:10, 5:20], img[20:25, 30:50] = (120, 0, 0), (0, 0, 90)
    for profile, least in (("lossless", 10), ("quality", 15), ("archival", 35)):
        page = container.read(iff.emit(R.encode_page(img, profile=profile, dpi=100))).pages[0]
        assert psnr(img, R.render(page)) > least
    assert len(R.progressive(page)) == 10 and R.render(page, aa=True).shape == (20, 30, 3) and R.render(page, 30, 20).shape == (20, 30, 3)
    assert R.render(page, rotation="cw90").shape == (60, 40, 3) and R.render(page, region=(1, 2, 5, 6)).shape == (6, 5, 3)
    with pytest.raises(ValueError):
        R.encode_page(mask=mask(4, 4), profile="quality")
    page.chunks[next(i for i, c in enumerate(page.chunks) if c.id == "BG44")].data = b"\0"
    with pytest.raises(ValueError):
        R.render(page)
    assert R.render(page, permissive=True).shape == (40, 60, 3)


def test_book_shares_symbols():
    a, b = mask(30, 40, 0.1), mask(30, 40, 0.1)
    doc = container.read(R.encode_book([a, a.copy(), b]))
    assert len(doc.pages) == 3 and all((R.page_mask(p)[0] == m).all() for p, m in zip(doc.pages, (a, a, b), strict=True))
    assert doc.pages[0].shared is not None


def test_junk_never_hangs():
    random.seed(3)
    for _ in range(150):
        data = bytes(random.randrange(256) for _ in range(random.randint(0, 60)))
        for read in (iff.parse, iff.parse_strict, container.read, bzz.decode, jb2.decode_dictionary, lambda d: layers.read_text(d, 10), lambda d: g4.decode(d[:2] + b"\0" + d[3:]) if len(d) > 4 and d[0] == 0 else None, lambda d: container.read_directory(d)):
            try:
                read(data)
            except (ValueError, IndexError):
                pass


def test_single_page_edits_touch_no_other_byte():
    def chunk(id_, body, pad=b"\7"):
        return id_ + len(body).to_bytes(4, "big") + body + pad * (len(body) & 1)

    head, odd = chunk(b"INFO", bytes([0, 90, 0, 60, 24, 0, 44, 1, 22, 1])), chunk(b"XYZW", b"odd")
    text, last = bzz.encode(b"\0\0\2me\1"), chunk(b"QQQQ", b"1", b"")

    def page(*parts, tail=b"\7after"):
        body = b"DJVU" + b"".join(parts)
        return b"AT&TFORM" + len(body).to_bytes(4, "big") + body + tail

    new = iff.emit_chunk(iff.Chunk("TXTz", text))
    before = page(head, odd, chunk(b"TXTa", b"\0\0\1x\1"), last)  # the form's length is odd: its pad byte follows
    after = container.put_layer(before, 0, "TXT", text)
    assert after == page(head, odd, new, last)
    assert container.read(after).pages[0].first("TXTz") == text
    gone = container.put_layer(after, 0, "TXT", b"")
    assert gone == page(head, odd, last)
    assert container.put_layer(gone, 0, "TXT", text) == page(head, odd, last, b"\0", new, tail=b"after")
    assert container.put_layer(gone, 0, "ANT", b"") == gone
