"""Documents as PDF, EPUB, TIFF and comic archives, from rendered pages.

A page is a dict: rgb (array), width, height, dpi, zones, links [(url, x, y, w, h from the bottom left)], mask.
A page that could not be rendered has ``rgb`` None and becomes a blank page."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from datetime import UTC, datetime

import numpy as np

from foliospark.codecs.raster import area_mean, write_png
from foliospark.functions.text import char_width
from foliospark.sinks.markup import _XML, _escape


def page_number(url: str) -> int | None:
    """The page that an anchor names, from 1."""
    m = re.fullmatch(r"#(?:\+|page[_=]?)?(\d+)", url)
    return int(m[1]) if m else None


# -- PDF --------------------------------------------------------------------------
def pdf_string(s: str) -> str:
    return "".join("\\" + c if c in "()\\" else c if ord(c) < 128 else "?" for c in s)


def text_operators(zones: list[dict], dpi: int, height_pt: float) -> str:
    """Invisible text at the places of words and characters, stretched to their width."""
    pt = lambda v: v * 72.0 / dpi
    out = ["BT", "3 Tr", "/F1 1 Tf"]
    for z in zones:
        w, h = pt(z["w"]), pt(z["h"])
        if z["kind"] not in ("word", "character") or not z["text"] or w <= 0 or h < 0.5:
            continue
        stretch = 100 * w / max(0.01, sum(map(char_width, z["text"])) / 1000 * h)
        out.append(f"{h:.2f} 0 0 {h:.2f} {pt(z['x']):.4f} {height_pt - pt(z['y'] + z['h']):.4f} Tm")
        if abs(stretch - 100) > 1:
            out.append(f"{stretch:.2f} Tz")
        out.append(f"({pdf_string(z['text'])}) Tj")
    return "\n".join([*out, "ET"]) + "\n"


class _Objects:
    def __init__(self) -> None:
        self.bodies: list[bytes] = []

    def add(self, body: bytes | str = b"") -> int:
        self.bodies.append(body.encode("latin-1", "replace") if isinstance(body, str) else body)
        return len(self.bodies)

    def put(self, number: int, body: str) -> None:
        self.bodies[number - 1] = body.encode("latin-1", "replace")

    def stream(self, head: str, data: bytes) -> int:
        z = zlib.compress(data)
        return self.add(f"<< {head} /Filter /FlateDecode /Length {len(z)} >>\nstream\n".encode() + z + b"\nendstream")

    def file(self, root: int) -> bytes:
        out, at = io.BytesIO(), []
        out.write(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n")
        for i, b in enumerate(self.bodies, 1):
            at.append(out.tell())
            out.write(f"{i} 0 obj\n".encode() + b + b"\nendobj\n")
        start = out.tell()
        out.write(f"xref\n0 {len(at) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{a:010d} 00000 n \n".encode() for a in at))
        out.write(f"trailer\n<< /Size {len(at) + 1} /Root {root} 0 R >>\nstartxref\n{start}\n%%EOF\n".encode())
        return out.getvalue()


def pdf(pages: list[dict], bookmarks: list[dict] | None = None, output_dpi: int | None = 150) -> bytes:
    """Page images (lossless), invisible text, links and outline; blank pages where rendering failed."""
    o = _Objects()
    root, tree = o.add(), o.add()
    font = o.add("<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>")
    kids = [o.add() for _ in pages]
    for p, number in zip(pages, kids, strict=True):
        dpi = p["dpi"] or 300
        w, h = p["width"] * 72 / dpi, p["height"] * 72 / dpi
        content, images = "", ""
        rgb, mask = p.get("rgb"), p.get("mask") if p.get("bilevel") else None
        if mask is not None:  # a page of ink alone: one bit a pixel at its own size
            head = f"/Type /XObject /Subtype /Image /Width {mask.shape[1]} /Height {mask.shape[0]} /ImageMask true /BitsPerComponent 1 /Decode [1 0]"
            image = o.stream(head, np.packbits(mask, axis=1).tobytes())
            content, images = f"q 0 g {w:.4f} 0 0 {h:.4f} 0 0 cm /Im0 Do Q\n", f"/XObject << /Im0 {image} 0 R >>"
        elif rgb is not None:
            if output_dpi and output_dpi < dpi:
                size = max(1, round(p["width"] * output_dpi / dpi)), max(1, round(p["height"] * output_dpi / dpi))
                if size[0] < rgb.shape[1]:
                    rgb = area_mean(rgb, *size)
            gray = bool((rgb[..., 0] == rgb[..., 1]).all() and (rgb[..., 1] == rgb[..., 2]).all())
            body = rgb[..., 0] if gray else rgb
            image = o.stream(f"/Type /XObject /Subtype /Image /Width {rgb.shape[1]} /Height {rgb.shape[0]} /ColorSpace /{'DeviceGray' if gray else 'DeviceRGB'} /BitsPerComponent 8", body.tobytes())
            content, images = f"q {w:.4f} 0 0 {h:.4f} 0 0 cm /Im0 Do Q\n", f"/XObject << /Im0 {image} 0 R >>"
        if p.get("zones"):
            content += text_operators(p["zones"], dpi, h)
        links = []
        for url, x, y, lw, lh in p.get("links") or ():
            box = " ".join(f"{v * 72 / dpi:.2f}" for v in (x, y, x + lw, y + lh))
            n = page_number(url)
            goal = f"/Dest [{kids[n - 1]} 0 R /Fit]" if n and 1 <= n <= len(kids) else f"/A << /S /URI /URI ({pdf_string(url)}) >>"
            links.append(o.add(f"<< /Type /Annot /Subtype /Link /Rect [{box}] /Border [0 0 0] {goal} >>"))
        stream = o.stream("", content.encode("latin-1", "replace"))
        notes = f"/Annots [{' '.join(f'{x} 0 R' for x in links)}]" if links else ""
        o.put(number, f"<< /Type /Page /Parent {tree} 0 R /MediaBox [0 0 {w:.4f} {h:.4f}] /Resources << {images} /Font << /F1 {font} 0 R >> >> /Contents {stream} 0 R {notes} >>")
    o.put(tree, f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>")
    outline = _outline(o, bookmarks or [], kids)
    o.put(root, f"<< /Type /Catalog /Pages {tree} 0 R {f'/Outlines {outline} 0 R /PageMode /UseOutlines' if outline else ''} >>")
    return o.file(root)


def _outline(o: _Objects, rows: list[dict], kids: list[int]) -> int | None:
    if not rows:
        return None
    below: dict = {}
    for r in rows:
        below.setdefault(r["parent_id"], []).append(r)
    top, number = o.add(), {r["node_id"]: o.add() for r in rows}

    def size(node) -> int:
        return sum(1 + size(r["node_id"]) for r in below.get(node, []))

    for parent, own in below.items():
        for i, r in enumerate(own):
            n = page_number(r["url"])
            goal = f"/Dest [{kids[n - 1]} 0 R /Fit]" if n and 1 <= n <= len(kids) else f"/A << /S /URI /URI ({pdf_string(r['url'])}) >>" if r["url"] else ""
            inner = below.get(r["node_id"])
            nest = f"/First {number[inner[0]['node_id']]} 0 R /Last {number[inner[-1]['node_id']]} 0 R /Count {size(r['node_id'])}" if inner else ""
            side = (f"/Prev {number[own[i - 1]['node_id']]} 0 R " if i else "") + (f"/Next {number[own[i + 1]['node_id']]} 0 R" if i + 1 < len(own) else "")
            o.put(number[r["node_id"]], f"<< /Title ({pdf_string(r['title'])}) /Parent {number[parent] if parent is not None else top} 0 R {side} {nest} {goal} >>")
    first = below[None]
    o.put(top, f"<< /Type /Outlines /First {number[first[0]['node_id']]} 0 R /Last {number[first[-1]['node_id']]} 0 R /Count {len(rows)} >>")
    return top


# -- EPUB -------------------------------------------------------------------------
def epub(pages: list[dict], bookmarks: list[dict] | None = None, title: str = "Document", author: str = "", language: str = "en", modified: str | None = None, reflowable: bool = False) -> bytes:
    """Page images with an overlay of words (top-left origin), navigation and package; the type entry first and stored."""
    modified = modified or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    esc = lambda s: _escape(s, _XML)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<?xml version="1.0"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        items, spine = [], []
        for i, p in enumerate(pages, 1):
            rgb = p.get("rgb")
            if rgb is None:
                rgb = np.full((max(1, p["height"]), max(1, p["width"]), 3), 255, np.uint8)
            z.writestr(f"OEBPS/images/page_{i:04d}.png", write_png(rgb))
            words = [w for w in p.get("zones") or () if w["kind"] == "word" and w["text"]]
            pct = lambda v, of: f"{100 * v / of:.4f}%"
            spans = [f'<span style="left:{pct(w["x"], p["width"])};top:{pct(w["y"], p["height"])};width:{pct(w["w"], p["width"])};height:{pct(w["h"], p["height"])}">{esc(w["text"])}</span>' for w in words]
            spans += [f'<a href="{f"page_{n:04d}.xhtml" if (n := page_number(url)) and n <= len(pages) else esc(url)}" style="left:{pct(x, p["width"])};top:{pct(p["height"] - y - h, p["height"])};width:{pct(w, p["width"])};height:{pct(h, p["height"])}"></a>' for url, x, y, w, h in p.get("links") or ()]
            flow = "".join(f"<p>{esc(t)}</p>" for t in p.get("paragraphs") or ()) if reflowable else ""
            z.writestr(f"OEBPS/page_{i:04d}.xhtml", f'<?xml version="1.0" encoding="UTF-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>Page {i}</title><style>.p{{position:relative}} .p img{{width:100%}} .t span,.t a{{position:absolute;color:transparent}}</style></head><body><div class="p"><img src="images/page_{i:04d}.png" alt="Page {i}"/><div class="t">{"".join(spans)}</div></div>{flow}</body></html>')
            items.append(f'<item id="p{i}" href="page_{i:04d}.xhtml" media-type="application/xhtml+xml"/><item id="i{i}" href="images/page_{i:04d}.png" media-type="image/png"/>')
            spine.append(f'<itemref idref="p{i}"/>')
        below: dict = {}
        for r in bookmarks or ():
            below.setdefault(r["parent_id"], []).append(r)

        def nav(node) -> str:
            own = [f'<li><a href="{f"page_{n:04d}.xhtml" if (n := page_number(r["url"])) and n <= len(pages) else esc(r["url"]) or "#"}">{esc(r["title"])}</a>{f"<ol>{nav(r["node_id"])}</ol>" if r["node_id"] in below else ""}</li>' for r in below.get(node, [])]
            return "".join(own)

        entries = nav(None) or "".join(f'<li><a href="page_{i:04d}.xhtml">Page {i}</a></li>' for i in range(1, len(pages) + 1))
        z.writestr("OEBPS/nav.xhtml", f'<?xml version="1.0" encoding="UTF-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{esc(title)}</title></head><body><nav epub:type="toc"><ol>{entries}</ol></nav></body></html>')
        z.writestr("OEBPS/content.opf", f'<?xml version="1.0" encoding="UTF-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">urn:document:{zlib.crc32(title.encode()):08x}</dc:identifier><dc:title>{esc(title)}</dc:title><dc:creator>{esc(author)}</dc:creator><dc:language>{esc(language)}</dc:language><meta property="dcterms:modified">{modified}</meta></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{"".join(items)}</manifest><spine>{"".join(spine)}</spine></package>')
    return out.getvalue()


# -- TIFF and archives ------------------------------------------------------------
def tiff(pages: list[dict], bilevel: bool = False) -> bytes:
    """A page an image directory: RGB, or 8-bit masks with ink as 255; strips are deflated."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for p in pages:
        if bilevel:
            img = (p["mask"] * np.uint8(255))[:, :, None]
        else:
            img = p["rgb"]
        h, w, c = img.shape
        body = zlib.compress(np.ascontiguousarray(img).tobytes())
        at = len(out)
        out += body + b"\0" * (len(body) & 1)
        bits = len(out)
        out += struct.pack("<3H", 8, 8, 8) + b"\0\0"
        res = len(out)
        out += struct.pack("<2I", p["dpi"] or 300, 1)
        tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, c, bits if c == 3 else 8), (259, 3, 1, 8), (262, 3, 1, 2 if c == 3 else 1), (273, 4, 1, at), (277, 3, 1, c), (278, 4, 1, h), (279, 4, 1, len(body)), (282, 5, 1, res), (283, 5, 1, res), (296, 3, 1, 2)]
        here = len(out)
        out[link : link + 4] = struct.pack("<I", here)
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def cbz(pages: list[dict]) -> bytes:
    """Stored images, numbered from 1."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i, p in enumerate(pages, 1):
            z.writestr(f"page_{i:04d}.png", write_png(p["rgb"]))
    return out.getvalue()
