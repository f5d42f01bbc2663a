"""Text layers as hOCR, ALTO and JSON, and the import of hOCR."""

from __future__ import annotations

import json
import re
from html import unescape

_HTML = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
_XML = [*_HTML[:4], ("'", "&apos;")]


def _escape(s: str, table: list[tuple[str, str]]) -> str:
    for a, b in table:
        s = s.replace(a, b)
    return s


def _children(zones: list[dict]) -> dict:
    below: dict = {}
    for z in zones:
        below.setdefault(z["parent_id"], []).append(z)
    return below


def scaled(zones: list[dict], page: dict, dpi: int | None) -> tuple[list[dict], int, int]:
    """Zones and page size at another resolution; unchanged if the page names none."""
    w, h = page["width"], page["height"]
    if not dpi or not page["dpi"]:
        return zones, w, h
    to_w, to_h = w * dpi // page["dpi"], h * dpi // page["dpi"]
    fit = [{**z, "x": z["x"] * to_w // w, "w": z["w"] * to_w // w, "y": z["y"] * to_h // h, "h": z["h"] * to_h // h} for z in zones]
    return fit, to_w, to_h


def hocr_page(zones: list[dict], page: dict, index: int, dpi: int | None = None) -> str:
    zones, w, h = scaled(zones, page, dpi)
    below, count = _children(zones), {"block": 0, "line": 0, "word": 0}
    out = [f'  <div class="ocr_page" id="page_{index}" title="image page_{index}.djvu; bbox 0 0 {w} {h}; ppageno {index}">']
    forms = {"column": ("div", "ocr_block", "block", "block"), "region": ("div", "ocr_block", "block", "block"), "para": ("p", "ocr_par", "par", "block"), "line": ("span", "ocr_line", "line", "line"), "word": ("span", "ocrx_word", "word", "word")}

    def put(z: dict, pad: int) -> None:
        if z["kind"] == "page":
            for c in below.get(z["zone_id"], []):
                put(c, pad)
        elif z["kind"] in forms:
            tag, cls, name, counter = forms[z["kind"]]
            number = count[counter]
            count[counter] += 1
            head = f'{" " * pad}<{tag} class="{cls}" id="{name}_{index}_{number}" title="bbox {z["x"]} {z["y"]} {z["x"] + z["w"]} {z["y"] + z["h"]}">'
            if z["kind"] == "word":
                out.append(f"{head}{_escape(z['text'], _HTML)}</{tag}>")
                return
            out.append(head)
            for c in below.get(z["zone_id"], []):
                put(c, pad + 2)
            out.append(f"{' ' * pad}</{tag}>")

    for z in below.get(None, []):
        put(z, 3)
    return "\n".join([*out, "  </div>"])


def hocr(pages: list[str]) -> str:
    head = ["<!DOCTYPE html>", '<html xmlns="http://www.w3.org/1999/xhtml">', "<head>", '  <meta charset="utf-8"/>', '  <meta name="ocr-system" content="foliospark"/>', '  <meta name="ocr-capabilities" content="ocr_page ocr_block ocr_par ocr_line ocrx_word"/>', "</head>", "<body>"]
    return "\n".join([*head, *pages, "</body>", "</html>", ""])


def alto_page(zones: list[dict], page: dict, index: int, dpi: int | None = None) -> str:
    zones, w, h = scaled(zones, page, dpi)
    below, count = _children(zones), {"block": 0, "line": 0, "word": 0}
    out = [f'    <Page ID="page_{index}" WIDTH="{w}" HEIGHT="{h}" PHYSICAL_IMG_NR="{index}">', f'      <PrintSpace WIDTH="{w}" HEIGHT="{h}" HPOS="0" VPOS="0">']
    forms = {"column": ("TextBlock", "block"), "region": ("TextBlock", "block"), "para": ("TextBlock", "block"), "line": ("TextLine", "line"), "word": ("String", "word")}

    def put(z: dict, pad: int) -> None:
        own = below.get(z["zone_id"], [])
        if z["kind"] == "page":
            for c in own:
                put(c, pad)
        elif z["kind"] in forms:
            tag, name = forms[z["kind"]]
            head = f'{" " * pad}<{tag} ID="{name}_{index}_{count[name]}" HPOS="{z["x"]}" VPOS="{z["y"]}" WIDTH="{z["w"]}" HEIGHT="{z["h"]}"'
            count[name] += 1
            if z["kind"] == "word":
                out.append(f'{head} CONTENT="{_escape(z["text"], _XML)}"/>')
                return
            out.append(head + ">")
            for c in own:
                put(c, pad + 2)
            out.append(f"{' ' * pad}</{tag}>")

    for z in below.get(None, []):
        put(z, 8)
    return "\n".join([*out, "      </PrintSpace>", "    </Page>"])


def alto(pages: list[str], name: str = "document.djvu") -> str:
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"', '      xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"', '      xsi:schemaLocation="http://www.loc.gov/standards/alto/ns-v4# https://www.loc.gov/standards/alto/v4/alto.xsd">', "  <Description>", "    <MeasurementUnit>pixel</MeasurementUnit>", "    <sourceImageInformation>", f"      <fileName>{_escape(name, _XML)}</fileName>", "    </sourceImageInformation>", "  </Description>", "  <Layout>"]
    return "\n".join([*head, *pages, "  </Layout>", "</alto>", ""])


def zones_json(zones: list[dict], page: dict, dpi: int | None = None) -> str:
    """Leaf zones with text, scaled."""
    zones, _, _ = scaled(zones, page, dpi)
    inner = {z["parent_id"] for z in zones}
    return json.dumps([{"t": z["text"], "x": z["x"], "y": z["y"], "w": z["w"], "h": z["h"]} for z in zones if z["zone_id"] not in inner and z["text"].strip()], ensure_ascii=False, separators=(",", ":"))


def read_hocr(text: str, width: int, height: int) -> tuple[str, list[dict]]:
    """(text, zones) of hOCR: words belong to the line that encloses them; words without a line get one."""
    zones = [{"zone_id": 0, "parent_id": None, "kind": "page", "x": 0, "y": 0, "w": width, "h": height, "text": ""}]
    line = None
    for m in re.finditer(r"<(\w+)[^>]*class=['\"](ocr_line|ocrx_word)['\"][^>]*>(?:([^<]*(?:<(?!/?\w+[^>]*class=)[^>]*>[^<]*)*?)</\1>)?", text):
        box = re.search(r"bbox (\d+) (\d+) (\d+) (\d+)", m[0])
        x0, y0, x1, y1 = map(int, box.groups()) if box else (0, 0, 0, 0)
        own = {"zone_id": len(zones), "x": x0, "y": y0, "w": x1 - x0, "h": y1 - y0}
        if m[2] == "ocr_line":
            line = own["zone_id"]
            zones.append(own | {"parent_id": 0, "kind": "line", "text": ""})
        else:
            word = unescape(re.sub("<[^>]*>", "", m[3] or "")).strip()
            if word:
                if line is None:
                    line = own["zone_id"]
                    zones.append(own | {"parent_id": 0, "kind": "line", "text": ""})
                    own = {**own, "zone_id": len(zones)}
                zones.append(own | {"parent_id": line, "kind": "word", "text": word})
    for z in zones:
        if z["kind"] == "line":
            z["text"] = " ".join(w["text"] for w in zones if w["parent_id"] == z["zone_id"])
    zones[0]["text"] = "\n".join(z["text"] for z in zones if z["kind"] == "line")
    return zones[0]["text"], zones
