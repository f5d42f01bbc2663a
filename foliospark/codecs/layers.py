"""Text zones, annotations and metadata: bytes to rows and back."""

from __future__ import annotations

from foliospark.codecs import bzz

KINDS = ["page", "column", "region", "para", "line", "word", "character"]
#: Kinds whose next sibling lies below; the others' next sibling lies to the right.
STACKED = {"page", "para", "line"}


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def uint(self, size: int) -> int:
        if self.at + size > len(self.data):
            raise ValueError("text: truncated")
        self.at += size
        return int.from_bytes(self.data[self.at - size : self.at], "big")

    def biased(self) -> int:
        return self.uint(2) - 0x8000


def clip(body: bytes, start: int, length: int) -> str:
    """Text of a byte range, widened to whole characters."""
    a, b = min(max(start, 0), len(body)), min(max(start + length, 0), len(body))
    while a > 0 and a < len(body) and body[a] & 0xC0 == 0x80:
        a -= 1
    while b < len(body) and body[b] & 0xC0 == 0x80:
        b += 1
    return body[a:b].decode()


def read_text(data: bytes, page_height: int) -> tuple[str, list[dict]]:
    """(text, zones in preorder); zone corners are top-left, cut off at the page's top."""
    r = _Reader(data)
    n = r.uint(3)
    body = data[3 : 3 + n]
    if len(body) < n:
        raise ValueError("text: truncated")
    text = body.decode()
    r.at = 3 + n
    r.at += 1  # version
    if r.at >= len(data):
        return text, []
    zones: list[dict] = []

    def zone(parent: int | None, around: dict | None, before: dict | None) -> dict:
        kind = KINDS[r.uint(1) - 1]
        x, y, w, h, start = (r.biased() for _ in range(5))
        length, children = r.uint(3), r.uint(3)
        if before is not None:
            if kind in STACKED:
                x, y = x + before["x"], before["y"] - (y + h)
            else:
                x, y = x + before["x"] + before["w"], y + before["y"]
            start += before["start"] + before["length"]
        elif around is not None:
            x, y = x + around["x"], around["y"] + around["h"] - (y + h)
            start += around["start"]
        own = {"zone_id": len(zones), "parent_id": parent, "kind": kind, "x": max(x, 0), "y": max(0, page_height - (y + h)), "w": max(w, 0), "h": max(h, 0), "text": clip(body, start, length)}
        zones.append(own)
        here = {"x": x, "y": y, "w": w, "h": h, "start": start, "length": length}
        last = None
        for _ in range(children):
            child = zone(own["zone_id"], here, last)
            # A sibling's text offset counts from the end of the parent's own text range.
            last = {**child, "start": start, "length": length}
        return here

    zone(None, None, None)
    return text, zones


def write_text(text: str, zones: list[dict], page_height: int) -> bytes:
    """Inverse of ``read_text`` for one root zone; a zone's text is found where it first occurs."""
    body = text.encode()
    out = [len(body).to_bytes(3, "big"), body, b"\x01"]
    below: dict = {}
    for z in zones:
        below.setdefault(z["parent_id"], []).append(z)

    def biased(v: int) -> bytes:
        return (min(max(v + 0x8000, 0), 0xFFFF)).to_bytes(2, "big")

    def put(z: dict, around: dict | None, before: dict | None) -> dict:
        x, w, h = z["x"], z["w"], z["h"]
        y = page_height - z["y"] - h
        start, length = max(text.find(z["text"]), 0), len(z["text"].encode())
        start = len(text[:start].encode())
        if before is not None:
            if z["kind"] in STACKED:
                rel = (x - before["x"], before["y"] - y - h)
            else:
                rel = (x - before["x"] - before["w"], y - before["y"])
            first = start - before["start"] - before["length"]
        elif around is not None:
            rel, first = (x - around["x"], around["y"] + around["h"] - y - h), start - around["start"]
        else:
            rel, first = (x, y), start
        own = below.get(z["zone_id"], [])
        out.append(bytes([KINDS.index(z["kind"]) + 1]) + b"".join(map(biased, (*rel, w, h, first))) + length.to_bytes(3, "big") + len(own).to_bytes(3, "big"))
        here = {"x": x, "y": y, "w": w, "h": h, "start": start, "length": length}
        last = None
        for c in own:
            last = {**put(c, here, last), "start": start, "length": length}
        return here

    for z in below.get(None, [])[:1]:
        put(z, None, None)
    return b"".join(out)


# -- S-expressions ----------------------------------------------------------------
def parse_expressions(text: str, depth: int = 64) -> list:
    """Lists, bare words (str) and quoted strings (``Quoted``); ``;`` starts a comment."""
    stack: list[list] = [[]]
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c.isspace():
            i += 1
        elif c == ";":
            while i < n and text[i] != "\n":
                i += 1
        elif c == "(":
            if len(stack) > depth:
                raise ValueError("nested too deep")
            stack.append([])
            i += 1
        elif c == ")":
            if len(stack) > 1:
                done = stack.pop()
                stack[-1].append(done)
            i += 1
        elif c == '"':
            got, i = [], i + 1
            while i < n and text[i] != '"':
                if text[i] == "\\" and i + 1 < n:
                    i += 1
                    got.append({"n": "\n", "t": "\t", "r": "\r"}.get(text[i], text[i]))
                else:
                    got.append(text[i])
                i += 1
            stack[-1].append(Quoted("".join(got)))
            i += 1
        else:
            j = i
            while j < n and not text[j].isspace() and text[j] not in '()";':
                j += 1
            stack[-1].append(text[i:j])
            i = j
    while len(stack) > 1:
        done = stack.pop()
        stack[-1].append(done)
    return stack[0]


class Quoted(str):
    pass


def quote(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


def parse_color(s: str) -> tuple[int, int, int] | None:
    s = s.removeprefix("#")
    try:
        return (int(s[0:2], 16), int(s[2:4], 16), int(s[4:6], 16)) if len(s) == 6 else None
    except ValueError:
        return None


def read_annotations(text: str) -> tuple[dict, list[dict]]:
    """(page settings, map areas); unknown heads are passed over, an unknown shape is an error."""
    page: dict = {"background": None, "zoom": None, "mode": None}
    areas = []
    for e in parse_expressions(text):
        if not isinstance(e, list) or not e:
            continue
        if e[0] == "background" and len(e) > 1:
            page["background"] = parse_color(e[1])
        elif e[0] == "zoom" and len(e) > 1:
            digits = e[1].lstrip("d")
            page["zoom"] = int(digits) if digits.isdigit() else None
        elif e[0] == "mode" and len(e) > 1:
            page["mode"] = str(e[1])
        elif e[0] == "maparea":
            areas.append(_area(e))
    return page, areas


def _area(e: list) -> dict:
    url = e[1] if len(e) > 1 else ""
    if isinstance(url, list):
        url = url[1] if len(url) > 1 else ""
    area = {"url": str(url), "description": str(e[2]) if len(e) > 2 and not isinstance(e[2], list) else "", "kind": None, "coords": [], "border": None, "highlight": None}
    for p in e[2:]:
        if not isinstance(p, list) or not p:
            continue
        if p[0] in ("rect", "oval", "text", "poly", "line"):
            coords = [int(v) for v in p[1:]]
            if p[0] in ("rect", "oval", "text", "line") and len(coords) != 4 or len(coords) % 2:
                raise ValueError(f"shape {p[0]}")
            area |= {"kind": str(p[0]), "coords": coords}
        elif p[0] in ("none", "xor", "border") or p[0].startswith("shadow_"):
            area["border"] = str(p[0])
        elif p[0] == "hilite" and len(p) > 1:
            area["highlight"] = parse_color(p[1])
    if area["kind"] is None:
        raise ValueError("map area without a known shape")
    return area


def write_annotations(page: dict, areas: list[dict]) -> str:
    hexed = lambda c: "#{:02x}{:02x}{:02x}".format(*c)
    out = []
    if page.get("background"):
        out.append(f"(background {hexed(page['background'])})")
    if page.get("zoom") is not None:
        out.append(f"(zoom {page['zoom']})")
    if page.get("mode"):
        out.append(f"(mode {page['mode']})")
    for a in areas:
        own = [quote(a["url"]), quote(a["description"]), f"({a['kind']} {' '.join(map(str, a['coords']))})"]
        if a.get("border"):
            own.append(f"({a['border']})")
        if a.get("highlight"):
            own.append(f"(hilite {hexed(a['highlight'])})")
        out.append(f"(maparea {' '.join(own)})")
    return "\n".join(out)


FIELDS = ["title", "author", "subject", "publisher", "year", "keywords"]
ALIASES = {"description": "subject", "date": "year", "keyword": "keywords"}


def read_metadata(data: bytes) -> dict:
    """Fixed fields (the last value wins) and other pairs in order, repeats kept."""
    out: dict = dict.fromkeys(FIELDS)
    out["extra"] = []
    for e in parse_expressions(data.decode()):
        if isinstance(e, list) and e and e[0] == "metadata":
            for kv in e[1:]:
                if isinstance(kv, list) and len(kv) > 1 and not isinstance(kv[1], list):
                    key = ALIASES.get(kv[0].lower(), kv[0].lower())
                    if key in FIELDS:
                        out[key] = str(kv[1])
                    else:
                        out["extra"].append((str(kv[0]), str(kv[1])))
    return out


def write_metadata(meta: dict) -> bytes:
    pairs = [(f, meta[f]) for f in FIELDS if meta.get(f) is not None] + list(meta.get("extra") or [])
    return b"" if not pairs else ("(metadata\n" + "\n".join(f"  ({k} {quote(v)})" for k, v in pairs) + ")").encode()


def unpack(compressed: bytes | None, plain: bytes | None) -> bytes | None:
    """A compressed chunk wins, even an empty one, which means nothing."""
    if compressed is not None:
        return bzz.decode(compressed) if compressed else None
    return plain
