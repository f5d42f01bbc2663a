"""Documents in containers: page headers, directories, bookmarks, pages, merging and splitting."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from foliospark.codecs import bzz, iff
from foliospark.codecs.iff import Chunk

ROTATIONS = {5: "cw90", 2: "rot180", 6: "ccw90"}
FLAGS = {"none": 1, "cw90": 5, "rot180": 2, "ccw90": 6}
KINDS = {1: "page", 2: "thumbnail"}


def read_info(data: bytes) -> dict:
    if len(data) < 10:
        raise ValueError("truncated")
    gamma = data[8] / 10 if data[8] else 2.2
    return {"width": int.from_bytes(data[0:2], "big"), "height": int.from_bytes(data[2:4], "big"), "dpi": int.from_bytes(data[6:8], "little"), "gamma": gamma, "rotation": ROTATIONS.get(data[9] & 7, "none")}


def write_info(width: int, height: int, dpi: int = 300, gamma: float = 2.2, rotation: str = "none") -> bytes:
    """10 bytes; version 0.24, flags 0 for an upright page."""
    return width.to_bytes(2, "big") + height.to_bytes(2, "big") + bytes([24, 0]) + dpi.to_bytes(2, "little") + bytes([round(gamma * 10), FLAGS[rotation] if rotation != "none" else 0])


@dataclass
class Entry:
    kind: str
    id: str
    offset: int | None = None
    size: int = 0


@dataclass
class Directory:
    bundled: bool
    entries: list[Entry] = field(default_factory=list)
    synthetic: bool = False


def read_directory(data: bytes) -> Directory:
    """Entries of a directory; if its names cannot be read, made-up page names (``synthetic``)."""
    if len(data) < 3:
        raise ValueError("directory: truncated")
    bundled, n = bool(data[0] & 0x80), int.from_bytes(data[1:3], "big")
    at, offsets = 3, [None] * n
    if bundled:
        if len(data) < 3 + 4 * n:
            raise ValueError("directory: truncated")
        offsets = [int.from_bytes(data[3 + 4 * i : 7 + 4 * i], "big") for i in range(n)]
        at += 4 * n
    try:
        meta = bzz.decode(data[at:])
        sizes = [int.from_bytes(meta[3 * i : 3 * i + 3], "big") for i in range(n)]
        flags, names, pos = meta[3 * n : 4 * n], [], 4 * n
        if len(flags) < n:
            raise ValueError("directory: short")
        for f in flags:
            own = []
            for _ in range(1 + bool(f & 0x80) + bool(f & 0x40)):
                end = meta.index(b"\0", pos)
                own.append(meta[pos:end].decode())
                pos = end + 1
            names.append(own[0])
        return Directory(bundled, [Entry(KINDS.get(f & 0x3F, "shared"), i, o, s) for f, i, o, s in zip(flags, names, offsets, sizes, strict=True)])
    except ValueError:
        return Directory(bundled, [Entry("page", f"p{i:04d}", o) for i, o in enumerate(offsets)], True)


def write_directory(entries: list[Entry], bundled: bool = True) -> bytes:
    code = {"page": 1, "thumbnail": 2, "shared": 0}
    meta = b"".join((e.size & 0xFFFFFF).to_bytes(3, "big") for e in entries) + bytes(code[e.kind] for e in entries) + b"".join(e.id.encode() + b"\0" for e in entries)
    head = bytes([0x81 if bundled else 1]) + len(entries).to_bytes(2, "big")
    if bundled:
        head += b"".join((e.offset or 0).to_bytes(4, "big") for e in entries)
    return head + bzz.encode(meta)


def read_bookmarks(data: bytes) -> list[dict]:
    """Rows in preorder: node_id, parent_id, depth, sibling_ord, title, url."""
    raw = bzz.decode(data)
    count, at, rows = int.from_bytes(raw[:2], "big"), 2, []

    def text(at: int) -> tuple[str, int]:
        n = int.from_bytes(raw[at : at + 3], "big")
        if at + 3 + n > len(raw):
            raise ValueError("bookmarks: truncated")
        return raw[at + 3 : at + 3 + n].decode(), at + 3 + n

    stack: list[list] = []  # [node, children left, next ordinal]
    top = 0
    while len(rows) < count and at < len(raw):
        n = raw[at]
        title, at_ = text(at + 1)
        url, at = text(at_)
        while stack and stack[-1][1] == 0:
            stack.pop()
        node = len(rows)
        if stack:
            parent, order = stack[-1][0], stack[-1][2]
            stack[-1][1] -= 1
            stack[-1][2] += 1
        else:
            parent, order, top = None, top, top + 1
        rows.append({"node_id": node, "parent_id": parent, "depth": len(stack), "sibling_ord": order, "title": title, "url": url})
        if n:
            stack.append([node, n, 0])
    return rows


def write_bookmarks(rows: list[dict]) -> bytes:
    """From rows with node_id, parent_id, sibling_ord; at most 255 children a node are counted."""
    below: dict = {}
    for r in sorted(rows, key=lambda r: r["sibling_ord"]):
        below.setdefault(r["parent_id"], []).append(r)
    out, count = [], 0

    def put(r: dict) -> None:
        nonlocal count
        own = below.get(r["node_id"], [])[:255]
        count += 1
        out.append(bytes([len(own)]) + b"".join(len(t.encode()).to_bytes(3, "big") + t.encode() for t in (r["title"], r["url"])))
        for c in own:
            put(c)

    for r in below.get(None, []):
        put(r)
    return bzz.encode(count.to_bytes(2, "big") + b"".join(out))


def bookmark_volumes(rows: list[dict], children: int = 255, most: int = 65_535) -> Iterator[dict]:
    """A tree of any size as trees that the format holds, not packed yet: all bookmarks, in preorder, dealt to volumes.

    A node counts its children in one byte and a file its bookmarks in two.  Where the next bookmark finds no place a new
    volume begins with its ancestors.  start: the number in the whole tree of the first bookmark that is new; chain: those of
    the ancestors; first: the ordinals among their siblings of the ancestors and of the first new bookmark."""
    below: dict = {}
    for r in sorted(rows, key=lambda r: r["sibling_ord"]):
        below.setdefault(r["parent_id"], []).append(r)
    path: list[list] = []  # [row, number, ordinal, place in the volume] of the ancestors
    own: list[list] = []  # [children, row]
    volume: dict | None = None

    def packed() -> dict:
        texts = [(n, *(r[t].encode() for t in ("title", "url"))) for n, r in own]
        return volume | {"raw": len(own).to_bytes(2, "big") + b"".join(bytes([n]) + b"".join(len(t).to_bytes(3, "big") + t for t in both) for n, *both in texts)}

    walks, number = [enumerate(below.get(None, []))], 0
    while walks:
        order, r = next(walks[-1], (0, None))
        del path[len(walks) - 1 :]
        if r is None:
            walks.pop()
            continue
        if len(path) >= most:
            raise ValueError("bookmarks: too deep for a volume")
        if volume is None or len(own) == most or path and own[path[-1][3]][0] == children:
            if volume is not None:
                yield packed()
            volume = {"start": number, "chain": [p[1] for p in path], "first": [*(p[2] for p in path), order]}
            own = [[1, p[0]] for p in path]
            for at, p in enumerate(path):
                p[3] = at
            if path:
                own[-1][0] = 0
        if path:
            own[path[-1][3]][0] += 1
        path.append([r, number, order, len(own)])
        own.append([0, r])
        walks.append(enumerate(below.get(r["node_id"], [])))
        number += 1
    if volume is not None:
        yield packed()


def volume_rows(rows: list[dict], start: int, chain: list[int], first: list[int]) -> Iterator[dict]:
    """The new bookmarks of a volume as it was read, with their places in the whole tree (see ``bookmark_volumes``)."""
    again = len(chain)
    for r in rows[again:]:
        up = r["parent_id"]
        shift = first[0] if up is None else first[up + 1] if up < again else 0
        parent = None if up is None else chain[up] if up < again else up - again + start
        yield r | {"node_id": r["node_id"] - again + start, "parent_id": parent, "sibling_ord": r["sibling_ord"] + shift}


@dataclass
class Page:
    id: str
    chunks: list[Chunk]
    info: dict
    span: tuple[int, int] | None = None
    shared: bytes | None = None

    def first(self, id_: str) -> bytes | None:
        return next((c.data for c in self.chunks if c.id == id_), None)

    def all(self, id_: str) -> list[bytes]:
        return [c.data for c in self.chunks if c.id == id_]


@dataclass
class Document:
    pages: list[Page]
    bookmarks: list[dict]
    chunks: list[Chunk]
    kind: str
    bundled: bool = True
    directory: Directory | None = None


def _page(id_: str, root: Chunk, dicts: dict[str, bytes]) -> Page:
    info = root.find("INFO")
    if info is None:
        raise ValueError("page without INFO")
    name = root.find("INCL")
    shared = dicts.get(name.data.decode("utf-8", "replace").rstrip()) if name else None
    return Page(id_, root.children, read_info(info.data), (root.offset, root.offset + 8 + root.length), shared)


def read(data: bytes, resolve=None) -> Document:
    """A single page, a bundle, or an index whose parts ``resolve(name)`` supplies.

    Parts are taken by ordinal, with their offsets only as a check; shared dictionaries resolve for
    parts from outside too."""
    root = iff.parse(data)
    if root.kind == "DJVU":
        return Document([_page("", root, {})], [], root.children, "DJVU")
    if root.kind != "DJVM":
        raise ValueError(f"not a document: {root.kind}")
    head = root.find("DIRM")
    if head is None:
        raise ValueError("no directory")
    directory = read_directory(head.data)
    marks = root.find("NAVM")
    if directory.bundled:
        forms = [c for c in root.children if c.kind is not None]
        if len(forms) < len(directory.entries):
            raise ValueError("malformed: component missing")
    else:
        if resolve is None:
            raise ValueError("no resolver for an indirect document")
        forms = [iff.parse(resolve(e.id)) for e in directory.entries]
    pairs = list(zip(directory.entries, forms, strict=False))
    dicts = {e.id: f.find("Djbz").data for e, f in pairs if f.kind == "DJVI" and f.find("Djbz")}
    pages = [_page(e.id, f, dicts) for e, f in pairs if e.kind == "page" and f.kind == "DJVU"]
    return Document(pages, read_bookmarks(marks.data) if marks and marks.data else [], [c for c in root.children if c.kind is None], "DJVM", directory.bundled, directory)


def bundle(parts: list[tuple[str, str, Chunk]], bookmarks: bytes | None = None) -> bytes:
    """(kind, id, form) parts as one file with true offsets."""
    bodies = [iff.emit_chunk(f) for _, _, f in parts]
    entries = [Entry(k, i, 0, len(b)) for (k, i, _), b in zip(parts, bodies, strict=True)]
    for _ in range(2):  # the directory's size does not depend on the offsets' values
        fixed = [Chunk("DIRM", write_directory(entries))] + ([Chunk("NAVM", bookmarks)] if bookmarks else [])
        at = 16 + sum(len(iff.emit_chunk(c)) for c in fixed)
        for e, b in zip(entries, bodies, strict=True):
            e.offset = at
            at += len(b)
    return iff.emit(iff.form("DJVM", *fixed, *[f for _, _, f in parts]))


def _parts(data: bytes) -> list[tuple[str, str, Chunk]]:
    root = iff.parse(data)
    if root.kind == "DJVU":
        return [("page", "", root)]
    forms = [c for c in root.children if c.kind is not None]
    entries = read_directory(root.find("DIRM").data).entries
    kind = {"DJVI": "shared", "THUM": "thumbnail"}
    return [(kind.get(f.kind, "page"), e.id, f) for e, f in zip(entries, forms, strict=True)]


def _renamed(form: Chunk, names: dict[str, str]) -> Chunk:
    """A form whose includes follow the new names."""
    own = [Chunk("INCL", names[n].encode()) if c.id == "INCL" and (n := c.data.decode().rstrip()) in names else c for c in form.children]
    return Chunk("FORM", b"", form.kind, own)


def merge(files: list[bytes]) -> bytes:
    """All parts of all files in order, renamed, with includes that follow."""
    if not files:
        raise ValueError("nothing to merge")
    out, n = [], 0
    for d, data in enumerate(files):
        parts, names = _parts(data), {}
        for _, id_, _ in parts:
            names[id_] = f"p{n:04d}.djvu" if len(files) == 1 else f"d{d}p{n:04d}.djvu"
            n += 1
        out += [(k, names[i], _renamed(f, names)) for k, i, f in parts]
    return bundle(out)


def split(data: bytes, start: int, end: int) -> bytes:
    """Pages [start, end) with the shared parts they include."""
    parts = _parts(data)
    pages = [p for p in parts if p[0] == "page"][start:end]
    if not pages or start < 0:
        raise ValueError("page range")
    used = {c.data.decode().rstrip() for _, _, f in pages for c in f.find_all("INCL")}
    return bundle([p for p in parts if p[0] == "shared" and p[1] in used] + pages) if len(pages) > 1 or used else iff.emit(pages[0][2])


def index_file(entries: list[tuple[str, str]]) -> bytes:
    """A file that only names its parts: (kind, id)."""
    return iff.emit(iff.form("DJVM", Chunk("DIRM", write_directory([Entry(k, i) for k, i in entries], bundled=False))))


def spliced(data: bytes, root: Chunk, names: tuple[str, ...], chunk: Chunk | None) -> bytes:
    """The file with ``chunk`` in place of the root's children of these names (at its end if there are none; None removes them).

    All other bytes stay as they are, whatever stands in pad bytes or after the form."""
    end = min(root.offset + 8 + root.length, len(data))
    first = root.offset + 12
    body, put = data[first - 4 : first], chunk
    for c in root.children:
        stop = min(c.offset + 8 + c.length + (c.length & 1), end)
        if c.id not in names:
            part = data[c.offset : stop]
        else:
            part, put = iff.emit_chunk(put) if put else b"", None
        body += b"\0" * (len(body) & 1) * bool(part) + part
        first = stop
    rest = data[first:end]  # too short for a chunk
    if put:
        body += b"\0" * (len(body) & 1) + iff.emit_chunk(put)
    body += rest
    after = data[end + (end - root.offset & 1) :]
    pad = data[end : end + 1] if end - root.offset & 1 else b"\0"
    return data[: root.offset + 4] + len(body).to_bytes(4, "big") + body + (pad if len(body) & 1 else b"") + after


def put_layer(data: bytes, page: int, base: str, payload: bytes) -> bytes:
    """Sets or removes (empty payload) the ``base`` layer of a page: the compressed form replaces a plain one.

    A file without a change to make comes back as it is; of a single page only the bytes of this layer and the length of
    the form change."""
    parts = _parts(data)
    at = [i for i, p in enumerate(parts) if p[0] == "page"][page]
    kind, id_, form = parts[at]
    names = (base + "z", base + "a")
    old = next((c for c in form.children if c.id in names), None)
    if old is None and not payload or old is not None and old.id == names[0] and old.data == payload:
        return data
    root = iff.parse(data)
    if root.kind == "DJVU":
        return spliced(data, root, names, Chunk(names[0], payload) if payload else None)
    own, done = [], False
    for c in form.children:
        if c.id not in names:
            own.append(c)
        elif payload and not done:
            own.append(Chunk(names[0], payload))
            done = True
    if payload and not done:
        own.append(Chunk(names[0], payload))
    parts[at] = (kind, id_, Chunk("FORM", b"", form.kind, own))
    marks = root.find("NAVM")
    return bundle(parts, marks.data if marks else None)


def put_bookmarks(data: bytes, rows: list[dict]) -> bytes:
    if iff.parse(data).kind != "DJVM":
        raise ValueError("bookmarks need a bundle")
    return bundle(_parts(data), write_bookmarks(rows) if rows else None)
