"""Chunk containers: reading them into rows and writing rows back."""

from __future__ import annotations

from dataclasses import dataclass, field

MAGIC = b"AT&T"
FORMS = (b"FORM", b"LIST", b"PROP", b"CAT ")


@dataclass
class Chunk:
    """A leaf (id, data) or a form (id FORM, kind, children)."""

    id: str
    data: bytes = b""
    kind: str | None = None
    children: list[Chunk] = field(default_factory=list)
    offset: int = 0
    length: int = 0

    def find(self, id_: str) -> Chunk | None:
        return next((c for c in self.children if c.id == id_), None)

    def find_all(self, id_: str) -> list[Chunk]:
        return [c for c in self.children if c.id == id_]


def _chunks(data: bytes, at: int, end: int, depth: int) -> list[Chunk]:
    out = []
    while end - at >= 8:
        id_, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "big")
        stop = min(at + 8 + size, end)
        if id_ in FORMS and depth > 0 and stop - at >= 12:
            out.append(Chunk("FORM", b"", data[at + 8 : at + 12].decode("latin-1"), _chunks(data, at + 12, stop, depth - 1), at, size))
        else:
            out.append(Chunk(id_.decode("latin-1"), data[at + 8 : stop], None, [], at, size))
        at = stop + (size & 1)
    return out


def parse(data: bytes, depth: int = 16) -> Chunk:
    """The root form; a missing magic and a short tail are tolerated."""
    at = 4 if data[:4] == MAGIC else 0
    if len(data) - at < 12:
        raise ValueError("too short")
    if data[at : at + 4] != b"FORM":
        raise ValueError("bad magic")
    return _chunks(data, at, len(data), depth)[0]


def parse_strict(data: bytes) -> Chunk:
    """One level, with the errors of a strict reader."""
    if len(data) < 16:
        raise ValueError("too short")
    if data[:8] != MAGIC + b"FORM":
        raise ValueError("bad magic")
    size = int.from_bytes(data[8:12], "big")
    if size < 4:
        raise ValueError("truncated")
    end, at = min(12 + size, len(data)), 16
    root = Chunk("FORM", b"", data[12:16].decode("latin-1"), [], 4, size)
    while end - at >= 8:
        n = int.from_bytes(data[at + 4 : at + 8], "big")
        if at + 8 + n > end:
            raise ValueError("chunk too large")
        root.children.append(Chunk(data[at : at + 4].decode("latin-1"), data[at + 8 : at + 8 + n], None, [], at, n))
        at += 8 + n + (n & 1)
    return root


def emit_chunk(chunk: Chunk) -> bytes:
    """A chunk with its header and pad byte."""
    if chunk.kind is None:
        body, id_ = chunk.data, chunk.id.encode("latin-1")
    else:
        body, id_ = chunk.kind.encode("latin-1") + b"".join(map(emit_chunk, chunk.children)), b"FORM"
        # A form that was read with an odd length keeps it: its last pad byte is not counted.
        if chunk.length % 2 and len(body) == chunk.length + 1:
            return id_ + chunk.length.to_bytes(4, "big") + body
    return id_ + len(body).to_bytes(4, "big") + body + b"\0" * (len(body) & 1)


def emit(root: Chunk) -> bytes:
    return MAGIC + emit_chunk(root)


def form(kind: str, *children: Chunk) -> Chunk:
    return Chunk("FORM", b"", kind, list(children))


def walk(root: Chunk, path: tuple[int, ...] = ()):
    """(path, parent's form kind, chunk) of all chunks below the root, in order."""
    for i, c in enumerate(root.children):
        yield (*path, i), root.kind, c
        if c.kind is not None:
            yield from walk(c, (*path, i))
