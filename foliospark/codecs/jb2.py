"""Bilevel layers as symbols: one description of the stream serves reading and writing.

``Stream`` walks numbers and pixels in the order of the format; with a decoder under it every call
returns what is read, with an encoder it writes the value it is given.  Bitmaps are
arrays of 0 and 1 with the top row first.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

from foliospark.codecs.zp import Decoder, Encoder

BIG = 262142
MOST_PAGE, MOST_SYMBOL, MOST_TOTAL, MOST_RECORDS, MOST_COMMENT = 64 << 20, 16 << 20, 256 << 20, 65536, 4096


class _Numbers:
    """A growing binary tree of contexts for one kind of number."""

    def __init__(self) -> None:
        self.state, self.next = bytearray(1), [[0, 0]]

    def step(self, node: int, way: int) -> int:
        to = self.next[node][way]
        if not to:
            to = self.next[node][way] = len(self.state)
            self.state.append(0)
            self.next.append([0, 0])
        return to


class Stream:
    def __init__(self, data: bytes | None = None):
        self.zp = Decoder(data) if data is not None else Encoder()
        self.reading = data is not None
        self.kinds: dict[str, _Numbers] = {}
        self.direct, self.refine = bytearray(1024), bytearray(2048)
        self.flags: dict[str, bytearray] = {}
        self.pixels = 0

    def reset(self) -> None:
        self.kinds = {}

    def bit(self, ctx: bytearray, i: int, value: int = 0) -> int:
        if self.reading:
            return self.zp.bit(ctx, i)
        self.zp.bit(value, ctx, i)
        return value

    def flag(self, kind: str, value: int = 0) -> int:
        return self.bit(self.flags.setdefault(kind, bytearray(1)), 0, value)

    def number(self, kind: str, low: int, high: int, value: int = 0) -> int:
        """Sign, then magnitude by doubling, then by halving; a decision that the bounds settle costs nothing."""
        tree, node = self.kinds.setdefault(kind, _Numbers()), 0

        def at_least(cut: int) -> bool:
            nonlocal node
            if low >= cut:
                yes = 1
            elif high < cut:
                yes = 0
            else:
                yes = self.bit(tree.state, node, int(value >= cut))
            node = tree.step(node, yes)
            return bool(yes)

        negative = not at_least(0)
        if negative:
            low, high, value = -high - 1, -low - 1, -value - 1
        cut = 1
        while at_least(cut):
            cut = 2 * cut + 1
        base, size = cut >> 1, (cut + 1) >> 1  # the value lies in [base, base + size)
        while size > 1:
            size >>= 1
            if at_least(base + size):
                base += size
        return -base - 1 if negative else base

    def bitmap(self, w: int, h: int, own: np.ndarray | None = None) -> np.ndarray:
        self._budget(w, h)
        rows = [[0] * (w + 4) for _ in range(h + 2)]
        if own is not None:
            for y in range(h):
                rows[y + 2][2 : w + 2] = own[y].tolist()
        bit, ctx, reading = (self.zp.bit, self.direct, self.reading)
        for y in range(2, h + 2):
            up2, up1, cur = rows[y - 2], rows[y - 1], rows[y]
            a, b, c = up2[1] << 1 | up2[2], up1[0] << 3 | up1[1] << 2 | up1[2] << 1 | up1[3], 0
            for x in range(2, w + 2):
                a = (a << 1 | up2[x + 1]) & 7
                b = (b << 1 | up1[x + 2]) & 31
                i = a << 7 | b << 2 | c
                if reading:
                    v = cur[x] = bit(ctx, i)
                else:
                    v = cur[x]
                    bit(v, ctx, i)
                c = (c << 1 | v) & 3
        return np.array([r[2 : w + 2] for r in rows[2:]], np.uint8).reshape(h, w)

    def refined(self, w: int, h: int, ref: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """A bitmap coded against another one, both centred."""
        self._budget(w, h)
        rh, rw = ref.shape
        dx = ((rw - 1) >> 1) - ((w - 1) >> 1)
        dy = (rh - 1 - ((rh - 1) >> 1)) - (h - 1 - ((h - 1) >> 1))  # counted from the top
        pad = np.zeros((h + 2, w + 2), np.uint8)
        ys, xs = np.arange(-1, h + 1) + dy, np.arange(-1, w + 1) + dx
        oy, ox = (ys >= 0) & (ys < rh), (xs >= 0) & (xs < rw)
        pad[np.ix_(oy, ox)] = ref[np.ix_(ys[oy], xs[ox])]
        m, rows = pad.tolist(), [[0] * (w + 2) for _ in range(h + 1)]
        if own is not None:
            for y in range(h):
                rows[y + 1][1 : w + 1] = own[y].tolist()
        bit, ctx, reading = self.zp.bit, self.refine, self.reading
        for y in range(1, h + 1):
            up, cur, m2, m1, m0 = rows[y - 1], rows[y], m[y - 1], m[y], m[y + 1]
            for x in range(1, w + 1):
                i = up[x - 1] << 10 | up[x] << 9 | up[x + 1] << 8 | cur[x - 1] << 7 | m2[x] << 6 | m1[x - 1] << 5 | m1[x] << 4 | m1[x + 1] << 3 | m0[x - 1] << 2 | m0[x] << 1 | m0[x + 1]
                if reading:
                    cur[x] = bit(ctx, i)
                else:
                    bit(cur[x], ctx, i)
        return np.array([r[1 : w + 1] for r in rows[1:]], np.uint8).reshape(h, w)

    def _budget(self, w: int, h: int) -> None:
        self.pixels += w * h
        if w * h > MOST_SYMBOL or self.pixels > MOST_TOTAL:
            raise ValueError("jb2: symbols too large")


@dataclass
class Layout:
    """Where the next symbol goes; corners are counted from the bottom left."""

    height: int
    left: int = -1
    right: int = -1
    bottom: int = 0
    lines: list[int] = field(default_factory=lambda: [0, 0, 0])

    def __post_init__(self) -> None:
        self.bottom = self.height - 1

    def place(self, s: Stream, w: int, h: int, x: int = 0, y: int = 0, new: int = 0) -> tuple[int, int]:
        if s.flag("line", new):
            x = self.left + s.number("line x", -BIG - 1, BIG, x - self.left)
            y = self.bottom + s.number("line y", -BIG - 1, BIG, y + h - 1 - self.bottom) - h + 1
            self.left, self.bottom, self.lines = x, y, [y] * 3
        else:
            x = self.right + s.number("x", -BIG - 1, BIG, x - self.right)
            base = sorted(self.lines)[1]
            y = base + s.number("y", -BIG - 1, BIG, y - base)
            self.lines = [*self.lines[1:], y]
        self.right = x + w - 1
        return x, y


def cropped(bm: np.ndarray) -> np.ndarray:
    rows, cols = np.flatnonzero(bm.any(axis=1)), np.flatnonzero(bm.any(axis=0))
    return bm[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1] if len(rows) else bm[:0, :0]


def _blit(page: np.ndarray, marks: np.ndarray | None, bm: np.ndarray, x: int, y: int, index: int) -> None:
    height, width = page.shape
    h, w = bm.shape
    top = height - y - h
    y0, y1, x0, x1 = max(top, 0), min(top + h, height), max(x, 0), min(x + w, width)
    if y0 < y1 and x0 < x1:
        part = bm[y0 - top : y1 - top, x0 - x : x1 - x]
        page[y0:y1, x0:x1] |= part
        if marks is not None:
            marks[y0:y1, x0:x1][part > 0] = index


def decode(data: bytes, shared: list[np.ndarray] | None = None, indexed: bool = False):
    """The page bitmap; with ``indexed`` also the number of the last symbol at each pixel (-1: none)."""
    s, symbols = Stream(data), []
    kind = s.number("record", 0, 11)
    if kind == 9:
        n = s.number("inherited", 0, BIG)
        if n and (shared is None or n > len(shared)):
            raise ValueError("jb2: shared dictionary missing or too short")
        symbols = list(shared[:n]) if n else []
        s.number("record", 0, 11)
    width, height = s.number("size", 0, BIG) or 200, s.number("size", 0, BIG) or 200
    if s.flag("reserved"):
        raise ValueError("jb2: bad header")
    if width * height > MOST_PAGE:
        raise ValueError("jb2: page too large")
    page, marks, place, blits = np.zeros((height, width), np.uint8), np.full((height, width), -1, np.int32) if indexed else None, Layout(height), 0
    for _ in range(MOST_RECORDS):
        kind = s.number("record", 0, 11)
        if kind == 11:
            return (page, marks) if indexed else page
        if kind in (1, 2, 3, 8):
            w, h = s.number("width", 0, BIG), s.number("height", 0, BIG)
            bm = s.bitmap(w, h)
        elif kind in (4, 5, 6, 7):
            if not symbols:
                raise ValueError("jb2: no symbol")
            ref = symbols[s.number("index", 0, len(symbols) - 1)]
            bm = ref
            if kind != 7:
                w, h = ref.shape[1] + s.number("dw", -BIG - 1, BIG), ref.shape[0] + s.number("dh", -BIG - 1, BIG)
                if w < 0 or h < 0:
                    raise ValueError("jb2: bad size")
                bm = s.refined(w, h, ref)
        elif kind == 9:
            s.reset()
            continue
        elif kind == 10:
            n = s.number("comment length", 0, BIG)
            if n > MOST_COMMENT:
                raise ValueError("jb2: comment too long")
            for _ in range(n):
                s.number("comment", 0, 255)
            continue
        else:
            raise ValueError(f"jb2: record {kind}")
        if kind in (1, 2, 4, 5):
            symbols.append(cropped(bm))
        if kind == 8:
            x = s.number("abs x", 1, width) - 1
            y = s.number("abs y", 1, height) - bm.shape[0]
        elif kind in (1, 3, 4, 6, 7):
            x, y = place.place(s, bm.shape[1], bm.shape[0])
        else:
            continue
        _blit(page, marks, bm, x, y, blits)
        blits += 1
    raise ValueError("jb2: too many records")


def decode_dictionary(data: bytes, inherited: list[np.ndarray] | None = None) -> list[np.ndarray]:
    s, symbols = Stream(data), []
    kind = s.number("record", 0, 11)
    if kind == 9:
        n = s.number("inherited", 0, BIG)
        if n and (inherited is None or n > len(inherited)):
            raise ValueError("jb2: inherited dictionary missing or too short")
        symbols = list(inherited[:n]) if n else []
        s.number("record", 0, 11)
    s.number("size", 0, BIG)
    s.number("size", 0, BIG)
    if s.flag("reserved"):
        raise ValueError("jb2: bad header")
    for _ in range(MOST_RECORDS):
        kind = s.number("record", 0, 11)
        if kind == 11:
            return symbols
        if kind == 2:
            symbols.append(cropped(s.bitmap(s.number("width", 0, BIG), s.number("height", 0, BIG))))
        elif kind == 5 and symbols:
            ref = symbols[s.number("index", 0, len(symbols) - 1)]
            w, h = ref.shape[1] + s.number("dw", -BIG - 1, BIG), ref.shape[0] + s.number("dh", -BIG - 1, BIG)
            symbols.append(cropped(s.refined(w, h, ref)))
        elif kind == 9:
            s.reset()
        elif kind == 10:
            for _ in range(min(s.number("comment length", 0, BIG), MOST_COMMENT)):
                s.number("comment", 0, 255)
        else:
            raise ValueError(f"jb2: record {kind} in a dictionary")
    raise ValueError("jb2: too many records")


def _head(s: Stream, width: int, height: int, inherited: int) -> None:
    if inherited:
        s.number("record", 0, 11, 9)
        s.number("inherited", 0, BIG, inherited)
    s.number("record", 0, 11, 0)
    s.number("size", 0, BIG, width)
    s.number("size", 0, BIG, height)
    s.flag("reserved", 0)


def encode(bm: np.ndarray, tile: int = 1024) -> bytes:
    """Without a dictionary: direct tiles of at most ``tile`` pixels a side."""
    s = Stream()
    height, width = bm.shape
    _head(s, width, height, 0)
    place = Layout(height)
    for top in range(0, height, tile):
        for x in range(0, width, tile):
            part = bm[top : top + tile, x : x + tile]
            h, w = part.shape
            s.number("record", 0, 11, 3)
            s.number("width", 0, BIG, w)
            s.number("height", 0, BIG, h)
            s.bitmap(w, h, part)
            place.place(s, w, h, x, height - top - h, 1)
    s.number("record", 0, 11, 11)
    return s.zp.finish()


def components(bm: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(x, top, bitmap) of each 8-connected component, in the order of their first pixel by rows.

    Runs of a row are joined with overlapping runs of the row above by union-find."""
    height, width = bm.shape
    runs: list[tuple[int, int, int]] = []
    up: list[int] = []

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    above: list[int] = []
    for y in range(height):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], bm[y], [0]]).astype(np.int8)))
        here = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            i = len(runs)
            runs.append((y, a, b))
            up.append(i)
            here.append(i)
        j = 0
        for i in here:
            _, a, b = runs[i]
            while j < len(above) and runs[above[j]][2] < a:
                j += 1
            k = j
            while k < len(above) and runs[above[k]][1] <= b:
                p, q = find(i), find(above[k])
                if p != q:
                    up[max(p, q)] = min(p, q)
                k += 1
        above = here
    groups: dict[int, list[int]] = {}
    for i in range(len(runs)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for own in groups.values():
        top, left = runs[own[0]][0], min(runs[i][1] for i in own)
        right, bottom = max(runs[i][2] for i in own), max(runs[i][0] for i in own)
        part = np.zeros((bottom - top + 1, right - left), np.uint8)
        for i in own:
            y, a, b = runs[i]
            part[y - top, a - left : b - left] = 1
        out.append((left, top, part))
    return out


def in_reading_order(parts: list[tuple[int, int, np.ndarray]], line: int = 16) -> list[tuple[int, int, np.ndarray]]:
    return sorted(parts, key=lambda p: ((p[1] + p[2].shape[0]) // line, p[0]))


def encode_symbols(bm: np.ndarray, shared: list[np.ndarray] | None = None, lossy: float = 0.0) -> bytes:
    """With a dictionary: a component seen before (or shared) is a copy, others are new symbols.

    ``lossy``: share of a symbol's pixels by which a copy may differ (symbols of 32 pixels and more)."""
    s, shared = Stream(), shared or []
    height, width = bm.shape
    _head(s, width, height, len(shared))
    known = {(x.shape, x.tobytes()): i for i, x in reversed(list(enumerate(shared)))}
    symbols, by_shape = list(shared), {}
    for i, x in enumerate(symbols):
        by_shape.setdefault(x.shape, []).append(i)
    place, first, last_bottom = Layout(height), True, 0
    for x, top, part in in_reading_order(components(bm)):
        h, w = part.shape
        y = height - top - h
        index = known.get((part.shape, part.tobytes()))
        if index is None and lossy and part.size >= 32 and part.shape in by_shape:
            own = by_shape[part.shape]
            apart = np.array([(symbols[i] != part).sum() for i in own])
            if apart.min() <= round(part.size * lossy):
                index = own[int(apart.argmin())]
        s.number("record", 0, 11, 1 if index is None else 7)
        if index is None:
            s.number("width", 0, BIG, w)
            s.number("height", 0, BIG, h)
            s.bitmap(w, h, part)
            known[part.shape, part.tobytes()] = len(symbols)
            by_shape.setdefault(part.shape, []).append(len(symbols))
            symbols.append(part)
        else:
            s.number("index", 0, len(symbols) - 1, index)
        new = int(first or abs(y - last_bottom) > 2 * h or x < place.right - 4 * w)
        place.place(s, w, h, x, y, new)
        first, last_bottom = False, y
    s.number("record", 0, 11, 11)
    return s.zp.finish()


def encode_dictionary(symbols: Iterable[np.ndarray]) -> bytes:
    s = Stream()
    _head(s, 1, 1, 0)
    for x in symbols:
        s.number("record", 0, 11, 2)
        s.number("width", 0, BIG, x.shape[1])
        s.number("height", 0, BIG, x.shape[0])
        s.bitmap(x.shape[1], x.shape[0], x)
    s.number("record", 0, 11, 11)
    return s.zp.finish()
