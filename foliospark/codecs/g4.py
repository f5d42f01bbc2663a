"""Bilevel layers in the two-dimensional facsimile code, and palettes."""

from __future__ import annotations

import numpy as np

from foliospark.codecs import bzz

# Fixed values of ITU-T T.4: terminating codes of run lengths 0 to 63, then make-up codes of 64, 128, ... 1728.
WHITE = """00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101
101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010
00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010
00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100
11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011""".split()
BLACK = """0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000
0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001
000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111
000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111
0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101""".split()
# Make-up codes of both colours for 1792, 1856, ... 2560.
LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
MODES = {"0001": "pass", "001": "horizontal", "1": 0, "011": 1, "010": -1, "000011": 2, "000010": -2, "0000011": 3, "0000010": -3}


def _lengths(codes: list[str]) -> dict[str, int]:
    own = {c: i if i < 64 else 64 * (i - 63) for i, c in enumerate(codes)}
    return own | {c: 1792 + 64 * i for i, c in enumerate(LONG)}


RUNS = (_lengths(WHITE), _lengths(BLACK))
CODES = tuple({n: c for c, n in r.items()} for r in RUNS)


def _run(color: int, n: int) -> str:
    out = ""
    while n >= 2560:
        out += CODES[color][2560]
        n -= 2560
    if n >= 64:
        out += CODES[color][n // 64 * 64]
        n %= 64
    return out + CODES[color][n]


def encode(bm: np.ndarray) -> bytes:
    """Horizontal mode only, for rows of pairs of runs; then the end mark."""
    h, w = bm.shape
    bits = []
    for row in bm:
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row]).astype(np.int8))).tolist()
        runs = np.diff([0, *edge, w]).tolist()
        if len(runs) % 2:
            runs.append(0)
        for i in range(0, len(runs), 2):
            bits += ["001", _run(0, runs[i]), _run(1, runs[i + 1])]
    bits.append("000000000001" * 2)
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return w.to_bytes(2, "big") + h.to_bytes(2, "big") + (int(text, 2).to_bytes(len(text) // 8, "big") if text else b"")


def decode(data: bytes) -> np.ndarray:
    """All modes; an unknown code ends its row, whose rest has the current colour; missing rows are white."""
    if len(data) < 4:
        raise ValueError("g4: too short")
    w, h = int.from_bytes(data[:2], "big"), int.from_bytes(data[2:4], "big")
    if w * h > 64 << 20:
        raise ValueError("g4: too large")
    bits = "".join(f"{b:08b}" for b in data[4:])
    at, out, above = 0, np.zeros((h, w), np.uint8), [w, w]

    def code(table: dict, longest: int):
        nonlocal at
        for n in range(1, longest + 1):
            if (hit := table.get(bits[at : at + n])) is not None and at + n <= len(bits):
                at += n
                return hit
        return None

    def run(color: int) -> int | None:
        total = 0
        while True:
            n = code(RUNS[color], 13)
            if n is None:
                return None
            total += n
            if n < 64:
                return total

    for y in range(h):
        if at >= len(bits):
            break
        edges: list[int] = []  # where the colour changes
        a, color, failed = -1, 0, False
        while a < w:
            start = max(a, 0)
            mode = code(MODES, 7)
            # b1: the first change above, right of a, to the opposite colour.
            i = next((i for i, e in enumerate(above) if e > a and i % 2 == color), len(above) - 1)
            b1 = above[i] if i < len(above) else w
            b2 = above[i + 1] if i + 1 < len(above) else w
            if mode is None:
                failed = True
                break
            if mode == "pass":
                a = b2
            elif mode == "horizontal":
                n, m = run(color), run(1 - color)
                if n is None or m is None:
                    failed = True
                    break
                edges += [min(start + n, w), min(start + n + m, w)]
                a = start + n + m
            else:
                a = min(max(b1 + mode, start), w)
                edges.append(a)
                color = 1 - color
        edges = [*edges, w, w]
        if failed and not edges[:-2] and at + 12 <= len(bits) and bits[at : at + 12] == "000000000001":
            break
        for i in range(0, len(edges) - 1, 2):
            out[y, edges[i] : edges[i + 1]] = 1
        if failed:
            break
        above = [*edges, w]
    return out


def encode_palette(colors: list[tuple[int, int, int]], indices: list[int] | None = None) -> bytes:
    """Version byte (bit 7: indices follow), count, blue-green-red triples, compressed indices."""
    out = bytes([0x80 if indices is not None else 0]) + len(colors).to_bytes(2, "big") + b"".join(bytes(c[::-1]) for c in colors)
    if indices is not None:
        out += len(indices).to_bytes(3, "big") + bzz.encode(b"".join((i & 0xFFFF).to_bytes(2, "big") for i in indices))
    return out


def decode_palette(data: bytes, strict: bool = True) -> tuple[list[tuple[int, int, int]], list[int] | None]:
    if len(data) < 3 or strict and data[0] & 0x7F:
        raise ValueError("palette: bad header")
    n = int.from_bytes(data[1:3], "big")
    if strict and len(data) < 3 + 3 * n:
        raise ValueError("palette: truncated")
    colors = [tuple(data[3 + 3 * i : 6 + 3 * i][::-1]) if 6 + 3 * i <= len(data) else (0, 0, 0) for i in range(n)]
    if not data[0] & 0x80:
        return colors, None
    at = 3 + 3 * n
    count = int.from_bytes(data[at : at + 3], "big")
    raw = bzz.decode(data[at + 3 :])
    if strict and len(raw) < 2 * count:
        raise ValueError("palette: truncated")
    return colors, [int.from_bytes(raw[2 * i : 2 * i + 2], "big", signed=True) for i in range(min(count, len(raw) // 2))]
