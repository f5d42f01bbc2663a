"""General compression of the directory, bookmarks and text: block sorting, ranks, adaptive bits."""

from __future__ import annotations

import numpy as np

from foliospark.codecs.zp import DOWN, ONES, UP, Decoder, Encoder, M, P

BLOCK, MOST_OUTPUT = 4 << 20, 256 << 20

class _Ranks:
    """Move-to-front with frequencies for the first four places."""

    def __init__(self, shift: int):
        self.order, self.freq, self.add, self.shift = list(range(256)), [0, 0, 0, 0], 4, shift

    def touch(self, place: int, symbol: int) -> None:
        self.add += self.add >> self.shift
        if self.add > 0x10000000:
            self.add >>= 24
            self.freq = [f >> 24 for f in self.freq]
        order, freq = self.order, self.freq
        score = self.add + (freq[place] if place < 4 else 0)
        to = min(place, 3) if place >= 4 else place
        while to > 0 and score >= freq[to - 1]:
            to -= 1
        del order[place]
        order.insert(to, symbol)
        if place < 4:
            del freq[place]
        else:
            freq.pop()
        freq.insert(to, score)


def _group_base(k: int) -> int:
    """Contexts 0-5 are for the first two ranks; each group has one, then a tree of 2^k - 1."""
    return 6 + sum(1 << j for j in range(1, k))


def decode(data: bytes) -> bytes:
    zp, ctx, out = Decoder(data), bytearray(300), []
    total = 0
    while True:
        size = 0
        for _ in range(24):
            size = size << 1 | zp.raw()
        if size == 0:
            return b"".join(out)
        if size > BLOCK:
            raise ValueError("bzz: block too large")
        shift = 0
        if zp.raw():
            shift = 1 + zp.raw()
        ranks, place, marker = _Ranks(shift), 3, -1
        symbols = bytearray(size)
        bit = zp.bit
        for i in range(size):
            c = min(place, 2)
            if bit(ctx, c):
                place = 0
            elif bit(ctx, 3 + c):
                place = 1
            else:
                place = 256
                for k in range(1, 8):
                    base = _BASE[k]
                    if bit(ctx, base):
                        n = 1
                        while n < 1 << k:
                            n = n << 1 | bit(ctx, base + n)
                        place = n
                        break
            if place == 256:
                marker = i
                continue
            symbol = symbols[i] = ranks.order[place]
            ranks.touch(place, symbol)
        if marker < 0:
            raise ValueError("bzz: no end mark")
        total += size - 1
        if total > MOST_OUTPUT:
            raise ValueError("bzz: output too large")
        out.append(_unsort(symbols, marker))


_BASE = [0, *[_group_base(k) for k in range(1, 8)]]


def _unsort(last: bytearray, marker: int) -> bytes:
    """The text whose rotations, sorted, end in ``last``; the end mark sorts before all bytes."""
    n = len(last)
    column = np.frombuffer(bytes(last), np.uint8).astype(np.int16)
    column[marker] = -1
    step = np.argsort(column, kind="stable").tolist()  # a row -> the row of the rotation one further on
    at, out = step[0], bytearray(n - 1)
    for i in range(n - 1):
        at = step[at]
        out[i] = last[at]
    return bytes(out)


def _sort(block: bytes) -> tuple[bytearray, int]:
    """Last column of the sorted rotations of the block with an end mark, and the mark's row."""
    n = len(block) + 1
    rank = np.zeros(n, np.int64)
    rank[:-1] = np.frombuffer(block, np.uint8).astype(np.int64) + 1
    size = 1
    while True:
        key = rank << 32
        key[: n - size] |= rank[size:] + 1 if size < n else 0
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1 or size >= n:
            break
        size *= 2
    before = (order - 1) % n
    text = np.frombuffer(block + b"\0", np.uint8)
    return bytearray(text[before].tobytes()), int(np.flatnonzero(before == n - 1)[0])


def encode(data: bytes) -> bytes:
    zp, ctx = Encoder(), bytearray(300)
    for at in range(0, len(data), BLOCK - 1):
        block = data[at : at + BLOCK - 1]
        last, marker = _sort(block)
        size = len(last)
        for i in range(23, -1, -1):
            zp.raw(size >> i & 1)
        shift = 0 if size < 100_000 else 1 if size < 1_000_000 else 2
        zp.raw(int(shift > 0))
        if shift:
            zp.raw(shift - 1)
        ranks, place = _Ranks(shift), 3
        bit = zp.bit
        for i, symbol in enumerate(last):
            c = min(place, 2)
            place = 256 if i == marker else ranks.order.index(symbol)
            bit(int(place == 0), ctx, c)
            if place > 0:
                bit(int(place == 1), ctx, 3 + c)
            if place > 1:
                for k in range(1, 8):
                    base, here = _BASE[k], place < 2 << k
                    bit(int(here), ctx, base)
                    if here:
                        n = 1
                        for j in range(k - 1, -1, -1):
                            b = place >> j & 1
                            bit(b, ctx, base + n)
                            n = n << 1 | b
                        break
            if place < 256:
                ranks.touch(place, symbol)
    for _ in range(24):
        zp.raw(0)
    return zp.finish()


# -- many small blocks at once --------------------------------------------------------
#: Data of at most so many bytes is coded with others in step, a decision of each at a time; the bytes are those of ``encode``.
SMALL = 2048
_P, _M, _UP, _DOWN = (np.array(t, np.int64) for t in (P, M, UP, DOWN))
_ONES = np.array([ONES[a >> 8] if a < 0xFF00 else 8 + ONES[a & 0xFF] for a in range(0x10000)], np.int64)
_RAW = 300  # stands for a context where a decision has none


def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each node of the decoder: its context, and by decision the node that follows and the place that is complete (or -1)."""
    names = [*range(6), *(("group", k) for k in range(1, 8)), *(("tree", k, n) for k in range(1, 8) for n in range(1, 1 << k))]
    at = {name: i for i, name in enumerate(names)}
    context, after, place = np.zeros(len(names), np.int64), np.zeros((len(names), 2), np.int64), np.full((len(names), 2), -1, np.int64)
    for i, name in enumerate(names):
        for b in (0, 1):
            done, to = -1, None
            if isinstance(name, int):
                context[i] = name
                done, to = (int(name >= 3), None) if b else (-1, name + 3 if name < 3 else ("group", 1))
            elif name[0] == "group":
                context[i], k = _BASE[name[1]], name[1]
                done, to = (-1, ("tree", k, 1)) if b else (-1, ("group", k + 1)) if k < 7 else (256, None)
            else:
                _, k, n = name
                context[i], n_ = _BASE[k] + n, n << 1 | b
                done, to = (n_, None) if n_ >= 1 << k else (-1, ("tree", k, n_))
            place[i, b] = done
            after[i, b] = at[to] if done < 0 else min(done, 2)
    return context, after, place


_CONTEXT, _AFTER, _PLACE = _automaton()


def _decisions() -> tuple[np.ndarray, np.ndarray]:
    """Of each (context of the first rank, place): 2 * context + decision of all decisions, and how many."""
    codes, many = np.zeros((3, 257, 16), np.int64), np.zeros((3, 257), np.int64)
    for c in range(3):
        walks = [(c, [])]
        while walks:
            node, done = walks.pop()
            for b in (0, 1):
                here = [*done, 2 * int(_CONTEXT[node]) + b]
                if _PLACE[node, b] < 0:
                    walks.append((int(_AFTER[node, b]), here))
                else:
                    codes[c, _PLACE[node, b], : len(here)], many[c, _PLACE[node, b]] = here, len(here)
    return codes, many


_CODES, _MANY = _decisions()


def _ranked(given: list[int], places: bool) -> list[int]:
    """Places to symbols, or symbols to ``places`` (256 and -1: the end mark), as ``_Ranks`` of a small block has them.

    Frequencies fall from the first place on, so one that is not below the first goes to the front."""
    order, freq, add, out = bytearray(range(256)), [0, 0, 0, 0], 4, []
    for x in given:
        if x == 256 or x < 0:
            out.append(256 if places else 0)
            continue
        place, symbol = (order.index(x), x) if places else (x, order[x])
        out.append(place if places else symbol)
        add += add
        if add > 0x10000000:
            add >>= 24
            freq = [f >> 24 for f in freq]
        score = add
        if place < 4:
            score += freq[place]
        to = 0
        if score < freq[0]:
            to = min(place, 3)
            while score >= freq[to - 1]:
                to -= 1
        if place != to:
            del order[place]
            order.insert(to, symbol)
        del freq[place if place < 4 else 3]
        freq.insert(to, score)
    return out


def _places(block: bytes) -> list[int]:
    """Ranks of the last column, 256 for the end mark; suffixes of a small block are sorted as they are."""
    n = len(block)
    own = sorted(range(n + 1), key=[block[i:] for i in range(n + 1)].__getitem__)
    return _ranked([block[i - 1] if i else -1 for i in own], True)


def encode_many(data: list[bytes]) -> list[bytes]:
    """``encode`` of each."""
    out: list = [None if 0 < len(d) <= SMALL else encode(d) for d in data]
    small = [i for i, o in enumerate(out) if o is None]
    if not small:
        return out
    streams, raw = [], lambda v, n: [2 * _RAW + (v >> i & 1) for i in range(n - 1, -1, -1)]
    for i in small:
        place = np.array(_places(data[i]))
        first = np.concatenate([[2], np.minimum(place[:-1], 2)])
        codes = _CODES[first, place]
        streams.append(np.concatenate([raw(len(place), 24), raw(0, 1), codes[np.arange(16) < _MANY[first, place][:, None]], raw(0, 24)]))
    by_length = sorted(range(len(small)), key=lambda j: -len(streams[j]))
    lengths = np.array([len(streams[j]) for j in by_length])
    n, steps = len(small), int(lengths[0])
    todo = np.zeros((n, steps), np.int64)
    for row, j in enumerate(by_length):
        todo[row, : lengths[row]] = streams[j]
    todo = np.ascontiguousarray(todo.T)
    active = np.searchsorted(-lengths, -np.arange(steps), "left")  # rows that are longer than a step's number
    state, base = np.zeros(n * (_RAW + 1), np.uint8), np.arange(n) * (_RAW + 1)
    a, at = np.zeros(n, np.int64), np.zeros(n, np.int64)  # at: how far the top has been shifted
    wide = steps + 4  # a decision shifts by 16 bits at the most
    taken = np.zeros((n, wide), np.int64)  # what was taken from the top, in digits of 16 bits
    flat = taken.reshape(-1)
    for t in range(steps):
        m = int(active[t])
        code, own = todo[t, :m], a[:m]
        where, value = base[:m] + (code >> 1), code & 1
        s, plain = state[where].astype(np.int64), code >= 2 * _RAW
        z = own + _P[s]
        likely = (value == s & 1) & ~plain
        fast = likely & (z < 0x8000)
        z_ = np.where(plain, 0x8000 + (own >> 1), np.minimum(z, 0x6000 + (z + own >> 2)))
        less = np.where(plain, value == 1, ~likely)
        state[where] = np.where(plain | fast, s, np.where(less, _DOWN[s], np.where(own >= _M[s], _UP[s], s)))
        up = np.where(less, own + 0x10000 - z_, 0)
        rows = np.flatnonzero(less)
        part, far = 0x10000 - z_[rows], at[rows]
        digit, r = rows * wide + (far >> 4), far & 15
        flat[digit] += part >> r
        flat[digit + 1] += part << 16 - r & 0xFFFF
        shift = np.where(less, _ONES[up & 0xFFFF], 1)
        shift[fast] = 0
        a[:m] = np.where(fast, z, np.where(less, up << shift, z_ << 1) & 0xFFFF)
        at[:m] += shift
    digits = int(at.max()) // 16 + 2
    taken = taken[:, :digits]
    for k in range(digits - 1, 0, -1):
        taken[:, k - 1] += taken[:, k] >> 16
        taken[:, k] &= 0xFFFF
    for row, j in enumerate(by_length):
        bits = int(at[row])
        less_ = (int(taken[row, 0]) << 16 * (digits - 1)) + int.from_bytes(taken[row, 1:].astype(">u2").tobytes(), "big")
        end = Encoder()
        end.a, end.top, end.bits = int(a[row]), (0x10000 << bits) - (less_ >> 16 * (digits - 1) - bits), 16 + bits
        out[small[j]] = end.finish()
    return out


def decode_many(data: list[bytes]) -> list[bytes | Exception]:
    """``decode`` of each, or its error."""

    def one(d: bytes) -> bytes | Exception:
        try:
            return decode(d)
        except (ValueError, IndexError, KeyError) as e:
            return e

    out: list = [None if 2 <= len(d) <= SMALL else one(d) for d in data]
    small = [i for i, o in enumerate(out) if o is None]
    if not small:
        return out
    n, wide = len(small), max(len(data[i]) for i in small) + 8
    own = np.full((n, wide + 3), 0xFF, np.int64)
    for row, i in enumerate(small):
        own[row, : len(data[i])] = np.frombuffer(data[i], np.uint8)
    words = (own[:, :-3] << 24 | own[:, 1:-2] << 16 | own[:, 2:-1] << 8 | own[:, 3:]).reshape(-1)
    last = wide - 4

    def shifted(c: np.ndarray, at: np.ndarray, rows: np.ndarray, by: np.ndarray | int) -> np.ndarray:
        bits = words[rows * wide + np.minimum(at >> 3, last)] >> 32 - (at & 7) - by & (1 << by) - 1
        return (c << by | bits) & 0xFFFF

    def raw(a: np.ndarray, c: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        z = 0x8000 + (a >> 1)
        less = z > c
        up = np.where(less, a + 0x10000 - z, 0)
        by = np.where(less, _ONES[up & 0xFFFF], 1)
        c = shifted(np.where(less, c + 0x10000 - z, c), at, rows, by)
        return np.where(less, up << by, z << 1) & 0xFFFF, c, at + by, less.astype(np.int64)

    rows, a, c, at = np.arange(n), np.zeros(n, np.int64), own[:, 0] << 8 | own[:, 1], np.full(n, 16)
    size = np.zeros(n, np.int64)
    for _ in range(24):
        a, c, at, b = raw(a, c, at, rows)
        size = size << 1 | b
    a, c, at, b = raw(a, c, at, rows)
    fine = (size > 0) & (size <= 4 * SMALL) & (b == 0)
    ends = [x.copy() for x in (a, c, at)]
    rows = rows[fine]
    a, c, at, left = a[rows], c[rows], at[rows], size[rows]
    places = np.zeros((n, int(left.max(initial=0)) + 1), np.int16)
    state, node, have = np.zeros(n * _RAW, np.uint8), np.full(len(rows), 2), np.zeros(len(rows), np.int64)
    while len(rows):
        where = rows * _RAW + _CONTEXT[node]
        s = state[where].astype(np.int64)
        z = a + _P[s]
        fast = (z <= c) & (z <= 0x7FFF)
        z_ = np.minimum(z, 0x6000 + (z + a >> 2))
        less = ~fast & (z_ > c)
        state[where] = np.where(fast, s, np.where(less, _DOWN[s], np.where(a >= _M[s], _UP[s], s)))
        up = np.where(less, a + 0x10000 - z_, 0)
        by = np.where(less, _ONES[up & 0xFFFF], 1)
        by[fast] = 0
        c = np.where(fast, c, shifted(np.where(less, c + 0x10000 - z_, c), at, rows, by))
        a = np.where(fast, z, np.where(less, up << by, z_ << 1) & 0xFFFF)
        at = at + by
        b = s & 1 ^ less
        place = _PLACE[node, b]
        places[rows, have] = place
        have = have + (place >= 0)
        node = _AFTER[node, b]
        if (have == left).any():
            done = have == left
            for x, y in zip(ends, (a, c, at), strict=True):
                x[rows[done]] = y[done]
            rows, a, c, at, node, have, left = (x[~done] for x in (rows, a, c, at, node, have, left))
    a, c, at = ends
    more = np.zeros(n, np.int64)
    for _ in range(24):
        a, c, at, b = raw(a, c, at, np.arange(n))
        more |= b
    fine &= more == 0
    for row, i in enumerate(small):
        got = places[row, : size[row]].tolist() if fine[row] else []
        if got.count(256) != 1:
            out[i] = one(data[i])  # several blocks, large ones or errors
            continue
        out[i] = _unsort(bytearray(_ranked(got, False)), got.index(256))
    return out
