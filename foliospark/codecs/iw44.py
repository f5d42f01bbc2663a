"""Wavelet layers: progressive bit planes of blocks, lifting transforms, colour planes.

One walk over a slice serves both directions: the state after each decision is what a decoder
knows; an encoder takes the decisions from the true coefficients.  The transforms are array operations
on the lattice of each scale.
"""

from __future__ import annotations

import numpy as np

from foliospark.codecs.zp import Decoder, Encoder

# Fixed values of the format: buckets of each band, first steps of band 0's coefficients and of the others.
BANDS = [(0, 0), (1, 1), (2, 2), (3, 3), (4, 7), (8, 11), (12, 15), (16, 31), (32, 47), (48, 63)]
LOW_STEPS = [0x4000, 0x8000, 0x8000, 0x10000, *[0x10000] * 4, *[0x10000] * 4, *[0x20000] * 4]
HIGH_STEPS = [0, 0x20000, 0x20000, 0x40000, 0x40000, 0x40000, 0x80000, 0x40000, 0x40000, 0x80000]
MOST_PIXELS = 64 << 20
ZERO, ACTIVE, UNKNOWN = 1, 2, 8
_I = np.arange(1024)
ROW = sum(((_I >> (2 * k + 1)) & 1) << (4 - k) for k in range(5))
COL = sum(((_I >> (2 * k)) & 1) << (4 - k) for k in range(5))


class Plane:
    def __init__(self, width: int, height: int):
        self.width, self.height = width, height
        self.across, self.down = -(-width // 32), -(-height // 32)
        self.blocks = [[0] * 1024 for _ in range(self.across * self.down)]
        self.low, self.high, self.band = list(LOW_STEPS), list(HIGH_STEPS), 0
        self.block_ctx, self.bucket_ctx, self.start_ctx, self.more_ctx = bytearray(1), bytearray(80), bytearray(16), bytearray(1)

    def slice(self, zp, true: list[list[int]] | None = None) -> None:
        """One band of every block: read if ``true`` is None, else written."""
        band = self.band
        first, last = BANDS[band]
        live = [s if 0 < s < 0x8000 else 0 for s in (self.low if band == 0 else [self.high[band]] * 16)]
        if any(live):
            for n, own in enumerate(self.blocks):
                self._block(zp, own, true[n] if true is not None else None, band, first, last, live)
        if band == 0:
            self.low = [s >> 1 for s in self.low]
        self.high[band] >>= 1
        self.band = (band + 1) % 10

    def _block(self, zp, own: list[int], want: list[int] | None, band: int, first: int, last: int, live: list[int]) -> None:
        states, whole = [], 0
        for i in range(first, last + 1):
            flags = 0
            for j, v in enumerate(own[i << 4 : (i << 4) + 16]):
                flags |= ZERO if not live[j] else ACTIVE if v else UNKNOWN
            states.append(flags)
            whole |= flags

        def new_in(i: int) -> bool:
            return any(live[j] and not own[i << 4 | j] and abs(want[i << 4 | j]) >= live[j] for j in range(16))

        bit = zp.bit
        was = {i: [v != 0 for v in own[i << 4 : (i << 4) + 16]] for i, f in zip(range(first, last + 1), states, strict=True) if f & ACTIVE}
        go = last - first < 15 or whole & ACTIVE
        if not go and whole & UNKNOWN:
            if want is None:
                go = bit(self.block_ctx, 0)
            else:
                go = int(any(new_in(i) for i in range(first, last + 1)))
                bit(go, self.block_ctx, 0)
        if go:
            fresh = []
            for i, f in zip(range(first, last + 1), states, strict=True):
                if not f & UNKNOWN:
                    continue
                c = 8 * band
                if band:
                    c += min(3, sum(v != 0 for v in own[4 * i : 4 * i + 4]))
                if whole & ACTIVE:
                    c |= 4
                if want is None:
                    yes = bit(self.bucket_ctx, c)
                else:
                    yes = int(new_in(i))
                    bit(yes, self.bucket_ctx, c)
                if yes:
                    fresh.append((i, 8 if f & ACTIVE else 0))
            for i, c in fresh:
                at = i << 4
                open_ = [j for j in range(16) if live[j] and not own[at + j]]
                left = len(open_)
                for j in open_:
                    s = live[j]
                    if want is None:
                        yes = bit(self.start_ctx, c + min(left, 7))
                    else:
                        yes = int(abs(want[at + j]) >= s)
                        bit(yes, self.start_ctx, c + min(left, 7))
                    if yes:
                        if want is None:
                            minus = zp.raw_wavelet()
                        else:
                            minus = int(want[at + j] < 0)
                            zp.raw_wavelet(minus)
                        v = s + (s >> 1) - (s >> 3)
                        own[at + j] = -v if minus else v
                        left = 0
                    left = max(left - 1, 0)
        for i, active in was.items():
            at = i << 4
            for j in range(16):
                if active[j] and live[j]:
                    s, v = live[j], own[at + j]
                    size = abs(v)
                    near = size <= 3 * s
                    middle = size + (s >> 2) if near else size
                    if want is None:
                        up = bit(self.more_ctx, 0) if near else zp.raw_wavelet()
                    else:
                        up = int(abs(want[at + j]) >= middle)
                        if near:
                            bit(up, self.more_ctx, 0)
                        else:
                            zp.raw_wavelet(up)
                    size = middle + (s >> 1) if up else middle - s + (s >> 1)
                    own[at + j] = -size if v < 0 else size

    def spread(self) -> np.ndarray:
        """Coefficients at their places."""
        b = np.array(self.blocks, np.int32).reshape(self.down, self.across, 1024)
        tile = np.zeros((self.down, self.across, 32, 32), np.int32)
        tile[:, :, ROW, COL] = b
        return tile.transpose(0, 2, 1, 3).reshape(self.down * 32, self.across * 32)

    def samples(self, sub: int = 1) -> np.ndarray:
        data = self.spread()
        s = 16
        while s >= sub:
            part = data[: self.height : s, : self.width : s]
            _lift(part, -1)
            _lift(part.T, -1)
            s //= 2
        return data[: self.height : sub, : self.width : sub]


def _lift(a: np.ndarray, sign: int) -> None:
    """One scale along the first axis, in place: sign -1 undoes what sign 1 does."""
    n = len(a)
    even, odd = a[0::2], a[1::2]

    def update() -> None:
        o = np.zeros((len(odd) + 4, *a.shape[1:]), np.int32)
        o[2 : 2 + len(odd)] = odd
        e = np.arange(len(even))
        near, far = o[e + 1] + o[e + 2], o[e] + o[e + 3]
        even[...] += sign * ((9 * near - far + 16) >> 5)

    def predict() -> None:
        if not len(odd):
            return
        k = np.arange(1, n, 2)
        p = even[: len(odd)]
        guess = p.copy()
        inner = (k >= 3) & (k + 3 <= n - 1)
        edge = ~inner & (k < n - 1)
        i = np.flatnonzero(inner)
        guess[i] = (9 * (even[i] + even[i + 1]) - (even[i - 1] + even[i + 2]) + 8) >> 4
        i = np.flatnonzero(edge)
        guess[i] = (even[i] + even[i + 1] + 1) >> 1
        odd[...] -= sign * guess

    for step in (update, predict) if sign < 0 else (predict, update):
        step()


def transform(samples: np.ndarray) -> np.ndarray:
    """Coefficients of a plane, padded to whole blocks."""
    h, w = samples.shape
    data = np.zeros((-(-h // 32) * 32, -(-w // 32) * 32), np.int32)
    data[:h, :w] = samples
    for s in (1, 2, 4, 8, 16):
        part = data[:h:s, :w:s]
        _lift(part.T, 1)
        _lift(part, 1)
    return data


def _blocks(data: np.ndarray) -> list[list[int]]:
    down, across = data.shape[0] // 32, data.shape[1] // 32
    tile = data.reshape(down, 32, across, 32).transpose(0, 2, 1, 3)
    return tile[:, :, ROW, COL].reshape(down * across, 1024).tolist()


def _normal(v: np.ndarray) -> np.ndarray:
    return np.clip((v + 32) >> 6, -128, 127)


class Wavelet:
    """A progressive image: chunks refine it one after the other."""

    def __init__(self) -> None:
        self.planes: list[Plane] = []
        self.done = 0

    def chunk(self, data: bytes) -> None:
        if len(data) < 2:
            raise ValueError("iw44: chunk too short")
        at = 2
        if data[0] == 0:
            if len(data) < 9:
                raise ValueError("iw44: header too short")
            minor, self.width, self.height = data[3], int.from_bytes(data[4:6], "big"), int.from_bytes(data[6:8], "big")
            if not self.width or not self.height:
                raise ValueError("iw44: no pixels")
            if self.width * self.height > MOST_PIXELS:
                raise ValueError("iw44: too large")
            self.gray = bool(data[2] & 0x80)
            self.delay = data[8] & 127 if minor >= 2 else 0
            self.half = not self.gray and minor >= 2 and not data[8] & 0x80
            size = (-(-self.width // 2), -(-self.height // 2)) if self.half else (self.width, self.height)
            self.planes = [Plane(self.width, self.height)] + ([] if self.gray else [Plane(*size), Plane(*size)])
            self.done, at = 0, 9
        elif not self.planes:
            raise ValueError("iw44: first chunk missing")
        zp = Decoder(data[at:])
        for _ in range(data[1]):
            self.done += 1
            self.planes[0].slice(zp)
            if not self.gray and self.done > self.delay:
                self.planes[1].slice(zp)
                self.planes[2].slice(zp)
            if zp.exhausted:
                break

    def rgb(self, sub: int = 1) -> np.ndarray:
        """height x width x 3 bytes, top row first, at every ``sub``-th sample."""
        if not self.planes:
            raise ValueError("iw44: nothing decoded")
        y = _normal(self.planes[0].samples(sub))
        if self.gray:
            out = np.repeat((127 - y)[:, :, None], 3, axis=2)
        else:
            if self.half:
                cb, cr = (np.repeat(np.repeat(_normal(p.samples(max(1, sub // 2))), 2 if sub == 1 else 1, axis=0), 2 if sub == 1 else 1, axis=1)[: y.shape[0], : y.shape[1]] for p in self.planes[1:])
            else:
                cb, cr = (_normal(p.samples(sub)) for p in self.planes[1:])
            t1, t2 = cr + (cr >> 1), y + 128 - (cb >> 2)
            out = np.stack([y + 128 + t1, t2 - (t1 >> 1), t2 + 2 * cb], axis=2)
        return np.clip(out, 0, 255).astype(np.uint8)[::-1]


def decode(chunks: list[bytes], sub: int = 1) -> np.ndarray:
    image = Wavelet()
    for c in chunks:
        image.chunk(c)
    return image.rgb(sub)


#: Luma and chroma of red, green, blue: the inverse of what a decoder does.
TO_PLANES = np.linalg.inv(np.array([[1, 0, 1.5], [1, -0.25, -0.75], [1, 1.75, 0]]))


def encode(rgb: np.ndarray, slices: int = 100, a_chunk: int = 10, gray: bool = False, delay: int = 0) -> list[bytes]:
    """Chunks of ``a_chunk`` slices of an image (height x width x 3, or x 1 levels for gray)."""
    flipped = rgb[::-1].astype(np.float64)
    if gray:
        levels = flipped.reshape(*flipped.shape[:2], -1)[:, :, 0]
        planes = [((127 - levels) * 64).astype(np.int32)]
    else:
        ycc = flipped @ TO_PLANES.T
        ycc[:, :, 0] -= 128
        planes = [np.rint(ycc[:, :, i] * 64).astype(np.int32) for i in range(3)]
    height, width = planes[0].shape
    true = [_blocks(transform(p)) for p in planes]
    state = [Plane(width, height) for _ in planes]
    out, done = [], 0
    while done < slices:
        n, zp = min(a_chunk, slices - done), Encoder()
        for _ in range(n):
            done += 1
            state[0].slice(zp, true[0])
            if not gray and done > delay:
                state[1].slice(zp, true[1])
                state[2].slice(zp, true[2])
        head = bytes([len(out), n])
        if not out:
            head += bytes([0x81 if gray else 1, 2]) + width.to_bytes(2, "big") + height.to_bytes(2, "big") + bytes([0x80 | delay])
        out.append(head + zp.finish())
    return out
