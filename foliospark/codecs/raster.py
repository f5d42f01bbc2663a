"""Raster kernels: composition of layers, resampling, rotation, segmentation, simple image files.

Images are height x width x channels arrays of bytes, masks arrays of 0 and 1; top row first."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from foliospark.codecs import g4, iw44, jb2
from foliospark.codecs.container import Page

STEPS = {"none": 0, "cw90": 1, "rot180": 2, "ccw90": 3}


# -- layers -----------------------------------------------------------------------
def page_mask(page: Page) -> tuple[np.ndarray, np.ndarray] | None:
    """(mask, symbol number at each pixel) of a page, with its own or shared dictionary."""
    data = page.first("Sjbz")
    if data is not None:
        own = page.first("Djbz") or page.shared
        return jb2.decode(data, jb2.decode_dictionary(own) if own else None, indexed=True)
    data = page.first("Smmr")
    if data is not None:
        bm = g4.decode(data)
        return bm, np.where(bm > 0, 0, -1).astype(np.int32)
    return None


def wavelet_layer(chunks: list[bytes], sub: int = 1, permissive: bool = False) -> np.ndarray | None:
    """A background, foreground or thumbnail; ``permissive`` stops at the first bad chunk."""
    if not chunks:
        return None
    image = iw44.Wavelet()
    for i, c in enumerate(chunks):
        try:
            image.chunk(c)
        except ValueError:
            if not permissive or i == 0:
                if permissive:
                    return None
                raise
            break
    return image.rgb(sub)


def thumbnail(page: Page) -> np.ndarray | None:
    """The small image that a page carries, or None."""
    return wavelet_layer(page.all("TH44"))


#: Layers in a photographic format that no kernel here reads.
UNREAD = ("BGjp", "FGjp")


def unread_layers(page: Page) -> list[str]:
    return [c for c in UNREAD if page.first(c) is not None and page.first(c.replace("jp", "44")) is None]


def is_bilevel(page: Page) -> bool:
    """Whether a page is a mask in black and nothing else."""
    return any(page.first(c) is not None for c in ("Sjbz", "Smmr")) and not any(page.first(c) is not None for c in ("BG44", "FG44", "FGbz", *UNREAD))


def renders_in_strips(page: Page, width: int, height: int, aa: bool = False, resampling: str = "bilinear", rotation: str = "none") -> bool:
    """Whether rows of the output come from the layers without the whole output at hand."""
    plain = resampling == "bilinear" or (page.info["width"], page.info["height"]) == (width, height)
    return plain and not aa and page.info["rotation"] == "none" and rotation == "none"


def any_ink(mask: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> bool:
    """Whether there is ink in a box with both its ends, cut off at the borders."""
    h, w = mask.shape
    return bool(mask[min(y0, h - 1) : min(y1, h - 1) + 1, min(x0, w - 1) : min(x1, w - 1) + 1].any())


def subsample_for(scale: float) -> int:
    if not 0 < scale < 1:
        return 1
    k = int(1.5 / scale)
    return 8 if k >= 8 else 4 if k >= 4 else 2 if k >= 2 else 1


def gamma_table(gamma: float) -> np.ndarray:
    power = gamma / 2.2 if gamma > 0 and np.isfinite(gamma) else 1.0
    if abs(power - 1) < 1e-4:
        return np.arange(256, dtype=np.uint8)
    return np.floor(255 * (np.arange(256) / 255) ** power + 0.5).astype(np.uint8)


# -- resampling -------------------------------------------------------------------
def _centres(n: int, size: int) -> np.ndarray:
    return (np.arange(n) + 0.5) * size / n - 0.5


def bilinear(img: np.ndarray, w: int, h: int, box: tuple[int, int, int, int] | None = None) -> np.ndarray:
    """Samples at pixel centres, with 4 fractional bits; of a box (x, y, w, h) of the output only."""
    x, y, bw, bh = box or (0, 0, w, h)

    def axis(n: int, size: int, first: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip(_centres(n, size)[first : first + count], 0, size - 1)
        first = np.floor(at).astype(int)
        return first, np.minimum(first + 1, size - 1), np.floor((at - first) * 16).astype(int)

    y0, y1, fy = axis(h, img.shape[0], y, bh)
    x0, x1, fx = axis(w, img.shape[1], x, bw)
    top_row, left = (int(y0.min()), int(x0.min())) if len(y0) and len(x0) else (0, 0)
    a = img[top_row : (int(y1.max()) if len(y1) else 0) + 1, left : (int(x1.max()) if len(x1) else 0) + 1].astype(np.int32)
    y0, y1, x0, x1 = y0 - top_row, y1 - top_row, x0 - left, x1 - left
    fx = fx.reshape(1, -1, *[1] * (img.ndim - 2))
    fy = fy.reshape(-1, 1, *[1] * (img.ndim - 2))
    top = a[y0][:, x0] * (16 - fx) + a[y0][:, x1] * fx
    low = a[y1][:, x0] * (16 - fx) + a[y1][:, x1] * fx
    return ((top * (16 - fy) + low * fy + 128) >> 8).astype(np.uint8)


def area_mean(img: np.ndarray, w: int, h: int) -> np.ndarray:
    """Rounded means of the boxes of source pixels under each output pixel."""
    def edges(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        a = np.arange(n) * size // n
        return a, np.maximum((np.arange(n) + 1) * size // n, a + 1)

    total = np.zeros((img.shape[0] + 1, img.shape[1] + 1, *img.shape[2:]), np.int64)
    total[1:, 1:] = img.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)
    (y0, y1), (x0, x1) = edges(h, img.shape[0]), edges(w, img.shape[1])
    box = total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]
    n = ((y1 - y0)[:, None] * (x1 - x0)[None, :]).reshape(h, w, *[1] * (img.ndim - 2))
    return ((box + n // 2) // n).astype(np.uint8)


def lanczos(img: np.ndarray, w: int, h: int) -> np.ndarray:
    """Separable windowed sinc of radius 3, as two matrix products."""
    def weights(n: int, size: int) -> np.ndarray:
        stretch = max(1.0, size / n)
        d = (np.arange(size)[None, :] - _centres(n, size)[:, None]) / stretch
        k = np.where(np.abs(d) < 3, np.sinc(d) * np.sinc(d / 3), 0.0)
        return k / k.sum(axis=1, keepdims=True)

    out = np.tensordot(weights(h, img.shape[0]), img.astype(np.float64), (1, 0))
    out = np.moveaxis(np.tensordot(weights(w, img.shape[1]), out, (1, 1)), 0, 1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def half(img: np.ndarray) -> np.ndarray:
    """2 x 2 means; an odd edge is repeated."""
    a = np.pad(img.astype(np.int32), [(0, img.shape[0] % 2), (0, img.shape[1] % 2), *[(0, 0)] * (img.ndim - 2)], mode="edge")
    return ((a[::2, ::2] + a[1::2, ::2] + a[::2, 1::2] + a[1::2, 1::2] + 2) >> 2).astype(np.uint8)


def turn(img: np.ndarray, rotation: str) -> np.ndarray:
    return np.rot90(img, -STEPS[rotation])


def dilate(mask: np.ndarray, passes: int = 1) -> np.ndarray:
    for _ in range(passes):
        m = mask.copy()
        m[1:] |= mask[:-1]
        m[:-1] |= mask[1:]
        m[:, 1:] |= mask[:, :-1]
        m[:, :-1] |= mask[:, 1:]
        mask = m
    return mask


def pool_any(mask: np.ndarray, block: int = 4) -> np.ndarray:
    h, w = mask.shape
    return np.pad(mask, ((0, -h % block), (0, -w % block))).reshape(-(-h // block), block, -(-w // block), block).max(axis=(1, 3))


def luma(rgb: np.ndarray) -> np.ndarray:
    c = rgb.astype(np.int32)
    return ((306 * c[..., 0] + 601 * c[..., 1] + 117 * c[..., 2]) >> 10).astype(np.uint8)


# -- rendering --------------------------------------------------------------------
def _layers(page: Page, scale: float, chunks: int | None, mask: bool, bold: int, permissive: bool):
    """Background, mask and symbol numbers of a page, each or None."""
    if not permissive and unread_layers(page):
        raise ValueError(f"unsupported layer {unread_layers(page)[0]}")
    own = page.all("BG44")
    back = wavelet_layer(own if chunks is None else own[:chunks], subsample_for(scale), permissive)
    try:
        ink = page_mask(page) if mask else None
    except ValueError:
        if not permissive:
            raise
        ink = None
    if ink is None:
        return back, None, None
    return back, dilate(ink[0], bold) if bold else ink[0], ink[1]


def _cut(page: Page, layers: tuple, w: int, h: int, box: tuple[int, int, int, int], permissive: bool) -> np.ndarray:
    """A box of the output at the mask's own size, from the parts of the layers under it."""
    back, bm, marks = layers
    x, y, bw, bh = box
    out = bilinear(back, w, h, box) if back is not None else np.full((bh, bw, 3), 255, np.uint8)
    if bm is not None:
        color = _ink_color(page, bm, marks, permissive, box)
        out = np.where(bm[y : y + bh, x : x + bw, None] > 0, color, out)
    return gamma_table(page.info["gamma"])[out]


def render(
    page: Page, width: int | None = None, height: int | None = None, *, bold: int = 0, aa: bool = False, rotation: str = "none", permissive: bool = False,
    resampling: str = "bilinear", chunks: int | None = None, mask: bool = True, region: tuple[int, int, int, int] | None = None,
) -> np.ndarray:
    """RGB of a page: ink takes its colour (palette, foreground layer or black), the rest the background or white.

    ``chunks`` takes only the first background chunks, ``region`` cuts (x, y, w, h) of the output (at the page's own size and
    upright only that part is composed); anti-aliasing halves the size; rotation adds to the page's own.  A photographic
    layer is an error unless ``permissive``."""
    info = page.info
    pw, ph = info["width"], info["height"]
    w, h = width or pw, height or ph
    scale = min(w / max(pw, 1), h / max(ph, 1))
    layers = _layers(page, scale, chunks, mask, bold, permissive)
    back, bm, marks = layers
    same = bm is None or (w, h) == (bm.shape[1], bm.shape[0])
    if region and same and renders_in_strips(page, w, h, aa, resampling, rotation):
        x, y, rw, rh = region
        box = (min(x, w), min(y, h), max(0, min(rw, w - x)), max(0, min(rh, h - y)))
        return np.ascontiguousarray(_cut(page, layers, w, h, box, permissive))
    if same:
        out = _cut(page, layers, w, h, (0, 0, w, h), permissive)
    else:
        out = bilinear(back, w, h) if back is not None else np.full((h, w, 3), 255, np.uint8)
        color, down = _ink_color(page, bm, marks, permissive), w < bm.shape[1]
        share = (area_mean if down else bilinear)(bm * np.uint8(255), w, h).astype(np.int32)[:, :, None]
        color = (area_mean if down else bilinear)(color, w, h)
        out = gamma_table(info["gamma"])[((color * share + out.astype(np.int32) * (255 - share) + 127) // 255).astype(np.uint8)]
    if aa:
        out = half(out)
    if resampling == "lanczos3" and back is not None and scale != 1 and not aa:
        full = render(page, chunks=chunks, mask=mask, bold=bold, permissive=permissive)
        out = lanczos(full, w, h)
    step = (STEPS[info["rotation"]] + STEPS[rotation]) % 4
    out = np.rot90(out, -step)
    if region:
        x, y, rw, rh = region
        out = out[y : y + rh, x : x + rw]
    return np.ascontiguousarray(out)


def render_rows(page: Page, rows: int = 64, **options):
    """Strips of a page from the top, ``rows`` high; where a page renders in strips no more than one is held beside the layers."""
    w, h = page.info["width"], page.info["height"]
    if not renders_in_strips(page, w, h) or options:
        whole = render(page, **options)
        yield from (whole[y : y + rows] for y in range(0, len(whole), rows))
        return
    layers = _layers(page, 1.0, None, True, 0, False)
    if layers[1] is not None and layers[1].shape != (h, w):
        whole = render(page)
        yield from (whole[y : y + rows] for y in range(0, h, rows))
        return
    for y in range(0, h, rows):
        yield _cut(page, layers, w, h, (0, y, w, min(rows, h - y)), False)


def _ink_color(page: Page, bm: np.ndarray, marks: np.ndarray, permissive: bool, box: tuple[int, int, int, int] | None = None) -> np.ndarray:
    """Colours of ink in a box (x, y, w, h) of the mask, or in all of it."""
    x, y, w, h = box or (0, 0, bm.shape[1], bm.shape[0])
    data = page.first("FGbz")
    if data is not None:
        colors, indices = g4.decode_palette(data, strict=False)
        table = np.array(colors or [(0, 0, 0)], np.uint8)
        index = np.array(indices if indices else [0], np.int64)
        marks = marks[y : y + h, x : x + w]
        at = np.clip(marks, 0, None)
        pick = np.where((marks >= 0) & (at < len(index)), index[np.minimum(at, len(index) - 1)], 0)
        return table[np.where((pick >= 0) & (pick < len(table)), pick, 0)]
    front = wavelet_layer(page.all("FG44"), 1, permissive)
    if front is not None:
        # A foreground layer is a grid of cells of whole pixels across, and of the plane's ratio down.
        cell = -(-bm.shape[1] // front.shape[1])
        ys = np.minimum(np.arange(y, y + h) * front.shape[0] // bm.shape[0], front.shape[0] - 1)
        xs = np.minimum(np.arange(x, x + w) // cell, front.shape[1] - 1)
        return front[ys][:, xs]
    return np.zeros((h, w, 3), np.uint8)


def progressive(page: Page, **options) -> list[np.ndarray]:
    """One frame a background chunk; a single one for a page without."""
    return [render(page, chunks=k, **options) for k in range(1, len(page.all("BG44")) + 1)] or [render(page, **options)]


# -- segmentation -----------------------------------------------------------------
def sauvola(gray: np.ndarray, window: int = 15, k: float = 0.34) -> np.ndarray:
    """Ink below m (1 + k (s / 128 - 1)) of a square window cut off at the borders."""
    window, k = max(3, window), 0.34 if not np.isfinite(k) else min(max(k, 0.0), 1.0)
    r, (h, w) = window // 2, gray.shape
    total = np.zeros((2, h + 1, w + 1))
    g = gray.astype(np.float64)
    total[:, 1:, 1:] = np.stack([g, g * g]).cumsum(axis=1).cumsum(axis=2)
    y0, y1 = np.maximum(np.arange(h) - r, 0), np.minimum(np.arange(h) + r + 1, h)
    x0, x1 = np.maximum(np.arange(w) - r, 0), np.minimum(np.arange(w) + r + 1, w)
    n = (y1 - y0)[:, None] * (x1 - x0)[None, :]
    m, q = (total[:, y1][:, :, x1] - total[:, y0][:, :, x1] - total[:, y1][:, :, x0] + total[:, y0][:, :, x0]) / n
    return (g < m * (1 + k * (np.sqrt(np.maximum(q - m * m, 0)) / 128 - 1))).astype(np.uint8)


def segment(rgb: np.ndarray, threshold: int = 128, subsample: int = 12, method: str = "fixed", window: int = 15, k: float = 0.34, inpaint: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(mask, background of block means without ink); blocks full of ink take the nearest others' mean."""
    gray = luma(rgb)
    mask = sauvola(gray, window, k) if method == "sauvola" else (gray < threshold).astype(np.uint8)
    h, w = mask.shape
    bh, bw = -(-h // subsample), -(-w // subsample)
    pad = ((0, bh * subsample - h), (0, bw * subsample - w))
    free = np.pad(1 - mask.astype(np.int64), pad)
    n = free.reshape(bh, subsample, bw, subsample).sum(axis=(1, 3))
    c = np.pad(rgb.astype(np.int64), (*pad, (0, 0))) * free[:, :, None]
    total = c.reshape(bh, subsample, bw, subsample, 3).sum(axis=(1, 3))
    mean = total // np.maximum(n, 1)[:, :, None]
    known = n > 0
    if not known.any():
        return mask, np.full((bh, bw, 3), 255, np.uint8)
    if inpaint and not known.all():  # pixels without ink of the nearest ring of blocks that has any
        sums = np.zeros((bh + 1, bw + 1, 4), np.int64)
        sums[1:, 1:] = np.concatenate([total, n[:, :, None]], axis=2).cumsum(axis=0).cumsum(axis=1)
        ys, xs = np.nonzero(~known)
        for r in range(1, max(bh, bw) + 1):
            y0, y1, x0, x1 = np.maximum(ys - r, 0), np.minimum(ys + r + 1, bh), np.maximum(xs - r, 0), np.minimum(xs + r + 1, bw)
            box = sums[y1, x1] - sums[y0, x1] - sums[y1, x0] + sums[y0, x0]  # nothing lies within the ring
            hit = box[:, 3] > 0
            mean[ys[hit], xs[hit]] = box[hit, :3] // box[hit, 3:]
            ys, xs = ys[~hit], xs[~hit]
            if not len(ys):
                break
    return mask, mean.astype(np.uint8)


# -- image files ------------------------------------------------------------------
def write_png(img: np.ndarray) -> bytes:
    h, w = img.shape[:2]
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[1 if img.ndim == 2 else img.shape[2]]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), img.reshape(h, -1)], axis=1).tobytes()

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """RGB of an 8-bit gray, gray-alpha, RGB or RGBA file without interlace; others are errors."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("png: bad magic")
    at, body, head = 8, b"", None
    while at + 8 <= len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif name == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        raise ValueError("png: unsupported")
    w, h, channels = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h + 1, w + 1, channels), np.int32)
    for y in range(h):
        kind, row = int(raw[y, 0]), raw[y, 1:].reshape(w, channels).astype(np.int32)
        if kind == 0:
            out[y + 1, 1:] = row
        elif kind == 2:
            out[y + 1, 1:] = (row + out[y, 1:]) & 255
        elif kind == 1:
            out[y + 1, 1:] = row.cumsum(axis=0) & 255
        else:
            for x in range(1, w + 1):
                a, b, c = out[y + 1, x - 1], out[y, x], out[y, x - 1]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    p = a + b - c
                    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                    guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
                out[y + 1, x] = (row[x - 1] + guess) & 255
    img = out[1:, 1:].astype(np.uint8)
    return np.repeat(img[:, :, :1], 3, axis=2) if channels < 3 else img[:, :, :3]


def write_pbm(mask: np.ndarray) -> bytes:
    return f"P4\n{mask.shape[1]} {mask.shape[0]}\n".encode() + np.packbits(mask, axis=1).tobytes()


def write_ppm(rgb: np.ndarray) -> bytes:
    return f"P6\n{rgb.shape[1]} {rgb.shape[0]}\n255\n".encode() + rgb.tobytes()


# -- pages ------------------------------------------------------------------------
def foreground_palette(rgb: np.ndarray, mask: np.ndarray, marks: np.ndarray) -> bytes | None:
    """Mean colour of each symbol, equal colours once in order of their first symbol; None if all are black."""
    n = int(marks.max()) + 1
    if n <= 0:
        return None
    own = marks[mask > 0]
    ok = own >= 0
    count = np.maximum(np.bincount(own[ok], minlength=n), 1)
    mean = np.stack([np.bincount(own[ok], weights=rgb[..., c][mask > 0][ok], minlength=n) // count for c in range(3)], axis=1).astype(int)
    if not mean.any():
        return None
    colors: dict[tuple, int] = {}
    indices = [colors.setdefault(tuple(c), len(colors)) for c in mean.tolist()]
    return g4.encode_palette(list(colors), indices)


def encode_page(rgb: np.ndarray | None = None, mask: np.ndarray | None = None, profile: str = "quality", dpi: int = 300, shared: list[np.ndarray] | None = None, include: str | None = None, **segmentation):
    """A page form: ``lossless`` (mask only), ``quality`` (mask and background) or ``archival`` (and ink colours)."""
    from foliospark.codecs.container import write_info
    from foliospark.codecs.iff import Chunk, form

    if profile == "lossless" and mask is None:
        if rgb is None:
            raise ValueError("nothing to encode")
        mask = (luma(rgb) < segmentation.get("threshold", 128)).astype(np.uint8)
    if profile != "lossless" and rgb is None:
        raise ValueError(f"{profile} needs an image")
    back = None
    if profile != "lossless":
        mask, back = segment(rgb, **segmentation)
    h, w = mask.shape
    own = [Chunk("INFO", write_info(w, h, dpi))]
    if include:
        own.append(Chunk("INCL", include.encode()))
    data = jb2.encode_symbols(mask, shared)
    own.append(Chunk("Sjbz", data))
    if back is not None:
        own += [Chunk("BG44", c) for c in iw44.encode(back)]
    if profile == "archival":
        palette = foreground_palette(rgb, mask, jb2.decode(data, shared, indexed=True)[1])
        if palette:
            own.append(Chunk("FGbz", palette))
    return form("DJVU", *own)


def encode_book(masks: list[np.ndarray], threshold: int = 2, dpi: int = 300) -> bytes:
    """Bilevel pages with the symbols that ``threshold`` pages share in one dictionary."""
    from foliospark.codecs.container import bundle
    from foliospark.codecs.iff import Chunk, form

    seen: dict[tuple, list] = {}
    for p, mask in enumerate(masks):
        for i, (_, _, part) in enumerate(jb2.components(mask)):
            seen.setdefault((part.shape, part.tobytes()), [part, set(), (p, i)])[1].add(p)
    shared = [x[0] for x in sorted(seen.values(), key=lambda x: x[2]) if threshold >= 2 and len(x[1]) >= threshold]
    name = "dict0000.iff"
    parts = [("shared", name, form("DJVI", Chunk("Djbz", jb2.encode_dictionary(shared))))] if shared else []
    parts += [("page", f"p{i:04d}.djvu", encode_page(mask=m, profile="lossless", dpi=dpi, shared=shared, include=name if shared else None)) for i, m in enumerate(masks)]
    return bundle(parts)
