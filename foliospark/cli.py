"""Single files from the command line: python -m foliospark.cli COMMAND ...

These verbs use the kernels directly; for many files use the tables and jobs of the package."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from foliospark.codecs import bzz, container, iff, layers, raster
from foliospark.operators import recognition
from foliospark.sinks import files, markup


def _document(path: str) -> container.Document:
    p = Path(path)
    return container.read(p.read_bytes(), lambda name: (p.parent / Path(name).name).read_bytes())


def _layer(page: container.Page) -> tuple[str, list[dict]]:
    raw = layers.unpack(page.first("TXTz"), page.first("TXTa"))
    return layers.read_text(raw, page.info["height"]) if raw is not None else ("", [])


def _put(out: str | None, data: bytes | str) -> None:
    if out:
        Path(out).write_bytes(data.encode() if isinstance(data, str) else data)
    elif isinstance(data, str):
        print(data)
    else:
        sys.stdout.buffer.write(data)


def _page_dicts(doc: container.Document, dpi: int | None, rotation: str) -> list[dict]:
    out = []
    for p in doc.pages:
        size = [max(1, round(p.info[k] * dpi / (p.info["dpi"] or dpi))) for k in ("width", "height")] if dpi else [None, None]
        mask = raster.page_mask(p)
        plain = rotation == p.info["rotation"] == "none" and raster.is_bilevel(p)
        out.append({**p.info, "bilevel": plain, "rgb": raster.render(p, *size, rotation=rotation, permissive=True), "zones": _layer(p)[1], "mask": mask[0] if mask else None})
    return out


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="foliospark")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple) -> None:
        p = sub.add_parser(name)
        for flags, options in args:
            p.add_argument(*flags, **options)

    out = (("-o", "--output"), {})
    file = (("file",), {})
    command("info", file, (("--json",), {"action": "store_true"}), (("--count",), {"action": "store_true"}))
    command("text", file, out, (("--page",), {"type": int}), (("--all",), {"action": "store_true"}), (("--format",), {"choices": ["plain", "hocr", "alto", "json"], "default": "plain"}))
    command("render", file, out, (("--page",), {"type": int, "default": 1}), (("--dpi",), {"type": int}), (("--rotate",), {"default": "none", "choices": list(raster.STEPS)}), (("--format",), {"choices": ["png", "pdf", "epub", "tiff", "cbz"], "default": "png"}), (("--layer",), {"choices": ["mask", "foreground", "background"]}))
    command("merge", (("files",), {"nargs": "+"}), out)
    command("split", file, out, (("--pages",), {"required": True}))
    command("ocr", file, out, (("--backend",), {"default": "tesseract"}), (("--lang",), {"default": "eng"}), (("--dpi",), {"type": int, "default": 300}))
    command("bzz-encode", file, out)
    command("bzz-decode", file, out)
    command("encode", file, out, (("--quality",), {"choices": ["lossless", "quality", "archival"], "default": "lossless"}), (("--dpi",), {"type": int, "default": 300}))
    a = top.parse_args(argv)
    try:
        return _run(a)
    except (ValueError, IndexError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(a: argparse.Namespace) -> int:
    if a.command in ("bzz-encode", "bzz-decode"):
        _put(a.output, (bzz.encode if a.command == "bzz-encode" else bzz.decode)(Path(a.file).read_bytes()))
    elif a.command == "ocr":
        _put(a.output, recognition.recognize_document(Path(a.file).read_bytes(), recognition.backend(a.backend), a.lang, a.dpi))
    elif a.command == "merge":
        _put(a.output, container.merge([Path(f).read_bytes() for f in a.files]))
    elif a.command == "split":
        first, _, last = a.pages.partition("-")
        if not (first.isdigit() and last.isdigit() and 1 <= int(first) <= int(last)):
            raise ValueError("pages are N-M, counted from 1")
        _put(a.output, container.split(Path(a.file).read_bytes(), int(first) - 1, int(last)))
    elif a.command == "encode":
        source = Path(a.file)
        names = sorted(p for p in source.iterdir() if p.suffix.lower() == ".png") if source.is_dir() else [source]
        if not names:
            raise ValueError("no PNG files")
        images = [raster.read_png(p.read_bytes()) for p in names]
        if source.is_dir() and a.quality == "lossless":
            _put(a.output, raster.encode_book([(raster.luma(i) < 128).astype("uint8") for i in images], dpi=a.dpi))
        elif source.is_dir():
            _put(a.output, container.bundle([("page", f"p{n:04d}.djvu", raster.encode_page(i, profile=a.quality, dpi=a.dpi)) for n, i in enumerate(images)]))
        else:
            _put(a.output, iff.emit(raster.encode_page(images[0], profile=a.quality, dpi=a.dpi)))
    else:
        doc = _document(a.file)
        if a.command == "info":
            rows = [{"page": i + 1, **p.info} for i, p in enumerate(doc.pages)]
            _put(None, str(len(rows)) if a.count else json.dumps(rows) if a.json else "\n".join(f"page {r['page']}: {r['width']}x{r['height']} @ {r['dpi']} dpi" for r in rows))
        elif a.command == "text":
            chosen = list(enumerate(doc.pages)) if a.all or a.page is None else [(a.page - 1, doc.pages[a.page - 1])]
            if a.format in ("hocr", "alto"):
                page, whole = (markup.hocr_page, markup.hocr) if a.format == "hocr" else (markup.alto_page, markup.alto)
                _put(a.output, whole([page(_layer(p)[1], p.info, i) for i, p in chosen]))
            elif a.format == "json":
                _put(a.output, "\n".join(markup.zones_json(_layer(p)[1], p.info) for _, p in chosen))
            else:
                _put(a.output, "\n".join(t if (t := _layer(p)[0]).strip() else "No text layer" for _, p in chosen))
        elif a.format != "png":
            pages = _page_dicts(doc, a.dpi, a.rotate)
            _put(a.output, {"pdf": lambda: files.pdf(pages, doc.bookmarks, a.dpi or 150), "epub": lambda: files.epub(pages, doc.bookmarks), "tiff": lambda: files.tiff(pages), "cbz": lambda: files.cbz(pages)}[a.format]())
        else:
            page = doc.pages[a.page - 1]
            if a.layer == "mask":
                got = raster.page_mask(page)
                img = None if got is None else (1 - got[0]) * 255
            elif a.layer:
                img = raster.wavelet_layer(page.all("FG44" if a.layer == "foreground" else "BG44"))
            else:
                size = [max(1, round(page.info[k] * a.dpi / (page.info["dpi"] or a.dpi))) for k in ("width", "height")] if a.dpi else [None, None]
                img = raster.render(page, *size, rotation=a.rotate)
            if img is None:
                raise ValueError(f"page has no {a.layer}")
            _put(a.output, raster.write_png(img))
    return 0


if __name__ == "__main__":
    sys.exit(main())
