"""Export jobs on DataFrames: pages render in parallel, a document is put together from its pages in order.

Rendered pages are kept as PNG between the two steps, so the shuffle carries compressed images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.codecs import container, iff, layers, raster
from foliospark.sinks import files, markup

RENDERED = "path string, page_index int, width int, height int, dpi int, png binary, error string"


def page_parts(df: DataFrame) -> DataFrame:
    """One row a page with its own bytes and its dictionary (path, page_index, page, shared), spread over tasks.

    A page carries what it needs and no more, so the exchange moves each page once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    for i, p in enumerate(container.read(content).pages):
                        rows.append({"path": path, "page_index": i, "page": iff.emit(iff.form("DJVU", *p.chunks)), "shared": p.shared})
                except (ValueError, IndexError):
                    pass  # a file without readable pages has none to render
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("page_index", pa.int32()), ("page", pa.binary()), ("shared", pa.binary())]))

    return df.select("path", "content").mapInArrow(run, "path string, page_index int, page binary, shared binary").repartition("path", "page_index")


def render(df: DataFrame, dpi: int | None = None, **options) -> DataFrame:
    """path, page_index, size and PNG of every page; a page that fails has an error instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("page_index", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("dpi", pa.int32()), ("png", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for path, index, data, shared in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                row = {"path": path, "page_index": index, "width": None, "height": None, "dpi": None, "png": None, "error": None}
                try:
                    page = container.read(data).pages[0]
                    page.shared = shared
                    info = page.info
                    w, h = (max(1, round(info[k] * dpi / (info["dpi"] or dpi))) for k in ("width", "height")) if dpi else (None, None)
                    row |= {"width": info["width"], "height": info["height"], "dpi": info["dpi"], "png": raster.write_png(raster.render(page, w, h, **options))}
                except (ValueError, IndexError) as e:
                    row["error"] = str(e)[:300]
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return page_parts(df).mapInArrow(run, RENDERED)


def export(df: DataFrame, kind: str, dpi: int | None = None, **options) -> DataFrame:
    """path, file of each document as pdf, epub, tiff or cbz."""
    images = render(df, dpi).withColumnRenamed("path", "doc")

    def assemble(key: tuple, pages: pd.DataFrame, source: pd.DataFrame) -> pd.DataFrame:
        doc = container.read(bytes(source["content"].iloc[0]))
        own = []
        for r in pages.sort_values("page_index").itertuples():
            page = doc.pages[r.page_index]
            raw = layers.unpack(page.first("TXTz"), page.first("TXTa"))
            text, zones = layers.read_text(raw, page.info["height"]) if raw is not None else ("", [])
            notes = layers.unpack(page.first("ANTz"), page.first("ANTa"))
            try:
                areas = layers.read_annotations(notes.decode("utf-8", "ignore"))[1] if notes is not None else []
            except ValueError:
                areas = []
            links = [(a["url"], *_box(a)) for a in areas if a["url"]]
            bilevel = kind == "pdf" and page.info["rotation"] == "none" and raster.is_bilevel(page)
            ink = {"bilevel": True, "mask": raster.page_mask(page)[0]} if bilevel and r.png is not None else {}
            own.append({**page.info, **ink, "rgb": raster.read_png(bytes(r.png)) if r.png is not None else None, "zones": zones, "links": links, "paragraphs": text.split("\n")})
        build = {"pdf": lambda: files.pdf(own, doc.bookmarks, dpi or 150), "epub": lambda: files.epub(own, doc.bookmarks, **options), "tiff": lambda: files.tiff(own, **options), "cbz": lambda: files.cbz(own)}
        return pd.DataFrame({"path": [key[0]], "file": [build[kind]()]})

    return images.groupBy("doc").cogroup(df.select(F.col("path").alias("doc"), "content").groupBy("doc")).applyInPandas(assemble, "path string, file binary")


def _box(area: dict) -> tuple[int, int, int, int]:
    c = area["coords"]
    if area["kind"] in ("poly", "line"):
        xs, ys = c[::2], c[1::2]
        return min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)
    return c[0], c[1], c[2], c[3]


def text_export(df: DataFrame, kind: str, dpi: int | None = None) -> DataFrame:
    """path, text of each document as hocr, alto, json or plain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, texts = [], []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = []
                for i, page in enumerate(container.read(content).pages):
                    raw = layers.unpack(page.first("TXTz"), page.first("TXTa"))
                    text, zones = layers.read_text(raw, page.info["height"]) if raw is not None else ("", [])
                    out.append({"hocr": markup.hocr_page, "alto": markup.alto_page}[kind](zones, page.info, i, dpi) if kind in ("hocr", "alto") else markup.zones_json(zones, page.info, dpi) if kind == "json" else text if text.strip() else "No text layer")
                paths.append(path)
                texts.append({"hocr": markup.hocr, "alto": markup.alto}[kind](out) if kind in ("hocr", "alto") else "\n".join(out))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=["path", "text"])

    return df.select("path", "content").mapInArrow(run, "path string, text string")


def with_bookmarks_counted(rows: list[dict]) -> np.ndarray:
    """Descendants of each node of a list in preorder."""
    n = np.zeros(len(rows), np.int64)
    for i in range(len(rows) - 1, -1, -1):
        if rows[i]["parent_id"] is not None:
            n[rows[i]["parent_id"]] += n[i] + 1
    return n
