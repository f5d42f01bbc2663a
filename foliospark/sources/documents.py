"""Files of documents as tables: chunks, components, pages, text, zones, bookmarks, annotations, metadata, symbols.

Every reader is one pass over (path, content) rows; a file or layer that cannot be read gives a row
with an ``error`` and nothing else stops.  Files are split over tasks by the binary reader,
rows of one file stay in their task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliospark.codecs import bzz, container, iff, jb2, layers

CHUNKS = "path string, chunk_path array<int>, parent_path array<int>, form_type string, chunk_id string, ordinal int, offset long, length long, data binary, error string"
COMPONENTS = "path string, comp_idx int, comp_type string, comp_id string, offset long, size long, bundled boolean, synthetic boolean, error string"
PAGES = "path string, page_index int, comp_id string, width int, height int, dpi int, gamma float, rotation string, incl_name string, byte_start long, byte_end long, n_background int, error string"
TEXTS = "path string, page_index int, text string, error string"
ZONES = "path string, page_index int, zone_id int, parent_id int, kind string, x long, y_tl long, w long, h long, text string, error string"
BOOKMARKS = "path string, node_id int, parent_id int, depth int, sibling_ord int, title string, url string, error string"
ANNOTATIONS = "path string, page_index int, background array<int>, zoom long, mode string, error string"
MAPAREAS = "path string, page_index int, ord int, url string, description string, kind string, coords array<long>, border string, highlight array<int>, error string"
METADATA = "path string, title string, author string, subject string, publisher string, year string, keywords string, extra array<struct<key:string,value:string>>, error string"
SYMBOLS = "path string, dict_id string, sym_idx int, w int, h int, data binary, error string"


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")


def rows_of(df: DataFrame, schema: str, read: Callable[..., Iterator[dict]], also: tuple[str, ...] = ()) -> DataFrame:
    """``read`` on each (path, content, and the columns ``also``); an exception becomes the row's error."""
    types = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(types)
        for batch in batches:
            for path, content, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = []
                try:
                    out += [{"path": path} | r for r in read(path, content, *more)]
                except (ValueError, IndexError, KeyError) as e:
                    out.append({"path": path, "error": f"{type(e).__name__}: {e}"[:300]})
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in arrow.names} for r in out], schema=arrow)

    return df.select("path", "content", *also).mapInArrow(run, types)


def chunks(df: DataFrame, depth: int = 16) -> DataFrame:
    def read(_: str, data: bytes) -> Iterator[dict]:
        for p, kind, c in iff.walk(iff.parse(data, depth)):
            yield {"chunk_path": list(p), "parent_path": list(p[:-1]), "form_type": c.kind or kind, "chunk_id": c.id, "ordinal": p[-1], "offset": c.offset, "length": c.length, "data": None if c.kind else c.data}

    return rows_of(df, CHUNKS, read)


def components(df: DataFrame) -> DataFrame:
    def read(_: str, data: bytes) -> Iterator[dict]:
        head = iff.parse(data).find("DIRM")
        if head is not None:
            d = container.read_directory(head.data)
            for i, e in enumerate(d.entries):
                yield {"comp_idx": i, "comp_type": e.kind, "comp_id": e.id, "offset": e.offset, "size": e.size, "bundled": d.bundled, "synthetic": d.synthetic}

    return rows_of(df, COMPONENTS, read)


def pages(df: DataFrame) -> DataFrame:
    def read(_: str, data: bytes) -> Iterator[dict]:
        for i, p in enumerate(container.read(data).pages):
            incl = p.first("INCL")
            yield {"page_index": i, "comp_id": p.id, **p.info, "incl_name": incl.decode("utf-8", "replace").rstrip() if incl is not None else None, "byte_start": p.span[0], "byte_end": p.span[1], "n_background": len(p.all("BG44"))}

    return rows_of(df, PAGES, read)


def _layer(p: container.Page, base: str) -> bytes | None:
    return layers.unpack(p.first(base + "z"), p.first(base + "a"))


def texts(df: DataFrame) -> DataFrame:
    def read(_: str, data: bytes) -> Iterator[dict]:
        for i, p in enumerate(container.read(data).pages):
            raw = _layer(p, "TXT")
            if raw is not None:
                yield {"page_index": i, "text": layers.read_text(raw, p.info["height"])[0]}

    return rows_of(df, TEXTS, read)


def zones(df: DataFrame) -> DataFrame:
    def read(_: str, data: bytes) -> Iterator[dict]:
        for i, p in enumerate(container.read(data).pages):
            raw = _layer(p, "TXT")
            for z in layers.read_text(raw, p.info["height"])[1] if raw is not None else ():
                yield {"page_index": i, **{k: z[k] for k in ("zone_id", "parent_id", "kind", "x", "w", "h", "text")}, "y_tl": z["y"]}

    return rows_of(df, ZONES, read)


def bookmarks(df: DataFrame) -> DataFrame:
    return rows_of(df, BOOKMARKS, lambda _, data: iter(container.read(data).bookmarks))


def volume_bookmarks(df: DataFrame) -> DataFrame:
    """Bookmarks of documents whose trees are kept in volumes (path, content, start, chain, first; see
    ``container.bookmark_volumes``), a row each, numbered as in the whole tree."""

    def read(_: str, data: bytes, *place) -> Iterator[dict]:
        return container.volume_rows(container.read(data).bookmarks, *place)

    return rows_of(df, BOOKMARKS, read, ("start", "chain", "first"))


def annotations(df: DataFrame) -> DataFrame:
    def read(_: str, data: bytes) -> Iterator[dict]:
        for i, p in enumerate(container.read(data).pages):
            raw = _layer(p, "ANT")
            if raw is not None:
                page, _areas = layers.read_annotations(raw.decode("utf-8", "ignore"))
                yield {"page_index": i, "background": list(page["background"]) if page["background"] else None, "zoom": page["zoom"], "mode": page["mode"]}

    return rows_of(df, ANNOTATIONS, read)


def mapareas(df: DataFrame) -> DataFrame:
    def read(_: str, data: bytes) -> Iterator[dict]:
        for i, p in enumerate(container.read(data).pages):
            raw = _layer(p, "ANT")
            for n, a in enumerate(layers.read_annotations(raw.decode("utf-8", "ignore"))[1] if raw is not None else ()):
                yield {"page_index": i, "ord": n, **a, "highlight": list(a["highlight"]) if a["highlight"] else None}

    return rows_of(df, MAPAREAS, read)


def annotated_areas(df: DataFrame, most: int = 4096) -> DataFrame:
    """Map areas with the settings of their page, in one reading: ``mapareas`` joined with ``annotations`` on path and page.

    The layers of up to ``most`` files are unpacked together."""
    types = StructType.fromDDL(f"{MAPAREAS.removesuffix(', error string')}, background array<int>, zoom long, mode string, error string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(types)
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in arrow.names} for r in _annotated(*(c.to_pylist() for c in part.columns))], schema=arrow)

    return df.select("path", "content").mapInArrow(run, types)


def _annotated(paths: list[str], contents: list[bytes]) -> Iterator[dict]:
    books: list = []
    for content in contents:
        try:
            books.append([(p.first("ANTz"), p.first("ANTa")) for p in container.read(content).pages])
        except (ValueError, IndexError, KeyError) as e:
            books.append(e)
    unpacked = iter(bzz.decode_many([z for b in books if isinstance(b, list) for z, _ in b if z]))
    for path, book in zip(paths, books, strict=True):
        # A packed layer wins, even an empty one, which means nothing.
        raws = [next(unpacked) if z else None if z is not None else a for z, a in book] if isinstance(book, list) else [book]
        out = []
        try:
            for i, raw in enumerate(raws):
                if isinstance(raw, Exception):
                    raise raw
                page, areas = layers.read_annotations(raw.decode("utf-8", "ignore")) if raw is not None else ({}, [])
                for n, a in enumerate(areas):
                    both = {**page, **a}
                    out.append({"path": path, "page_index": i, "ord": n, **both, **{c: list(both[c]) if both[c] else None for c in ("background", "highlight")}})
        except (ValueError, IndexError, KeyError) as e:
            out.append({"path": path, "error": f"{type(e).__name__}: {e}"[:300]})
        yield from out


def hyperlinks(df: DataFrame) -> DataFrame:
    return mapareas(df).where("url <> ''")


def metadata(df: DataFrame) -> DataFrame:
    def read(_: str, data: bytes) -> Iterator[dict]:
        doc = container.read(data)
        first = {}
        for c in [*doc.chunks, *[c for p in doc.pages for c in p.chunks]]:
            first.setdefault(c.id, c.data)
        raw = layers.unpack(first.get("METz"), first.get("METa"))
        if raw is not None:
            m = layers.read_metadata(raw)
            yield {**m, "extra": [{"key": k, "value": v} for k, v in m["extra"]]}

    return rows_of(df, METADATA, read)


def symbols(df: DataFrame) -> DataFrame:
    """Symbols of shared dictionaries, one bit a pixel, rows padded to bytes."""
    import numpy as np

    def read(_: str, data: bytes) -> Iterator[dict]:
        root = iff.parse(data)
        head = root.find("DIRM")
        entries = container.read_directory(head.data).entries if head else []
        for e, f in zip(entries, [c for c in root.children if c.kind is not None], strict=False):
            body = f.find("Djbz")
            for i, s in enumerate(jb2.decode_dictionary(body.data) if f.kind == "DJVI" and body else ()):
                yield {"dict_id": e.id, "sym_idx": i, "w": s.shape[1], "h": s.shape[0], "data": np.packbits(s, axis=1).tobytes()}

    return rows_of(df, SYMBOLS, read)


def with_parts(index_files: DataFrame, part_files: DataFrame) -> DataFrame:
    """Indirect documents made whole: their parts joined by folder and name; missing parts are errors.

    Names with a path in them are refused, so a document cannot reach outside its folder."""
    listed = components(index_files).where("bundled = false").withColumn("folder", F.regexp_replace("path", "[^/]*$", ""))
    safe = ~F.col("comp_id").rlike("(^/)|(\\.\\.)|(^file:)")
    listed = listed.withColumn("part_path", F.when(safe, F.concat("folder", "comp_id")))
    joined = listed.join(part_files.select(F.col("path").alias("part_path"), F.col("content").alias("part")), "part_path", "left")
    return joined.select("path", "comp_idx", "comp_id", "comp_type", "part", F.when(F.col("part").isNull(), F.concat(F.lit("unresolved component "), "comp_id")).alias("error"))


def assembled(index_files: DataFrame, part_files: DataFrame) -> DataFrame:
    """path, content, error: indirect documents as bundles that every reader here takes; one that lacks a part is an error.

    The parts of one document meet in one row, as its file would hold them."""
    parts = F.array_sort(F.collect_list(F.struct("comp_idx", "comp_type", "comp_id", "part")))
    found = with_parts(index_files, part_files).groupBy("path").agg(parts.alias("parts"), F.first("error", ignorenulls=True).alias("error"))

    @F.pandas_udf("binary")
    def bundle(rows: pd.Series) -> pd.Series:
        def one(parts) -> bytes | None:
            if any(p["part"] is None for p in parts):
                return None
            return container.bundle([(p["comp_type"], p["comp_id"], iff.parse(bytes(p["part"]))) for p in parts])

        return rows.map(one)

    return found.select("path", bundle("parts").alias("content"), "error")


def thumbnails(df: DataFrame) -> DataFrame:
    """path, page_index, png of the pages that carry a small image."""
    from foliospark.codecs import raster

    def read(_: str, data: bytes) -> Iterator[dict]:
        for i, p in enumerate(container.read(data).pages):
            small = raster.thumbnail(p)
            if small is not None:
                yield {"page_index": i, "width": small.shape[1], "height": small.shape[0], "png": raster.write_png(small)}

    return rows_of(df, "path string, page_index int, width int, height int, png binary, error string", read)


def page_bytes(df: DataFrame, index: DataFrame) -> DataFrame:
    """The bytes of indexed pages only (path, page_index, byte_start, byte_end), cut out in the JVM."""
    own = df.join(index.select("path", "page_index", "byte_start", "byte_end"), "path")
    return own.select("path", "page_index", F.substring("content", (F.col("byte_start") + 1).cast("int"), (F.col("byte_end") - F.col("byte_start")).cast("int")).alias("page"))


def _binary(kernel: Callable[[bytes], bytes]):
    """A vectorised binary function; what cannot be read is null."""

    @F.pandas_udf("binary")
    def run(col: pd.Series) -> pd.Series:
        def one(b):
            try:
                return None if b is None else kernel(bytes(b))
            except (ValueError, IndexError):
                return None

        return col.map(one)

    return run


def bzz_encode(col):
    return _binary(bzz.encode)(col)


def bzz_decode(col):
    return _binary(bzz.decode)(col)
