"""Queries through the binary kernels: what is packed and unpacked again must be what went in."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.codecs import bzz, container, g4, iff, iw44, jb2, layers, raster
from foliospark.plans.common import table
from foliospark.sources import documents as D


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))


def bzz_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir).withColumn("packed", D.bzz_encode(F.encode("text", "UTF-8")))
    t = t.withColumn("raw", D.bzz_decode(F.col("packed")))
    return t.select("conv_id", "turn", F.sha2("raw", 256).alias("text_sha256"), F.octet_length("raw").cast("long").alias("n_bytes"))


def container_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of one page a turn, written as files and read back as tables."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for turns in batch.column(1).to_pylist():
                parts = []
                for t in turns:
                    page = {"zone_id": 0, "parent_id": None, "kind": "page", "x": 0, "y": 0, "w": 1000, "h": 1400, "text": t["text"]}
                    raw = layers.write_text(t["text"], [page], 1400)
                    parts.append(("page", f"p{t['turn']:04d}", iff.form("DJVU", iff.Chunk("INFO", container.write_info(1000, 1400, 150)), iff.Chunk("TXTz", bzz.encode(raw)))))
                out.append(container.bundle(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["path", "content"])

    turns = _turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    files = turns.select(F.col("conv_id").cast("string").alias("path"), "turns").mapInArrow(build, "path string, content binary")
    return D.texts(files).select(F.col("path").cast("long").alias("conv_id"), F.col("page_index").cast("long").alias("page_index"), F.sha2("text", 256).alias("text_sha256"), "error")


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.least(F.greatest(F.floor((v.cast("double") + 0.5) * 255), F.lit(0)), F.lit(255)).cast("int")).alias("g"))


def _digest(a: np.ndarray) -> str:
    return hashlib.sha256(np.ascontiguousarray(a, dtype=np.uint8).tobytes()).hexdigest()


def _kernels(df: DataFrame, schema: str, run: Callable[[list], list[tuple]], most: int = 512) -> DataFrame:
    """``run`` on the second column of each slice of a batch; its tuples follow the first column."""
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                got = run(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([g[i] for g in got]) for i in range(len(names) - 1)]], names=names)

    return df.mapInArrow(rows, schema)


def _masks(rasters: list[list[int]]) -> list[np.ndarray]:
    return [(np.array(g).reshape(4, 16) < 128).astype(np.uint8) for g in rasters]


def bilevel_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of 16 x 4 through the symbol coder (whole and by symbols) and the facsimile coder: digests of their pixels afterwards."""
    coders = ((jb2.encode, jb2.decode), (jb2.encode_symbols, jb2.decode), (g4.encode, g4.decode))

    def run(rasters: list) -> list[tuple]:
        return [tuple(_digest(read(write(m))) for write, read in coders) for m in _masks(rasters)]

    return _kernels(_rasters(spark, sf_dir), "vec_id long, tiles string, symbols string, facsimile string", run)


def wavelet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray rasters through the wavelet coder with all slices, which loses nothing: digests of their levels afterwards."""

    def run(rasters: list) -> list[tuple]:
        out = []
        for g in rasters:
            img = np.array(g, np.uint8).reshape(4, 16, 1)
            out.append((_digest(iw44.decode(iw44.encode(img, slices=160, a_chunk=20, gray=True))[:, :, 0]),))
        return out

    return _kernels(_rasters(spark, sf_dir), "vec_id long, levels string", run)


def page_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks as pages with a palette of one colour, written as files, read again and rendered: digests of the pixels."""

    def run(rasters: list) -> list[tuple]:
        out = []
        for m in _masks(rasters):
            own = [iff.Chunk("INFO", container.write_info(16, 4, 300)), iff.Chunk("Sjbz", jb2.encode_symbols(m)), iff.Chunk("FGbz", g4.encode_palette([(200, 30, 10)], [0] * 64))]
            page = container.read(iff.emit(iff.form("DJVU", *own))).pages[0]
            out.append((_digest(raster.render(page)), _digest(raster.render(page, region=(3, 1, 8, 2))), _digest(raster.render(page, rotation="rot180"))))
        return out

    return _kernels(_rasters(spark, sf_dir), "vec_id long, pixels string, part string, turned string", run)


def text_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages with a line and a word a piece of text, written as files: the zones read back, with their places and parents."""

    def run(texts: list) -> list[tuple]:
        out = []
        for t in texts:
            zones, words = [{"zone_id": 0, "parent_id": None, "kind": "page", "x": 0, "y": 0, "w": 1000, "h": 1400, "text": t}], t.split(" ")
            zones.append({"zone_id": 1, "parent_id": 0, "kind": "line", "x": 10, "y": 20, "w": 900, "h": 30, "text": t})
            zones += [{"zone_id": 2 + i, "parent_id": 1, "kind": "word", "x": 10 + 3 * i, "y": 20 + i % 5, "w": 7, "h": 11, "text": w} for i, w in enumerate(words)]
            out.append((iff.emit(iff.form("DJVU", iff.Chunk("INFO", container.write_info(1000, 1400, 150)), iff.Chunk("TXTa", layers.write_text(t, zones, 1400)))),))
        return out

    turns = _turns(spark, sf_dir).select(F.concat_ws("/", "conv_id", "turn").alias("path"), "text")
    files = _kernels(turns, "path string, content binary", run)
    return D.zones(files).select("path", F.coalesce("parent_id", F.lit(-1)).cast("long").alias("parent_id"), *[F.col(c).cast("long").alias(c) for c in ("zone_id", "x", "y_tl", "w", "h")], "kind", F.sha2("text", 256).alias("text_sha256"), "error")


def _one_page(*chunks: iff.Chunk) -> bytes:
    return iff.emit(iff.form("DJVU", iff.Chunk("INFO", container.write_info(100, 200, 300)), *chunks))


def map_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as links on a page: annotations written, packed, and read back as rows."""

    def run(rows: list) -> list[tuple]:
        shapes = [("rect", 4), ("oval", 4), ("text", 4), ("line", 4), ("poly", 6)]
        out = []
        for r in rows:
            kind, n = shapes[r["key"] % 5]
            area = {"url": f"#{r['key'] % 30 + 1}", "description": r["text"], "kind": kind, "coords": [r["key"] % (7 + i) for i in range(n)], "border": "xor" if r["key"] % 2 else None, "highlight": (r["key"] % 256, 2, 3)}
            page = {"background": (1, 2, r["key"] % 256), "zoom": r["key"] % 400, "mode": "color"}
            out.append(layers.write_annotations(page, [area]).encode())
        return [(_one_page(iff.Chunk("ANTz", packed)),) for packed in bzz.encode_many(out)]

    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.struct(F.col("c_custkey").alias("key"), F.concat(F.lit('a "b" \\c '), "c_name").alias("text")).alias("r"))
    # Customers are few bytes and long work: as they are read they would be one task.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    files = _kernels(rows.repartition(parts, "path"), "path string, content binary", run, 4096)
    areas = D.annotated_areas(files)
    return areas.select("path", "url", "description", "kind", F.array_join(F.transform("coords", lambda c: c.cast("string")), ",").alias("coords"), "border", F.col("highlight")[0].cast("long").alias("red"), F.col("background")[2].cast("long").alias("blue"), "zoom", "mode")


def metadata_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' metadata written with keys in any case, aliases and repeats, and read back: the last value of a field wins."""

    def run(rows: list) -> list[tuple]:
        out = []
        for r in rows:
            pairs = [("Title", "first"), ("TITLE", r["text"]), ("description", f"d {r['key']}"), ("date", str(r["key"])), ("Keyword", "k"), ("Other", 'x "y"'), ("Other", "z")]
            body = "(metadata " + " ".join(f"({k} {layers.quote(v)})" for k, v in pairs) + ")"
            out.append((_one_page(iff.Chunk("METz", bzz.encode(body.encode()))),))
        return out

    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.struct(F.col("s_suppkey").alias("key"), F.col("s_name").alias("text")).alias("r"))
    found = D.metadata(_kernels(rows, "path string, content binary", run))
    extra = F.array_join(F.transform("extra", lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("path", "title", "author", "subject", "year", "keywords", extra.alias("extra"), "error")


def bookmark_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region's nations as bookmarks of one document, its first nation's suppliers below them: written and read back.

    A node of the format has 255 children at most, a nation any number: a document is kept in volumes."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc"), F.struct(F.lit(0).alias("level"), F.col("n_nationkey").cast("long").alias("key"), F.lit(None).cast("long").alias("up"), F.col("n_name").alias("title")).alias("b"))
    below = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    below = below.select(F.col("n_regionkey").alias("doc"), F.struct(F.lit(1).alias("level"), F.col("s_suppkey").cast("long").alias("key"), F.col("n_nationkey").cast("long").alias("up"), F.col("s_name").alias("title")).alias("b"))
    docs = n.unionByName(below).groupBy("doc").agg(F.array_sort(F.collect_list("b")).alias("rows"))

    def volumes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                marks = [{"node_id": (r["level"], r["key"]), "parent_id": (0, r["up"]) if r["up"] is not None else None, "sibling_ord": r["key"], "title": r["title"], "url": f"#{r['key']}"} for r in rows]
                for v in container.bookmark_volumes(marks):
                    columns = [pa.array([path], pa.string()), pa.array([v["raw"]], pa.binary()), pa.array([v["start"]], pa.int64()), *(pa.array([v[c]], pa.list_(pa.int64())) for c in ("chain", "first"))]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "raw", "start", "chain", "first"])

    @F.pandas_udf("binary")
    def files(raw: pd.Series) -> pd.Series:
        part = ("page", "p0000.djvu", iff.form("DJVU", iff.Chunk("INFO", container.write_info(10, 10, 300))))
        return raw.map(lambda r: container.bundle([part], bzz.encode(r)))

    # Volumes are few bytes and long work: without a number of partitions they would be one task.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col("doc").cast("string").alias("path"), "rows").mapInArrow(volumes, "path string, raw binary, start long, chain array<long>, first array<long>")
    found = D.volume_bookmarks(dealt.repartition(parts, "path", "start").withColumn("content", files("raw")))
    return found.select("path", *[F.col(c).cast("long").alias(c) for c in ("node_id", "depth", "sibling_ord")], "title", "url", "error")


def palette_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines as a palette (a colour a line) with their numbers as indices, written and read back."""
    line = F.struct("l_linenumber", (F.col("l_partkey") % 256).alias("r"), (F.col("l_suppkey") % 256).alias("g"))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))

    def run(rows: list) -> list[tuple]:
        out = []
        for lines in rows:
            colors, indices = g4.decode_palette(g4.encode_palette([(x["r"], x["g"], x["l_linenumber"]) for x in lines], [x["l_linenumber"] for x in lines]))
            out.append((",".join("%02x%02x%02x" % tuple(c) for c in colors), ",".join(map(str, indices))))
        return out

    return _kernels(orders, "l_orderkey long, colors string, indices string", run)


def page_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as page headers: sizes, resolution, gamma and rotation written and read back as the table of pages."""

    def run(keys: list) -> list[tuple]:
        turns = ["none", "cw90", "rot180", "ccw90"]
        info = [container.write_info(k % 5000 + 1, k % 7000 + 1, k % 600 + 25, (k % 30 + 1) / 10, turns[k % 4]) for k in keys]
        return [(iff.emit(iff.form("DJVU", iff.Chunk("INFO", i))),) for i in info]

    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_partkey")
    pages = D.pages(_kernels(rows, "path string, content binary", run))
    return pages.select("path", *[F.col(c).cast("long").alias(c) for c in ("page_index", "width", "height", "dpi")], F.round(F.col("gamma").cast("double") * 10).cast("long").alias("gamma10"), "rotation", "incl_name", "error")


_ALL = (bzz_roundtrip, container_text, bilevel_roundtrip, wavelet_roundtrip, page_pixels, text_zones, map_areas, metadata_fields, bookmark_tree, palette_roundtrip, page_headers)
QUERIES = {f.__name__: f for f in _ALL}
_LEVELS = "list_transform(embedding, lambda v: cast(least(greatest(floor((cast(v as double) + 0.5) * 255), 0), 255) as int))"
_INK = "sha256(unhex(array_to_string(list_transform(g, lambda v: case when v < 128 then '01' else '00' end), '')))"
_COLOR = "case when g[{0}] < 128 then 'C81E0A' else 'FFFFFF' end"
_RENDERED = "sha256(unhex(array_to_string(list_transform({0}, lambda i: " + _COLOR.format("i") + "), '')))"
ORACLE_SQL = {
    "bzz_roundtrip": "select conv_id, turn, sha256(coalesce(text, '')) as text_sha256, cast(strlen(coalesce(text, '')) as bigint) as n_bytes from conversations",
    "container_text": "select conv_id, row_number() over (partition by conv_id order by turn, text) - 1 as page_index, sha256(coalesce(text, '')) as text_sha256, cast(null as varchar) as error from conversations",
    "bilevel_roundtrip": f"select vec_id, {_INK} as tiles, {_INK} as symbols, {_INK} as facsimile from (select vec_id, {_LEVELS} as g from embeddings)",
    "wavelet_roundtrip": f"select vec_id, sha256(unhex(array_to_string(list_transform({_LEVELS}, lambda v: printf('%02x', v)), ''))) as levels from embeddings",
    "page_pixels": f"""
select vec_id, {_RENDERED.format('range(1, 65)')} as pixels, {_RENDERED.format('list_concat(range(20, 28), range(36, 44))')} as part,
  {_RENDERED.format('list_reverse(range(1, 65))')} as turned from (select vec_id, {_LEVELS} as g from embeddings)""",
    "text_zones": """
with t as (select conv_id || '/' || turn as path, coalesce(text, '') as text from conversations),
w as (select path, unnest(string_split(text, ' ')) as word, unnest(range(0, len(string_split(text, ' ')))) as i from t)
select path, 0 as zone_id, -1 as parent_id, 0 as x, 0 as y_tl, 1000 as w, 1400 as h, 'page' as kind, sha256(text) as text_sha256, cast(null as varchar) as error from t
union all select path, 1, 0, 10, 20, 900, 30, 'line', sha256(text), null from t
union all select path, 2 + i, 1, 10 + 3 * i, 20 + i % 5, 7, 11, 'word', sha256(word), null from w""",
    "map_areas": r"""
with c as (select c_custkey as k, 'a "b" \c ' || c_name as d, c_custkey % 5 as s from customer)
select cast(k as varchar) as path, '#' || (k % 30 + 1) as url, d as description, (['rect', 'oval', 'text', 'line', 'poly'])[s + 1] as kind,
  array_to_string(list_transform(range(7, case when s = 4 then 13 else 11 end), lambda i: k % i), ',') as coords,
  case when k % 2 = 1 then 'xor' end as border, k % 256 as red, k % 256 as blue, k % 400 as zoom, 'color' as mode from c""",
    "metadata_fields": """
select cast(s_suppkey as varchar) as path, s_name as title, cast(null as varchar) as author, 'd ' || s_suppkey as subject, cast(s_suppkey as varchar) as year, 'k' as keywords,
  'Other=x "y";Other=z' as extra, cast(null as varchar) as error from supplier""",
    "bookmark_tree": """
with r as (select n_regionkey as doc, n_nationkey as up, cast(null as bigint) as key, n_nationkey as ord, n_name as title from nation
  union all select n_regionkey, n_nationkey, s_suppkey, s_suppkey, s_name from supplier join nation on s_nationkey = n_nationkey)
select cast(doc as varchar) as path, row_number() over (partition by doc order by up, key nulls first) - 1 as node_id, case when key is null then 0 else 1 end as depth,
  case when key is null then row_number() over (partition by doc, key is null order by up) - 1 else row_number() over (partition by doc, up, key is null order by key) - 1 end as sibling_ord,
  title, '#' || ord as url, cast(null as varchar) as error from r""",
    "palette_roundtrip": """
select l_orderkey, string_agg(printf('%02x%02x%02x', l_partkey % 256, l_suppkey % 256, l_linenumber), ',' order by l_linenumber, l_partkey % 256, l_suppkey % 256) as colors,
  string_agg(cast(l_linenumber as varchar), ',' order by l_linenumber) as indices from lineitem group by l_orderkey""",
    "page_headers": """
select cast(p_partkey as varchar) as path, 0 as page_index, p_partkey % 5000 + 1 as width, p_partkey % 7000 + 1 as height, p_partkey % 600 + 25 as dpi, p_partkey % 30 + 1 as gamma10,
  (['none', 'cw90', 'rot180', 'ccw90'])[p_partkey % 4 + 1] as rotation, cast(null as varchar) as incl_name, cast(null as varchar) as error from part""",
}
