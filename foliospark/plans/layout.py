"""Queries on rectangles, sizes, colours and coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions import numeric as N
from foliospark.plans.common import table


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles on a page of 3000 x 4000: x, y, w, h and a rotation in quarter turns."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 3000).cast("long").alias("x"), (F.col("l_suppkey") * 37 % 4000).cast("long").alias("y"), F.col("l_quantity").cast("long").alias("w"), (F.col("l_linenumber") * 9).cast("long").alias("h"), (F.col("l_orderkey") % 4).cast("int").alias("step"))


def zone_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _zones(spark, sf_dir)
    r = G.rotate_rect(*map(F.col, "xywh"), F.lit(3000), F.lit(4000), F.col("step"))
    return z.select("l_orderkey", "l_linenumber", r.alias("r")).select("l_orderkey", "l_linenumber", *[F.col(f"r.{c}").cast("long").alias(c) for c in "xywh"])


def zone_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _zones(spark, sf_dir)
    r = G.scale_rect(F.struct(*"xywh"), F.lit(3000), F.lit(4000), F.lit(1275), F.lit(1651))
    return z.select("l_orderkey", "l_linenumber", r.alias("r"), G.flip_y(F.col("y"), F.col("h"), F.lit(4000)).cast("long").alias("y_bl")).select("l_orderkey", "l_linenumber", *[F.col(f"r.{c}").cast("long").alias(c) for c in "xywh"], "y_bl")


def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display sizes, sizes at a resolution, and sizes that fit a width, a height and a box."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 50 + 100).alias("w"), (F.col("p_partkey") % 900 + 100).cast("int").alias("h"), F.element_at(F.array(*map(F.lit, G.STEPS)), (F.col("p_partkey") % 4 + 1).cast("int")).alias("rotation"))
    w, h = F.col("w"), F.col("h")
    p = p.select("p_partkey", "rotation", G.display_size(w, h, F.col("rotation")).alias("d"), G.at_dpi(w, F.lit(150), F.lit(400)).alias("w150"), G.fit_to_width(w, h, F.lit(640)).alias("fw"), G.fit_to_height(w, h, F.lit(480)).alias("fh"), G.fit_to_box(w, h, F.lit(512.0), F.lit(512.0)).alias("fb"), G.combine(F.col("rotation"), F.lit("cw90")).alias("turned"))
    return p.select("p_partkey", "turned", F.col("d.w").alias("dw"), F.col("d.h").alias("dh"), "w150", F.col("fw.h").alias("fw_h"), F.col("fh.w").alias("fh_w"), F.col("fb.w").alias("fb_w"), F.col("fb.h").alias("fb_h"))


def colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luma, colour conversion and hex colours of integer triples."""
    p = table(spark, sf_dir, "part").select("p_partkey", *[(F.col("p_partkey") * k % 256).cast("int").alias(c) for c, k in (("a", 7), ("b", 31), ("c", 113))])
    a, b, c = map(F.col, "abc")
    rgb = N.ycbcr_to_rgb(a - 128, b - 128, c - 128)
    hexed = N.parse_hex_color(F.concat(F.lit("#"), *[F.lpad(F.hex(x), 2, "0") for x in (a, b, c)]))
    out = p.select("p_partkey", N.luma(a, b, c).alias("luma"), rgb.alias("rgb"), hexed.alias("hx"), N.normalize((a - 128) * (b + 1)).alias("norm"), N.rgb_to_ycbcr(a, b, c).alias("yc"))
    return out.select("p_partkey", F.col("luma").cast("long").alias("luma"), *[F.col(f"rgb.{x}").cast("long").alias(x) for x in "rgb"], F.col("hx.g").cast("long").alias("hex_g"), *[F.col(f"yc.{x}").cast("long").alias(f"to_{x}") for x in ("y", "cb", "cr")], F.col("norm").cast("long").alias("norm"))


def gamma_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", ((F.col("n_nationkey") + 10) / 10.0).alias("gamma"))
    return n.select("n_nationkey", F.posexplode(N.gamma_lut(F.col("gamma"))).alias("level", "out")).select("n_nationkey", F.col("level").cast("long").alias("level"), F.col("out").cast("long").alias("out"))


def index_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficient positions, resolution choice, plane steps and size estimates."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 1024).cast("int").alias("i"), ((F.col("p_partkey") % 97 + 3) / 100.0).alias("scale"))
    i = F.col("i")
    return p.select("p_partkey", N.zigzag_row(i).cast("long").alias("zrow"), N.zigzag_col(i).cast("long").alias("zcol"), N.best_subsample(F.col("scale")).cast("long").alias("sub"), N.plane_step_q24(i + 1, F.lit(1000)).alias("q24"), N.packed_bytes(i).alias("packed"), N.index_bytes(F.col("p_partkey").cast("long")).alias("index_bytes"))


def annotation_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding boxes of polygons (an order's zones are its points) and their percent boxes."""
    z = _zones(spark, sf_dir).groupBy("l_orderkey").agg(G.points_box(F.col("x"), F.col("y")).alias("b"))
    z = z.select("*", G.percent_box(F.col("b"), F.lit(3000), F.lit(4000)).alias("p"))
    return z.select("l_orderkey", *[F.col(f"b.{c}").alias(c) for c in "xywh"], F.col("p.left").alias("left_pct"), F.col("p.top").alias("top_pct"))


def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors resolved to pages that exist."""
    from foliospark.operators.outline import page_of_anchor

    c = table(spark, sf_dir, "customer")
    form = F.element_at(F.array(*map(F.lit, ["#", "#+", "#page", "#page_", "#page=", "http://x/#"])), (F.col("c_custkey") % 6 + 1).cast("int"))
    links = c.select("c_custkey", F.concat(form, (F.col("c_custkey") % 30 + 1).cast("string")).alias("url"))
    pages = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("page"), F.col("n_name").alias("target"))
    return links.withColumn("page", page_of_anchor(F.col("url"))).join(pages, "page", "left").select("c_custkey", "url", F.when(F.col("target").isNotNull(), F.col("page")).otherwise(0).cast("long").alias("page"), "target")


QUERIES = {f.__name__: f for f in (zone_rotate, zone_scale, page_sizes, colors, gamma_tables, index_arithmetic, annotation_boxes, link_targets)}

_Z = "(select l_orderkey, l_linenumber, l_partkey % 3000 as x, (l_suppkey * 37) % 4000 as y, cast(l_quantity as bigint) as w, l_linenumber * 9 as h, l_orderkey % 4 as step from lineitem)"
_P = "(select p_partkey, (p_partkey * 7) % 256 as a, (p_partkey * 31) % 256 as b, (p_partkey * 113) % 256 as c from part)"
ORACLE_SQL = {
    "zone_rotate": f"""
select l_orderkey, l_linenumber,
  cast(case step when 1 then greatest(4000 - y - h, 0) when 2 then greatest(3000 - x - w, 0) when 3 then y else x end as bigint) as x,
  cast(case step when 1 then x when 2 then greatest(4000 - y - h, 0) when 3 then greatest(3000 - x - w, 0) else y end as bigint) as y,
  cast(case when step in (1, 3) then h else w end as bigint) as w, cast(case when step in (1, 3) then w else h end as bigint) as h from {_Z}""",
    "zone_scale": f"""
select l_orderkey, l_linenumber, cast(x * 1275 // 3000 as bigint) as x, cast(y * 1651 // 4000 as bigint) as y, cast(w * 1275 // 3000 as bigint) as w,
  cast(h * 1651 // 4000 as bigint) as h, cast(greatest(4000 - (y + h), 0) as bigint) as y_bl from {_Z}""",
    "page_sizes": """
with p as (select p_partkey, p_size * 50 + 100 as w, cast(p_partkey % 900 + 100 as int) as h, p_partkey % 4 as s from part)
select p_partkey, (['none', 'cw90', 'rot180', 'ccw90'])[(s + 1) % 4 + 1] as turned, case when s in (1, 3) then h else w end as dw, case when s in (1, 3) then w else h end as dh,
  cast(greatest(1, round(w * 150 / 400)) as int) as w150, cast(greatest(1, round(h * 640 / w)) as int) as fw_h, cast(greatest(1, round(w * 480 / h)) as int) as fh_w,
  cast(greatest(1, round(w * least(512.0::double / w, 512.0::double / h))) as int) as fb_w, cast(greatest(1, round(h * least(512.0::double / w, 512.0::double / h))) as int) as fb_h from p""",
    "colors": f"""
with v as (select *, a - 128 as y, b - 128 as cb, c - 128 as cr from {_P}),
t as (select *, cr + (cr >> 1) as t1, y + 128 - (cb >> 2) as t2 from v)
select p_partkey, (306 * a + 601 * b + 117 * c) >> 10 as luma, least(greatest(y + 128 + t1, 0), 255) as r, least(greatest(t2 - (t1 >> 1), 0), 255) as g,
  least(greatest(t2 + cb * 2, 0), 255) as b, b as hex_g, ((a + 2 * b + c) >> 2) - 128 as to_y, c - b as to_cb, a - b as to_cr, least(greatest(((a - 128) * (b + 1) + 32) >> 6, -128), 127) as norm from t""",
    "gamma_tables": """
with n as (select n_nationkey, ((n_nationkey + 10) / 10.0)::double / 2.2::double as p from nation)
select n_nationkey, level, cast(case when abs(p - 1) < 1e-4 then level else least(greatest(floor(255.0 * pow(level / 255.0::double, p) + 0.5), 0), 255) end as bigint) as out
from n, (select unnest(range(0, 256)) as level)""",
    "index_arithmetic": """
with p as (select p_partkey, p_partkey % 1024 as i, (p_partkey % 97 + 3) / 100.0 as scale from part)
select p_partkey, ((i >> 1) & 1) * 16 + ((i >> 3) & 1) * 8 + ((i >> 5) & 1) * 4 + ((i >> 7) & 1) * 2 + ((i >> 9) & 1) as zrow,
  (i & 1) * 16 + ((i >> 2) & 1) * 8 + ((i >> 4) & 1) * 4 + ((i >> 6) & 1) * 2 + ((i >> 8) & 1) as zcol,
  cast(case when floor(1.5::double / scale) >= 8 then 8 when floor(1.5::double / scale) >= 4 then 4 when floor(1.5::double / scale) >= 2 then 2 else 1 end as bigint) as sub,
  ((i + 1) * 16777216) // 1000 as q24, (i + 7) // 8 as packed, cast(ceil(length(ltrim(bin(greatest(p_partkey, 1)), '0')) / 8.0) as bigint) as index_bytes from p""",
    "annotation_boxes": f"""
select l_orderkey, min(x) as x, min(y) as y, max(x) - min(x) as w, max(y) - min(y) as h, round(min(x) * 100.0::double / 3000, 4) as left_pct, round(min(y) * 100.0::double / 4000, 4) as top_pct
from {_Z} group by l_orderkey""",
    "link_targets": r"""
with l as (select c_custkey, (['#', '#+', '#page', '#page_', '#page=', 'http://x/#'])[c_custkey % 6 + 1] || (c_custkey % 30 + 1) as url from customer),
r as (select *, try_cast(nullif(regexp_extract(url, '^#(?:\+|page[_=]?)?([0-9]+)$', 1), '') as bigint) as page from l)
select c_custkey, url, case when n_name is not null then page else 0 end as page, n_name as target
from r left join (select n_nationkey + 1 as p, n_name from nation) on p = page""",
}
