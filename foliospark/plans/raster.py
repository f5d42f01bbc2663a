"""Queries on pixel tables: vectors stand for rasters of 16 x 4 pixels with levels from 0 to 255."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import pixels as P
from foliospark.plans.common import table

W, H = 16, 4


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img"), F.posexplode("embedding").alias("i", "v"))
    level = F.least(F.greatest(F.floor((F.col("v").cast("double") + 0.5) * 255), F.lit(0)), F.lit(255)).cast("int")
    return e.select("img", (F.col("i") % W).alias("x"), P.div(F.col("i"), W).alias("y"), level.alias("g"))


def _longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


def fixed_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(P.threshold_mask(_pixels(spark, sf_dir), "g", 128).where("ink").select("img", "x", "y"))


def block_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(P.block_mean(P.threshold_mask(_pixels(spark, sf_dir), "g", 128), "g", 3, "ink"))


def mask_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(P.pool_any(P.threshold_mask(_pixels(spark, sf_dir), "g", 100), 4, "ink"))


def half_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters of 17 columns, so that a last column is odd: the first stands at the end again."""
    px = _pixels(spark, sf_dir)
    return _longs(P.half_mean(px.unionByName(px.where("x = 0").withColumn("x", F.lit(16))), "g"))


def integral_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(P.integral(_pixels(spark, sf_dir), F.col("g").cast("long"), "total").select("img", "x", "y", "total"))


def sauvola(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(P.sauvola(_pixels(spark, sf_dir), "g", 2, 0.34).where("ink").select("img", "x", "y"))


def dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ink = P.threshold_mask(_pixels(spark, sf_dir), "g", 90).where("ink").select("img", "x", "y")
    return _longs(P.dilate(ink, F.lit(W), F.lit(H)))


def rotate_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(P.rotate(_pixels(spark, sf_dir), (F.col("img") % 4).cast("int"), F.lit(W), F.lit(H)).select("img", "x", "y", "g"))


def compose_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _pixels(spark, sf_dir)
    fg = F.when(F.col("g") % 3 == 0, F.col("x") * 10)
    bg = F.when(F.col("g") % 5 != 0, F.col("g"))
    return _longs(px.select("img", "x", "y", P.compose(F.col("g") < 120, fg, bg).alias("out")))


def diff_renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second render that is 9 levels off in every fourth column, 2 in others; each has a column that the other lacks."""
    a = _pixels(spark, sf_dir)
    b = a.withColumn("g", F.col("g") + F.when(F.col("x") % 4 == 0, 9).otherwise(2))
    a, b = (r.unionByName(r.where("x = 0").withColumn("x", F.lit(x))) for r, x in ((a, 16), (b, -1)))
    return _longs(P.differ(a, b, ["g"], 8))


QUERIES = {f.__name__: f for f in (fixed_threshold, block_mean, mask_pyramid, half_size, integral_image, sauvola, dilate, rotate_pixels, compose_layers, diff_renders)}

_PX = f"""(select img, i % {W} as x, i // {W} as y, g from (select vec_id as img, unnest(range(0, len(embedding))) as i,
  cast(least(greatest(floor((cast(unnest(embedding) as double) + 0.5) * 255), 0), 255) as bigint) as g from embeddings))"""
ORACLE_SQL = {
    "fixed_threshold": f"select img, x, y from {_PX} where g < 128",
    "block_mean": f"select img, x // 3 as bx, y // 3 as by, sum(g) filter (where g >= 128) // count(*) filter (where g >= 128) as mean from {_PX} group by all",
    "mask_pyramid": f"select img, x // 4 as bx, y // 4 as by, bool_or(g < 100) as ink from {_PX} group by all",
    "half_size": f"""
with p as (select img, x, y, g, 1 as n from {_PX} union all select img, 16, y, g, 2 from {_PX} where x = 0)
select img, x // 2 as bx, y // 2 as by, cast((sum(g * n) + 2) // 4 as bigint) as mean from p group by all""",
    "integral_image": f"""
with r as (select img, x, y, sum(g) over (partition by img, y order by x) as s from {_PX})
select img, x, y, cast(sum(s) over (partition by img, x order by y) as bigint) as total from r""",
    "sauvola": f"""
with p as (select * from {_PX}), b as (select a.img, a.x, a.y, a.g, cast(sum(b.g) as double) / count(*) as m, cast(sum(b.g * b.g) as double) / count(*) as q
  from p a join p b on a.img = b.img and b.x between a.x - 2 and a.x + 2 and b.y between a.y - 2 and a.y + 2 group by a.img, a.x, a.y, a.g)
select img, x, y from b where g < m * (1 + 0.34::double * (sqrt(greatest(q - m * m, 0.0)) / 128 - 1))""",
    "dilate": f"""
with p as (select * from {_PX} where g < 90), s as (select * from (values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) t(dx, dy))
select distinct img, x + dx as x, y + dy as y from p, s where x + dx between 0 and {W - 1} and y + dy between 0 and {H - 1}""",
    "rotate_pixels": f"""
select img, case img % 4 when 1 then {H - 1} - y when 2 then {W - 1} - x when 3 then y else x end as x,
  case img % 4 when 1 then x when 2 then {H - 1} - y when 3 then {W - 1} - x else y end as y, g from {_PX}""",
    "compose_layers": f"select img, x, y, case when g < 120 then case when g % 3 = 0 then x * 10 else 0 end else case when g % 5 <> 0 then g else 255 end end as out from {_PX}",
    "diff_renders": f"select img, count(*) filter (where x % 4 = 0) + 2 * count(*) filter (where x = 0) as mismatches, count(*) + 2 * count(*) filter (where x = 0) as pixels from {_PX} group by img",
}
