"""Raster operators on a pixel table (img, x, y, values): for small rasters and as a check of the kernels.

Every stencil is grouped or windowed by image, so images spread over the cluster; big
rasters stay packed and use the vectorised kernels instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("int")


def threshold_mask(px: DataFrame, luma: str, limit: int) -> DataFrame:
    return px.withColumn("ink", F.col(luma) < limit)


def block_mean(px: DataFrame, value: str, block: int, ink: str) -> DataFrame:
    """Truncated mean of the pixels without ink of each block; null if all have ink."""
    free = ~F.col(ink)
    total, count = F.sum(F.when(free, F.col(value))), F.count_if(free)
    return px.groupBy("img", div(F.col("x"), block).alias("bx"), div(F.col("y"), block).alias("by")).agg(F.when(count > 0, F.floor(total / count)).cast("int").alias("mean"))


def pool_any(px: DataFrame, block: int, ink: str) -> DataFrame:
    return px.groupBy("img", div(F.col("x"), block).alias("bx"), div(F.col("y"), block).alias("by")).agg(F.bool_or(ink).alias("ink"))


def half_mean(px: DataFrame, value: str) -> DataFrame:
    """2 x 2 means rounded; an odd last row or column is repeated."""
    edge = px.groupBy("img").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    rows = px.join(edge, "img").withColumn("n", F.when((F.col("x") == F.col("mx")) & (F.col("x") % 2 == 0), 2).otherwise(1) * F.when((F.col("y") == F.col("my")) & (F.col("y") % 2 == 0), 2).otherwise(1))
    return rows.groupBy("img", div(F.col("x"), 2).alias("bx"), div(F.col("y"), 2).alias("by")).agg(F.floor((F.sum(F.col(value) * F.col("n")) + 2) / 4).cast("int").alias("mean"))


def integral(px: DataFrame, value: Column, name: str) -> DataFrame:
    """Two running sums: along x, then along y."""
    across = Window.partitionBy("img", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("img", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return px.withColumn("__row", F.sum(value).over(across)).withColumn(name, F.sum("__row").over(down)).drop("__row")


def sauvola(px: DataFrame, luma: str, radius: int, k: float) -> DataFrame:
    """Ink below m (1 + k (s / 128 - 1)) of the window of ``radius`` around, clamped at the borders."""
    v = F.col(luma).cast("long")

    def box(df: DataFrame, partition: list[str], order: str, cols: list[tuple[Column, str]]) -> DataFrame:
        w = Window.partitionBy(*partition).orderBy(order).rangeBetween(-radius, radius)
        return df.select("*", *[F.sum(c).over(w).alias(n) for c, n in cols])

    rows = box(px, ["img", "y"], "x", [(v, "s1"), (v * v, "s2"), (F.lit(1), "s0")])
    rows = box(rows, ["img", "x"], "y", [(F.col("s1"), "t1"), (F.col("s2"), "t2"), (F.col("s0"), "t0")])
    mean = F.col("t1") / F.col("t0")
    spread = F.sqrt(F.greatest(F.col("t2") / F.col("t0") - mean * mean, F.lit(0.0)))
    return rows.withColumn("ink", F.col(luma) < mean * (1 + k * (spread / 128 - 1))).drop("s0", "s1", "s2", "t0", "t1", "t2")


def dilate(ink: DataFrame, width: Column, height: Column) -> DataFrame:
    """Ink pixels (img, x, y) and their four neighbours within the image."""
    steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    moved = ink.withColumn("s", F.explode(steps)).select("img", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    return moved.where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < width) & (F.col("y") < height)).distinct()


def rotate(px: DataFrame, step: Column, width: Column, height: Column) -> DataFrame:
    """Coordinates after ``step`` quarter turns clockwise."""
    x, y = F.col("x"), F.col("y")
    nx = F.when(step == 1, height - 1 - y).when(step == 2, width - 1 - x).when(step == 3, y).otherwise(x)
    ny = F.when(step == 1, x).when(step == 2, height - 1 - y).when(step == 3, width - 1 - x).otherwise(y)
    return px.withColumn("nx", nx.cast("int")).withColumn("ny", ny.cast("int")).drop("x", "y").withColumnRenamed("nx", "x").withColumnRenamed("ny", "y")


def compose(mask_ink: Column, foreground: Column, background: Column, white: int = 255) -> Column:
    """Ink takes the foreground (black if none), other pixels the background (white if none)."""
    return F.when(mask_ink, F.coalesce(foreground, F.lit(0))).otherwise(F.coalesce(background, F.lit(white)))


def differ(a: DataFrame, b: DataFrame, channels: list[str], tolerance: int) -> DataFrame:
    """Per image: pixels whose largest channel difference exceeds the tolerance; a missing pixel differs."""
    both = a.alias("a").join(b.alias("b"), ["img", "x", "y"], "full")
    each = [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in channels]
    apart = F.greatest(*each) if len(each) > 1 else each[0]
    return both.groupBy("img").agg(F.count_if(F.coalesce(apart > tolerance, F.lit(True))).alias("mismatches"), F.count("*").alias("pixels"))


def quality(runs: DataFrame, by: list[str], size: str, pixels: str, squares: Column) -> DataFrame:
    """Of each corpus: pages, bytes, bits a pixel, ratio to 24-bit pixels, and peak signal-to-noise from sums of squared errors."""
    total, n = F.sum(size), F.sum(pixels)
    psnr = F.round(10 * F.log10(F.lit(65025.0) * n / F.sum(squares)), 4)
    return runs.groupBy(*by).agg(F.count("*").alias("pages"), total.alias("bytes"), F.round(total * 8.0 / n, 6).alias("bpp"), F.round(n * 3.0 / total, 6).alias("ratio"), psnr.alias("psnr"))
