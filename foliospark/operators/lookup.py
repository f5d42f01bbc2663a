"""Lookups: directory to forms, pages to dictionaries, pixels to colours, symbols to near symbols."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import numeric as N


def with_dictionary(pages: DataFrame, dictionaries: DataFrame, include: str, name: str, strict: bool = False) -> DataFrame:
    """Pages with their shared dictionary by trimmed name; a miss is null, or with ``strict`` an error text.

    No broadcast hint: adaptive execution broadcasts a dictionary table only while it is small."""
    keyed = pages.withColumn("__key", F.rtrim(F.col(include)))
    right = dictionaries.withColumnRenamed(name, "__key").withColumn("__found", F.lit(True))
    out = keyed.join(right, "__key", "left")
    if strict:
        out = out.withColumn("error", F.when(F.col("__key").isNotNull() & F.col("__found").isNull(), F.concat(F.lit("missing component "), "__key")))
    return out.drop("__key", "__found")


def by_ordinal(directory: DataFrame, forms: DataFrame, keys: list[str]) -> DataFrame:
    """Directory entries with the form of the same ordinal; ``error`` where there is none."""
    return directory.join(forms.withColumn("__hit", F.lit(True)), keys, "left").withColumn("error", F.when(F.col("__hit").isNull(), "malformed")).drop("__hit")


def palette_color(pixels: DataFrame, blits: DataFrame, colors: DataFrame, first: str) -> DataFrame:
    """pixel -> blit -> colour index -> colour; a miss takes ``first``, or black if there is no colour."""
    return pixels.join(blits, "blit", "left").join(colors, "color_index", "left").withColumn("color", F.coalesce("color", F.lit(first)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def nearest_symbol(symbols: DataFrame, size: str, bits: str, key: str, budget: int, width: int = 64, agree: int = 2) -> DataFrame:
    """For each symbol the earlier one of the same size at the least distance within the budget.

    Patterns have ``width`` bits.  Equal patterns are one: the first key stands for them, and later ones are at distance 0 from it.
    Pigeonhole: of ``budget`` + ``agree`` bit ranges, patterns that differ in at most ``budget`` bits have ``agree`` alike, so
    candidates come from equi-joins on choices of ``agree`` ranges and not from all pairs of a size.  More ranges that must
    agree make more rows a pattern and fewer candidates a row: choose more for more symbols."""
    rows = symbols.select(F.col(size).alias("size"), F.col(key).alias("key"), F.col(bits).alias("bits"))
    unique = rows.groupBy("size", "bits").agg(F.min("key").alias("key"))
    cuts = [i * width // (budget + agree) for i in range(budget + agree + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    picks = [sum(c) for c in combinations(masks, agree)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in picks]
    choices = F.array(*[F.xxhash64("size", F.lit(i), F.col("bits").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])
    # Few bytes make many pairs: without a number of partitions adaptive execution would join them in one task.
    parts = int(symbols.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Spark takes the rows of ``explode`` to be as few as those before it, and would broadcast them through the driver: joins are by merging.
    a = unique.where("size is not null").select("size", "key", "bits", F.explode(choices).alias("r")).repartition(parts, "r", "size")
    b = a.select("r", "size", F.col("key").alias("near"), F.col("bits").alias("other"))
    distance = hamming(F.col("bits"), F.col("other"))
    pairs = a.join(b.hint("merge"), ["r", "size"]).where((F.col("near") < F.col("key")) & (distance <= budget))
    pairs = pairs.select("size", "key", "near", distance.alias("distance"))
    best = pairs.groupBy("size", "key").agg(F.min(F.struct("distance", "near")).alias("m"))
    found = best.select("size", "key", F.col("m.near").alias("near"), F.col("m.distance").alias("distance"))
    again = rows.join(unique.withColumnRenamed("key", "near").hint("merge"), ["size", "bits"]).where("key <> near")
    return found.unionByName(again.select("size", "key", "near", F.lit(0).alias("distance")))


def unlike_size_nearest(symbols: DataFrame, most: int) -> DataFrame:
    """For each symbol the earlier one of another size, at most ``most`` wider and higher, that it is nearest to.

    symbols: doc_id, sym_idx, w, h, data (one bit a pixel, rows padded).  A band join: sizes fall into cells of
    ``most`` + 1, and a symbol meets the cells around its own within its document.  The distance counts
    the pixels that differ after scaling the other symbol to this one's size by nearest samples."""
    cell = most + 1
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    own = symbols.select("doc_id", "sym_idx", "w", "h", "data", F.floor(F.col("w") / cell).alias("cw"), F.floor(F.col("h") / cell).alias("ch"))
    probe = own.withColumn("s", F.explode(around)).withColumn("cw", F.col("cw") + F.col("s.a")).withColumn("ch", F.col("ch") + F.col("s.b")).drop("s")
    other = own.select("doc_id", "cw", "ch", F.col("sym_idx").alias("near"), F.col("w").alias("nw"), F.col("h").alias("nh"), F.col("data").alias("ndata"))
    pairs = probe.join(other, ["doc_id", "cw", "ch"]).where((F.col("near") < F.col("sym_idx")) & (F.abs(F.col("w") - F.col("nw")) <= most) & (F.abs(F.col("h") - F.col("nh")) <= most) & ((F.col("w") != F.col("nw")) | (F.col("h") != F.col("nh"))))

    @F.pandas_udf("long")
    def apart(w: pd.Series, h: pd.Series, d: pd.Series, nw: pd.Series, nh: pd.Series, nd: pd.Series) -> pd.Series:
        def bits(data: bytes, width: int, height: int) -> np.ndarray:
            return np.unpackbits(np.frombuffer(data, np.uint8).reshape(height, -1), axis=1)[:, :width]

        out = []
        for a, b, x, c, e, y in zip(w, h, d, nw, nh, nd, strict=True):
            scaled = bits(y, c, e)[np.arange(b) * e // b][:, np.arange(a) * c // a]
            out.append(int((bits(x, a, b) != scaled).sum()))
        return pd.Series(out)

    pairs = pairs.withColumn("distance", apart("w", "h", "data", "nw", "nh", "ndata"))
    best = pairs.groupBy("doc_id", "sym_idx").agg(F.min(F.struct("distance", "near")).alias("m"))
    return best.select("doc_id", "sym_idx", F.col("m.near").alias("near"), F.col("m.distance").alias("distance"))


def refinement_totals(symbols: DataFrame, most: int, share: float, least_pixels: int = 32) -> DataFrame:
    """Of each document: distinct symbols, those large enough, those with an earlier symbol of another size near (see
    ``unlike_size_nearest``), those within ``share`` of their pixels, and the bytes that refinement would change."""
    near = unlike_size_nearest(symbols, most).select("doc_id", "sym_idx", "distance")
    pixels = F.col("w") * F.col("h")
    rows = symbols.join(near, ["doc_id", "sym_idx"], "left").withColumn("large", pixels >= least_pixels)
    rows = rows.withColumn("candidate", F.col("large") & F.col("distance").isNotNull())
    rows = rows.withColumn("match", F.col("candidate") & (F.col("distance") <= F.round(pixels * share)))
    change = N.refined_bytes(F.col("distance"), F.col("sym_idx")) - N.symbol_bytes(F.col("w"), F.col("h"))
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("symbols"), F.count_if("large").alias("eligible"), F.count_if("candidate").alias("candidates"), F.count_if("match").alias("matches"),
        F.coalesce(F.sum(F.when(F.col("match"), change)), F.lit(0)).alias("byte_change"),
    )
