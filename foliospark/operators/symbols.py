"""Statistics of connected components across pages: shared symbols, repeats, reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_symbols(components: DataFrame, signature: list[str], page: str, ordinal: str, threshold: int) -> DataFrame:
    """Signatures on at least ``threshold`` distinct pages, with the first place they occur.

    Two steps of partial aggregation: occurrences to (signature, page), then to signatures."""
    if threshold < 2:
        return components.select(*signature, F.lit(0).cast("long").alias("pages"), F.lit(0).cast("long").alias("first_page"), F.lit(0).cast("long").alias("first_ordinal")).where("false")
    once = components.groupBy(*signature, page).agg(F.min(ordinal).alias("__o"))
    found = once.groupBy(*signature).agg(F.count("*").alias("pages"), F.min(F.struct(page, "__o")).alias("__f")).where(F.col("pages") >= threshold)
    return found.select(*signature, "pages", F.col(f"__f.{page}").alias("first_page"), F.col("__f.__o").alias("first_ordinal"))


def distinct_symbols(components: DataFrame, signature: list[str], page: str, ordinal: str) -> DataFrame:
    """The first place of each distinct symbol and how often it occurs: one partial aggregation on the content."""
    found = components.groupBy(*signature).agg(F.min(F.struct(page, ordinal)).alias("__m"), F.count("*").alias("times"))
    return found.select(*signature, F.col(f"__m.{page}").alias(page), F.col(f"__m.{ordinal}").alias(ordinal), "times")


def within_budget(symbols: DataFrame, pages: str, pixels: str, budget: int) -> DataFrame:
    """Greedy choice by pages (most first), then pixels (least first): what does not fit is skipped.

    A fold over the ordered candidates of a document; candidates are dictionary symbols, not rows of data."""
    entry = F.struct((-F.col(pages)).alias("p"), F.col(pixels).alias("x"), F.col("symbol").alias("s"))
    kind = "struct<used:bigint,kept:array<bigint>>"
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("kept")).cast(kind)

    def step(a: Column, e: Column) -> Column:
        fits = a["used"] + e["x"] <= budget
        return F.when(fits, F.struct((a["used"] + e["x"]).alias("used"), F.concat(a["kept"], F.array(e["s"])).alias("kept")).cast(kind)).otherwise(a)

    return symbols.groupBy("doc_id").agg(F.aggregate(F.array_sort(F.collect_list(entry)), start, step)["kept"].alias("kept"))


def repeat_stats(components: DataFrame, shared: DataFrame, signature: list[str], page: str, ordinal: str, pixels: str) -> DataFrame:
    """Of each page: components that are new in it, and those that repeat an earlier or a shared one."""
    known = shared.select(*signature).distinct().withColumn("__shared", F.lit(True))
    place = F.row_number().over(Window.partitionBy(page, *signature).orderBy(ordinal))
    rows = components.join(known, signature, "left").withColumn("__again", F.coalesce("__shared", F.lit(False)) | (place > 1))
    return rows.groupBy(page).agg(
        F.count_if("__again").alias("copies"), F.count_if(~F.col("__again")).alias("news"),
        F.coalesce(F.sum(F.when(F.col("__again"), F.col(pixels))), F.lit(0)).cast("long").alias("copy_pixels"),
        F.coalesce(F.sum(F.when(~F.col("__again"), F.col(pixels))), F.lit(0)).cast("long").alias("new_pixels"),
    )


def reading_order(components: DataFrame, page: str, bottom: str, x: str, key: str, line: int = 16) -> DataFrame:
    """Rank of each component by line bands of ``line`` pixels, then x."""
    w = Window.partitionBy(page).orderBy(F.floor(F.col(bottom) / line), x, key)
    return components.withColumn("position", F.row_number().over(w))


def middle_of_three(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Median of the last three values; the first value stands for those that are missing."""
    w = Window.partitionBy(group).orderBy(*order)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    three = F.array_sort(F.array(F.col(value), F.coalesce(F.lag(value, 1).over(w), first), F.coalesce(F.lag(value, 2).over(w), first)))
    return df.withColumn("baseline", three[1])
