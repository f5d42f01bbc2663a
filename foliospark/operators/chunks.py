"""Selection and editing of chunk rows: a page or document is a set of rows with an ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.operators.shared import running_sum, same


def first_chunk(chunks: DataFrame, keys: list[str], id_col: str, ordinal: str, value: str) -> DataFrame:
    """The first value of each id: one aggregation, no sort of whole groups."""
    return chunks.groupBy(*keys, id_col).agg(F.min_by(value, ordinal).alias("first"))


def all_chunks(chunks: DataFrame, keys: list[str], ordinal: str, value: str, alias: str = "all") -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(value).alias("v"))))
    return chunks.groupBy(*keys).agg(F.transform(pairs, lambda x: x["v"]).alias(alias))


def prefer_compressed(compressed: Column, plain: Column, parse_compressed, parse_plain) -> Column:
    """A compressed chunk wins even if it is empty, which then means nothing at all."""
    return F.when(compressed.isNotNull(), F.when(F.octet_length(compressed) > 0, parse_compressed(compressed))).when(plain.isNotNull(), parse_plain(plain))


def replace_chunks(chunks: DataFrame, updates: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values of ``updates`` where its keys match; other rows stay as they are."""
    new = updates.select(*keys, F.col(value).alias("__new"), F.lit(True).alias("__hit"))
    return chunks.join(new, keys, "left").withColumn(value, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(value))).drop("__new", "__hit")


def upsert_chunks(chunks: DataFrame, updates: DataFrame, owner: list[str], id_col: str, ordinal: str, value: str) -> DataFrame:
    """Merge by (owner, id): an update keeps the ordinal, an empty value deletes, a new id goes last."""
    keys = [*owner, id_col]
    new = updates.select(*keys, F.col(value).alias("__new"), F.lit(True).alias("__hit"))
    kept = chunks.join(new, keys, "left").withColumn(value, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(value)))
    last = chunks.groupBy(*owner).agg(F.max(ordinal).alias("__last"))
    fresh = updates.join(chunks.select(*keys).distinct(), keys, "left_anti").join(last, owner, "left")
    rank = F.row_number().over(Window.partitionBy(*owner).orderBy(id_col))
    fresh = fresh.withColumn(ordinal, (F.coalesce(F.col("__last"), F.lit(-1)) + rank).cast(dict(chunks.dtypes)[ordinal]))
    columns = [*keys, ordinal, value]
    return kept.select(columns).unionByName(fresh.select(columns)).where(F.col(value).isNotNull() & (F.length(value) > 0))


def padded_size(length: Column) -> Column:
    """Bytes of a chunk in a file: header, body and a pad byte for odd bodies."""
    return 8 + length + length % 2


def directory_offsets(components: DataFrame, owner: list[str], ordinal: str, length: Column, start: int = 16) -> DataFrame:
    """Where each component starts: an exclusive running sum of padded sizes from ``start``."""
    return running_sum(components, owner, ordinal, padded_size(length), "__offset").withColumn("offset", F.lit(start) + F.col("__offset")).drop("__offset")


def merge_renumber(parts: DataFrame, target: str, document: str, page: str) -> DataFrame:
    """Bag union of the pages of documents, in order, with new component names.

    Pages are numbered within their document, and documents by a table of a row each; one without a name comes last."""
    docs = parts.groupBy(target, document).agg(F.count("*").alias("__n"))
    row = Window.partitionBy(target).orderBy(F.col(document).asc_nulls_last())
    docs = docs.select(target, document, (F.row_number().over(row) - 1).alias("__doc"), F.coalesce(F.sum("__n").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    rows = running_sum(parts, [target, document], page, F.lit(1), "__at")
    out = rows.join(docs, same(rows, docs, [target, document]), "left")
    index = (F.col("__first") + F.col("__at")).cast("int")
    out = out.select(*[rows[c] for c in parts.columns], index.alias("page_index"), "__doc")
    return out.withColumn("component_id", F.format_string("d%dp%04d.djvu", "__doc", "page_index")).drop("__doc")


def page_listing(pages: DataFrame) -> DataFrame:
    """path, pages, listing: the number of pages of each document and their sizes as JSON, in order of page_index.

    One row holds the pages of one document; the format counts pages in two bytes."""
    row = F.struct((F.col("page_index") + 1).alias("page"), "width", "height", "dpi")
    return pages.where("path is not null").groupBy("path").agg(F.count("*").alias("pages"), F.to_json(F.array_sort(F.collect_list(row))).alias("listing"))


def page_range(text: Column) -> Column:
    """struct<start, end> (from 0, half open) of ``N-M`` counted from 1; null if malformed."""
    ok = text.rlike("^[0-9]+-[0-9]+$")
    a, b = (F.split(text, "-")[i].try_cast("int") for i in (0, 1))
    return F.when(ok & (a >= 1) & (a <= b), F.struct((a - 1).alias("start"), b.alias("end")))
