"""Trees as adjacency lists: bookmarks, zones, outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.operators.shared import SPAN, same, stored


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """node_id and the number of descendants of each node (node_id, parent_id), whatever the depth.

    By doubling: after round r a node knows how many nodes lie fewer than 2^r levels below, and its ancestor 2^r levels up.
    What the nodes that name an ancestor know is added to it, so rounds are as many as bits of the depth, and each
    is a partial aggregation and two joins on tables as long as the tree.  A cycle is an error."""
    known = nodes.select("node_id", F.col("parent_id").alias("above"), F.lit(1).cast("long").alias("size"))
    most = nodes.count()
    for r in range(most.bit_length() + 2):
        known = stored(known)
        if not known.where("above is not null").limit(1).count():
            return known.select("node_id", (F.col("size") - 1).alias("descendants"))
        if (1 << r) > 2 * max(1, most):
            break
        more = known.where("above is not null").groupBy(F.col("above").alias("node_id")).agg(F.sum("size").alias("more"))
        next_ = known.select(F.col("node_id").alias("above"), F.col("above").alias("higher"))
        known = known.join(more, "node_id", "left").join(next_, "above", "left")
        known = known.select("node_id", F.col("higher").alias("above"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
    raise ValueError("the tree has a cycle")


def sibling_links(nodes: DataFrame, span: int = SPAN) -> DataFrame:
    """prev_id and next_id of each node among its siblings.

    Siblings are linked within buckets of ``span`` ordinals; the ends of buckets are linked by a table of a row a bucket, so
    that a parent (or the lack of one) with very many children is no task of its own."""
    rows = nodes.select("node_id", "parent_id", "sibling_ord", F.floor(F.col("sibling_ord") / span).alias("bucket"))
    order = F.struct("sibling_ord", "node_id")
    ends = rows.groupBy("parent_id", "bucket").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    row = Window.partitionBy("parent_id").orderBy("bucket")
    ends = ends.select("parent_id", "bucket", F.lag("last.node_id").over(row).alias("before"), F.lead("first.node_id").over(row).alias("after"))
    w = Window.partitionBy("parent_id", "bucket").orderBy("sibling_ord", "node_id")
    linked = rows.withColumn("prev", F.lag("node_id").over(w)).withColumn("next", F.lead("node_id").over(w))
    out = linked.join(ends, same(linked, ends, ["parent_id", "bucket"]), "left")
    return out.select("node_id", linked["parent_id"], F.coalesce("prev", "before").alias("prev_id"), F.coalesce("next", "after").alias("next_id"))


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.join(nodes.select(F.col("parent_id").alias("node_id")).where("node_id is not null").distinct(), "node_id", "left_anti")


def class_counters(zones: DataFrame, page: str, kind_class: str, preorder: list[str]) -> DataFrame:
    """Running number from 0 of each zone within its page and class."""
    w = Window.partitionBy(page, kind_class).orderBy(*preorder)
    return zones.withColumn("counter", F.row_number().over(w) - 1)


def page_of_anchor(url: Column) -> Column:
    """1-based page that ``#N``, ``#+N``, ``#pageN``, ``#page_N`` or ``#page=N`` names; null for other links."""
    n = F.regexp_extract(url, "^#(?:\\+|page[_=]?)?([0-9]+)$", 1)
    return F.when(n != "", n.cast("int"))
