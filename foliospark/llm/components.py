"""Connected components of a table of links, by the smallest id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import materialize, per_task


class Forest:
    """Union-find over any ids, whose roots are the least ids."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, a: int) -> int:
        up, path = self.up, []
        while (b := up.setdefault(a, a)) != a:
            path.append(a)
            a = b
        for x in path:
            up[x] = a
        return a

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        return True

    def links(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.up) if (r := self.find(x)) != x]


def contract(links: DataFrame) -> DataFrame:
    """Links (a, b) of each partition, in blocks, replaced by a spanning forest of stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(f: Forest) -> pa.RecordBatch:
            got = np.array(f.links(), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.union(a, b)
            if len(forest.up) > 1_000_000:
                yield out(forest)
                forest = Forest()
        yield out(forest)

    return links.select("a", "b").mapInArrow(per_task(run), "a long, b long")


#: Links (after contraction) that one task joins by itself, in some 100 MB.
AT_ONCE = 500_000


def _joined(edges: DataFrame) -> DataFrame:
    """node, component of all links in one task; their number was counted before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.union(a, b)
        nodes = list(forest.up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.find(x) for x in nodes], pa.int64())], names=["node", "component"])

    return materialize(edges.coalesce(1).mapInArrow(per_task(run), "node long, component long"))


def components(links: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """node, component (the smallest id reachable) of every id in links (a, b).

    Partitions are first contracted to forests.  Up to ``at_once`` links that are left (counted) are joined by one task.
    Beyond, labels point to smaller ids of the same component.  Each round takes for every node the least label's label
    among its neighbours, for the node itself and for the one that it points to, so whole trees hook to smaller
    ones, and then the label's own label, so trees grow flat by doubling.  Rounds go on until nothing changes.
    Labels live in the shared folder between rounds; aggregations are partial, so a node of many links is no hot spot."""
    edges = materialize(contract(links).where("a <> b").distinct())
    if edges.count() <= at_once:
        return _joined(edges)
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")))
    while True:
        own = labels.select(F.col("node").alias("up"), F.col("up").alias("component"))
        ends = materialize(labels.join(own, "up").select("node", "up", "component"))
        near = both.join(ends.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        least = ends.join(near, ends.node == near.a).select("node", "up", F.least("component", "m").alias("m"))
        hooked = least.groupBy("up").agg(F.min("m").alias("hook")).withColumnRenamed("up", "root")
        new = least.join(hooked, least.node == hooked.root, "left").select("node", F.col("up").alias("old"), F.least("m", F.coalesce("hook", "m")).alias("up"))
        new = materialize(new)
        if not new.where("up <> old").limit(1).count():
            return new.select("node", F.col("up").alias("component"))
        labels = new.select("node", "up")
