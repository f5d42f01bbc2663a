"""Distinct valid vectors and their shards, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm.common import materialize, per_task


def valid() -> Column:
    """Not null, no null or non-finite component, not zero, with an id."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def keyed(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (doubles), ok, and a 128-bit hash (h1, h2) of the vector."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    return rows.select("vec_id", "v", valid().alias("ok"), F.xxhash64("v", F.lit(1)).alias("h1"), F.xxhash64(F.reverse("v"), F.lit(2)).alias("h2"))


def distinct(rows: DataFrame, keep_ids: int = 1, salts: int = 64) -> DataFrame:
    """id (the least), n and the ``keep_ids`` least ids of each distinct valid vector.

    Many copies of one vector are reduced in ``salts`` parts before their parts meet."""
    ok = rows.where("ok")
    first = ok.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v"))
    if keep_ids == 1:
        return first
    part = F.pmod(F.xxhash64("vec_id"), F.lit(salts))
    few = ok.select("vec_id", "h1", "h2", part.alias("part"))
    for by in (("h1", "h2", "part"), ("h1", "h2")):
        few = few.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("r") <= keep_ids)
    ids = few.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return first.join(ids, ["h1", "h2"])


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")


def every_shard(shards: int) -> Column:
    """Each query asks all shards."""
    return F.sequence(F.lit(0), F.lit(shards - 1))


def half_of_shards(shards: int) -> Column:
    """Each query asks its own shard and those after it, in a circle, so that of two vectors of unlike shards one asks the other's."""
    own, half = shard_of(shards), shards // 2
    last = half - F.when(own >= half, F.lit(1)).otherwise(F.lit(0)) if shards % 2 == 0 else F.lit(half)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.pmod(own + i, F.lit(shards)).cast("int"))


def by_shard(index: DataFrame, queries: DataFrame, shards: int, parts: int, cols: list[str], asked: Column, schema: str, build: Callable, ask: Callable, done: Callable | None = None) -> DataFrame:
    """Builds an index of each shard once a task and streams the queries through it.

    ``index`` and ``queries`` have id, v and ``cols`` (null in queries that lack them); a row of the index goes to one shard, a
    query to the shards ``asked``.  ``parts`` splits the queries of a shard over several tasks, and each task has a
    partition of its own, so that it holds one shard and one batch.  build(shard, ids, vectors, other columns) -> index;
    ask(index, ids, vectors, other columns) -> batches; done(index) -> batches, once the queries have ended."""
    kinds = dict(index.dtypes)
    extra = [F.col(c) for c in cols]
    also = [F.col(c) if c in queries.columns else F.lit(None).cast(kinds[c]).alias(c) for c in cols]
    at = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = index.select(shard_of(shards).alias("shard"), at.alias("part"), F.lit(0).alias("role"), "id", "v", *extra)
    right = queries.select(F.explode(asked).alias("shard"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("role"), "id", "v", *also)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, index_ = None, [], None
        for batch in batches:
            shard, part, role = (batch.column(i).to_numpy() for i in range(3))
            both = shard.astype(np.int64) * parts * 2 + part * 2 + role
            cuts = [0, *(np.flatnonzero(np.diff(both)) + 1).tolist(), len(both)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                own = both[a] - role[a]
                if own != key:
                    if index_ is not None and done:
                        yield from done(index_)
                    key, held, index_ = own, [], None
                piece = batch.slice(a, b - a)
                others = [piece.column(5 + i) for i in range(len(cols))]
                if role[a] == 0:
                    held.append((piece.column(3).to_numpy(), matrix(piece.column(4)), others))
                    continue
                if not held and index_ is None:
                    continue
                if index_ is None:
                    index_ = build(int(shard[a]), np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), [pa.concat_arrays([x[2][i] for x in held]) for i in range(len(cols))])
                    held = []
                ids, vs = piece.column(3).to_numpy(), matrix(piece.column(4))
                for i in range(0, len(ids), 512):
                    yield from ask(index_, ids[i : i + 512], vs[i : i + 512], [o.slice(i, 512) for o in others])
        if index_ is not None and done:
            yield from done(index_)

    task = F.col("shard") * parts + F.col("part")
    return left.unionByName(right).repartitionById(shards * parts, task.cast("int")).sortWithinPartitions("shard", "part", "role").mapInArrow(per_task(run), schema)


def matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def prepared(embeddings: DataFrame, keep_ids: int = 1) -> tuple[DataFrame, DataFrame, list[tuple[int, int]]]:
    """(rows without vectors, distinct vectors with their dimension, the number of these by dimension).

    Vectors of unlike dimensions cannot be compared; each dimension is a table of its own."""
    rows = keyed(embeddings)
    unique = materialize(distinct(rows, keep_ids).withColumn("dim", F.size("v")))
    sizes = unique.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect()
    return rows.select("vec_id", "ok", "h1", "h2"), unique, [(r["dim"], r["n"]) for r in sizes]
