"""Operator 2: interleaving sources at target weights by Pfair scheduling.

Documents of a source form blocks of ``block_docs``.  With weight w, block j may start at
floor(j / w) and must start before ceil((j + 1) / w); earliest deadline first then keeps
every source within one block of its share at every moment.  Weights are taken as the exact
fractions that they are, so rounding adds up to nothing however long a phase is.  The driver deals
the blocks ``period`` slots at a time and writes them as a table with a row a block.  When a
source runs out, the others' weights are scaled up and a new phase begins, so no row is lost.

Ranks within a source are counted in buckets of a hash (counts, then running sums of counts,
then ranks within a bucket), so that no task ever holds a whole source.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm.anchors import small
from foliospark.llm.common import materialize

BLOCK, PERIOD, BUCKET_ROWS, HEX, BROADCAST_ROWS = 64, 262_144, 4_000, 8, 1_000_000


def quantise(weights: dict, period: int) -> dict:
    """Whole shares of the period, at least 1 each, by largest remainder; ties by name.  For schedules that repeat; ``schedule`` does not round."""
    total = sum(weights.values())
    exact = {k: w / total * period for k, w in weights.items()}
    q = {k: max(1, math.floor(x)) for k, x in exact.items()}
    order = sorted(exact, key=lambda k: (-(exact[k] - math.floor(exact[k])), str(k)))
    i = 0
    while sum(q.values()) < period:
        q[order[i % len(order)]] += 1
        i += 1
    while sum(q.values()) > period:
        big = max(q, key=lambda k: (q[k], str(k)))
        q[big] -= 1
    return q


def dealt(q: dict, total: int) -> Iterator[tuple]:
    """(source, block, release, deadline) of slots 0, 1, 2, ... at weights q / total: earliest deadline first among the released blocks."""
    waiting = [(0, str(k), k, 0) for k in q]  # release
    heapq.heapify(waiting)
    ready: list = []
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            _, name, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // q[k]), name, k, j))
        deadline, name, k, j = heapq.heappop(ready)
        yield k, j, j * total // q[k], deadline
        heapq.heappush(waiting, ((j + 1) * total // q[k], name, k, j + 1))
        t += 1


def edf(q: dict, period: int) -> dict:
    """Slot of each block of one period."""
    slots: dict = {k: [] for k in q}
    for t, (k, *_) in enumerate(islice(dealt(q, period), period)):
        slots[k].append(t)
    return slots


def schedule(blocks: dict, weights: dict) -> Iterator[tuple]:
    """(source, block, phase, release, deadline, slot) of every block in order of slots."""
    left = {k: n for k, n in blocks.items() if n > 0}
    done, base, phase = dict.fromkeys(left, 0), 0, 0
    while left:
        exact = {k: Fraction(weights[k]) for k in left}
        unit = math.lcm(*(w.denominator for w in exact.values()))
        q = {k: int(w * unit) for k, w in exact.items()}
        first = dict(done)
        for t, (k, j, release, deadline) in enumerate(dealt(q, sum(q.values()))):
            yield k, first[k] + j, phase, base + release, base + deadline, base + t
            done[k] += 1
            left[k] -= 1
            if not left[k]:
                del left[k]
                base += t + 1
                break
        phase += 1


def temper(counts: dict, power: float = 0.5) -> dict:
    """Default target weights: sizes to a power below 1, which lifts small sources."""
    return {k: n**power for k, n in counts.items()}


def interleave(docs: DataFrame, weights: dict | None = None, block_docs: int = BLOCK, period: int = PERIOD, carry: list[str] | None = None) -> DataFrame:
    """doc_id, source, block, phase, release, deadline, slot of every row.

    ``weights`` maps sources to positive numbers (default: square root of their sizes; a source
    without a weight gets the least one given).  A null source is a source of its own, and
    rows with a null doc_id come first in theirs.  Repeated rows each take a place.  An empty table gives an
    empty result.  Columns named in ``carry`` go along; others are ignored.  The driver holds one count a source and
    ``period`` slots."""
    spark: SparkSession = docs.sparkSession
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null")).alias("k"), key.alias("h"), *(carry or []))
    counts = {r["k"]: r["n"] for r in docs.select(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null")).alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect()}
    given = {("null" if k is None else f"s{k}"): w for k, w in weights.items()} if weights else temper(counts)
    share = {k: given.get(k, min(given.values())) for k in counts}
    slots = schedule({k: -(-n // block_docs) for k, n in counts.items()}, share)
    kind = pa.schema([("k", pa.string()), *((c, pa.int64()) for c in ("block", "phase", "release", "deadline", "slot"))])
    plans = spark.createDataFrame([], "k string, block long, phase long, release long, deadline long, slot long")
    while part := list(islice(slots, period)):
        plans = plans.union(materialize(spark.createDataFrame(pa.table(list(zip(*part, strict=True)), schema=kind))))
    n_buckets = max(1, -(-sum(counts.values()) // BUCKET_ROWS))
    bucket = F.floor(F.conv(F.substring("h", 1, HEX), 16, 10).cast("long") * n_buckets / 16**HEX)
    rows = rows.withColumn("bucket", bucket)
    sizes = rows.groupBy("k", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("k", "bucket", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("k", "bucket").orderBy("h", "doc_id")) - 1
    ranked = rows.withColumn("within", within).join(offsets, ["k", "bucket"]).select("doc_id", "source", *(carry or []), "k", F.floor((F.col("before") + F.col("within")) / block_docs).alias("block"))
    placed = ranked.join(small(plans, BROADCAST_ROWS), ["k", "block"])
    return placed.select("doc_id", "source", *(carry or []), "block", F.col("phase").cast("int").alias("phase"), "release", "deadline", "slot")
