"""Repeats of at least ``length`` units (bytes or words) across documents, found by winnowed anchors.

Every window of ``length`` units holds a gram of ``gram`` units whose hash is least in it (the
leftmost of equals), so equal windows have the same anchor at the same place.  The
windows of one anchor form a snippet of fewer than 2 * length units.  Steps:

1. one row an anchor: its hash h, a hash sh of the whole snippet, and where the snippet is;
2. only hashes that occur twice stay (a count with partial aggregation);
3. equal snippets collapse to one representative, the one in the smallest document; where all
   snippets of an anchor are equal nothing needs comparing;
4. the other representatives' text goes to shards.  All snippets of an anchor meet in one
   shard; anchors that first occur near each other share a shard, so the text that their
   snippets have in common is sent once; a kernel finds the windows that repeat;
5. the windows found, as ranges of positions, come back to every document that holds them.

Rows of documents are told apart by (k, fp): the id, with null as the greatest, and a 64-bit hash of
the text.  What goes to one row is bounded by its text: the snippets wanted of a document are one list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import BROADCAST_BYTES, materialize, per_task, stored_bytes

#: Rows that a broadcast side may have (about 60 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Units of the smallest document that share a shard, and symbols a kernel takes at once.
NEAR, BATCH = 4096, 400_000
CHUNK = 1 << 22
LAST_ID = (1 << 63) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def gram_hashes(units: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each ``gram`` units (a power of two) that start at a position."""
    h, size, base = units.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while size < gram:
        h = h[:-size] * np.uint64(base) + h[size:]
        base = base * base % (1 << 64)
        size *= 2
    return _mix(h)


def slide_min(a: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[: len(a) - (width - size)], a[width - size :]) if size < width else a


def anchors(units: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, first window, number of windows, anchor's offset in the first window), in pieces of a text.

    Pieces overlap so that each window lies in one; a window's anchor depends on the window alone."""
    n = len(units)
    for at in range(0, max(0, n - length + 1), CHUNK):
        part = units[at : at + CHUNK + length - 1]
        h = gram_hashes(part, gram)
        low = np.uint64(0xFFFFFF)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        pos = (slide_min(key, length - gram + 1) & low).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(pos)) + 1])
        yield h[pos[first]], first + at, np.diff(np.append(first, len(pos))), pos[first] - first


@dataclass(frozen=True)
class Repeats:
    """What differs between bytes and words.

    split: text -> units; numbers: makes, for a task, units -> array to hash; digest: (numbers, first, end) -> hash;
    cut: (units, first, end) -> bytes; kernel: regions in order of (k, fp, at) -> (h, sh, runs) with runs of windows,
    as (first, number) in the snippet, of the representative that repeat.  stays: which copy of a window does,
    none, all of the smallest ``id``, or the first ``place`` by (k, fp, position)."""

    length: int
    gram: int
    split: Callable
    numbers: Callable
    digest: Callable
    cut: Callable
    kernel: Callable
    stays: str


def keyed(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *(keep or []))
    return rows.select("doc_id", "text", *(keep or []), F.coalesce("doc_id", F.lit(LAST_ID)).alias("k"), F.xxhash64("text").alias("fp"))


ANCHOR = "h long, sh long, k long, fp long, st int, nw int, a int"
RUN = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))
ITEM = pa.struct([("h", pa.int64()), ("sh", pa.int64()), ("st", pa.int32()), ("nw", pa.int32()), ("a", pa.int32())])


def anchor_rows(docs: DataFrame, spec: Repeats) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered = spec.numbers()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                cols: list[list] = [[] for _ in range(7)]
                for text, k, fp in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    numbers = numbered(spec.split(text))
                    for h, st, nw, a in anchors(numbers, spec.length, spec.gram):
                        end = st + nw + spec.length - 1
                        sh = np.fromiter((spec.digest(numbers, s, e) for s, e in zip(st.tolist(), end.tolist(), strict=True)), np.uint64, len(st))
                        own = (h.view(np.int64), sh.view(np.int64), np.full(len(h), k), np.full(len(h), fp), *(x.astype(np.int32) for x in (st, nw, a)))
                        for c, x in zip(cols, own, strict=True):
                            c.append(x)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["h", "sh", "k", "fp", "st", "nw", "a"])

    return docs.select("text", "k", "fp").mapInArrow(per_task(run), ANCHOR)


def small(df: DataFrame, limit: int) -> DataFrame:
    """A table written before: a broadcast hint if its files and its counted rows are within their limits."""
    return F.broadcast(df) if limit and stored_bytes(df) <= BROADCAST_BYTES and df.count() <= limit else df


def windows(docs: DataFrame, spec: Repeats, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """k, fp, runs: the repeated windows of each document (docs as from ``keyed``), as (first, n) ranges of starts."""
    rows = materialize(anchor_rows(docs, spec))
    twice = materialize(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    rows = materialize(rows.join(small(twice, 4 * broadcast_rows), "h"))
    rep = F.struct("k", "fp", "st", "nw", "a")
    kinds = rows.groupBy("h", "sh").agg(F.count("*").alias("cnt"), F.min(rep).alias("rep"))
    kinds = materialize(kinds)
    groups = kinds.groupBy("h").agg(F.count("*").alias("ns"), F.min("rep").alias("root")).where("ns > 1")
    shard = F.xxhash64("root.k", "root.fp", F.floor(F.col("root.st") / NEAR))
    item = F.struct("h", "sh", F.col("rep.st").alias("st"), F.col("rep.nw").alias("nw"), F.col("rep.a").alias("a"))
    items = kinds.join(groups, "h").select(F.col("rep.k").alias("k"), F.col("rep.fp").alias("fp"), shard.alias("shard"), item.alias("item"))
    wanted = materialize(items.groupBy("k", "fp").agg(F.collect_list(F.struct("shard", "item")).alias("wanted")))
    regions = docs.select("k", "fp", "text").join(small(wanted, broadcast_rows // 4), ["k", "fp"])
    found = materialize(_compare(_regions(regions, spec), spec))
    # Written, so that the join below reads plain exchanges on both sides and adaptive execution can split a hot snippet.
    kinds = materialize(kinds.join(found, ["h", "sh"], "left").select("h", "sh", "cnt", "rep", "runs"))
    every = F.array(F.struct(F.col("st").alias("first"), F.col("nw").alias("n")))
    some = F.transform("runs", lambda r: F.struct((r["first"] + F.col("st")).alias("first"), r["n"].alias("n")))
    later = F.struct("k", "fp", "st") > F.struct("rep.k", "rep.fp", "rep.st")
    whole = {"none": F.col("cnt") > 1, "id": F.col("k") > F.col("rep.k"), "place": later}[spec.stays]
    placed = rows.join(kinds, ["h", "sh"]).select("k", "fp", F.when(whole, every).otherwise(some).alias("runs")).where("size(runs) > 0")
    return placed.groupBy("k", "fp").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def _stretches(items: list[dict], length: int) -> Iterator[tuple[int, int, list[dict]]]:
    """(first, end, items) of the stretches of units that the items' snippets cover together."""
    items = sorted({(i["h"], i["sh"], i["st"]): i for i in items}.values(), key=lambda i: i["st"])  # repeated rows count once
    i = 0
    while i < len(items):
        j, end = i + 1, items[i]["st"] + items[i]["nw"] + length - 1
        while j < len(items) and items[j]["st"] <= end:
            end = max(end, items[j]["st"] + items[j]["nw"] + length - 1)
            j += 1
        yield items[i]["st"], end, items[i:j]
        i = j


def _regions(docs: DataFrame, spec: Repeats) -> DataFrame:
    """The text that the wanted snippets of a document cover, one row a shard and stretch."""
    names = ["shard", "k", "fp", "at", "body", "items"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(ITEM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for k, fp, text, wanted in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    units = spec.split(text)
                    by: dict[int, list] = {}
                    for w in wanted:
                        by.setdefault(w["shard"], []).append(w["item"])
                    for s, own in by.items():
                        rows += [(s, k, fp, a, spec.cut(units, a, b), i) for a, b, i in _stretches(own, spec.length)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    schema = "shard long, k long, fp long, at int, body binary, items array<struct<h:long,sh:long,st:int,nw:int,a:int>>"
    return docs.select("k", "fp", "text", "wanted").mapInArrow(per_task(run), schema)


def _compare(regions: DataFrame, spec: Repeats) -> DataFrame:
    def flush(held: list[dict]) -> pa.RecordBatch:
        held = list({(r["shard"], r["k"], r["fp"], r["at"]): r for r in held}.values())  # repeated rows count once
        held.sort(key=lambda r: (r["k"], r["fp"], r["at"]))
        out = [x for x in spec.kernel(held) if x[2]]
        runs = [[{"first": a, "n": n} for a, n in x[2]] for x in out]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array(runs, RUN)], names=["h", "sh", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size, last = 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    if size >= BATCH and row["shard"] != last:
                        yield flush(held)
                        held, size = [], 0
                    held.append(row)
                    size += len(row["body"])
                    last = row["shard"]
        if held:
            yield flush(held)

    return regions.repartition("shard").sortWithinPartitions("shard").mapInArrow(per_task(run), "h long, sh long, runs array<struct<first:int,n:int>>")


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, number) of each stretch of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [(a, b - a) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def merged(runs: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """[first, end) stretches of units that the windows cover."""
    out: list[list[int]] = []
    for a, b in sorted((r["first"], r["first"] + r["n"] + length - 1) for r in runs or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def with_windows(docs: DataFrame, found: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, text, runs and the kept columns of every row; the join shuffles both sides on the row's key."""
    return docs.join(found, ["k", "fp"], "left").select("doc_id", "text", "runs", *(keep or []))
