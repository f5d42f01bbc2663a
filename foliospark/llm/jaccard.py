"""Operator 10: Jaccard join of documents' word shingles by an R-tree over count vectors.

A document's shingles are hashed into groups; the counts of the groups are a point.  The overlap
of two documents is at most the sum of the smaller of their counts, group by group, and for a
node of the tree the sum against its largest counts, so nodes and points that cannot reach the
threshold are passed over and only the others' sets are compared.

Trees stand in buckets that cannot miss a pair.  In any one order of all shingles, two sets that link share one of
their first n - ceil(n * percent / 100) + 1; those, each with the class of the set's size, are a document's marks, and a bucket
holds documents of one mark.  The order puts shingles that are frequent in a sample last, then goes by hash: the sample
makes buckets small, while no pair depends on it.  Equal sets are one point.

Buckets are compared in rounds.  At first a document goes to one of its marks only, which joins most copies;
from then on marks whose documents are all in one component need no comparison.  At the end every other mark is a bucket
with all its documents (marks with the same documents once).  Buckets above ``block`` documents are split, and blocks
compared two by two, but for those that hold one component.  Only points travel at first; the documents for which the bounds leave a
partner then come with their sets.  Overlaps are counted on 64-bit hashes of the shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.anchors import LAST_ID, small
from foliospark.llm.common import WordHashes, materialize, per_task
from foliospark.llm.components import components

WORDS, PERCENT, BLOCK, LEAF, FAN, BROADCAST_ROWS = 3, 90, 1024, 16, 8, 1_000_000
#: Shingles of the documents in a block, about.
BLOCK_SHINGLES = 2_000_000
#: Documents of the sample (at least so many, or this share of all), and shingles that count as frequent.
SAMPLE, SAMPLE_SHARE, FREQUENT = 50_000, 0.001, 1 << 18


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS, hashes: WordHashes | None = None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text (A-Z lower-cased, cut at ASCII white space)."""
    own = (text or "").encode().lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    h = (WordHashes(0) if hashes is None else hashes).of(own)
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = _mix(out + h[i : len(h) - size + 1 + i])
    return np.unique(out)


class Order:
    """An order of all shingles: frequent ones last, by classes of their counts, then by hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        by = np.argsort(hashes)
        self.hashes = hashes[by]
        self.kinds = np.log2(np.maximum(counts[by], 1)).astype(np.int8) + 1

    def marks(self, own: np.ndarray, percent: int) -> np.ndarray:
        """The first shingles of a set of which any set that links shares one."""
        n = len(own)
        first = n + percent * n // -100 + 1
        if not len(self.hashes):
            return own[:first]
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        kind = np.where(self.hashes[at] == own, self.kinds[at], 0)
        return own[np.argsort(kind, kind="stable")[:first]]


def frequent(docs: DataFrame, words: int, sample: int = SAMPLE, most: int = FREQUENT) -> Order:
    """Counts of the commonest shingles of a sample; the driver gets at most ``most`` of them."""
    share = max(sample / max(1, docs.count()), SAMPLE_SHARE)
    unit = F.pmod(F.xxhash64("text", "k"), F.lit(1_000_000)) / 1e6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                own = [shingles(t, words, hashes) for t in batch.column(0).slice(at, 1024).to_pylist()]
                h, n = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    found = docs.where(unit < share).select("text").mapInArrow(per_task(run), "h long, n long")
    top = found.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.col("n").desc(), "h").limit(most).toArrow()
    return Order(top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy())


def groups_of(n: int) -> int:
    """Groups of a point of n shingles: about four shingles each."""
    return min(1024, max(16, 1 << max(0, (n - 1) // 4).bit_length()))


def point(own: np.ndarray) -> bytes:
    groups = groups_of(len(own))
    counts = np.bincount((own & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return counts.astype(np.uint16 if len(own) < 1 << 16 else np.uint32).tobytes()


def unpacked(body: bytes, n: int) -> np.ndarray:
    return np.frombuffer(body, np.uint16 if n < 1 << 16 else np.uint32).astype(np.int32)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """The counts of fewer groups."""
    return counts.reshape(-1, groups).sum(axis=0)


def needed(percent: int, n: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The least overlap of sets of these sizes that link."""
    return -(-percent * (n + other) // (100 + percent))


class CountTree:
    """A packed R-tree over count vectors; its nodes also know whether all below are in one component."""

    def __init__(self, points: np.ndarray, n: np.ndarray, percent: int, labels: np.ndarray | None = None):
        self.percent, self.order = percent, self._packed(points)
        self.points, self.n = points[self.order], n[self.order]
        self.labels = np.unique(np.arange(len(n)) if labels is None else labels, return_inverse=True)[1][self.order]
        self.levels = []  # (points in a node, largest counts, least and greatest size), leaves first
        most, low, high, span = self.points, self.n, self.n, 1
        while len(most) > 1:
            fan = LEAF if span == 1 else FAN
            cuts = np.arange(0, len(most), fan)
            most, low, high, span = np.maximum.reduceat(most, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), span * fan
            self.levels.append((span, most, low, high))
        self.mark()

    @staticmethod
    def _packed(points: np.ndarray) -> np.ndarray:
        """An order in which neighbours are near: halves by the coordinate that varies most, down to leaves."""
        order, todo = np.arange(len(points)), [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= LEAF:
                continue
            own = points[order[a:b]]
            axis = int(own.astype(np.float32).var(axis=0).argmax())
            order[a:b] = order[a:b][np.argsort(own[:, axis], kind="stable")]
            mid = a + -(-(b - a) // 2 // LEAF) * LEAF
            todo += [(a, mid), (mid, b)]
        return order

    def mark(self) -> None:
        """Of each node the component of all its points, or -1."""
        self.whole = []
        for span, *_ in self.levels:
            cuts = np.arange(0, len(self.labels), span)
            low, high = np.minimum.reduceat(self.labels, cuts), np.maximum.reduceat(self.labels, cuts)
            self.whole.append(np.where(low == high, low, -1))

    def before(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Points before q in the order, of other components, whose bound reaches the threshold; and by how much it does."""
        n, p, own = int(self.n[q]), self.points[q], self.labels[q]
        least, most = -(-self.percent * n // 100), n * 100 // self.percent
        at = np.zeros(1, np.int64)
        for i in range(len(self.levels) - 1, -1, -1):
            span, counts, low, high = self.levels[i]
            at = at[(at * span < q) & (self.whole[i][at] != own) & (high[at] >= least) & (low[at] <= most)]
            bound = np.minimum(counts[at], p).sum(axis=1)
            at = at[bound >= needed(self.percent, n, np.maximum(low[at], least))]
            fan = LEAF if not i else FAN
            at = (at[:, None] * fan + np.arange(fan)).ravel()
            at = at[at < (len(self.n) if not i else len(self.levels[i - 1][1]))]
            if not len(at):
                return at, at
        at = at[(at < q) & (self.labels[at] != own) & (self.n[at] >= least) & (self.n[at] <= most)]
        spare = np.minimum(self.points[at], p).sum(axis=1) - needed(self.percent, n, self.n[at])
        return at[spare >= 0], spare[spare >= 0]


def may_link(n: np.ndarray, bodies: list[bytes], labels: np.ndarray, percent: int) -> np.ndarray:
    """A group for each point: points of other components that the bounds do not rule out are in its group; -1 if there are none.

    Points of about the same size have the same groups of shingles; those of more are folded beside those of fewer."""
    out = np.arange(len(n))
    some = np.zeros(len(n), bool)

    def join(at: np.ndarray) -> None:
        some[at] = True
        own = np.unique(out[at])
        if len(own) > 1:
            out[np.isin(out, own)] = own[0]

    points = [unpacked(b, int(m)) for b, m in zip(bodies, n, strict=True)]
    wide = np.array([len(p) for p in points])
    for groups in np.unique(wide).tolist():
        at = np.flatnonzero(wide == groups)
        at = np.append(at, np.flatnonzero((wide > groups) & (n * percent <= 100 * n[at].max())))
        if len(at) < 2 or labels[at].min() == labels[at].max():
            continue
        own = np.stack([folded(points[i], groups) for i in at])
        if len(at) <= 4 * LEAF:
            bound = np.minimum(own[:, None], own[None]).sum(axis=2)
            ok = (bound >= needed(percent, n[at][:, None], n[at][None])) & (labels[at][:, None] != labels[at][None])
            for i in np.flatnonzero(ok.any(axis=1)).tolist():
                join(np.append(at[ok[i]], at[i]))
            continue
        tree = CountTree(own, n[at], percent, labels[at])
        for q in range(1, len(at)):
            found, _ = tree.before(q)
            if len(found):
                join(at[tree.order[np.append(found, q)]])
    return np.where(some, out, -1)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def link_bucket(sets: list[np.ndarray], percent: int, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (positions) that connect all sets that are linked; sets known to be of one component are not compared."""
    if len(sets) < 2:
        return []
    groups = min(512, groups_of(max(map(len, sets))))
    points = np.stack([np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups) for s in sets]).astype(np.int32)
    tree, out = CountTree(points, np.array([len(s) for s in sets]), percent, labels), []
    for q in range(1, len(sets)):
        at, spare = tree.before(q)
        at = at[np.argsort(-spare, kind="stable")]
        while len(at):
            b, at = int(at[0]), at[1:]
            if linked(sets[tree.order[q]], sets[tree.order[b]], percent):
                out.append((int(tree.order[q]), int(tree.order[b])))
                tree.labels[tree.labels == tree.labels[b]] = tree.labels[q]
                tree.mark()
                at = at[tree.labels[at] != tree.labels[q]]
    return out


def tasks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each task in turn, without the task, from batches in order of tasks; equal rows once."""
    held: dict[tuple, None] = {}
    last = None
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for task, *row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                if task != last and held:
                    yield last, list(held)
                    held = {}
                last = task
                held[tuple(row)] = None
    if held:
        yield last, list(held)


class Join:
    """One Jaccard join of a table: its digests, its distinct sets, and the components of these."""

    def __init__(self, docs: DataFrame, words: int, percent: int, block: int, broadcast_rows: int, every_row: bool):
        self.words, self.percent, self.block, self.broadcast_rows = words, percent, block, broadcast_rows
        text = F.col("text").cast("string")
        k = F.col("doc_id").cast("long")
        self.docs = docs.select(F.coalesce(k, F.lit(LAST_ID)).alias("k"), F.xxhash64(text).alias("f"), text.alias("text"), k.isNull().alias("no_id"))
        self.rows = materialize(self._digests(frequent(self.docs, words)))
        told = self.rows.where("n > 0") if every_row else self.rows.where("n > 0 and not no_id")
        equal = told.groupBy("s1", "s2").agg(F.min(F.struct("k", "f")).alias("rep"))
        node = F.monotonically_increasing_id() if every_row else F.col("rep.k")
        self.equal = materialize(equal.select("s1", "s2", node.alias("id"), F.col("rep.k").alias("k"), F.col("rep.f").alias("f")))

    def _digests(self, order: Order) -> DataFrame:
        words, percent = self.words, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    n, s1, s2, points, marks = [], [], [], [], []
                    for text in part.column(3).to_pylist():
                        own = shingles(text, words, hashes)
                        h = xxhash.xxh3_128_intdigest(own)
                        n.append(len(own))
                        s1.append((h >> 64) - (1 << 63))
                        s2.append((h & ((1 << 64) - 1)) - (1 << 63))
                        points.append(point(own))
                        marks.append(order.marks(own, percent).view(np.int64) if len(own) else np.zeros(0, np.int64))
                    ends = pa.array(np.cumsum([0, *map(len, marks)]).astype(np.int32))
                    cols = [*part.columns[:3], pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(points, pa.binary())]
                    cols.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(marks))))
                    yield pa.RecordBatch.from_arrays(cols, names=["k", "f", "no_id", "n", "s1", "s2", "point", "marks"])

        schema = "k long, f long, no_id boolean, n long, s1 long, s2 long, point binary, marks array<long>"
        return self.docs.select("k", "f", "no_id", "text").mapInArrow(per_task(run), schema)

    def _compared(self, tasks: DataFrame, points: DataFrame) -> DataFrame:
        """Links (a, b) within each task of (id, label, task)."""
        words, percent = self.words, self.percent

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, rows in tasks_of(batches):
                ids, labels, n, bodies = zip(*rows, strict=True)
                group = may_link(np.array(n), list(bodies), np.array(labels), percent)
                ids, labels = np.array(ids), np.array(labels)
                for g in np.unique(group[group >= 0]).tolist():
                    at = np.flatnonzero(group == g)
                    # Named by its documents, so that a group that several marks bring is compared once.
                    task = xxhash.xxh3_64_intdigest(np.sort(ids[at]).tobytes()) - (1 << 63)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (np.full(len(at), task), ids[at], labels[at])], names=["task", "id", "label"])

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    own = [shingles(t, words, hashes).tobytes() for t in part.column(3).to_pylist()]
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(own, pa.binary())], names=["task", "id", "label", "own"])

        def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, rows in tasks_of(batches):
                got = link_bucket([np.frombuffer(r[2], np.uint64) for r in rows], percent, np.array([r[1] for r in rows]))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([rows[x[i]][0] for x in got], pa.int64()) for i in (0, 1)], names=["a", "b"])

        def by_task(df: DataFrame) -> DataFrame:
            return df.repartition("task").sortWithinPartitions("task")

        near = by_task(tasks.join(points, "id").select("task", "id", "label", "n", "point")).mapInArrow(per_task(bounds), "task long, id long, label long")
        near = materialize(near.distinct().join(self.equal.select("id", "k", "f"), "id"))
        held = self.docs.join(small(near, self.broadcast_rows), ["k", "f"]).select("task", "id", "label", "text").mapInArrow(per_task(sets), "task long, id long, label long, own binary")
        return by_task(held).mapInArrow(per_task(link), "a long, b long")

    def _sizes(self):
        """Two classes of sizes for each n, so that sets whose sizes let them link have one in common."""
        # A class is as wide as sizes of linked sets may differ; the margin is for what logarithms are off.
        own = F.floor(F.log(F.col("n")) / (math.log(100 / self.percent) + 1e-9) + 1e-9)
        return F.array(own, own + 1)

    def _blocks(self):
        return F.greatest(F.ceil(F.col("c") / self.block), F.ceil(F.col("s") / BLOCK_SHINGLES), F.lit(1)).cast("int")

    def _first_marks(self, shared: DataFrame, seed: int) -> DataFrame:
        """Every document at one of its marks, the least by a hash, in blocks of one mark."""
        one = shared.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("mark", F.lit(seed)).alias("o"), "mark", "n")).alias("p")).select("id", "label", "p.mark", "p.n")
        sizes = one.groupBy("mark").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
        block = F.pmod(F.xxhash64("id", F.lit(seed)), self._blocks())
        return one.join(sizes, "mark").select("id", "label", F.xxhash64("mark", block).alias("task"))

    def _all_marks(self, shared: DataFrame, sizes: DataFrame) -> DataFrame:
        """Every document at all marks that still join components; large buckets as pairs of blocks."""
        once = sizes.groupBy("c", "x1", "x2").agg(F.min("mark").alias("mark"), F.first("s").alias("s"))
        at = shared.join(once, "mark").select("id", "label", "mark", self._blocks().alias("blocks"))
        own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")))
        spread = at.withColumn("own", own).select("id", "label", "mark", F.explode(pairs).alias("pair")).select("id", "label", F.xxhash64("mark", "pair.i", "pair.j").alias("task"))
        mixed = spread.groupBy("task").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("task")
        return spread.join(mixed, "task")

    def groups(self) -> DataFrame:
        """id, component of the distinct sets that link with others."""
        same = (self.rows["s1"] == self.equal["s1"]) & (self.rows["s2"] == self.equal["s2"]) & (self.rows["k"] == self.equal["k"]) & (self.rows["f"] == self.equal["f"])
        reps = self.rows.join(self.equal, same)
        marks = reps.select("id", "n", F.explode("marks").alias("mark"))
        twice = materialize(marks.groupBy("mark").agg(F.count("*").alias("c")).where("c > 1").select("mark"))
        shared = marks.join(small(twice, self.broadcast_rows), "mark").select("id", "n", F.explode(F.transform(self._sizes(), lambda c: F.xxhash64("mark", c))).alias("mark"))
        shared = materialize(shared)
        twice = materialize(shared.groupBy("mark").agg(F.count("*").alias("c")).where("c > 1").select("mark"))
        shared = materialize(shared.join(small(twice, self.broadcast_rows), "mark").select("id", "n", "mark", F.col("id").alias("label")))
        points = reps.select("id", "n", "point").join(shared.select("id").distinct(), "id", "left_semi")
        points = materialize(points)
        links = found = None
        for seed in range(4):
            links = materialize(self._compared(self._first_marks(shared, seed), points))
            links = links if found is None else links.union(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
            found = materialize(components(links))
            sizes = shared.select("id", "n", "mark").join(found, F.col("id") == F.col("node"), "left").withColumn("label", F.coalesce("component", "id")).drop("node", "component")
            groups = sizes.groupBy("mark").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.min("label").alias("low"), F.max("label").alias("high"), F.bit_xor(F.xxhash64("id")).alias("x1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x2")).where("low <> high")
            groups = materialize(groups)
            shared = materialize(sizes.join(small(groups.select("mark"), self.broadcast_rows), "mark"))
            # Large buckets are worth another round at one mark; blocks of it mix what the last ones held apart.
            if not groups.where(self._blocks() > 1).limit(1).count():
                break
        links = materialize(self._compared(self._all_marks(shared, groups), points))
        if not links.limit(1).count():
            return found
        return components(links.union(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    def named(self) -> DataFrame:
        """s1, s2, component of every distinct set; the component is the least id."""
        found = self.groups()
        return self.equal.join(found, self.equal["id"] == found["node"], "left").select("s1", "s2", F.coalesce("component", "id").alias("component"))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of each row.

    Two documents link when 100 * intersection >= percent * union of their shingle sets.  No words or a
    null text: an empty set, linked with nothing.  Rows of one id count as one document of that
    component; a null id links with nothing and has a null component.  Extra columns are ignored; an empty table gives
    an empty result."""
    own = Join(docs, words, percent, block, broadcast_rows, every_row=False)
    out = own.rows.select("k", "no_id", "n", "s1", "s2").join(own.named(), ["s1", "s2"], "left")
    alone = F.when(F.col("n") > 0, F.col("component"))
    doc_id = F.when(~F.col("no_id"), F.col("k"))
    return out.select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(doc_id.isNotNull(), F.coalesce(alone, "k")).alias("component_id"))


def keep_one(docs: DataFrame, words: int, percent: int, block: int = BLOCK, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: one row of each component of texts stays, the one of the smallest id.

    Rows are told apart by id and text: rows of one id with unlike texts all stay, a null id is the greatest, and of
    rows that repeat an id and a text one stays.  Texts without words link with nothing and stay as they are."""
    own = Join(docs, words, percent, block, broadcast_rows, every_row=True)
    told = own.rows.where("n > 0").join(own.named(), ["s1", "s2"]).select("component", "k", "f")
    told = materialize(told.groupBy("component", "k", "f").agg(F.count("*").alias("c")))
    stays = told.groupBy("component").agg(F.min(F.struct("k", "f")).alias("first"))
    told = told.join(stays, "component").select("k", "f", "c", ((F.col("first.k") == F.col("k")) & (F.col("first.f") == F.col("f"))).alias("first"))
    odd = materialize(told.where("not first or c > 1").select(F.col("k").alias("__k"), F.col("f").alias("__f"), F.col("first").alias("__first")))
    keyed = docs.withColumns({"__k": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), "__f": F.xxhash64(F.col("text").cast("string"))})
    left = keyed.join(small(odd, broadcast_rows), ["__k", "__f"], "left_anti")
    again = keyed.join(small(odd.where("__first"), broadcast_rows), ["__k", "__f"], "left_semi").dropDuplicates(["__k", "__f"])
    return left.unionByName(again).select(docs.columns)
