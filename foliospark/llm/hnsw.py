"""Operator 1: near-duplicate embeddings by hierarchical navigable small-world graphs.

Every shard holds a graph; of two vectors in unlike shards one asks the other's graph, and within a shard all ask.  Many
queries walk a graph in step: each has a beam of the best nodes seen, and all neighbours of a step are compared in one array
operation.  A query whose beam holds nothing but links lies in a dense group and is compared with the whole shard, a few rows at a
time.  A sample of the queries, bounded for each task, is compared with brute force over the shard (the audit), by classes of
queries with about as many links, so that a large group does not hide what small ones miss; while too few of the true links of
any class are found, all beams widen, up to the whole shard.  Links are verified as cosines in double precision.  Tasks keep
components as labels of their nodes; only a spanning forest leaves them, beside the numbers of links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.components import components
from foliospark.llm.common import materialize
from foliospark.llm.vectors import by_shard, half_of_shards, prepared, shard_of

COSINE, LINKS, BUILD_BEAM, BEAM, SHARD, SHARDS, RECALL = 0.9, 12, 32, 16, 65_536, 4, 0.995
#: One of so many queries is audited, but no more than so many of a task (about).
AUDIT, AUDITS = 16, 2048
#: Wider beams cost more than a comparison with the whole shard, which takes their place.
WIDEST = 256
QUERIES_A_TASK = 2_000_000
#: Pairs that are looked at in one step.
SLICE = 1 << 19


class Graph:
    """Layers of neighbour lists over unit vectors; built by inserting growing batches."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, weights: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM):
        self.ids, self.weights = ids, weights
        self.unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
        self.fast = self.unit.astype(np.float32)
        n = len(ids)
        # A node's layer comes from a hash of its id: geometric with ratio 1 / links.
        u = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        level = np.floor(-np.log(np.maximum(u, 1e-12)) / math.log(links)).astype(np.int64)
        order = np.argsort(-level, kind="stable")
        self.ids, self.weights, self.unit, self.fast, level = ids[order], weights[order], self.unit[order], self.fast[order], level[order]
        self.layers = []  # of upper layers the first m nodes are members, as nodes are in order of level
        above: list[tuple[np.ndarray, int]] = []
        for top in range(int(level[0]), -1, -1):
            m = int((level >= top).sum())
            width = links * 2 if top == 0 else links
            self.layers = above + [(np.full((m, width), -1, np.int32), m)]
            self._fill(self.layers[-1][0], m, width, beam, above)
            above = self.layers

    def _fill(self, near: np.ndarray, m: int, width: int, beam: int, above: list) -> None:
        done = 0
        while done < m:
            size = min(max(1, done), 512, m - done)
            new = np.arange(done, done + size)
            q = self.fast[new]
            own = q @ q.T
            np.fill_diagonal(own, -2.0)
            own[np.triu_indices(size)] = -2.0  # earlier ones of the batch only
            k = min(size, beam)
            best = np.argpartition(-own, k - 1, axis=1)[:, :k]
            cand, sim = new[best], np.take_along_axis(own, best, axis=1)
            if done:
                found, s = self._walk(q, self._start(q, above, done), near, beam, done)
                cand, sim = np.concatenate([found, cand], axis=1), np.concatenate([s, sim], axis=1)
            cand = np.where(sim > -1.5, cand, -1)
            chosen, s = self._diverse(cand, sim, width // 2 if width > LINKS else width)
            near[new, : chosen.shape[1]] = chosen
            self._back(near, new, chosen, s, width)
            done += size

    def _diverse(self, cand: np.ndarray, sim: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row's candidates the best that are nearer to the row's node than to one already taken; then the best others."""
        order = np.argsort(-sim, axis=1, kind="stable")
        cand, sim = np.take_along_axis(cand, order, axis=1), np.take_along_axis(sim, order, axis=1)
        vec = self.fast[np.maximum(cand, 0)]
        pair = np.matmul(vec, vec.transpose(0, 2, 1))
        rows, width = cand.shape
        taken = np.zeros((rows, width), bool)
        count = np.zeros(rows, np.int64)
        for j in range(width):
            free = (cand[:, j] >= 0) & (count < keep)
            clash = (taken & (pair[:, j, :] > sim[:, j, None])).any(axis=1)
            taken[:, j] = free & ~clash
            count += taken[:, j]
        rank = np.where(taken, 0, 1) * width + np.arange(width)
        order = np.argsort(np.where(cand >= 0, rank, 9 * width), axis=1, kind="stable")[:, :keep]
        return np.take_along_axis(cand, order, axis=1), np.take_along_axis(sim, order, axis=1)

    def _back(self, near: np.ndarray, new: np.ndarray, chosen: np.ndarray, sim: np.ndarray, width: int) -> None:
        """Links back from the chosen nodes; where they have no room the diverse best stay."""
        at, j = np.nonzero(chosen >= 0)
        to, source, s = chosen[at, j], new[at], sim[at, j]
        order = np.lexsort((-s, to))
        to, source = to[order], source[order]
        first = np.flatnonzero(np.diff(to, prepend=-1))
        rank = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
        nodes = to[first]
        most = min(int(rank.max()) + 1, width) if len(rank) else 0
        more = np.full((len(nodes), most), -1, np.int64)
        ok = rank < most
        more[np.searchsorted(nodes, to[ok]), rank[ok]] = source[ok]
        have = (near[nodes] >= 0).sum(axis=1)
        room = have + (more >= 0).sum(axis=1) <= width
        easy = np.flatnonzero(room)
        if len(easy):
            r, c = np.nonzero(more[easy] >= 0)
            near[nodes[easy][r], have[easy][r] + c] = more[easy][r, c]
        hard = np.flatnonzero(~room)
        for i in range(0, len(hard), 1024):
            h = hard[i : i + 1024]
            both = np.concatenate([near[nodes[h]], more[h]], axis=1)
            sims = np.where(both >= 0, np.einsum("ijk,ik->ij", self.fast[np.maximum(both, 0)], self.fast[nodes[h]]), -2.0)
            kept, _ = self._diverse(both, sims, width)
            near[nodes[h]] = -1
            near[nodes[h], : kept.shape[1]] = kept

    def _start(self, q: np.ndarray, above: list, limit: int) -> np.ndarray:
        """Entry nodes from the layers above: a greedy walk with a beam of 1 (4 here, as wide as a step)."""
        entry = np.zeros((len(q), 1), np.int64)
        for near, m in above:
            entry = self._walk(q, entry, near, 4, m)[0][:, :1]
        return np.where(entry < limit, entry, 0)

    def _walk(self, q: np.ndarray, entry: np.ndarray, near: np.ndarray, beam: int, limit: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The beams (nodes, similarities; best first) of all queries in one layer."""
        rows = len(q)
        seen = np.zeros((rows, limit), bool)
        nodes = np.full((rows, beam), -1, np.int64)
        sims = np.full((rows, beam), -2.0, np.float32)
        opened = np.ones((rows, beam), bool)
        k = entry.shape[1]
        nodes[:, :k], opened[:, :k] = entry, False
        sims[:, :k] = np.einsum("ijk,ik->ij", self.fast[entry], q)
        np.put_along_axis(seen, entry, True, axis=1)
        live = np.arange(rows)
        while len(live):
            s = np.where(opened[live], -3.0, sims[live])
            w = min(step, beam)
            pick = np.argpartition(-s, w - 1, axis=1)[:, :w] if w < beam else np.argsort(-s, axis=1)[:, :w]
            good = np.take_along_axis(s, pick, axis=1) > -1.5
            some = good.any(axis=1)
            live, pick, good = live[some], pick[some], good[some]
            if not len(live):
                break
            opened[live[:, None], pick] = True
            hop = np.where(good[:, :, None], near[np.maximum(nodes[live[:, None], pick], 0)], -1).reshape(len(live), -1)
            fresh = (hop >= 0) & (hop < limit)
            fresh &= ~seen[live[:, None], np.where(fresh, hop, 0)]
            r, c = np.nonzero(fresh)
            if not len(r):
                continue
            x = hop[r, c]
            key = np.unique(r * np.int64(limit) + x)
            r, x = key // limit, key % limit
            seen[live[r], x] = True
            got = np.einsum("ij,ij->i", self.fast[x], q[live[r]])
            better = got > sims[live[r]].min(axis=1)
            r, x, got = r[better], x[better], got[better]
            if not len(r):
                continue
            first = np.flatnonzero(np.diff(r, prepend=-1))
            rank = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
            rows_in = r[first]
            wide = int(rank.max()) + 1
            more = np.full((len(rows_in), wide), -1, np.int64)
            more_s = np.full((len(rows_in), wide), -2.0, np.float32)
            at = np.searchsorted(rows_in, r)
            more[at, rank], more_s[at, rank] = x, got
            to = live[rows_in]
            all_n, all_s = np.concatenate([nodes[to], more], axis=1), np.concatenate([sims[to], more_s], axis=1)
            all_o = np.concatenate([opened[to], more < 0], axis=1)
            top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            nodes[to], sims[to], opened[to] = (np.take_along_axis(y, top, axis=1) for y in (all_n, all_s, all_o))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(nodes, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        near, m = self.layers[-1]
        return self._walk(q, self._start(q, self.layers[:-1], m), near, min(beam, m), m)


class Linker:
    """Finds the links of queries in one shard, widening beams until the audit passes."""

    def __init__(self, shard: int, ids: np.ndarray, vectors: np.ndarray, weights: np.ndarray, cosine: float, every: int = AUDIT):
        self.shard, self.cosine, self.beam, self.every = shard, cosine, BEAM, every
        self.graph = g = Graph(ids, vectors, weights)
        self.near = max(1e-5, 4e-7 * vectors.shape[1])  # what single precision may be off
        self.true = self.missed = np.zeros(64)  # links of all audited queries so far, by class
        self.by_id = np.argsort(g.ids)
        self.labels = np.arange(len(g.ids))  # of each node the least node of its component
        self.heard = np.zeros(len(g.ids), np.int64)  # links that queries of other shards found to a node

    def verified(self, unit: np.ndarray, a: np.ndarray, b: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Which pairs link: by double precision where single precision cannot tell."""
        ok = sims >= self.cosine + self.near
        for i in np.array_split(at := np.flatnonzero(np.abs(sims - self.cosine) < self.near), len(at) // 65_536 + 1):
            ok[i] = np.einsum("ij,ij->i", unit[a[i]], self.graph.unit[b[i]]) >= self.cosine
        return ok

    def scanned(self, unit: np.ndarray, todo: np.ndarray, own: np.ndarray):
        """(rows, which nodes link to them) of queries against the whole shard, a few rows at a time."""
        g = self.graph
        step = max(1, SLICE // len(g.ids))
        for i in range(0, len(todo), step):
            rows = todo[i : i + step]
            sims = unit[rows].astype(np.float32) @ g.fast.T
            found = sims >= self.cosine + self.near
            r, c = np.nonzero(np.abs(sims - self.cosine) < self.near)
            found[r, c] = self.verified(unit, rows[r], c, sims[r, c])
            at = np.flatnonzero(own[rows] >= 0)
            found[at, own[rows[at]]] = False
            yield rows, found

    def links(self, unit: np.ndarray, own: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node) pairs that link, and the queries whose whole beam does; own: a query's own node, or -1."""
        g = self.graph
        if beam > WIDEST or beam >= len(g.ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.arange(len(unit))
        nodes, sims = g.search(unit.astype(np.float32), beam)
        full = (nodes[:, -1] >= 0) & (sims[:, -1] >= self.cosine - self.near)
        a, j = np.nonzero((nodes >= 0) & (sims >= self.cosine - self.near) & ~full[:, None])
        b, s = nodes[a, j], sims[a, j]
        ok = self.verified(unit, a, b, s) & (own[a] != b)
        return a[ok], b[ok], np.flatnonzero(full)

    def union(self, a: np.ndarray, b: np.ndarray, own: np.ndarray) -> None:
        """Nodes that link to one query, and the query if it is a node, are of one component."""
        label = self.labels[b]
        pairs = np.unique(np.concatenate([a, a[own[a] >= 0]]) * len(self.labels) + np.concatenate([label, self.labels[own[a[own[a] >= 0]]]]))
        of = pairs // len(self.labels)
        some = np.flatnonzero((of[1:] == of[:-1]))
        for x, y in zip((pairs[some] % len(self.labels)).tolist(), (pairs[some + 1] % len(self.labels)).tolist(), strict=True):
            x, y = self.labels[x], self.labels[y]
            if x != y:
                self.labels[self.labels == max(x, y)] = min(x, y)

    def __call__(self, ids: np.ndarray, vectors: np.ndarray, weights: np.ndarray, asked_by_own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(links, a node that links or -1) of each query; nodes are joined and hear of links on the way."""
        g, n = self.graph, len(ids)
        unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
        at = np.minimum(np.searchsorted(g.ids, ids, sorter=self.by_id), len(g.ids) - 1)
        own = np.where(asked_by_own, self.by_id[at], -1)
        sample = np.flatnonzero(((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(self.every) == 0)
        truth = np.zeros(n, np.int64)
        for rows, found in self.scanned(unit, sample, own):
            truth[rows] = found.sum(axis=1)
        kind = np.log2(np.maximum(truth[sample], 1)).astype(np.int64)
        true = self.true + np.bincount(kind, weights=truth[sample], minlength=64)
        while True:
            a, b, dense = self.links(unit, own, self.beam)
            have = np.bincount(a, minlength=n)
            have[dense] = truth[dense]  # they are compared with all
            off = np.bincount(kind, weights=np.maximum(truth - have, 0)[sample], minlength=64)
            # A class passes if this batch misses none of it, or if few enough are missed over all audited queries.
            if self.beam > WIDEST or ((off == 0) | (self.missed + off <= (1 - RECALL) * true)).all():
                self.true, self.missed = true, self.missed + off
                break
            self.beam *= 2
        count, to = np.bincount(a, weights=g.weights[b], minlength=n), np.full(n, -1)
        to[a] = b
        self.union(a, b, own)
        other = own < 0
        self.heard += np.bincount(b, weights=(weights * other)[a], minlength=len(g.ids)).astype(np.int64)
        for rows, found in self.scanned(unit, dense, own):
            count[rows] = found @ g.weights
            some = found.any(axis=1)
            to[rows[some]] = found[some].argmax(axis=1)
            self.heard += (weights * other)[rows] @ found
            hit = np.unique(np.append(self.labels[found.any(axis=0)], self.labels[own[rows[some & (own[rows] >= 0)]]]))
            if len(hit) > 1:
                r, c = np.nonzero(found)
                self.union(rows[r], c, own)
        return count.astype(np.int64), to


def links_of(vectors: DataFrame, n: int, shards: int, cosine: float) -> DataFrame:
    """a, b, n_links: numbers of links of distinct vectors (b null), and links (a, b) that connect all that are linked."""
    parts = max(1, -(-n // QUERIES_A_TASK))
    every = max(AUDIT, n * (shards + 1) // (2 * shards * parts * AUDITS))
    names = ["a", "b", "n_links"]

    def told(ids: np.ndarray, count: np.ndarray, links: tuple[np.ndarray, np.ndarray]) -> list[pa.RecordBatch]:
        has = np.flatnonzero(count)
        none = pa.nulls(len(has), pa.int64())
        counts = pa.RecordBatch.from_arrays([pa.array(ids[has], pa.int64()), none, pa.array(count[has], pa.int64())], names=names)
        a, b = links
        return [counts, pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.zeros(len(a), np.int64))], names=names)]

    def build(shard: int, ids: np.ndarray, v: np.ndarray, others: list[pa.Array]) -> Linker:
        return Linker(shard, ids, v, others[0].to_numpy(), cosine, every)

    def ask(own: Linker, ids: np.ndarray, v: np.ndarray, others: list[pa.Array]) -> list[pa.RecordBatch]:
        count, to = own(ids, v, others[0].to_numpy(), others[1].to_numpy() == own.shard)
        at = np.flatnonzero((to >= 0) & (others[1].to_numpy() != own.shard))
        return told(ids, count, (ids[at], own.graph.ids[to[at]]))

    def done(own: Linker) -> list[pa.RecordBatch]:
        at = np.flatnonzero(own.labels != np.arange(len(own.labels)))
        return told(own.graph.ids, own.heard, (own.graph.ids[at], own.graph.ids[own.labels[at]]))

    rows = vectors.withColumn("home", shard_of(shards))
    return by_shard(rows, rows, shards, parts, ["n", "home"], half_of_shards(shards), "a long, b long, n_links long", build, ask, done)


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, shards: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row.

    Null, zero and non-finite vectors link with nothing, and vectors of unlike dimensions not with each other; equal vectors link
    with each other; a null id takes no part and has a null component.  Repeated rows count as different vectors.
    Extra columns are ignored; an empty table gives an empty result."""
    rows, unique, sizes = prepared(embeddings)
    found = unique.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).cast("long").alias("n_links")).where("false")
    for dim, n in sizes:
        own = unique.where(F.col("dim") == dim).select("id", "v", "n")
        found = found.unionByName(materialize(links_of(own, n, shards or max(SHARDS, -(-n // SHARD)), cosine)))
    counts = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n_links").alias("others"))
    groups = components(found.where("b is not null"))
    named = unique.select("id", "n", "h1", "h2").join(counts, "id", "left").join(groups, F.col("id") == F.col("node"), "left")
    named = named.select("h1", "h2", F.lit(True).alias("ok"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.join(named, ["h1", "h2", "ok"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
