"""Operator 3: nearest neighbours by inner product with multi-index hashing.

Vectors get one more coordinate that makes their lengths equal, so the largest inner product is the
smallest angle.  Rotations learned on a bounded sample (iterative quantisation: alternate signs
and the rotation that best fits them) give binary codes.  A shard cuts its codes into 16-bit substrings and lists its
vectors by the value of each; a code within radius r of the query agrees with it in some substring up to
floor(r / substrings) bits, so probing those values in every list finds all of them.  Where that is more work
than comparing all codes of the shard, these are compared, which retrieves the same ones.  A query's radius is the least that
holds ``want`` codes; their vectors are ranked by the exact product in double precision.

How many are wanted is audited in every shard: some of its vectors are asked and compared with brute force, and
``want`` doubles until the recall is reached (at the latest when the whole shard is wanted).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm.vectors import by_shard, every_shard, prepared

TOP, EVERY, BITS, SAMPLE, ROUNDS, SHARD, SHARDS, AUDITS, RECALL = 20, 20, 256, 4096, 12, 65_536, 6, 128, 0.97
QUERIES_A_TASK = 200_000
#: Looking up a value costs about as much as comparing so many codes.
PROBE = 16
#: Values of a substring in order of their bits, and how many have up to so many.
BY_BITS = np.argsort(np.bitwise_count(np.arange(1 << 16, dtype=np.uint16)), kind="stable").astype(np.uint16)
UP_TO = np.cumsum(np.bincount(np.bitwise_count(np.arange(1 << 16, dtype=np.uint16)), minlength=17))


def augmented(vectors: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, longest**2 - (vectors * vectors).sum(axis=1)))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def learn(sample: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection to ``bits``): as many rotations as needed, each fitted to its own signs."""
    rng, dim = np.random.default_rng(seed), sample.shape[1]
    mean = sample.mean(axis=0)
    centred, out = sample - mean, []
    while sum(r.shape[1] for r in out) < bits:
        r = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(centred @ r >= 0, 1.0, -1.0).T @ centred)
            r = (u @ w).T
        out.append(r)
    return mean, np.concatenate(out, axis=1)[:, :bits]


class MultiIndex:
    """The codes of a shard, listed by the values of their substrings."""

    def __init__(
        self, vectors: np.ndarray, groups: list[list[int]], mean: np.ndarray, rotation: np.ndarray, longest: float, top: int, recall: float = RECALL, audits: int = AUDITS
    ):
        self.vectors, self.groups, self.mean, self.rotation, self.top = vectors, groups, mean, rotation, top
        codes = self.code(augmented(vectors, longest))
        self.words, parts = codes.view(np.uint64), codes.view(np.uint16)
        self.substrings = parts.shape[1]
        self.lists = []
        for j in range(self.substrings):
            order = np.argsort(parts[:, j], kind="stable").astype(np.int32)
            self.lists.append((order, np.searchsorted(parts[order, j], np.arange((1 << 16) + 1)).astype(np.int32)))
        self.probed = self.asked = self.reranked = 0  # values or codes looked at, queries, vectors ranked
        self.want = self._audited(recall, audits)

    def code(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.mean) @ self.rotation >= 0, axis=1)

    def _audited(self, recall: float, audits: int) -> int:
        n, want = len(self.vectors), 4 * self.top
        at = np.unique(np.linspace(0, n - 1, min(n, audits)).astype(np.int64))
        asked = self.vectors[at]
        codes = self.code(np.concatenate([asked, np.zeros((len(at), 1))], axis=1))
        score = asked @ self.vectors.T
        score[np.arange(len(at)), at] = -np.inf
        k = min(self.top, n - 1)
        if not k:
            return n
        least = np.partition(score, n - k, axis=1)[:, n - k]
        while want < n:
            q, x = self.nearest_codes(codes, want)
            if ((score[q, x] >= least[q]) & (x != at[q])).sum() >= recall * k * len(at):
                return want
            want *= 2
        return n

    def distances(self, codes: np.ndarray) -> np.ndarray:
        own = codes.view(np.uint64)
        far = np.zeros((len(codes), len(self.words)), np.uint16)
        for w in range(own.shape[1]):
            far += np.bitwise_count(own[:, w, None] ^ self.words[None, :, w])
        return far

    def within(self, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, distance) of all codes within a radius, by probing the lists.

        A radius of m * a + b (m substrings, b < m) puts a code within a bits in one of the first b + 1
        substrings or within a - 1 in one of the others."""
        n, found = len(self.words), []
        parts = codes.view(np.uint16)
        for j, (order, cut) in enumerate(self.lists):
            reach = radius // self.substrings - (j > radius % self.substrings)
            if reach < 0:
                continue
            values = (parts[:, j, None] ^ BY_BITS[None, : UP_TO[min(reach, 16)]]).astype(np.int64)
            self.probed += values.size
            first, size = cut[values], cut[values + 1] - cut[values]
            q, v = np.nonzero(size)
            many, start = size[q, v], first[q, v]
            at = np.arange(many.sum()) + np.repeat(start - (np.cumsum(many) - many), many)
            found.append(np.unique(np.repeat(q, many) * np.int64(n) + order[at]))
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        q, x = both // n, both % n
        far = np.bitwise_count(self.words[x] ^ codes.view(np.uint64)[q]).sum(axis=1)
        return q[far <= radius], x[far <= radius], far[far <= radius]

    def nearest_codes(self, codes: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) of all codes within the least radius of each query that holds ``want``; grouped by query."""
        n, todo, out, radius = len(self.words), np.arange(len(codes)), [], 0
        while len(todo) and want < n:
            reach, more = divmod(radius, self.substrings)
            values = UP_TO[min(reach, 16)] * (more + 1) + (UP_TO[min(reach, 17) - 1] if reach else 0) * (self.substrings - more - 1)
            if values * PROBE > n:
                break  # comparing the codes themselves is less work
            q, x, far = self.within(codes[todo], radius)
            order = np.lexsort((far, q))
            q, x, far = q[order], x[order], far[order]
            first = np.searchsorted(q, np.arange(len(todo)))
            have = np.searchsorted(q, np.arange(len(todo)), side="right") - first
            done = have >= want
            edge = np.full(len(todo), -1, np.int64)
            edge[done] = far[first[done] + want - 1]
            keep = far <= edge[q]
            out.append((todo[q[keep]], x[keep]))
            todo = todo[~done]
            radius += self.substrings
        for i in range(0, len(todo), 64):
            part = todo[i : i + 64]
            far = self.distances(codes[part])
            self.probed += far.size
            edge = np.partition(far, want - 1, axis=1)[:, want - 1] if want < n else np.full(len(part), 1 << 15)
            q, x = np.nonzero(far <= edge[:, None])
            out.append((part[q], x))
        q, x = (np.concatenate(c) for c in zip(*out, strict=True))
        order = np.argsort(q, kind="stable")
        return q[order], x[order]

    def search(self, ids: np.ndarray, queries: np.ndarray, codes: np.ndarray) -> list[tuple[int, int, float]]:
        """(query id, vector id, product) of the ``top`` best of each query, with all that tie."""
        q, x = self.nearest_codes(codes, min(self.want, len(self.words)))
        self.asked, self.reranked = self.asked + len(ids), self.reranked + len(x)
        ends, out = np.searchsorted(q, np.arange(len(ids) + 1)), []
        for n in range(len(ids)):
            found = x[ends[n] : ends[n + 1]]
            score = self.vectors[found] @ queries[n]
            if len(found) > self.top:
                keep = score >= np.partition(score, len(score) - self.top - 1)[len(score) - self.top - 1]
                found, score = found[keep], score[keep]
            own = int(ids[n])
            best = [(y, s) for f, s in zip(found.tolist(), score.tolist(), strict=True) for y in self.groups[f] if y != own]
            best.sort(key=lambda z: (-z[1], z[0]))
            out += [(own, y, s) for y, s in best[: self.top]]
        return out


def nearest(embeddings: DataFrame, top: int = TOP, every: int = EVERY, bits: int = BITS, sample: int = SAMPLE, shards: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``top`` largest inner products of each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all other rows.  Ties go to the
    smaller id; fewer rows if there are fewer candidates.  Vectors that are null, zero or hold null or non-finite
    components, and null ids, take no part; vectors of unlike dimensions are no candidates for each other.  Rows that repeat an id
    are candidates only once a vector; an empty table gives an empty result.  The rotation is learned on about ``sample``
    vectors of a dimension, chosen by a hash."""
    rows, unique, sizes = prepared(embeddings, keep_ids=top + 1)
    queries = rows.where(F.col("ok") & (F.pmod("vec_id", F.lit(every)) == 0)).select("vec_id", "h1", "h2").distinct()
    queries = queries.join(unique.select("h1", "h2", "v", "dim"), ["h1", "h2"]).select(F.col("vec_id").alias("id"), "v", "dim")
    found = unique.select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    for dim, n in sizes:
        own = F.col("dim") == dim
        found = found.unionByName(_nearest(unique.where(own).select("id", "v", "ids"), queries.where(own).select("id", "v"), n, top, every, bits, sample, shards))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _nearest(index: DataFrame, queries: DataFrame, n: int, top: int, every: int, bits: int, sample: int, shards: int | None) -> DataFrame:
    """query_id, vec_id, score: the best of each shard, of vectors of one dimension."""
    longest = index.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).head()[0]
    unit = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1_000_000)) / 1e6
    few = index.where(unit < min(1.0, sample / n)).select("v").limit(2 * sample).collect() or index.select("v").limit(sample).collect()
    mean, rotation = learn(augmented(np.array([r["v"] for r in few]), longest), bits)
    shards = shards or max(SHARDS, -(-n // SHARD))

    def build(shard: int, ids: np.ndarray, vectors: np.ndarray, others: list[pa.Array]) -> MultiIndex:
        return MultiIndex(vectors, others[0].to_pylist(), mean, rotation, longest, top)

    def ask(own: MultiIndex, ids: np.ndarray, vectors: np.ndarray, others: list[pa.Array]) -> list[pa.RecordBatch]:
        codes = own.code(np.concatenate([vectors, np.zeros((len(vectors), 1))], axis=1))
        got = [x for i in range(0, len(ids), 128) for x in own.search(ids[i : i + 128], vectors[i : i + 128], codes[i : i + 128])]
        cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
        return [pa.RecordBatch.from_arrays(cols, names=["query_id", "vec_id", "score"])]

    parts = max(1, -(-n // (every * QUERIES_A_TASK)))
    return by_shard(index, queries, shards, parts, ["ids"], every_shard(shards), "query_id long, vec_id long, score double", build, ask)
