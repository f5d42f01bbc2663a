"""Operator 9: removal of repeated passages of words by seed and extend.

Documents are joined on winnowed anchors (``anchors``); from each anchor matches are extended
word by word both ways.  All copies of an anchor are extended at once: those that agree so far
form a class, and a class splits where its members' next words differ.  A window repeats where
a left and a right extension that together fill it are shared with a smaller document;
neighbouring windows make up the maximal repeats that are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from foliospark.llm import anchors as A
from foliospark.llm.common import WordHashes, per_task

LENGTH, GRAM = 50, 16


def _split(ids: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Classes refined by the next word; -1 marks those that have none."""
    out = np.full(len(ids), -1)
    live = np.flatnonzero((ids >= 0) & (words >= 0))
    if len(live):
        out[live] = np.unique((ids[live] << 32) | words[live], return_inverse=True)[1]
    return out


def _kernel(length: int, gram: int):
    def run(regions: list[dict]) -> list[tuple]:
        number: dict[bytes, int] = {}
        words, at, rows = [], 0, []
        for r in regions:
            own = r["body"].split()
            words.append(np.fromiter((number.setdefault(w, len(number)) for w in own), np.int64, len(own)))
            for i in r["items"]:
                first = at + i["st"] - r["at"]
                rows.append((i["h"], i["sh"], r["k"], first, i["nw"], i["a"]))
            at += len(own) + 1
            words.append(np.full(1, -1))
        text = np.concatenate([*words, np.full(length, -1)])
        h, sh, k, first, nw, a = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        start = np.unique(h, return_inverse=True)[1]
        seed, reach = first + a, length - gram
        left, right = [start], [start]
        for step in range(1, reach + 1):
            left.append(_split(left[-1], np.where(step <= a, text[seed - step], -1)))
            nxt = gram + step - 1
            right.append(_split(right[-1], np.where(seed + nxt < first + nw + length - 1, text[np.minimum(seed + nxt, len(text) - 1)], -1)))
        flags = np.zeros((len(rows), reach + 1), bool)
        for step in range(reach + 1):  # windows with ``step`` words before the anchor
            at_ = np.flatnonzero((left[step] >= 0) & (right[reach - step] >= 0) & (step <= a) & (a - step < nw))
            if len(at_):
                both = np.unique((left[step][at_] << 32) | right[reach - step][at_], return_inverse=True)[1]
                least = np.full(both.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, both, k[at_])
                flags[at_, a[at_] - step] = least[both] < k[at_]
        return [(int(x), int(y), A.runs_of(f[:n])) for x, y, f, n in zip(h, sh, flags, nw, strict=True)]

    return run


def spec(length: int = LENGTH, gram: int = GRAM) -> A.Repeats:
    return A.Repeats(
        length, gram,
        split=lambda text: text.encode().split(),  # at the six ASCII white-space bytes
        numbers=lambda: WordHashes().of,
        digest=lambda n, s, e: xxhash.xxh3_64_intdigest(n[s:e]),
        cut=lambda words, s, e: b" ".join(words[s:e]),
        kernel=_kernel(length, gram),
        stays="id",
    )


def remove_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False, broadcast_rows: int = A.BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and on demand kept_text (kept words joined by a space).

    A word goes if a window of ``length`` words that covers it also starts in a document of a
    smaller id.  A null text has no words; a document with fewer words than a window keeps all;
    rows of one id never remove each other's words; a null id counts as the greatest; extra columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = []
                for text, runs in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = text.encode().split()
                    spans, kept, last = A.merged(runs, length), [], 0
                    for a, b in spans:
                        kept += words[last:a]
                        last = b
                    kept += words[last:]
                    body = b" ".join(kept)
                    rows.append((len(words), len(words) - len(kept), hashlib.sha256(body).hexdigest(), body.decode() if keep_text else None))
                cols = [part.column(0)] + [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
                yield pa.RecordBatch.from_arrays(cols[: 4 + keep_text], names=names[: 4 + keep_text])

    own = A.keyed(docs)
    found = A.windows(own, spec(length, gram), broadcast_rows)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return A.with_windows(own, found).mapInArrow(per_task(run), schema)
