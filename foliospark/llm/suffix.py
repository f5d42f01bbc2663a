"""Operator 7: removal of repeated byte strings by a Burrows-Wheeler transform.

Bytes that lie in a ``length``-byte string which also starts anywhere else are found by
breadth-first backward extension (``bwt``) within shards; ``anchors`` sees to it that all
places of a string meet in one shard.  A filter goes before: of places whose whole surroundings are equal one
stands for all in the transform, and where there are no others the copies are known without it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from foliospark.llm import anchors as A
from foliospark.llm.bwt import classes
from foliospark.llm.common import per_task

LENGTH, GRAM = 200, 32


def _kernel(length: int, keep_first: bool = False):
    def run(regions: list[dict]) -> list[tuple]:
        parts = []
        for r in regions:
            parts += [np.frombuffer(r["body"], np.uint8).astype(np.uint16) + 1, np.zeros(1, np.uint16)]
        same = classes(np.concatenate(parts), length)
        # Two stretches may hold the same text of a document, but each window is in one snippet only.
        own, at = np.zeros(len(same), bool), 0
        for r in regions:
            for i in r["items"]:
                first = at + i["st"] - r["at"]
                own[first : first + i["nw"]] = True
            at += len(r["body"]) + 1
        if keep_first:  # regions come in order of places
            first = np.full(same.max() + 1, len(same))
            np.minimum.at(first, same[own], np.flatnonzero(own))
            flags = first[same] < np.arange(len(same))
        else:
            flags = np.bincount(same[own], minlength=same.max() + 1)[same] > 1
        out, at = [], 0
        for r in regions:
            for i in r["items"]:
                first = at + i["st"] - r["at"]
                out.append((i["h"], i["sh"], A.runs_of(flags[first : first + i["nw"]])))
            at += len(r["body"]) + 1
        return out

    return run


def spec(length: int = LENGTH, gram: int = GRAM, keep_first: bool = False) -> A.Repeats:
    return A.Repeats(
        length, gram,
        split=lambda text: text.encode(),
        numbers=lambda: lambda b: np.frombuffer(b, np.uint8),
        digest=lambda n, s, e: xxhash.xxh3_64_intdigest(n[s:e]),
        cut=lambda b, s, e: b[s:e],
        kernel=_kernel(length, keep_first),
        stays="place" if keep_first else "none",
    )


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, broadcast_rows: int = A.BROADCAST_ROWS, keep: list[str] | None = None, keep_first: bool = False
) -> DataFrame:
    """doc_id, text and the runs of repeated windows of each document, one row a row of ``docs``.

    A null text is empty; a text shorter than ``length`` bytes has no window; repeated rows repeat each other
    (so they lose all they have if long enough); null ids are rows like others; extra columns are ignored.
    With ``keep_first`` the first place of each window stays, by id (null last), a hash of the text, and position;
    rows that repeat an id and a text then count as one."""
    own = A.keyed(docs, keep)
    return A.with_windows(own, A.windows(own, spec(length, gram, keep_first), broadcast_rows), keep)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False, broadcast_rows: int = A.BROADCAST_ROWS, keep: list[str] | None = None, keep_first: bool = False
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, on demand kept_text, and the columns named in ``keep``.

    ``kept_text`` is UTF-8 again: a character that a span cuts is kept whole.  Rows, nulls and ``keep_first``: as in
    ``repeated_spans``; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = []
                for text, runs in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    body = text.encode()
                    spans = A.merged(runs, length)
                    kept, last = [], 0
                    for a, b in spans:
                        kept.append(body[last:a])
                        last = b
                    kept.append(body[last:])
                    text = _whole(body, spans) if keep_text else None
                    rows.append((len(body), sum(b - a for a, b in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest(), text))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                cols = [part.column(0)] + [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
                more = [part.column(3 + i) for i in range(len(keep or []))]
                yield pa.RecordBatch.from_arrays(cols[: 5 + keep_text] + more, names=names[: 5 + keep_text] + list(keep or []))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text
    spans = repeated_spans(docs, length, gram, broadcast_rows, keep, keep_first)
    schema += "".join(f", `{c}` {dict(docs.dtypes)[c]}" for c in keep or [])
    return spans.mapInArrow(per_task(run), schema)


def _whole(body: bytes, spans: list[tuple[int, int]]) -> str:
    kept, last = [], 0
    for a, b in spans:
        while a < b and body[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(body) and body[b] & 0xC0 == 0x80:
            b -= 1
        kept.append(body[last:a])
        last = b
    kept.append(body[last:])
    return b"".join(kept).decode()
