"""Operator 4: byte-pair encoding and decoding, long unsplit text by tree concatenation.

A text is cut at ASCII white space, where the vocabulary's normaliser and splitting pattern
can never join two sides, and each distinct word is encoded once per batch.  A word of more
than ``LONG`` bytes is not given to the tokenizer as a whole:
its pieces of more than ``LEAF`` characters are halved down to leaves, the leaves are encoded in one parallel batch, and the
halves are joined bottom-up.  At each join a window of the last k tokens on the left and the
first k on the right is encoded again, k growing until the window starts with the left side's
own token and ends with the right side's own token.  Then every pair of neighbouring tokens
of the result stood side by side in some real encoding, which makes the whole sequence the
encoding of the joined text (a merge across a boundary would have shown in that pair).
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliospark.llm.common import per_task

LONG, LEAF, CACHE = 24, 24, 100_000
#: Printable ASCII and Latin-1 letters: composed already, and lower-cased alike everywhere.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")


class TreeBpe:
    """Encoder and decoder for one vocabulary file of the tokenizers library."""

    def __init__(self, path: str, long: int = LONG, leaf: int = LEAF, cache: int = CACHE):
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.long, self.leaf, self.cap = long, leaf, cache
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        # The same merges for a part that does not end its word, and for one that does.
        self.inner = Tokenizer(models.BPE(vocab=spec["model"]["vocab"], merges=merges))
        self.final = Tokenizer(models.BPE(vocab=spec["model"]["vocab"], merges=merges, end_of_word_suffix=self.suffix or None))
        #: (ids, decoded text, pieces that took the tree) of words, and (ids, text) of their plain pieces.
        self.words: dict[bytes, tuple[bytes, bytes, int]] = {}
        self.pieces: dict[str, tuple[bytes, bytes]] = {}
        # The vocabulary's own splitting pattern for the plain characters, where \\p{L} and \\p{N} are known.
        split = next((p["pattern"]["Regex"] for p in spec["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split"), None)
        self.split = re.compile(split.replace("\\p{L}", "a-zß-öø-ÿ").replace("\\p{N}", "0-9")) if split else None
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.level = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}

    # -- one word -------------------------------------------------------------
    def _parts(self, texts: list[str], last: list[bool]) -> list[list[tuple[int, int]]]:
        """(id, length) of the tokens of each part; last: whether the part ends its word."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        for coder, flag in ((self.inner, False), (self.final, True)):
            at = [i for i, x in enumerate(last) if x is flag]
            for i, e in zip(at, coder.encode_batch([texts[i] for i in at], add_special_tokens=False), strict=True):
                out[i] = [(t, b - a) for t, (a, b) in zip(e.ids, e.offsets, strict=True)]
        return out

    def _join(self, piece: str, mid: int, left: list, right: list, ends: bool) -> list:
        """Tokens of left + right, which meet at piece[mid]; windows grow until both sides agree."""
        k = 2
        while True:
            a, b = left[-k:], right[:k]
            lo, hi = mid - sum(n for _, n in a), mid + sum(n for _, n in b)
            window = self._parts([piece[lo:hi]], [ends and len(b) == len(right)])[0]
            if (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            k *= 2

    def tree(self, piece: str) -> list[int]:
        """Token ids of one piece that no pattern splits, by halves."""
        n, cuts = len(piece), [0, len(piece)]
        while cuts[1] - cuts[0] > self.leaf:
            cuts = [*chain.from_iterable((a, (a + b) // 2) for a, b in zip(cuts, cuts[1:], strict=False)), n]
        cuts = sorted(set(cuts))
        spans = list(zip(cuts, cuts[1:], strict=False))
        coded = self._parts([piece[a:b] for a, b in spans], [b == n for _, b in spans])
        while len(spans) > 1:
            new_spans, new_coded = [], []
            for i in range(0, len(spans) - 1, 2):
                (a, m), (_, b) = spans[i], spans[i + 1]
                new_coded.append(self._join(piece, m, coded[i], coded[i + 1], b == n))
                new_spans.append((a, b))
            if len(spans) % 2:
                new_spans.append(spans[-1])
                new_coded.append(coded[-1])
            spans, coded = new_spans, new_coded
        return [t for t, _ in coded[0]]

    def encode_long(self, word: str) -> tuple[list[int], int]:
        """Ids of a word without ASCII white space, whatever its length, and how many of its pieces took the tree."""
        ids: list[int] = []
        at = trees = 0
        for m in [*(self.special_re.finditer(word) if self.special_re else ()), None]:
            part = word[at : m.start() if m else len(word)]
            if part:
                for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part)):
                    if len(piece) > self.leaf:
                        ids += self.tree(piece)
                        trees += 1
                    else:
                        ids += [t for t, _ in self._parts([piece], [True])[0]]
            if m:
                ids.append(self.special[m[0]])
                at = m.end()
        return ids, trees

    # -- whole texts ----------------------------------------------------------
    def pack(self, ids: list[int], tokens: list[str]) -> tuple[bytes, bytes]:
        return struct.pack(f"<{len(ids)}I", *ids), " ".join(tokens).encode()

    def _plain(self, word: str) -> tuple[bytes, bytes, int]:
        """A short word of plain characters, from the codes of its pieces."""
        ids, text = [], []
        for piece in self.split.findall(word.lower()):
            if (got := self.pieces.get(piece)) is None:
                tokens = self.final.model.tokenize(piece.translate(self.level))
                got = self.pack([t.id for t in tokens], [t.value for t in tokens])
                if len(self.pieces) < 2 * self.cap:
                    self.pieces[piece] = got
            ids.append(got[0])
            text.append(got[1])
        return b"".join(ids), b" ".join(text), 0

    def _learn(self, words: set[bytes]) -> dict[bytes, tuple[bytes, bytes, int]]:
        short, new = [], {}
        for w in words:
            if len(w) <= self.long and self.split and PLAIN.fullmatch(x := w.decode()) and "<|" not in x:
                new[w] = self._plain(x)
            elif len(w) <= self.long:
                short.append(w)
        for i in range(0, len(short), 8192):
            part = short[i : i + 8192]
            for w, e in zip(part, self.tok.encode_batch([w.decode() for w in part], add_special_tokens=False), strict=True):
                new[w] = *self.pack(e.ids, e.tokens), 0
        for w in words:
            if len(w) > self.long:
                ids, trees = self.encode_long(w.decode())
                new[w] = *self.pack(ids, [self.tok.id_to_token(i) for i in ids]), trees
        return new

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes, int]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text in UTF-8, pieces that took the tree) of each text."""
        split = [(t or "").encode().split() for t in texts]
        known = self.words
        new = self._learn(set(chain.from_iterable(split)) - known.keys())
        if len(known) < self.cap:  # common words come early; the rest are coded once a batch
            for w in new:
                if len(known) >= self.cap:
                    break
                if len(w) < 64:
                    known[w] = new[w]
        for words in split:
            found = [known.get(w) or new[w] for w in words]
            yield b"".join([x for x, _, _ in found]), b" ".join([y for _, y, _ in found if y]), sum([n for _, _, n in found])


def encode(docs: DataFrame, vocabulary: str, keep_ids: bool = False, keep_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Encodes and decodes the whole ``text`` of each document.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, n_tree (pieces encoded by tree concatenation), and on demand the
    ids themselves (``ids`` array<int>), the ``decoded`` text, and the columns named in ``carry``.  A null or empty text has
    0 tokens; rows are kept one by one, so repeated documents give repeated rows and other columns are ignored.  No
    shuffle: one pass over the scan, memory bounded by a batch, the longest text and the word cache."""
    carry = carry or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One coder a task: kept for a worker's life, its tables would stay beside the next stage's.
        bpe = TreeBpe(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                coded = list(bpe.encode_batch(part.column(1).to_pylist()))
                out = [
                    part.column(0),
                    pa.array([len(i) // 4 for i, _, _ in coded], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i, _, _ in coded]),
                    pa.array([hashlib.sha256(d).hexdigest() for _, d, _ in coded]),
                    pa.array([n for _, _, n in coded], pa.int64()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_tree"]
                if keep_ids:
                    ends = np.cumsum([0, *[len(i) // 4 for i, _, _ in coded]]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join([i for i, _, _ in coded]), "<i4"))))
                    names.append("ids")
                if keep_text:
                    out.append(pa.array([d.decode() for _, d, _ in coded]))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays([*out, *part.columns[2:]], names=[*names, *carry])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_tree long"
    schema += ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    schema += "".join(f", `{c}` {dict(docs.dtypes)[c]}" for c in carry)
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", *[f"`{c}`" for c in carry]).mapInArrow(per_task(run), schema)
