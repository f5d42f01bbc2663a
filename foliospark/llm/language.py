"""Operator 5: language identification by script, word scores and a switching penalty.

Fit: character trigrams of the words of a bounded sample of labelled rows (``max_docs`` rows
of each language, about, chosen by a hash of the id) give each language a smoothed model; all of the sample's
trigrams count.
Predict: a word's script narrows the languages to those seen with it, its trigrams score
each of them, and Viterbi over the words with a penalty for each switch labels the spans of
a text.  Most texts stay in one language; that this is optimal is proved from running sums
(no stretch of words gains more elsewhere than the switches cost), else the full recursion runs.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import per_task

WORD = re.compile(r"[^\W\d_]+")
MAX_DOCS, MAX_LANGS, SWITCH, CACHE = 400, 1000, 20.0, 250_000
#: First code points of Unicode script ranges.
SCRIPTS = [(0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "indic"), (0xE00, "thai"), (0xE80, "asian"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0xFF21, "latin"), (0xFF5B, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x30000, "other")]
STARTS = [a for a, _ in SCRIPTS]


def script(word: str) -> str:
    return SCRIPTS[bisect_right(STARTS, ord(word[0])) - 1][1]


def trigrams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled rows to learn from: those that are not held out."""
    return docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


@dataclass
class LanguageModel:
    langs: list[str]
    grams: dict[str, int]
    table: np.ndarray  # a row of log probabilities for each trigram; the last row is for unseen ones
    scripts: dict[str, np.ndarray]  # whether a language is a candidate
    switch: float = SWITCH
    index: dict[str, int] = field(default_factory=dict)
    known: tuple[np.ndarray, ...] | None = None

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by language, letters, and trigrams of new words."""
        get, unseen = self.grams.get, len(self.grams)
        ids, starts, letters, masks = [], [], [], []
        for w in words:
            starts.append(len(ids))
            letters.append(len(w))
            masks.append(self.scripts.get(script(w)))
            ids += [get(g, unseen) for g in trigrams(w)]
        scores = np.add.reduceat(self.table[ids], starts, axis=0)
        for i, m in enumerate(masks):
            if m is not None and not m.all():
                scores[i, ~m] -= 1000.0
        return scores, np.array(letters, np.int64), np.diff([*starts, len(ids)])

    def label(self, texts: list[list[str]]) -> Iterator[tuple[str, float, np.ndarray, float]]:
        """(language, score, label of each word, mean log score of a trigram) of texts given as lists of lower-case words.

        The first ``CACHE`` short words stay known; the others are scored once a call."""
        if self.known is None:
            self.known = (np.zeros((0, len(self.langs))), np.zeros(0, np.int64), np.zeros(0, np.int64))
        index, now = self.index, self.known
        fresh = list({w for t in texts for w in t} - index.keys())
        if fresh:
            stay = [w for w in fresh if len(w) < 32][: max(0, CACHE - len(index))]
            if stay:
                index.update(zip(stay, range(len(index), len(index) + len(stay)), strict=True))
                now = self.known = tuple(np.concatenate(x) for x in zip(self.known, self.learn(stay), strict=True))
            rest = [w for w in fresh if w not in index]
            if rest:
                now = tuple(np.concatenate(x) for x in zip(now, self.learn(rest), strict=True))
                index = _Both(index, dict(zip(rest, range(len(index), len(index) + len(rest)), strict=True)))
        scores, sizes, grams = now
        for words in texts:
            if not words:
                yield "und", 0.0, np.zeros(0, np.int64), 0.0
                continue
            at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
            own = scores[at]
            path = self.viterbi(own)
            letters = np.bincount(path, weights=sizes[at], minlength=len(self.langs))
            best = int(letters.argmax())
            yield self.langs[best], float(letters[best] / letters.sum()), path, float(own[np.arange(len(at)), path].sum() / grams[at].sum())

    def viterbi(self, s: np.ndarray) -> np.ndarray:
        n, width = s.shape
        best = int(s.sum(axis=0).argmax())
        if width == 1:
            return np.zeros(n, np.int64)
        others = s.copy()
        others[:, best] = -np.inf
        gain = np.cumsum(others.max(axis=1) - s[:, best])
        low = np.minimum.accumulate(np.concatenate([[0.0], gain[:-1]]))
        if gain.max() <= self.switch and gain[-1] - min(0.0, gain.min()) <= self.switch and (gain - low).max() <= 2 * self.switch:
            return np.full(n, best)
        back = np.empty((n, width), np.int64)
        value, own = s[0].copy(), np.arange(width)
        for i in range(1, n):
            top = int(value.argmax())
            stay = value >= value[top] - self.switch
            back[i] = np.where(stay, own, top)
            value = np.where(stay, value, value[top] - self.switch) + s[i]
        path = np.empty(n, np.int64)
        path[-1] = int(value.argmax())
        for i in range(n - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        return path


class _Both:
    def __init__(self, known: dict, new: dict):
        self.known, self.new = known, new

    def __getitem__(self, w: str) -> int:
        got = self.known.get(w)
        return self.new[w] if got is None else got


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, max_langs: int = MAX_LANGS, switch: float = SWITCH) -> LanguageModel | None:
    """Learns from a bounded sample: about ``max_docs`` labelled rows of each language, by a hash of the id.

    The driver receives the languages with their counts (more than ``max_langs`` are an error: the column is no
    language then) and the sample's trigram counts.  None if there is nothing to learn from."""
    rows = training_rows(docs)
    have = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(max_langs + 1).collect()}
    if not have:
        return None
    if len(have) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    share = F.create_map(*[F.lit(x) for k, n in have.items() for x in (k, min(1.0, max_docs / n))])
    unit = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1_000_000)) / 1e6
    sample = rows.where(unit < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w, n in Counter(WORD.findall(text.lower())).items():
                    found[lang, "s", script(w)] += n
                    for g in trigrams(w):
                        found[lang, "g", g] += n
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array([found[k] for k in keys], pa.int64())], names=["lang", "kind", "gram", "n"])

    counts = sample.mapInArrow(per_task(count), "lang string, kind string, gram string, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    top = counts.orderBy("kind", "lang", "gram").collect()
    langs = sorted(have)
    at = {x: i for i, x in enumerate(langs)}
    grams = {g: i for i, g in enumerate(sorted({r["gram"] for r in top if r["kind"] == "g"}))}
    freq, seen = np.zeros((len(grams) + 1, len(langs))), {}
    for r in top:
        if r["kind"] == "g":
            freq[grams[r["gram"]], at[r["lang"]]] = r["n"]
        else:
            seen.setdefault(r["gram"], np.zeros(len(langs)))[at[r["lang"]]] = r["n"]
    freq += 0.5
    table = np.log(freq / freq.sum(axis=0))
    total = sum(seen.values()) if seen else np.ones(len(langs))
    scripts = {k: v / np.maximum(total, 1) >= 0.01 for k, v in seen.items()}
    return LanguageModel(langs, grams, table, {k: v for k, v in scripts.items() if v.any()}, switch)


def identify(docs: DataFrame, model: LanguageModel | None, spans: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each whole ``text``, and on demand its labelled spans.

    ``und`` with score 0 if the text is null or has no letter, or if there was nothing to learn
    from.  The score is the share of the text's letters in words labelled with the prediction.
    Ties go to the first language in order.  Repeated rows give repeated rows, extra columns are
    ignored; memory is bounded by a batch and the word cache, and nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(model.langs, model.grams, model.table, model.scripts, model.switch) if model else None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [(t or "") for t in part.column(2).to_pylist()]
                words = [WORD.findall(t.lower()) for t in texts]
                got = list(own.label(words)) if own else [("und", 0.0, np.zeros(0, np.int64), 0.0)] * len(texts)
                out = [part.column(0), part.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
                names = ["doc_id", "held_out", "lang_pred", "score"]
                if spans:
                    out.append(pa.array([_spans(t, g[2], own.langs) if own else [] for t, g in zip(texts, got, strict=True)], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    schema += ", spans array<struct<first:int,last:int,lang:string>>" * spans
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(per_task(run), schema)


def _spans(text: str, path: np.ndarray, langs: list[str]) -> list[dict]:
    """Spans in words: the first and last word (from 0) of each stretch of one language."""
    if not len(path):
        return []
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    return [{"first": a, "last": b - 1, "lang": langs[path[a]]} for a, b in zip(cuts, cuts[1:], strict=False)]


def keep_identified(docs: DataFrame, model: LanguageModel | None, min_score: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that have a language.

    Not ``und``; enough of the text's letters (a share of ``min_score``) in words of one language; and trigrams that are
    nearer to those of a language than to unseen ones: the mean log score is above the middle between that of a trigram
    picked evenly and that of an unseen one (letter junk, scripts and languages never learned lie below).  A null lang takes the
    prediction.  Nulls and empty texts go; repeated rows and null ids are judged one by one; an empty table stays empty."""
    marks = ["__lang", "__score", "__mean"]
    kinds = [T.StringType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(marks, kinds, strict=True)]])
    text_at = docs.columns.index("text")
    least = (float(model.table[-1].max()) - float(np.log(max(1, len(model.grams))))) / 2 if model else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(model.langs, model.grams, model.table, model.scripts, model.switch) if model else None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words = [WORD.findall((t or "").lower()) for t in part.column(text_at).to_pylist()]
                got = list(own.label(words)) if own else [("und", 0.0, None, 0.0)] * len(words)
                cols = [pa.array([g[i] for g in got], k) for i, k in ((0, pa.string()), (1, pa.float64()), (3, pa.float64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*part.schema.names, *marks])

    found = docs.mapInArrow(per_task(run), schema)
    kept = found.where((F.col("__lang") != "und") & (F.col("__score") >= min_score) & (F.col("__mean") > least))
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).select(docs.columns)
