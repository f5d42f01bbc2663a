"""Operator 8: token counts of a unigram vocabulary without building the tokens.

An Aho-Corasick automaton over the vocabulary names every piece that ends at a character;
dynamic programming carries, for each end, the best score and the number of pieces.  The
tie rules are those of the tokenizers library: starts are tried from left to right and only
a strictly better score replaces an earlier one, so of equal scores the longest last piece
stays; an unknown character costs ``min(score) - 10``, is considered only where no piece of
exactly that character exists, and counts one byte piece for each of its UTF-8 bytes.

Text is cut where no piece can cross: before a space mark that follows another character,
and around characters that no piece contains.  Scores add up exactly when they are whole
numbers (checked at load), so the cuts cannot change a tie; otherwise no cuts are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from foliospark.llm.common import per_task

MARK, PENALTY, CACHE = "▁", 10.0, 400_000


class UnigramCounter:
    """Counts for a list of (piece, score)."""

    def __init__(self, vocabulary: list[tuple[str, float]], cache: int = CACHE):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        scores: dict[str, float] = {}
        for piece, score in vocabulary:
            if piece:
                scores[piece] = score  # as in the library, a later entry of the same piece wins
        for piece, score in scores.items():
            self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.single = {p for p in scores if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - PENALTY
        self.alphabet = set().union(*scores)
        self.bytes = all(f"<0x{b:02X}>" in scores for b in range(256))
        exact = all(float(s).is_integer() for s in scores.values())
        crossing = any(MARK in p.lstrip(MARK) for p in scores)
        self.cut = exact and self.bytes and not crossing
        self.cache = _Cache(self, cache)

    def viterbi(self, text: str) -> tuple[int, float]:
        """(pieces, best score) of a text that is already normalised."""
        n = len(text)
        if not n:
            return 0, 0.0
        worst = float("-inf")
        if self.single.issuperset(text):  # the automaton names the ends in order, the longest piece first
            best, count = [0.0] + [worst] * n, [0] * (n + 1)
            for end, (length, score) in self.auto.iter(text):
                value = best[end + 1 - length] + score
                if value > best[end + 1]:
                    best[end + 1] = value
                    count[end + 1] = count[end + 1 - length] + 1
            return count[n], best[n]
        best, count, run = [worst] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, found in self.auto.iter(text):
            ends[end].append(found)
        single, unknown = self.single, self.unknown
        for i in range(n):
            top, pieces, fused = worst, 0, False
            for length, score in sorted(ends[i], reverse=True):  # longest first: the earliest start
                value = best[i + 1 - length] + score
                if value > top:
                    top, pieces, fused = value, count[i + 1 - length] + 1, False
            if text[i] not in single:
                value = best[i] + unknown
                if value > top:
                    own = len(text[i].encode()) if self.bytes else (0 if run[i] else 1)
                    top, pieces, fused = value, count[i] + own, True
            best[i + 1], count[i + 1], run[i + 1] = top, pieces, fused
        return count[n], best[n]

    def count(self, text: str | None) -> tuple[int, float]:
        """(tokens, score) of a whole raw text: a space mark goes before it and stands for each space."""
        if not text:
            return 0, 0.0
        if not self.cut:
            return self.viterbi(MARK + text.replace(" ", MARK))
        cache, total, score = self.cache, 0, 0.0
        text = text.replace(MARK, " ")
        for i, line in enumerate(text.split("\n") if "\n" not in self.alphabet else [text]):
            if i:
                total, score = total + 1, score + self.unknown
            words = line.split(" ")
            if i == 0:
                words.insert(0, "")
            first = words.pop(0)
            if "" in words:  # runs of spaces: their marks stay together with the next word
                joined, run = [], ""
                for w in words:
                    if w:
                        joined.append(run + w)
                        run = ""
                    else:
                        run += MARK
                if run:
                    joined.append(run[1:])
                words = joined
            found = [cache[w] for w in words]
            if first:
                found.append(self.viterbi(first))
            total += sum([c for c, _ in found])
            score += sum([s for _, s in found])
        return total, score


class _Cache(dict):
    """(pieces, score) of a word after one space mark; the first ``cap`` short words stay."""

    def __init__(self, counter: UnigramCounter, cap: int):
        super().__init__()
        self.counter, self.cap = counter, cap

    def __missing__(self, word: str) -> tuple[int, float]:
        got = self.counter.viterbi(MARK + word)
        if len(self) < self.cap and len(word) < 64:
            self[word] = got
        return got


def sentencepiece_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and the best path's score of each whole ``text``.

    A null or empty text has 0 tokens and score 0; repeated rows give repeated rows; other
    columns are ignored.  One pass without a shuffle; memory is bounded by a batch and the
    word cache."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = UnigramCounter(sentencepiece_vocabulary(vocabulary))  # ends with its task
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = [c.count(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(per_task(run), "doc_id long, n_tokens long, score double")
