import hashlib
import math
import random
import struct
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models

from foliospark.llm import anchors, bpe, bwt, counting, jaccard, substring, suffix

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


# -- 4: encoding ------------------------------------------------------------------
def ids_of(data):
    return list(struct.unpack(f"<{len(data) // 4}I", data))


def test_tree_encoding_equals_the_library():
    rng, tree, lib = random.Random(1), bpe.TreeBpe(WORD_BPE, long=600, leaf=64), Tokenizer.from_file(WORD_BPE)
    for k in range(120):
        letters = rng.choice(["ab", "thenigoué", "abcdefghijklmnopqrstuvwxyz", "a!?", "aé́X1<|endoftext|>'s", "a  \x1c\x85 b\x00", "漢字 한글 ", "😀é"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 3000)))
        if k % 5 == 0:
            text = text[:50] + "<|endoftext|>" + text[50:]
        want = lib.encode(text, add_special_tokens=False).ids
        packed, decoded, _ = next(iter(tree.encode_batch([text])))
        assert ids_of(packed) == want and decoded.decode() == lib.decode(want, skip_special_tokens=False)
        if " " not in text:
            assert tree.encode_long(text)[0] == want


def test_encoding_rows(docs, empty, texts):
    lib = Tokenizer.from_file(WORD_BPE)
    rows = bpe.encode(docs, WORD_BPE, keep_ids=True, keep_text=True).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = lib.encode((texts[r["doc_id"]] if r["doc_id"] is not None else texts[3]) or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["n_tokens"] == len(want) and r["decoded"] == lib.decode(want, skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
    assert bpe.encode(empty, WORD_BPE).count() == 0


def test_long_words_take_the_tree(spark):
    rng, lib = random.Random(5), Tokenizer.from_file(WORD_BPE)
    long = "".join(rng.choice("theinandoré") for _ in range(1_000_000))
    texts = [long, "short words only", "a " + long[:25] + " b", "é" * 5000 + "1" * 300, None]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, ids int")
    rows = sorted(bpe.encode(df, WORD_BPE, keep_ids=True, keep_text=True).collect())
    for r in rows:
        want = lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == lib.decode(want, skip_special_tokens=False)
    assert [r["n_tree"] > 0 for r in rows] == [True, False, True, True, False]


# -- 8: counting ------------------------------------------------------------------
def test_counts_equal_the_library():
    v = counting.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    c, lib, rng = counting.UnigramCounter(v), Tokenizer(models.Unigram(v, unk_id=0, byte_fallback=True)), random.Random(2)
    assert c.cut
    for _ in range(400):
        letters = rng.choice(["ab ", "the ing\n", "aé漢字😀 \n", "a  b", "<s>0x4A \n", "▁a "])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        want = len(lib.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0
        assert c.count(text)[0] == want
        if text:
            assert c.count(text) == c.viterbi("▁" + text.replace(" ", "▁"))


def test_counts_with_fractions_and_ties():
    v = [("<unk>", 0.0), ("a", -1.5), ("aa", -3.0), ("aaa", -4.5), ("b", -0.1), ("▁", -1.0), ("ab", -1.6)]
    c, lib = counting.UnigramCounter(v), Tokenizer(models.Unigram(v, unk_id=0))
    assert not c.cut
    for text in ("aaaa", "aab", "abab", "xx", "axxa", "a b"):
        assert c.count(text)[0] == len(lib.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids)


def test_counts_of_whole_texts_with_fractional_scores(texts):
    """All pieces of the vocabulary with scores as of a unigram model: negative logarithms that follow no merge order."""
    pieces = [p for p, _ in counting.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))]
    v = [(p, -math.log(i + 2) - 0.37 * len(p) % 1) for i, p in enumerate(pieces)]
    c, lib = counting.UnigramCounter(v), Tokenizer(models.Unigram(v, unk_id=0, byte_fallback=True))
    assert not c.cut
    for text in [*texts, "señal 漢字😀 " * 50]:
        assert c.count(text)[0] == (len(lib.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0)


def test_count_rows(docs, empty, texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r["doc_id"]: r["n_tokens"] for r in counting.token_counts(docs, path).collect()}
    lib = Tokenizer(models.Unigram(counting.sentencepiece_vocabulary(path), unk_id=0, byte_fallback=True))
    assert len(got) == len(texts) + 1 and got[texts.index(None)] == 0
    for i, text in enumerate(texts):
        assert got[i] == (len(lib.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0)
    assert counting.token_counts(empty, path).count() == 0


# -- 7 and 9: repeats -------------------------------------------------------------
def spans_of(marked):
    return sum(1 for i, x in enumerate(marked) if x and (i == 0 or not marked[i - 1]))


def test_transform_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(80):
        length, parts = int(rng.integers(1, 30)), []
        for _ in range(rng.integers(1, 6)):
            x = rng.integers(1, int(rng.integers(2, 6)), rng.integers(1, 60))
            parts.append(np.concatenate([x[:5], parts[0][: rng.integers(1, 60)], x[:3]]) if parts and rng.random() < 0.5 else x)
        text = np.concatenate([np.append(p, 0) for p in parts]).astype(np.uint16)
        seen, at = defaultdict(list), 0
        for p in parts:
            for i in range(len(p) - length + 1):
                seen[tuple(p[i : i + length])].append(at + i)
            at += len(p) + 1
        own = bwt.classes(text, length)
        places = [i for v in seen.values() for i in v]
        for v in seen.values():
            assert len({own[i] for i in v}) == 1
        assert len({own[i] for i in places}) == len(seen)


def brute_bytes(rows, length):
    count = defaultdict(int)
    bodies = [(i, (t or "").encode()) for i, t in rows]
    for _, b in bodies:
        for j in range(len(b) - length + 1):
            count[b[j : j + length]] += 1
    out = []
    for i, b in bodies:
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        kept = bytes(c for c, x in zip(b, gone, strict=True) if not x)
        out.append((i, len(b), sum(gone), spans_of(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "broadcast"), [(200, 1_000_000), (64, 0)])
def test_byte_repeats(docs, empty, length, broadcast):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = suffix.remove_repeats(docs, length, broadcast_rows=broadcast, keep_text=True, keep=["source"]).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == brute_bytes(rows, length)
    assert all(len(r["kept_text"].encode()) >= r["n_bytes"] - r["n_removed"] for r in got)
    assert suffix.remove_repeats(empty, length).count() == 0


@pytest.mark.parametrize(("length", "broadcast"), [(200, 1_000_000), (40, 0)])
def test_first_place_of_repeated_bytes_stays(docs, length, broadcast):
    rows = sorted(((anchors.LAST_ID if r["doc_id"] is None else r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: r[0])
    seen, want = set(), {}
    for i, t in rows:
        body = (t or "").encode()
        gone = bytearray(len(body))
        for j in range(len(body) - length + 1):
            if body[j : j + length] in seen:
                gone[j : j + length] = b"\1" * length
            seen.add(body[j : j + length])
        want[i] = hashlib.sha256(bytes(c for c, x in zip(body, gone, strict=True) if not x)).hexdigest()
    twice = docs.unionByName(docs.where("doc_id in (0, 3)"))
    got = suffix.remove_repeats(twice, length, broadcast_rows=broadcast, keep_first=True).collect()
    assert len(got) == len(rows) + 2
    assert all(r["kept_sha256"] == want[anchors.LAST_ID if r["doc_id"] is None else r["doc_id"]] for r in got)


def test_transform_finds_a_pair_of_copies():
    """Equal surroundings are known before the transform; given to it, they are found by it as well."""
    body = np.random.default_rng(3).integers(32, 127, 500).astype(np.uint8).tobytes()
    regions = [{"k": k, "fp": 0, "at": 0, "body": body, "items": [{"h": 1, "sh": k, "st": 0, "nw": 301, "a": 0}]} for k in (1, 2)]
    assert suffix._kernel(200)(regions) == [(1, 1, [(0, 301)]), (1, 2, [(0, 301)])]
    assert suffix._kernel(200, keep_first=True)(regions) == [(1, 1, []), (1, 2, [(0, 301)])]


def test_rows_without_ids_are_told_apart_by_their_texts(spark):
    rng = random.Random(3)
    rows = [(None, "".join(rng.choice("abcdefgh ") for _ in range(220))) for _ in range(20_000)]
    copies = rows[:40]
    df = spark.createDataFrame(rows + [(9 + i, t) for i, (_, t) in enumerate(copies)], "doc_id long, text string").repartition(4)
    got = suffix.remove_repeats(df, 200).where("n_removed > 0").groupBy("n_removed").count().collect()
    assert [tuple(r) for r in got] == [(220, 80)]
    words = spark.createDataFrame([(None, " ".join(rng.choice("abcdefgh") for _ in range(30))) for _ in range(300)] + [(7, "a b c d")], "doc_id long, text string")
    got = substring.remove_passages(words, 4, 2).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == brute_words([tuple(r) for r in words.collect()], 4)


def brute_words(rows, length):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        key = anchors.LAST_ID if i is None else i
        for j in range(len(w) - length + 1):
            g = tuple(w[j : j + length])
            first[g] = min(first.get(g, key), key)
    out = []
    for i, w in split:
        key, gone = anchors.LAST_ID if i is None else i, bytearray(len(w))
        for j in range(len(w) - length + 1):
            if first[tuple(w[j : j + length])] < key:
                gone[j : j + length] = b"\1" * length
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "broadcast"), [(50, 1_000_000), (20, 0)])
def test_word_repeats(docs, empty, length, broadcast):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = substring.remove_passages(docs, length, broadcast_rows=broadcast).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == brute_words(rows, length)
    assert substring.remove_passages(empty, length).count() == 0


def test_long_texts_are_anchored_alike_in_pieces(monkeypatch):
    units = np.random.default_rng(2).integers(0, 4, 5000).astype(np.uint8)
    whole = [np.concatenate(x) for x in zip(*anchors.anchors(units, 200, 32), strict=True)]
    monkeypatch.setattr(anchors, "CHUNK", 512)
    starts, covered = {}, 0
    for h, st_, nw, a in anchors.anchors(units, 200, 32):
        for x, s, n, o in zip(h, st_, nw, a, strict=True):
            covered += n
            for i in range(s, s + n):
                starts[i] = (x, s + o)
    assert covered == 4801
    assert all(starts[i] == (h, s + a) for h, s, n, a in zip(*whole, strict=True) for i in range(s, s + n))


# -- 10: Jaccard ------------------------------------------------------------------
def brute_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append({tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    up = {i: i for i in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(up)
    for a in ids:
        for b in ids:
            if a < b:
                for x in sets[a]:
                    for y in sets[b]:
                        if x and y and 100 * len(x & y) >= percent * len(x | y):
                            p, q = sorted((find(a), find(b)))
                            up[q] = p
    return {i: find(i) for i in up}


@pytest.mark.parametrize(("words", "percent", "block", "broadcast"), [(3, 90, 1024, 1_000_000), (5, 80, 2, 0), (2, 60, 1024, 0)])
def test_jaccard(docs, empty, words, percent, block, broadcast):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_components(rows, words, percent)
    got = jaccard.jaccard_components(docs, words, percent, block, broadcast).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    if words == 3:
        assert {r["doc_id"]: r["n_shingles"] for r in got}[[i for i, t in rows if t == "one two"][0]] == 1
    assert jaccard.jaccard_components(empty).count() == 0


def test_large_groups_of_near_copies_in_small_blocks(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(900):  # one word of each is its own
        words = list(base)
        words[rng.randrange(150)] = f"own{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(100)) + " " + " ".join(base[:30])) for i in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, block=64).collect()}
    assert got == {i: 0 if i < 900 else i for i, _ in rows}


def test_one_row_of_each_component_stays(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    twice = docs.unionByName(docs.where("doc_id is null or doc_id in (3, 7)")).unionByName(docs.where("doc_id = 8").selectExpr("9L as doc_id", "text", "lang", "source", "h", "k"))
    got = jaccard.keep_one(twice, 5, 80)
    assert got.columns == docs.columns
    want = {i: t for i, t in rows if i is not None and i == brute_components(rows, 5, 80)[i]}
    # Id 9 has a text of its own and that of 8: the one of 8 goes, its own stays.
    assert sorted((r["doc_id"], r["text"] or "") for r in got.collect()) == sorted((i, t or "") for i, t in want.items())
    lost = docs.where("doc_id is null").unionByName(docs.where("doc_id is null"))
    assert [r["text"] for r in jaccard.keep_one(lost, 5, 80).collect()] == [rows[[i for i, _ in rows].index(3)][1]]
    assert jaccard.keep_one(empty, 5, 80).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_no_pair_is_missed_by_marks(percent):
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        both = rng.integers(0, 1 << 63, n).astype(np.uint64)
        extra = rng.integers(0, 1 << 63, max(1, n * (100 - percent) // percent)).astype(np.uint64)
        cut = int(rng.integers(0, len(extra) + 1))
        a, b = np.unique(np.append(both, extra[:cut])), np.unique(np.append(both, extra[cut:]))
        known = rng.choice(np.append(both, extra), int(rng.integers(0, n + 1)), replace=False)
        order = jaccard.Order(np.unique(known), rng.integers(1, 99, len(np.unique(known))))
        i = len(np.intersect1d(a, b))
        if 100 * i >= percent * (len(a) + len(b) - i):
            assert len(np.intersect1d(order.marks(a, percent), order.marks(b, percent)))


@pytest.mark.parametrize(("n", "low"), [(150, 100), (700, 60)])
def test_tree_connects_all_that_link(n, low):
    rng = np.random.default_rng(6)
    base = [rng.integers(0, 1 << 63, 120).astype(np.uint64) for _ in range(3)]
    sets = [np.unique(np.append(base[i % 3][: int(rng.integers(low, 121))], rng.integers(0, 1 << 63, int(rng.integers(0, 12))).astype(np.uint64))) for i in range(n)]
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    near = [(a, b) for a in range(n) for b in range(a) if jaccard.linked(sets[a], sets[b], 90)]
    some = jaccard.may_link(np.array([len(s) for s in sets]), [jaccard.point(s) for s in sets], np.arange(n), 90)
    assert all(some[a] == some[b] >= 0 for a, b in near)

    def parts(links):
        up[:] = range(n)
        for a, b in links:
            up[find(a)] = find(b)
        out = {}
        for i in range(n):
            out.setdefault(find(i), []).append(i)
        return sorted(out.values())

    links = jaccard.link_bucket(sets, 90)
    assert parts(links) == parts(near) and len(links) == n - len(parts(near))


def test_points_of_unlike_sizes_and_known_components():
    rng = np.random.default_rng(7)
    base = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    sets = [rng.choice(base, int(m), replace=False) for m in rng.integers(1, 5000, 80)]
    sets = [np.sort(s) for s in sets] + [base[:m] for m in (62, 64, 66, 68, 1020, 1030, 4090, 4100, 4500)]
    n, bodies = np.array([len(s) for s in sets]), [jaccard.point(s) for s in sets]
    near = [(a, b) for a in range(len(n)) for b in range(a) if jaccard.linked(sets[a], sets[b], 80)]
    some = jaccard.may_link(n, bodies, np.arange(len(n)), 80)
    assert near and all(some[a] == some[b] >= 0 for a, b in near)
    assert (jaccard.may_link(n, bodies, np.zeros(len(n)), 80) < 0).all() and not jaccard.link_bucket(sets, 80, np.zeros(len(n)))


def test_batches_are_bounded_by_bytes(spark):
    from foliospark.llm.common import BATCH_BYTES, BATCHES, per_task

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    before = spark.conf.get(BATCHES, None)
    try:
        spark.conf.unset(BATCHES)
        table = spark.range(0, 3000, 1, 1).selectExpr("repeat('abcd', case when id % 1000 = 0 then 2000000 else 1000 end) text")
        got = table.mapInArrow(per_task(sizes), "rows long, bytes long").collect()
        assert sum(r["rows"] for r in got) == 3000  # longer rows are not lost
        assert all(r["bytes"] <= BATCH_BYTES + 8_000_100 for r in got) and len(got) > 3
        spark.conf.set(BATCHES, "16m")
        per_task(sizes)
        assert spark.conf.get(BATCHES) == "16m"
    finally:
        spark.conf.unset(BATCHES) if before is None else spark.conf.set(BATCHES, before)
