import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm import chat, components, entries, hamming, hnsw, language, mixing

DATA = "/root/testdata/sf0.001"


# -- components -------------------------------------------------------------------
@pytest.mark.parametrize("at_once", [0, 500_000])
def test_components(spark, at_once):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300)]
    up = {x: x for e in links for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        up[q] = p
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(7), at_once).collect()}
    assert all(got.get(x, x) == find(x) for x in up)


def test_components_of_a_long_chain(spark):
    ids = list(range(1000))
    random.Random(5).shuffle(ids)
    chain = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long").repartition(16)
    got = {r["node"]: r["component"] for r in components.components(chain, at_once=0).collect()}
    assert got == dict.fromkeys(range(1000), 0)


# -- 1 and 3: vectors -------------------------------------------------------------
@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((12, 24))
    rows = [(i, (centre[i % 12] + rng.standard_normal(24) * (0.12 if i % 3 else 1.5)).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]  # many copies
    rows += [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [None] + [1.0] * 23), (2080, [float("inf")] * 24), (2100, [1.0, 2.0]), (None, rows[5][1])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, id string").repartition(5)
    ok = [(i, v) for i, v in rows if i is not None and i < 2000]
    return df, np.array([i for i, _ in ok]), np.array([v for _, v in ok])


def test_near_duplicates(vectors):
    df, ids, x = vectors
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r for r in hnsw.near_duplicates(df, shards=3).collect()}
    assert len(got) == df.count()
    links = np.array([got[i]["n_links"] for i in ids])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.99 * near.sum()
    seen, comp = set(), {}
    for i in range(len(ids)):
        if i not in seen:
            todo, own = [i], {i}
            while todo:
                for j in np.flatnonzero(near[todo.pop()]):
                    if j not in own:
                        own.add(j)
                        todo.append(j)
            seen |= own
            comp |= dict.fromkeys(own, min(ids[j] for j in own))
    assert np.mean([got[int(i)]["component_id"] == comp[n] for n, i in enumerate(ids)]) > 0.99
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (2000, 2020, 2040, 2060, 2080, 2100))
    assert got[None]["component_id"] is None and hnsw.near_duplicates(df.where("false")).count() == 0


def test_audit_sees_small_groups_beside_a_large_one():
    rng = np.random.default_rng(9)
    hot = rng.standard_normal(32) + 0.02 * rng.standard_normal((400, 32))
    pairs = np.repeat(rng.standard_normal((56, 32)), 2, axis=0) + 0.01 * rng.standard_normal((112, 32))
    x, ids = np.concatenate([hot, pairs])[(order := rng.permutation(512))], np.arange(512)
    own = hnsw.Linker(0, ids, x, np.ones(512, np.int64), 0.9)
    search = own.links

    def narrow(unit, at, beam):  # finds no pair before the beam is 128
        a, b, dense = search(unit, at, beam)
        keep = (order[a] < 400) | (beam >= 128)
        return a[keep], b[keep], dense

    own.links = narrow
    count, _ = own(ids, x, np.ones(512, np.int64), np.ones(512, bool))
    assert (count[order >= 400] == 1).all() and (count[order < 400] == 399).all()
    ends = own.graph.ids[own.labels]
    of = dict(zip(own.graph.ids.tolist(), ends.tolist(), strict=True))
    assert len({of[i] for i in np.flatnonzero(order < 400)}) == 1 and len(set(of.values())) == 57


def test_dense_groups_are_counted_in_slices():
    rng = np.random.default_rng(4)
    x = rng.standard_normal(48) + 0.05 * rng.standard_normal((6000, 48))
    own = hnsw.Linker(3, np.arange(6000), x, np.ones(6000, np.int64), 0.9, every=10**6)
    for i in range(0, 1024, 512):  # queries of another shard
        count, to = own(np.arange(512) + 10_000 + i, x[i : i + 512], np.full(512, 2), np.zeros(512, bool))
        assert (count == 6000).all() and (to >= 0).all()
    assert (own.heard == 2048).all() and len(set(own.labels.tolist())) == 1


def test_links_of_exactly_the_threshold_and_of_unlike_dimensions(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.19**0.5]), (3, [0.5, 0.5, 0.5]), (4, [0.5, 0.5, 0.5]), (4, [0.5, 0.5, 0.5]), (5, [-1.0, 0.0])]
    unit = np.array(rows[1][1])
    exact = unit[0] / np.sqrt((unit * unit).sum()) >= 0.9
    got = {(r["vec_id"], r["n_links"], r["component_id"]) for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {(1, int(exact), 1), (2, int(exact), 1 if exact else 2), (3, 2, 3), (4, 2, 3), (5, 0, 5)}


def test_nearest(vectors):
    df, ids, x = vectors
    got = {}
    for r in hamming.nearest(df, shards=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    queries = [i for i in ids if i % 20 == 0]
    assert set(got) == set(queries)
    hit = 0
    for q in queries:
        at = int(np.flatnonzero(ids == q)[0])
        score = x @ x[at]
        order = [j for j in np.lexsort((ids, -score)) if j != at][:20]
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert all(math.isclose(s, score[int(np.flatnonzero(ids == v)[0])], rel_tol=1e-9) for _, v, s in own)
        hit += len({int(ids[j]) for j in order} & {v for _, v, _ in own})
    assert hit >= 0.95 * 20 * len(queries)
    few = df.where("vec_id in (0, 1, 2)")
    assert hamming.nearest(few).count() == 2 and hamming.nearest(df.where("false")).count() == 0


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 16))
    mean, rotation = hamming.learn(hamming.augmented(x, 9.0), 64)
    index = hamming.MultiIndex(x, [[i] for i in range(400)], mean, rotation, 9.0, 5)
    codes = index.code(hamming.augmented(x, 9.0))
    far = np.unpackbits(codes[:20, None] ^ codes[None], axis=2).sum(axis=2)
    for radius in (0, 3, 5, 9, 14):
        q, v, d = index.within(codes[:20], radius)
        assert set(zip(q.tolist(), v.tolist(), strict=True)) == {(a, b) for a, b in zip(*np.nonzero(far <= radius), strict=True)}
        assert (d == far[q, v]).all()
    for want in (1, 3, 50, 400):
        q, v = index.nearest_codes(codes[:20], want)
        edge = np.sort(far, axis=1)[:, want - 1]
        assert set(zip(q.tolist(), v.tolist(), strict=True)) == {(a, b) for a, b in zip(*np.nonzero(far <= edge[:, None]), strict=True)}


def test_nearest_prunes_and_reaches_its_recall(spark):
    rng = np.random.default_rng(12)
    centre = rng.standard_normal((300, 32))
    x = centre[rng.integers(0, 300, 9000)] + 0.35 * rng.standard_normal((9000, 32))
    longest = float(np.linalg.norm(x, axis=1).max())
    mean, rotation = hamming.learn(hamming.augmented(x[:2000], longest), 256)
    index = hamming.MultiIndex(x, [[i] for i in range(len(x))], mean, rotation, longest, 20)
    assert index.want <= len(x) // 10
    asked = np.arange(0, 9000, 20)
    got = index.search(asked, x[asked], index.code(np.concatenate([x[asked], np.zeros((450, 1))], axis=1)))
    score = x[asked] @ x.T
    score[np.arange(450), asked] = -np.inf
    least = np.sort(score, axis=1)[:, -20]
    assert sum(score[q // 20, v] >= least[q // 20] for q, v, _ in got) >= 0.95 * 20 * 450


# -- 2: mixing --------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(5))
def test_schedule_deviates_by_less_than_a_block(seed):
    rng = random.Random(seed)
    q = mixing.quantise({f"s{i}": rng.random() + 0.01 for i in range(rng.randint(1, 9))}, 64)
    assert sum(q.values()) == 64 and min(q.values()) >= 1
    slots = mixing.edf(q, 64)
    assert sorted(t for s in slots.values() for t in s) == list(range(64))
    for k, own in slots.items():
        for j, t in enumerate(own):
            assert j * 64 // q[k] <= t < -(-(j + 1) * 64 // q[k])
        for t in range(65):
            assert abs(sum(1 for x in own if x < t) - q[k] * t / 64) < 1


def test_mixing_rows(spark):
    rows = [(i, "t", "a" if i % 3 else "b" if i % 2 else None, 1) for i in range(500)] + [(7, "t", "a", 1), (None, "u", "a", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int").repartition(4)
    got = mixing.interleave(df, {"a": 1.0, "b": 2.0, None: 1.0}, block_docs=8, period=16).collect()
    assert len(got) == len(rows)
    blocks = {}
    for r in got:
        blocks.setdefault((r["source"], r["block"]), []).append(r)
    slots = [x[0]["slot"] for x in blocks.values()]
    assert sorted(slots) == list(range(len(blocks)))
    for own in blocks.values():
        assert len({r["slot"] for r in own}) == 1 and len(own) <= 8 and own[0]["release"] <= own[0]["slot"] < own[0]["deadline"]
    first = sorted((x[0]["slot"], k[0]) for k, x in blocks.items())
    end = max(x[0]["slot"] for k, x in blocks.items() if x[0]["phase"] == 0) + 1
    for source, share in (("a", 0.25), ("b", 0.5), (None, 0.25)):
        for t in range(1, end + 1):
            assert abs(sum(1 for s, k in first if s < t and k == source) - share * t) < 1
    assert mixing.interleave(df.where("false")).count() == 0


def test_mixing_stays_within_a_block_of_the_given_weights(spark):
    weights = {"a": 1.0, "b": 1.0, "c": 1.0, "d": 0.003}
    df = spark.range(2400).selectExpr("id doc_id", "case when id < 2 then 'd' else substr('abc', cast(id % 3 as int) + 1, 1) end source")
    got = sorted((r["slot"], r["source"]) for r in mixing.interleave(df, weights, block_docs=1, period=16).where("phase = 0").collect())
    assert [t for t, _ in got] == list(range(len(got))) and len(got) > 1000
    for k, w in weights.items():
        seen = 0
        for t, source in got:
            seen += source == k
            assert abs(seen - w / sum(weights.values()) * (t + 1)) < 1


def test_schedule_of_a_long_phase():
    q = {"a": 1.0, "b": 1.0, "c": 1.0, "d": 0.0003}
    seen = dict.fromkeys(q, 0)
    for k, j, phase, release, deadline, slot in mixing.schedule(dict.fromkeys(q, 20_000), q):
        if phase:
            break
        seen[k] += 1
        assert j == seen[k] - 1 and release <= slot < deadline
        assert all(abs(seen[s] - w / sum(q.values()) * (slot + 1)) < 1 for s, w in q.items())
    assert sum(seen.values()) > 50_000


def test_equal_weights_take_turns_by_name():
    order = [k for k, *_ in mixing.schedule({"b": 3, "a": 3, "c": 3}, {"a": 1, "b": 1, "c": 1})]
    assert order == ["a", "b", "c"] * 3


# -- 5: language ------------------------------------------------------------------
@pytest.fixture(scope="module")
def languages(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_language_accuracy_and_edge_cases(spark, languages):
    model = language.fit(languages)
    got = language.identify(languages, model).join(languages.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "the of and thing"), (4, "the of and thing"), (None, "der die und"), (5, "привет мир")], "doc_id long, text string").withColumn("source", F.lit("x"))
    rows = {r["doc_id"]: r for r in language.identify(odd, model).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (1, 2, 3))
    assert rows[4]["lang_pred"] == "en" and rows[5]["lang_pred"] in model.langs and all(0 <= r["score"] <= 1 for r in rows.values())
    assert language.fit(languages.where("false")) is None
    assert [r["lang_pred"] for r in language.identify(odd.where("doc_id = 4"), None).collect()] == ["und", "und"]


def test_language_query_equals_brute_force(spark):
    """The whole query against counts and a full recursion written plainly."""
    import re
    import zlib

    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()
    cut = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows}
    count, scripts = {}, {}
    for r in rows:
        if not held[r["doc_id"]] and r["text"] is not None and r["lang"] is not None:
            for w in cut(r["text"]):
                scripts.setdefault(language.script(w), {}).setdefault(r["lang"], 0)
                scripts[language.script(w)][r["lang"]] += 1
                for i in range(len(w)):
                    g = f"^{w}$"[i : i + 3]
                    count.setdefault(g, {}).setdefault(r["lang"], 0)
                    count[g][r["lang"]] += 1
    langs = sorted({r["lang"] for r in rows if not held[r["doc_id"]] and r["lang"] and r["text"] is not None})
    total = {k: sum(c.get(k, 0) + 0.5 for c in count.values()) + 0.5 for k in langs}
    most = {k: sum(s.get(k, 0) for s in scripts.values()) for k in langs}

    def score(w, k):
        own = sum(math.log((count.get(f"^{w}$"[i : i + 3], {}).get(k, 0) + 0.5) / total[k]) for i in range(len(w)))
        s = scripts.get(language.script(w))
        return own - 1000 * (s is not None and s.get(k, 0) / max(1, most[k]) < 0.01)

    known = {}
    want = {}
    for r in rows:
        words = cut(r["text"])
        if not words:
            want[r["doc_id"]] = ("und", 0.0)
            continue
        s = [known.setdefault(w, [score(w, k) for k in langs]) for w in words]
        value, back = list(s[0]), []
        for x in s[1:]:
            top = max(range(len(langs)), key=lambda i: value[i])
            step = [i if value[i] >= value[top] - 20.0 else top for i in range(len(langs))]
            back.append(step)
            value = [max(value[i], value[top] - 20.0) + x[i] for i in range(len(langs))]
        path = [max(range(len(langs)), key=lambda i: value[i])]
        for step in reversed(back):
            path.append(step[path[-1]])
        letters = [0] * len(langs)
        for i, w in zip(reversed(path), words, strict=True):
            letters[i] += len(w)
        best = max(range(len(langs)), key=lambda i: letters[i])
        want[r["doc_id"]] = (langs[best], letters[best] / sum(letters))
    got = {r["doc_id"]: r for r in entries.op5_language(spark, DATA).collect()}
    assert {i: r["held_out"] for i, r in got.items()} == held
    assert {i: r["lang_pred"] for i, r in got.items()} == {i: w[0] for i, w in want.items()}
    assert all(math.isclose(r["score"], want[i][1], abs_tol=1e-9) for i, r in got.items())


def test_language_of_very_long_and_tied_texts(spark, languages):
    model = language.fit(languages)
    odd = spark.createDataFrame([(1, "the and of " * 100_000, 5, "x"), (2, "x" * 200_000, 6, "y")], "doc_id long, text string, score int, lang_pred string")
    rows = {r["doc_id"]: r for r in language.identify(odd, model).collect()}
    assert rows[1]["lang_pred"] == "en" and rows[1]["score"] == 1 and rows[2]["lang_pred"] in model.langs
    even = language.LanguageModel(["a", "b"], {}, np.zeros((1, 2)), {}, 20.0)
    assert [g[:2] for g in even.label([["x", "y"]])] == [("a", 1.0)]
    assert language.identify(odd.where("false"), model).count() == 0
    with pytest.raises(ValueError, match="languages"):
        language.fit(languages, max_langs=2)


def test_language_learns_nothing_from_held_out_rows(languages):
    poisoned = languages.withColumn("lang", F.when(language.held_out(), "zz").otherwise(F.col("lang")))
    assert "zz" not in language.fit(poisoned).langs


def test_spans_of_mixed_text(spark, languages):
    model = language.fit(languages)
    by = {k: " ".join(r["text"] for r in languages.where(F.col("lang") == k).limit(3).collect()).split()[:80] for k in ("en", "de")}
    text = " ".join(by["en"] + by["de"])
    row = language.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, spans=True).collect()[0]
    assert [s["lang"] for s in row["spans"]] == ["en", "de"]


def test_viterbi_shortcut_equals_full_recursion():
    rng, model = np.random.default_rng(2), language.LanguageModel(["a", "b", "c"], {}, np.zeros((1, 3)), {}, switch=3.0)
    for _ in range(200):
        s = rng.standard_normal((int(rng.integers(1, 12)), 3)) * 2
        path = model.viterbi(s)
        best = -1e18
        for code in range(3 ** len(s)):
            p = [code // 3**i % 3 for i in range(len(s))]
            best = max(best, sum(s[i, x] for i, x in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:], strict=False)))
            if len(s) > 7:
                break
        value = sum(s[i, x] for i, x in enumerate(path)) - 3.0 * int((np.diff(path) != 0).sum())
        assert len(s) > 7 or math.isclose(value, best)


# -- 6: chat ----------------------------------------------------------------------
def test_chat(spark):
    turn = lambda p, i, r, t: (p, i, r, t, "x")
    kind = "pair_id long, turn long, role string, text string, c string"
    chosen = spark.createDataFrame([turn(1, 0, "user", "hi"), turn(1, 1, "assistant", "yes"), turn(2, 0, "user", "q"), turn(3, 0, None, None), turn(None, 0, "user", "z"), turn(4, 0, "user", "a")], kind)
    rejected = spark.createDataFrame([turn(1, 0, "user", "hi"), turn(1, 1, "assistant", "no"), turn(1, 2, "user", "?"), turn(3, 0, None, None), turn(4, 0, "user", "b")], kind)
    got = {r["pair_id"]: r for r in chat.format_preferences(chosen, rejected).collect()}
    assert set(got) == {1, 2, 3, 4}
    a = got[1]
    assert a["n_prompt_turns"] == 1 and a["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    assert [a["chosen"][m["first"] : m["end"]] for m in a["chosen_mask"]] == ["yes<|im_end|>\n"]
    assert [a["rejected"][m["first"] : m["end"]] for m in a["rejected_mask"]] == ["no<|im_end|>\n"]
    assert got[2]["n_prompt_turns"] == 0 and got[2]["rejected"] == "" and got[2]["chosen_mask"] == []
    assert got[3]["n_prompt_turns"] == 1 and got[3]["chosen"] == "" and got[4]["n_prompt_turns"] == 0
    assert chat.format_preferences(chosen.where("false"), rejected.where("false")).count() == 0


def test_chat_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    want = con.execute(entries.ORACLE_SQL["op6_chat"]).df().sort_values("pair_id").reset_index(drop=True)
    got = entries.op6_chat(spark, DATA).toPandas().sort_values("pair_id").reset_index(drop=True)
    assert got[sorted(got.columns)].astype(str).equals(want[sorted(want.columns)].astype(str))


# -- pipeline ---------------------------------------------------------------------
def first_places(rows, length):
    """Text left of each (id, text) when every ``length`` bytes that stood in an earlier place go, at whole characters."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        body = t.encode()
        gone = bytearray(len(body))
        for j in range(len(body) - length + 1):
            if body[j : j + length] in seen:
                gone[j : j + length] = b"\1" * length
            seen.add(body[j : j + length])
        at = 0
        for c in t:  # a character goes if all of it does
            n = len(c.encode())
            gone[at : at + n] = bytes([all(gone[at : at + n])]) * n
            at += n
        out[i, t] = bytes(c for c, x in zip(body, gone, strict=True) if not x).decode()
    return out


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    from tests.llm.test_text_operators import brute_components

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    odd = [(10_001, "123", "en", "s", 3), (10_002, None, None, None, None), (10_003, "привет мир " * 9, "en", "s", 5)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.limit(2)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    own = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, own, str(tmp_path)).write.parquet(str(tmp_path / name))
        before, own = own, spark.read.parquet(str(tmp_path / name))
        seen.append((before, own))
    assert all(x.columns == corpus_pipeline.COLUMNS for _, x in seen[:-1])
    (first, a), (_, b), (_, c), (_, d), (_, e) = [(x.collect(), y.collect()) for x, y in seen]
    assert {r["doc_id"] for r in first} - {r["doc_id"] for r in a} == {10_001, 10_002, 10_003}
    rows = [(r["doc_id"], r["text"]) for r in a if r["doc_id"] is not None]
    want = sorted(i for i, x in brute_components(rows, 5, 80).items() if i == x)
    assert sorted(r["doc_id"] for r in b) == want  # also of rows that repeat, and of the copy without an id
    left = first_places([(r["doc_id"], r["text"]) for r in b], 200)
    assert {(r["doc_id"], r["text"]) for r in c} == {(i, t) for (i, _), t in left.items() if t.strip()}
    assert all(r["n_chars"] == len(r["text"]) for r in c)
    assert sorted(map(tuple, c)) == sorted(map(tuple, d))
    lib = Tokenizer.from_file(entries.vocabulary("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in d}
    assert {r["doc_id"]: r["ids"] for r in e} == {i: lib.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    # The places of the last stage follow the schedule of the one before it.
    slot = {r["doc_id"]: r["slot"] for r in mixing.interleave(seen[3][0]).collect()}
    order = [slot[r["doc_id"]] for r in sorted(e, key=lambda r: (r["part"], r["place"]))]
    assert order == sorted(order)


def odd_documents(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, slot int, k string, f int, h double, part int"
    long = " ".join(f"the of and to in is was {i}" for i in range(40_000))
    some = "the quick of and that was in for it with as his on be at by this had not are but from or have"
    # Ids 0 and 1 are rows to learn from.
    rows = [(None, some), (None, some), (1, some + " one two three four five six seven"), (1, "la que el en y a los se del las por un para con no una su al lo como")]
    rows += [(6, long), (7, None), (8, ""), (9, some)]
    return spark.createDataFrame([(i, t, "es" if t and t.startswith("la") else "en", None if i == 6 else "s", 1, 3, "x", 4, 0.5, 6) for i, t in rows], kind)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_documents(spark, stage):
    docs = odd_documents(spark)
    got = stage(spark, docs, DATA).collect()
    key = lambda rows: sorted(((r["doc_id"], r["text"] or "") for r in rows), key=str)
    if stage is corpus_pipeline.encode:
        assert len(got) == 8 and sorted(r["n_tokens"] == 0 for r in got) == [False] * 6 + [True] * 2
    else:
        rows = {(r["doc_id"], r["text"] or "") for r in docs.collect()}
        if stage is corpus_pipeline.language_id:
            assert key(got) == key(r for r in docs.collect() if r["text"])
        elif stage is corpus_pipeline.near_duplicates:  # the smallest id of the copies of ``some`` stays
            assert key(got) == sorted(((i, t) for i, t in rows if i is not None), key=str)
        else:
            assert key(got) == key(docs.collect())
        assert all(list(r.asDict()) == corpus_pipeline.COLUMNS for r in got)
    assert stage(spark, docs.where("false"), DATA).count() == 0


def test_pipeline_drops_scattered_edits_by_five_words(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    near = [f"edit{i}" if i in (30, 80, 130, 170) else w for i, w in enumerate(words)]
    far = [f"edit{i}" if i in (20, 50, 80, 110, 140, 170) else w for i, w in enumerate(words)]
    rows = [(1, " ".join(words), "en", "s", 1), (2, " ".join(near), "en", "s", 1), (3, " ".join(far), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()) == [1, 3]
