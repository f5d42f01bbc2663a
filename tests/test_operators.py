import numpy as np
from pyspark.sql import functions as F

from foliospark.operators import chunks, lookup, symbols


def test_unlike_sizes(spark):
    rng, rows = np.random.default_rng(1), []
    for i in range(30):
        w, h = int(rng.integers(3, 9)), int(rng.integers(3, 9))
        rows.append((1, i, w, h, (rng.random((h, w)) < 0.5).astype(np.uint8)))
    df = spark.createDataFrame([(d, i, w, h, np.packbits(m, axis=1).tobytes()) for d, i, w, h, m in rows], "doc_id int, sym_idx int, w int, h int, data binary")
    want = {}
    for _, i, w, h, m in rows:
        for _, j, nw, nh, n in rows[:i]:
            if abs(w - nw) <= 2 and abs(h - nh) <= 2 and (w, h) != (nw, nh):
                d = int((m != n[np.arange(h) * nh // h][:, np.arange(w) * nw // w]).sum())
                want[i] = min(want.get(i, (d, j)), (d, j))
    got = {r["sym_idx"]: (r["distance"], r["near"]) for r in lookup.unlike_size_nearest(df, 2).collect()}
    assert got == want


def test_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([(1, 1, 9, 50), (1, 2, 8, 60), (1, 3, 7, 40), (1, 4, 7, 10)], "doc_id int, symbol long, pages int, pixels long")
    assert symbols.within_budget(df, "pages", "pixels", 100).collect()[0]["kept"] == [1, 4, 3]


def test_ranges_and_compressed_first(spark):
    r = spark.createDataFrame([("2-5",), ("5-2",), ("x",)], "t string").select(chunks.page_range(F.col("t")).alias("r")).collect()
    assert [x["r"] and tuple(x["r"]) for x in r] == [(1, 5), None, None]
    df = spark.createDataFrame([(b"", b"p"), (None, b"p"), (b"z", None), (None, None)], "z binary, a binary")
    own = df.select(chunks.prefer_compressed(F.col("z"), F.col("a"), lambda c: F.lit("packed"), lambda c: F.lit("plain")).alias("v")).collect()
    assert [x["v"] for x in own] == [None, "plain", "packed", None]
