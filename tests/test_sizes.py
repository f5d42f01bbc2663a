"""Queries on tables larger than those of the given scales, where a format or a name has few digits."""

import duckdb
import numpy as np
import pytest

from foliospark import plans
from foliospark.codecs import bzz, container, iff
from foliospark.operators import chunks
from foliospark.sources import documents as D
from tests.test_queries import rows


def against_sql(spark, name, folder, **tables):
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"copy ({sql}) to '{folder}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = plans.QUERIES[name](spark, str(folder)).toPandas()
    want = con.execute(plans.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    return got


def preorder(marks):
    below, out = {}, []
    for m in sorted(marks, key=lambda m: m["sibling_ord"]):
        below.setdefault(m["parent_id"], []).append(m)

    def put(up, at, depth):
        for i, m in enumerate(below.get(up, [])):
            node = len(out)
            out.append({"node_id": node, "parent_id": at, "depth": depth, "sibling_ord": i, "title": m["title"], "url": m["url"]})
            put(m["node_id"], node, depth + 1)

    put(None, None, 0)
    return out


@pytest.mark.parametrize("children, most", [(255, 65_535), (3, 1000), (1, 40), (255, 31), (2, 33)])
def test_bookmarks_in_volumes(children, most):
    rng = np.random.default_rng(children)
    up = [None if i < 2 else int(rng.integers(max(0, i - 30), i)) if i < 30 else int(rng.integers(0, 4)) for i in range(1200)]
    marks = [{"node_id": i, "parent_id": u, "sibling_ord": i, "title": f"T {i} é", "url": f"#{i}"} for i, u in enumerate(up)]
    got, volumes = [], list(container.bookmark_volumes(marks, children, most))
    for v in volumes:
        read = container.read_bookmarks(bzz.encode(v["raw"]))
        assert len(read) <= most and max(np.bincount([0, *(1 + r["parent_id"] for r in read if r["parent_id"] is not None)])[1:], default=0) <= children
        got += container.volume_rows(read, v["start"], v["chain"], v["first"])
    assert len(volumes) > 1 and got == preorder(marks)


def test_bookmarks_beyond_a_byte(spark, tmp_path):
    got = against_sql(
        spark, "bookmark_tree", tmp_path, nation="select i::int as n_nationkey, 'N' || i as n_name, (i % 2)::int as n_regionkey from range(5) r(i)",
        supplier="select i as s_suppkey, 'S' || i as s_name, (case when i < 600 then 2 else i % 4 end)::int as s_nationkey from range(1200) r(i)",
    )
    assert len(got) == 1205


def test_merged_pages_beyond_four_digits(spark, tmp_path):
    docs = "select i as doc_id, case when i % 3 > 0 then 'l' || i % 3 end as lang, case when i < 10050 then 'a' else 'b' end as source from range(10100) r(i)"
    got = against_sql(spark, "merge_renumber", tmp_path, documents=docs)
    assert got["page_index"].max() == 10_049
    parts = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = chunks.merge_renumber(parts, "source", "lang", "doc_id").where("source = 'a'").select("component_id")
    assert names.distinct().count() == 10_050 and names.where("component_id = 'd2p10049.djvu'").count() == 1


def test_nearest_symbols_are_not_broadcast(spark, tmp_path):
    orders = "select i as o_orderkey, (i * 37 % 700)::bigint as o_custkey, case when i % 9 > 0 then 'p' || i % 3 end as o_orderpriority from range(6000) r(i)"
    assert len(against_sql(spark, "nearest_symbol", tmp_path, orders=orders))
    plan = plans.QUERIES["nearest_symbol"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2


def test_many_small_blocks_are_coded_as_one():
    rng = np.random.default_rng(4)
    data = [b"", b"a", b"\0", b"\xff" * 50, b"ab" * 700, bytes(2049), *(rng.integers(0, k, n, dtype=np.uint8).tobytes() for k in (2, 30, 256) for n in rng.integers(1, 300, 9))]
    packed = bzz.encode_many(data)
    assert packed == [bzz.encode(d) for d in data] and bzz.decode_many(packed) == data
    assert isinstance(bzz.decode_many([b"x", packed[4]])[0], ValueError) and bzz.decode_many([]) == bzz.encode_many([]) == []


def test_areas_with_their_page(spark):
    info = iff.Chunk("INFO", container.write_info(100, 200, 300))
    text = '(background #ff00aa) (zoom 150) (mode color) (maparea "#1" "d" (rect 1 2 3 4) (xor)) (maparea "#2" "" (poly 1 2 3 4 5 6) (hilite #00ff00))'
    packed, plain = iff.Chunk("ANTz", bzz.encode(text.encode())), iff.Chunk("ANTa", b'(maparea "#3" "" (oval 1 2 3 4))')
    bad = iff.Chunk("ANTa", b'(maparea "u" "" (blob 1 2))')
    layered = [[packed], [plain], [iff.Chunk("ANTz", b""), plain], [packed, plain], [], [bad], [iff.Chunk("ANTz", b"x")]]
    files = [(f"f{i}", bytearray(iff.emit(iff.form("DJVU", info, *cs)))) for i, cs in enumerate(layered)] + [("f9", bytearray(b"nothing"))]
    df = spark.createDataFrame(files, "path string, content binary")
    page = D.annotations(df).where("error is null").select("path", "page_index", "background", "zoom", "mode")
    want = D.mapareas(df).join(page, ["path", "page_index"], "left")
    got = D.annotated_areas(df)
    assert rows(got.select(want.columns).toPandas().astype(str)) == rows(want.toPandas().astype(str)) and got.count() == 8


def test_few_bytes_are_many_tasks(spark, tmp_path):
    against_sql(spark, "map_areas", tmp_path, customer="select i as c_custkey, 'Customer ' || i as c_name from range(3000) r(i)")
    plan = plans.QUERIES["map_areas"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("FileScan") == 1
