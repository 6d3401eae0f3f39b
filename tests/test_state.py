from pyspark.sql import functions as F

from quire.operators import state as S
from quire.operators.prefix import running_max_blocks, running_total_blocks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_upsert_keeps_old_values_and_adds_keys(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", None), (None, "n", 0)], "id BIGINT, name STRING, pages BIGINT")
    new = spark.createDataFrame([(2, None, 7), (3, "c", None), (None, "m", 1)], "id BIGINT, name STRING, pages BIGINT")
    assert rows(S.upsert(old, new, "id")) == sorted([(1, "a", 5), (2, "b", 7), (3, "c", None), (None, "n", 0), (None, "m", 1)], key=repr)
    assert rows(S.upsert(old, new.limit(0), "id")) == rows(old)
    assert rows(S.sparse_update(old, new, "id")) == sorted([(1, "a", 5), (2, "b", 7), (None, "n", 0)], key=repr)


def test_top_k_with_ties_nulls_and_one_hot_group(spark):
    data = [("h", i % 5, i) for i in range(500)] + [(None, None, 1), (None, 2, 2), ("x", 1, 9)]
    df = spark.createDataFrame(data, "k STRING, v BIGINT, id BIGINT")
    got = S.top_k(df, ["k"], [F.desc("v"), F.asc("id")], 3, parts=4)
    want = sorted([("h", 4, i) for i in (4, 9, 14)] + [(None, 2, 2), (None, None, 1), ("x", 1, 9)], key=repr)
    assert rows(got.select("k", "v", "id")) == want
    assert S.latest(df.limit(0), ["k"], [F.desc("v")]).count() == 0


def test_swap_rejects_stale_changes(spark):
    cur = spark.createDataFrame([("a", 1, "x"), ("b", 4, "y")], "k STRING, revision BIGINT, text STRING")
    ch = spark.createDataFrame([("a", 1, "new"), ("b", 3, "late"), ("c", None, "first")], "k STRING, expected BIGINT, text STRING")
    snapshot, rejected = S.swap(cur, ch, "k", "revision")
    assert rows(snapshot) == sorted([("a", 2, "new"), ("b", 4, "y"), ("c", 1, "first")], key=repr)
    assert [r.k for r in rejected.collect()] == ["b"]


def test_drift_and_digest(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "id BIGINT, v STRING")
    b = spark.createDataFrame([(1, "x"), (3, "y"), (None, None)], "id BIGINT, v STRING")
    assert rows(S.drift(a, b, ["id"])) == sorted([(2, "missing"), (3, "extra"), (None, "changed")], key=repr)
    d = lambda df: tuple(S.digest(df, F.col("id"), F.col("v")).first())
    assert d(a) == d(a.repartition(3)) and d(a) != d(b) and d(a)[0] == 3


def test_replan_needs_text(spark):
    s = "id BIGINT, document_id BIGINT, sequence_index BIGINT, source_hash STRING, status STRING, translation_text STRING"
    prev = spark.createDataFrame([(1, 1, 1, "h", "done", "a"), (2, 1, 2, "h", "done", "b"), (3, 1, 3, "g", "done", ""), (4, 2, 1, "k", "failed", "c")], s)
    new = spark.createDataFrame([(1, "u1", "h"), (1, "u2", "g"), (2, "u1", "k"), (None, "u1", "h")], "document_id BIGINT, unit_key STRING, source_hash STRING")
    got = {(r.document_id, r.unit_key): (r.status, r.kept_from) for r in S.replan(new, prev).collect()}
    assert got == {(1, "u1"): ("done", 2), (1, "u2"): ("pending", None), (2, "u1"): ("pending", None), (None, "u1"): ("pending", None)}


def test_pages(spark):
    f = spark.createDataFrame([(1, 20), (2, None), (3, 0), (4, 3)], "id BIGINT, page_count BIGINT")
    assert rows(S.page_tiles(f))[:3] == [(1, 1, 1, 8), (1, 2, 9, 16), (1, 3, 17, 20)] and S.page_tiles(f).count() == 4
    b = spark.createDataFrame([(1, 1, 18, "done"), (1, 15, 19, "done_cached"), (4, 1, 3, "failed"), (4, 3, 1, "done"), (4, None, 2, "done")], "document_id BIGINT, page_start BIGINT, page_end BIGINT, status STRING")
    assert rows(S.uncovered_pages(f, b)) == [(1, 20), (4, 1), (4, 2), (4, 3)]


def test_running_total_over_blocks(spark):
    df = spark.createDataFrame([(k, i, i % 9) for k in ("a", None) for i in range(200)], "k STRING, i BIGINT, v BIGINT")
    got = running_total_blocks(df, ["k"], F.floor(F.col("i") / 16), ["i"], F.col("v"), "t").collect()
    for r in got:
        assert r.t == sum(x % 9 for x in range(r.i))


def test_running_max_over_blocks(spark):
    df = spark.createDataFrame([(k, i, (i * 7) % 31 if i % 3 else None) for k in ("a", None) for i in range(150)], "k STRING, i BIGINT, v BIGINT")
    for inclusive in (True, False):
        for r in running_max_blocks(df, ["k"], F.floor(F.col("i") / 16), ["i"], {"m": F.col("v")}, inclusive).collect():
            seen = [(x * 7) % 31 for x in range(r.i + inclusive) if x % 3]
            assert r.m == (max(seen) if seen else None)


def test_carry_forward(spark):
    p = spark.createDataFrame([(i, 1, i) for i in range(1, 6)] + [(9, None, 1)], "id BIGINT, document_id BIGINT, sequence_index BIGINT")
    c = spark.createDataFrame([(2, 7), (2, 8), (4, 1), (None, 3)], "source_partition_id BIGINT, version BIGINT")
    got = {r.partition_id: (r.frozen_version, r.used_version) for r in S.carry_forward(p, c).collect()}
    assert got == {1: (None, None), 2: (8, None), 3: (None, 8), 4: (1, 8), 5: (None, 1), 9: (None, None)}
