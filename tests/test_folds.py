import random

from quire.operators import folds


def fold(rule, values):
    step = rule()
    return [step(v) for v in values]


def test_reference_vector():
    assert [x[0] for x in fold(folds.partition_rule(), [(40_000,)] * 5)] == [1, 1, 1, 2, 2]


def test_partition_rule_keeps_its_bounds():
    rng = random.Random(1)
    sizes = [rng.randint(0, 900) for _ in range(400)]
    parts = [x[0] for x in fold(folds.partition_rule(1_000, 2_000, 2_500), [(s,) for s in sizes])]
    assert parts == sorted(parts) and set(parts) == set(range(1, max(parts) + 1))
    for p in set(parts):
        assert sum(s for s, q in zip(sizes, parts) if q == p) <= 2_500


def test_unit_rule():
    atomic = frozenset({"code"})
    rule = folds.unit_rule(10, 20, 4, atomic)
    got = [x[0] for x in fold(rule, [(4, "paragraph", None), (1, "heading", 2), (3, "paragraph", None), (1, "heading", 3), (9, "code", None), (30, "paragraph", None), (1, "paragraph", None), (30, "code", None)])]
    assert got == [1, 2, 2, 2, 2, 3, 4, 5]
    # atomic blocks are never parted from each other by the target, and no unit but a first node is above the maximum
    assert [x[0] for x in fold(rule, [(9, "code", None)] * 3)] == [1, 1, 2]


def test_budget_rule_skips_what_does_not_fit():
    got = fold(folds.budget_rule(10), [(6, True), (5, False), (4, False), (None, False), (9, True), (1, False)])
    assert [x[0] for x in got] == ["selected", "budget_trimmed", "selected", "selected", "selected", "budget_trimmed"]
    assert got[-1][1] == 19


def test_limit_rule():
    codes = [200, 200, 429, 503, 500, None, 200, 200]
    assert [x[0] for x in fold(folds.limit_rule(16, 64, 2), [(c,) for c in codes])] == [16, 18, 9, 6, 6, 6, 6, 8]


def test_frames(spark):
    rows = [("a", i, 3) for i in range(30)] + [(None, 1, 50), (None, 2, 1), ("b", 1, None)]
    df = spark.createDataFrame(rows, "k STRING, i BIGINT, n BIGINT")
    out = folds.ordered_fold(df, "k", ["i"], ["n"], folds.chunk_rule(12), "chunk BIGINT").collect()
    a = [r.chunk for r in sorted(out, key=lambda r: r.i) if r.k == "a"]
    assert a == [1 + i // 2 for i in range(30)]
    assert {(r.i, r.chunk) for r in out if r.k is None} == {(1, 1), (2, 2)} and len(out) == len(rows)
    assert folds.ordered_fold(df.limit(0), "k", ["i"], ["n"], folds.chunk_rule(12), "chunk BIGINT").count() == 0


def test_ranges_give_what_whole_groups_give(spark):
    rng = random.Random(7)
    kinds = ["paragraph", "heading", "code"]
    # one group holds most rows, so that it lies in many ranges; others begin and end inside ranges, some are tiny
    rows = [(k, i, rng.choice([None, rng.randint(0, 40)]), rng.choice(kinds), rng.choice([None, 1, 3]), rng.choice([200, 200, 200, 429, 503, None])) for k, n in ((None, 30), ("a", 2), ("b", 3000), ("c", 1), ("d", 200)) for i in range(n)]
    df = spark.createDataFrame(rows, "k STRING, i BIGINT, n INT, t STRING, l INT, code INT").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for rule, inputs in (
            (folds.chunk_rule(60), ["n"]), (folds.partition_rule(50, 120, 150), ["n"]), (folds.unit_rule(60, 90, 20, frozenset({"code"})), ["n", "t", "l"]), (folds.limit_rule(16, 64, 3), ["code"]),
            (folds.chunk_rule(10**9), ["n"]),  # the runs never meet
        ):
            got = {(r.k, r.i): r.x for r in folds.ranged_fold(df, "k", ["i"], inputs, rule, "x").collect()}
            want = {}
            for key in {r[0] for r in rows}:
                step = rule()
                for r in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
                    want[key, r[1]] = step(tuple(r[["k", "i", "n", "t", "l", "code"].index(c)] for c in inputs))[0]
            assert got == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert folds.ranged_fold(df.limit(0), "k", ["i"], ["n"], folds.chunk_rule(), "x").count() == 0
