import random
import re

from quire.operators.hierarchy import faults, tree_table
from quire.operators.prefix import running_total

SCHEMA = "id BIGINT, document_id BIGINT, parent_id BIGINT, node_type STRING, heading_level BIGINT, heading_path STRING, source_text STRING, depth STRING"


def brute(rows):
    """Reference answer by walking the chain of each node."""
    by = {r[0]: r for r in rows}
    title = lambda r: re.sub(r"^#+", "", r[6] or "").strip()
    found, trees = set(), {}
    for i, r in by.items():
        chain, seen, at = [], set(), r
        while at is not None and at[0] not in seen:
            seen.add(at[0])
            chain.append(at)
            at = by.get(at[2]) if at[2] is not None else None
        if at is not None:
            on = False
            x = by.get(r[2])
            for _ in range(len(by) + 1):
                if x[0] == i:
                    on = True
                    break
                x = by[x[2]]
            found.add((i, "cycle" if on else "below_cycle"))
        else:
            path = " / ".join(title(x) for x in reversed(chain) if x[3] == "heading")
            trees[i] = (chain[-1][0], len(chain) - 1, path)
            whole = chain[-1][2] is None and len({x[1] for x in chain}) == 1
            if whole and r[5] is not None and r[5] != path:
                found.add((i, "path_mismatch"))
        if r[2] is not None:
            p = by.get(r[2])
            if p is None:
                found.add((i, "lost_parent"))
            elif p[1] != r[1]:
                found.add((i, "foreign_parent"))
            elif r[3] == p[3] == "heading" and r[4] is not None and p[4] is not None and r[4] <= p[4]:
                found.add((i, "level_mismatch"))
    return found, trees


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    found, trees = brute(rows)
    got = [tuple(r) for r in faults(df).collect()]
    assert len(got) == len(set(got)) and set(got) == found
    out = {r.node_id: r for r in tree_table(df).collect()}
    assert set(out) == {r[0] for r in rows}
    by = {r[0]: r for r in rows}
    spans = {}
    for i, r in out.items():
        assert ((r.root_id, r.depth, r.path) if r.root_id is not None else None) == trees.get(i)
        if r.root_id is not None:
            spans.setdefault(r.root_id, {})[r.pre] = i
    for i, r in out.items():
        if r.root_id is None:
            continue
        got = {spans[r.root_id][k] for k in range(r.pre + 1, r.pre + r.subtree_size)}
        want = set()
        for j in out:
            x = by[j][2]
            hops = 0
            while x in by and hops <= len(by):
                if x == i:
                    want.add(j)
                    break
                x, hops = by[x][2], hops + 1
        assert got == want


def test_random_forests(spark):
    rng = random.Random(5)
    for n, deep in ((60, False), (40, True)):
        rows = []
        for i in range(1, n + 1):
            parent = rng.choice([None, max(1, i - 1) if deep else rng.randint(1, n), rng.randint(1, i), n + 9, i - 1 or None])
            kind = rng.choice(["heading", "heading", "paragraph"])
            rows.append((i, rng.choice([1, 1, 1, 2, None]), parent, kind, rng.choice([None, 1, 2, 3]), rng.choice([None, "", "T1", "T1 / T2"]), f"## T{i} \n", "clash"))
        check(spark, rows)


def test_long_chain_star_and_repeats(spark):
    chain = [(i, 1, i - 1 if i > 1 else None, "heading", i, None, f"# c{i}", "x") for i in range(1, 40)]
    star = [(100 + i, 1, 100 if i else None, "paragraph", None, "", "t", "x") for i in range(60)]
    check(spark, chain + star)
    df = spark.createDataFrame((chain + star) * 2, SCHEMA)
    assert tree_table(df).count() == len(chain + star)


def test_empty_table_and_null_ids(spark):
    assert faults(spark.createDataFrame([], SCHEMA)).count() == 0
    only = spark.createDataFrame([(None, 1, 1, "heading", 1, "a", "# a", "x")], SCHEMA)
    assert tree_table(only).count() == 0


def test_running_total_splits_hot_groups(spark):
    from pyspark.sql import functions as F

    rows = [(1 if i % 3 else i, i, i % 7) for i in range(900)] + [(None, 1000, 3), (None, 1001, 4)]
    df = spark.createDataFrame(rows, "k BIGINT, id BIGINT, v BIGINT")
    got = running_total(df, ["k"], F.xxhash64("id"), ["id"], F.col("v"), "before", len(rows), rows_per_task=50).withColumn("h", F.xxhash64("id")).collect()
    sums = {}
    for r in sorted(got, key=lambda r: (r.h, r.id)):
        assert r.before == sums.get(r.k, 0)
        sums[r.k] = sums.get(r.k, 0) + r.v
    assert len(got) == len(rows)
