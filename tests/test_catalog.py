import math

import pytest
from pyspark.sql import functions as F

from quire.operators import catalog as C
from quire.session import Stage

RECORDS = [
    ("m1", "Alpha architecture", "Alpha kernel boundary", "active", -1, 1), ("m2", "Beta implementation", "Body token-2", "active", -1, 1), ("m3", "Alpha candidate", "Body token-3", "candidate", -1, 1),
    ("m4", "Old active memory", "Body token-4", "active", -3, -2), ("m5", "Third hop", "Body token-5", "active", -1, 1),
]
EDGES = [("m1", "related_to", "m2"), ("m1", "related_to", "m3"), ("m1", "related_to", "m4"), ("m2", "related_to", "m5")]
NOW = "2026-07-24 02:00:00"


def fixture(spark):
    """Five records and four relations around one instant."""
    rows = [(i, f"memory/{i}.md", t, c, s, a, z, ["shared", f"tag-{i[1]}"], [f"entity-{i[1]}"]) for i, t, c, s, a, z in RECORDS]
    r = spark.createDataFrame(rows, "memory_id STRING, path STRING, title STRING, content STRING, status STRING, a INT, z INT, tags ARRAY<STRING>, entity_ids ARRAY<STRING>")
    day = lambda c: F.timestamp_add("DAY", F.col(c), F.lit(NOW).cast("timestamp"))
    r = r.select("memory_id", "path", "title", C.description(F.col("content")).alias("description"), "content", "status", "tags", "entity_ids", F.lit("query-test").alias("namespace"), F.lit("workspace-1").alias("workspace_id"), day("a").alias("valid_from"), day("z").alias("valid_until"))
    return r, spark.createDataFrame(EDGES, "memory_id STRING, relation_type STRING, target_memory_id STRING")


SCOPE = {"namespace": "query-test", "workspace_id": "workspace-1"}


def ids(spark, **asked):
    records, relations = fixture(spark)
    return [r.memory_id for r in C.query(records, relations, C.Request(**asked)).orderBy("rank").collect()]


def test_requests(spark):
    assert ids(spark, text="ALPHA", valid_at=NOW) == ["m1"]
    assert ids(spark, text="Alpha", text_mode="fts", valid_at=NOW) == ["m1"]
    assert ids(spark, text="nothing here", text_mode="fts") == []
    assert ids(spark, tags=("shared", "tag-1")) == ["m1"] and ids(spark, tags=("tag-1", "tag-2")) == []
    assert ids(spark, statuses=("candidate",)) == ["m3"]
    assert ids(spark, scope=SCOPE, entity_ids=("entity-2",), valid_at=NOW) == ["m2"]
    assert ids(spark, memory_ids=("m4",), valid_at=NOW) == [] and ids(spark, memory_ids=("m4",), valid_at="2026-07-22 02:00:00") == ["m4"]
    assert ids(spark, paths=("memory/m5.md",)) == ["m5"]
    assert ids(spark, memory_ids=("m1",), include_related=True, valid_at=NOW) == ["m1", "m2"]
    assert ids(spark, memory_ids=("m1", "m2"), include_related=True, valid_at=NOW, limit=2) == ["m1", "m2"]
    assert ids(spark, memory_ids=("m1",), include_related=True, relation_types=("other",)) == ["m1"]


def test_one_hop_is_one_hop(spark):
    assert "m5" not in ids(spark, memory_ids=("m1",), include_related=True, valid_at=NOW)


def test_warnings_and_reasons(spark):
    records, _ = fixture(spark)
    r = C.direct(records, C.Request(statuses=("candidate",), tags=("shared",))).first()
    assert r.matched_fields == ["tags", "status"] and r.match_reasons == ["tag:shared", "status:candidate"]
    assert r.warnings == ["excluded from ordinary queries: status candidate", "validity not evaluated"] and r.score is None


@pytest.mark.parametrize("bad", [{"limit": 0}, {"limit": 1001}, {"statuses": ()}, {"relation_types": ("x",)}, {"paths": ("/a",)}, {"paths": ("a/../b",)}, {"text_mode": "regex"}])
def test_bad_requests(bad):
    with pytest.raises(ValueError):
        C.Request(**bad)


def test_bm25_against_the_formula(spark):
    docs = [("a", "weld seam", "", "weld weld flow", []), ("b", "seam", "", "flow", ["weld"]), ("c", "x", "", "y", []), ("d", "", "", "", None), ("e", "flow", "", "flow", [])]
    df = spark.createDataFrame(docs, "memory_id STRING, title STRING, description STRING, content STRING, tags ARRAY<STRING>")
    lens = {d[0]: len((" ".join([d[1], d[3], *(d[4] or [])])).split()) for d in docs}
    n, avg = len(docs), sum(lens.values()) / len(docs)
    idf = lambda df: max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
    part = lambda tf, df, k: idf(df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lens[k] / avg))
    got = {r.memory_id: r for r in C.bm25(df, ["WELD", "seam"]).collect()}
    assert set(got) == {"a", "b"}
    assert abs(got["a"].score - part(3, 2, "a") - part(1, 2, "a")) < 1e-9 and got["b"].matched_fields == ["title", "tags"]


def test_description(spark):
    texts = ["# T\n\n# H\nline a\n line b \n\nnext", "# Only\n## Heads", "", "x" * 500]
    got = [r.d for r in spark.createDataFrame([(t,) for t in texts], "t STRING").select(C.description(F.col("t")).alias("d")).collect()]
    assert got == ["line a line b", "Only Heads", "", "x" * 280]


def test_query_rows(spark):
    """What each request gives, in the order of ranks."""
    records, relations = fixture(spark)
    scope = {"namespace": "query-test", "workspace_id": "workspace-1"}
    rows = lambda request: [(r.memory_id, r.score, r.relation_source_id, "|".join(r.matched_fields)) for r in C.query(records, relations, request).orderBy("rank").collect()]
    assert rows(C.Request(text="ALPHA", scope=scope, valid_at=NOW)) == [("m1", 3.0, None, "scope|status|validity|title|description|content")]
    assert rows(C.Request(memory_ids=("m1",), include_related=True, valid_at=NOW)) == [("m1", None, None, "memory_id|status|validity"), ("m2", None, "m1", "relations")]
    assert rows(C.Request(scope=scope, entity_ids=("entity-2",), valid_at=NOW)) == [("m2", None, None, "scope|status|validity")]


def test_match_syntax(spark):
    docs = [("a", "Café crème", "", "alpha beta gamma", ["x"]), ("b", "cafe", "", "beta alpha", []), ("c", "Alpha", "beta", "delta delta", None), ("d", None, None, None, [])]
    df = spark.createDataFrame(docs, "memory_id STRING, title STRING, description STRING, content STRING, tags ARRAY<STRING>")
    ask = lambda q: {r.memory_id for r in C.match(df, q).collect()}
    assert ask("cafe") == ask("CAFÉ") == {"a", "b"} and ask('"alpha beta"') == {"a"} and ask("alpha beta") == {"a", "b", "c"}
    assert ask("delta OR cafe") == {"a", "b", "c"} and ask("alpha NOT cafe") == {"c"} and ask('(gamma OR delta) AND alpha') == {"a", "c"} and ask("nothing") == set()
    assert {r.memory_id: r.matched_fields for r in C.match(df, "delta").collect()} == {"c": ["content"]}
    terms = {r.memory_id: r.score for r in C.bm25(df, ["alpha", "beta"]).collect()}
    assert {k: round(v, 9) for k, v in terms.items()} == {r.memory_id: round(r.score, 9) for r in C.match(df, "alpha beta").collect()}
    assert C.match(df.limit(0), "a").count() == 0
    for bad in ("", "alpha AND", "(alpha", "alpha)", '"', "NOT alpha", "a-b", "OR"):
        with pytest.raises(C.MatchSyntax):
            C.match(df, bad)


def test_a_damaged_catalog_is_seen(spark):
    from quire.sources import stores

    records, relations = fixture(spark)
    folder = Stage(spark, "catalog-test").base
    C.rebuild(records, relations, folder)
    assert all(r.ok for r in C.verify(spark, folder).collect())
    stores.replace(records.withColumn("content", F.when(F.col("memory_id") == "m2", "other").otherwise(F.col("content"))), f"{folder}/memories")
    stores.replace(relations.limit(2), f"{folder}/relations")
    assert {r.key for r in C.verify(spark, folder).collect() if not r.ok} == {"digest", "relations_count"}
