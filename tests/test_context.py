from pyspark.sql import functions as F

from quire.operators.context import ContextRequest, select, warnings
from quire.operators.folds import select_within_budget

SCHEMA = (
    "document_id STRING, path STRING, kind STRING, text STRING, tokens BIGINT, tags ARRAY<STRING>, symbols ARRAY<STRING>, temperature STRING, epistemic_status STRING, lifecycle STRING, "
    "status STRING, namespace STRING, task_id STRING, valid_from TIMESTAMP, valid_until TIMESTAMP"
)


def knowledge(i, text, tokens, symbols=(), hot=None, epistemic="accepted"):
    return (i, f"docs/{i}.md", "knowledge", text, tokens, [], list(symbols), hot, epistemic, "stable", None, None, None, None, None)


def memory(i, tags, tokens=10, status="active", task=None, until=None):
    import datetime

    return (i, f"memory/{i}.md", "memory", f"note {i}", tokens, tags, [], None, None, None, status, "coding", task, None, until and datetime.datetime.fromisoformat(until))


ROWS = [
    knowledge("Architecture", "overview", 100, hot="hot"), knowledge("Domain", "terms", 50, ["ContextPlanner"]), knowledge("Large", "budgetword " * 3, 5_000), knowledge("Deprecated", "old", 20, hot="hot", epistemic="deprecated"),
    knowledge("Silent", "nothing asked", 5), memory("m1", ["mandatory"]), memory("m2", ["symbol:ContextPlanner", "path:src/context"]), memory("m3", ["mandatory"], task="TASK-OTHER"), memory("m4", ["mandatory"], until="2025-01-01"),
]
EDGES = [("Architecture", "uses", "Domain"), ("m1", "related_to", "m2"), ("m3", "related_to", "Silent")]


def run(spark, budget):
    c = spark.createDataFrame(ROWS, SCHEMA)
    r = spark.createDataFrame(EDGES, "document_id STRING, kind STRING, target_id STRING")
    request = ContextRequest(paths=("src/context/plan.py",), symbols=("contextplanner",), keywords=("BUDGETWORD",), scope=(("task_id", "TASK-1"),), budget=budget)
    out = select(c, r, request)
    return out, {x.document_id: x for x in out.collect()}


def test_states_reasons_and_budget(spark):
    out, got = run(spark, 200)
    assert {k: v.state for k, v in got.items()} == {
        "Architecture": "selected", "Domain": "selected", "Large": "budget_trimmed", "Deprecated": "epistemic_status_filtered:deprecated", "m1": "selected", "m2": "selected",
        "m3": "scope_filtered:task_id:TASK-OTHER", "m4": "validity_filtered:2026-01-01 00:00:00",
    }
    assert got["m2"].priority == "required" and got["m2"].reasons == ["path_match:src/context/plan.py", "symbol_match:contextplanner", "relation_from:m1:related_to"]
    assert got["Domain"].reasons == ["symbol_match:contextplanner", "relation_from:Architecture:uses"] and got["Large"].priority == "relevant"
    assert warnings(out, 200).count() == 0
    out, got = run(spark, 100)
    assert got["Architecture"].state == "selected" and [r.warning for r in warnings(out, 100).collect()] == ["required context exceeds budget by 70 token(s)"]
    assert run(spark, 6_000)[1]["Large"].state == "selected"


def test_budget_against_a_plain_walk(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([0, 1, 2, 3, 5, 8, 13, 40, None]), rng.random() < 0.03) for i in range(700)]
    df = spark.createDataFrame(rows, "k STRING, i BIGINT, t BIGINT, must BOOLEAN")
    got = {(r.k, r.i): r.state for r in select_within_budget(df, "k", ["i"], F.col("t"), F.col("must"), 100).collect()}
    want = {}
    for k in ("a", "b", None):
        used = sum(t or 0 for x, _, t, m in rows if x == k and m)
        for x, i, t, m in rows:
            if x == k:
                fits = m or used + (t or 0) <= 100
                used += (t or 0) if fits and not m else 0
                want[k, i] = "selected" if fits else "budget_trimmed"
    assert got == want
