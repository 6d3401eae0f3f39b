from pyspark.sql import functions as F

from quire.functions import records as R
from quire.operators import knowledge as K
from quire.operators import qa
from quire.operators import translate as T
from quire.sources import markdown as M

NESTED = """# about
title: "A: b"
scope:
  namespace: coding
  levels:
    repo: demo  # which
    empty:
tags: [a, "b, c", null]
list:
  - one
  - "two"
flag: True
none: ~
at: 2026-01-01T00:00:00Z
text: |
  first
  second
nothing: {}"""


def test_nested_front_matter():
    fields, error = M.parse_fields(NESTED)
    assert error is None and fields == {
        "title": "A: b", "scope.namespace": "coding", "scope.levels.repo": "demo", "scope.levels.empty": "", "tags": ["a", "b, c", ""], "list": ["one", "two"], "flag": "true", "none": "",
        "at": "2026-01-01T00:00:00Z", "text": "first\nsecond", "nothing": [],
    }
    assert M.parse_fields("a: 1\nb: 2\na: 3")[1] == "duplicate_key: a" and M.parse_fields("a:\n  x: 1\n  x: 2")[1] == "duplicate_key: a.x"
    assert M.parse_fields("a: 1\nno key")[1] == "unreadable: line 2" and M.parse_fields("- a")[1] == "unreadable: line 1" and M.parse_fields("") == ({}, None)
    assert M.parse_fields("a:\n  x: 1\nb:\n  x: 2")[0] == {"a.x": "1", "b.x": "2"}


def test_decode_problems(spark):
    import hashlib

    body = "the content\n"
    good = hashlib.sha256(body.encode()).hexdigest()
    heads = [f"v: 1\nhash: {good}", f"v: 2\nhash: {good}", "v: 1\nhash: 00", f"hash: {good}", f"v: 1\nv: 1\nhash: {good}", f"v: 1\nhash: {good}\nmore: x", None]
    df = spark.createDataFrame([(i, h, body) for i, h in enumerate(heads)], "i INT, h STRING, body STRING").select("i", M.nested_fields(F.col("h")).alias("f"), "body")
    p = M.decode_problems(F.col("f.fields"), F.col("f.error"), F.col("body"), ["v", "hash"], version=("v", "1"), hash_key="hash")
    got = {r.i: r.p for r in df.select("i", p.alias("p")).collect()}
    assert got == {0: [], 1: ["version"], 2: ["hash_mismatch"], 3: ["key_missing:v"], 4: ["duplicate_key: v", "key_missing:hash"], 5: ["key_unknown:more"], 6: ["key_missing:v", "key_missing:hash"]}


def test_flat_translation_keeps_what_passes_through():
    text = "one `code`\n\n<!-- keep me -->\n\ntwo <table><tr><td>three</td></tr></table> four\n"
    out, prompt, _ = T.flat(T.echo, "k", text)
    assert out == "ONE `code`\n\n<!-- keep me -->\n\nTWO <table><tr><td>three</td></tr></table> FOUR\n" and prompt == len("four")
    assert T.flat(T.echo, "k", "") == ("", 0, 0)


def test_repair_is_taken_only_if_it_helps(spark):
    table = "| a | b |\n| --- | --- |\n| 1 | 2 |"
    rows = [(1, table, "lost", "done", None), (2, table + " `x`", "lost", "done", None), (3, table, table, "done", ""), (4, table, "RAISE", "done", None), (5, None, None, None, None)]
    df = spark.createDataFrame(rows, "id BIGINT, source_text STRING, translation_text STRING, status STRING, warning_flags STRING")

    def chat(source, old, codes):
        if old == "RAISE":
            raise RuntimeError("down")
        return source.replace(" `x`", "")

    got = {r.id: (r.repaired, r.qa_status, r.translation_text) for r in qa.repair(df, chat).collect()}
    assert got[1] == (True, "pass", table) and got[2][:1] + got[2][2:] == (False, "lost") and got[3] == (False, "pass", table) and got[4][0] is False and got[5][0] is False


def test_versions_and_relations(spark):
    df = spark.createDataFrame([("1.2.3", "1.2.3"), ("1.2.3", "1.10.0"), ("2.0.0", "1.10.0"), ("x", "1.0.0"), (None, "1.0.0")], "a STRING, b STRING")
    assert [r.s for r in df.select(R.version_state(F.col("a"), F.col("b")).alias("s")).collect()] == ["same", "behind", "ahead", "unknown", "unknown"]
    d = spark.createDataFrame([("uses: b.md",), ("c.md",), (":x",), ("k:a:b",)], "r STRING")
    kind, target = K.split_relation(F.col("r"))
    assert [tuple(r) for r in d.select(kind, target).collect()] == [("uses", "b.md"), ("related_to", "c.md"), ("related_to", "x"), ("k", "a:b")]
