import datetime
import json

from pyspark.sql import functions as F

from quire.functions import records as R
from quire.operators import knowledge as K
from quire.operators import translate as T
from quire.sources import stores as S

UNITS = "id BIGINT, unit_key STRING, source_text STRING, translation_text STRING, status STRING"


def test_translate_ladder(spark):
    def chat(key, text):
        if "FAIL" in text and "OTHER" in text:
            raise RuntimeError("too long")
        if "NEVER" in text:
            return "lost", "stop", 1, 1
        if "LENGTH" in text:
            return text, "length", 1, 1
        return T.echo(key, text)

    long = "FAIL here.\n\nOTHER half `code`."
    rows = [(1, "u1", "see `code` and $x$", None, "pending"), (2, "u2", long, None, "failed"), (3, "u3", "NEVER `c`", "", "pending"), (4, "u4", "x", "kept", "done"), (5, "u5", "x", "", "done"), (6, None, None, None, None), (7, "u7", "LENGTH", None, "pending")]
    got = {r.id: r for r in T.translate(spark.createDataFrame(rows, UNITS), chat, calls=2).collect()}
    assert set(got) == {1, 2, 3, 5, 6, 7}
    assert got[1].translation_text == "SEE `code` AND $x$\n" and got[1].status == "done" and got[1].attempts == 1
    assert got[2].translation_text == "FAIL HERE.\n\nOTHER HALF `code`.\n" and got[2].warning == "bisected" and got[2].attempts == 4
    assert got[3].status == "fallback" and got[3].translation_text == "NEVER `c`\n" and "protected" in got[3].warning
    assert got[7].warning == "finish_reason=length" and got[5].status == "done"
    assert T.extract_reply("no marks ", "u") == "no marks\n" and T.extract_reply("a<<<UNIT:u:BEGIN>>> b <<<UNIT:u:END>>>c", "u") == "b\n"


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, t {kind}")
    return [r.o for r in df.select("i", f(F.col("t")).alias("o")).orderBy("i").collect()]


def test_memory_ids(spark):
    at = datetime.datetime(2016, 7, 30, 23, 54, 10, 259000)
    df = spark.createDataFrame([(at, "00" * 10), (at, "ff" * 10)], "t TIMESTAMP, e STRING").select(R.memory_id(F.col("t"), F.col("e")).alias("m"))
    low, high = (r.m for r in df.collect())
    value = 0
    for ch in low[4:]:
        value = value * 32 + R.BASE32.index(ch)
    assert value >> 80 == 1469922850259 and value & ((1 << 80) - 1) == 0 and low < high and len(low) == 30
    assert column(spark, [low, high, "MEM-8" + low[5:], low.lower(), None], R.is_memory_id) == [True, True, False, False, False]


def test_values(spark):
    assert column(spark, ["3", "1e3", "-1", "nan", "", None, "301"], R.retry_after) == [3.0, None, None, None, None, None, 300.0]
    assert column(spark, [1, 2, 9], R.backoff, "int") == [1.0, 2.0, 8.0]
    assert column(spark, ["1.2.3", "1.2", "01.2.3", "1.0.0-rc.1+b"], R.is_semver) == [True, False, False, True]
    assert column(spark, ["2026-01-01T00:00:00Z", "2026-01-01", "2026-01-01T00:00+08:00"], R.is_instant) == [True, False, True]
    row = spark.range(1).select(R.canonical_json(b=F.lit(1), a=F.lit(None).cast("string")).alias("j"), R.ignore_labels(F.lit(True), F.lit(False)).alias("l")).first()
    assert row.j == '{"a":null,"b":1}' and row.l == [*R.PAGE_CHROME, "footnote"]


def test_index_blocks_round_trip(spark):
    rows = [("s", "b.md", "note", "B|x", ["h1", "h2", "h3", "h4"]), ("s", "a.md", "note", "A\nline", []), ("t", "c.md", "log", "C", None)]
    b = K.index_blocks(spark.createDataFrame(rows, "scope STRING, path STRING, type STRING, title STRING, hints ARRAY<STRING>"))
    got = {r.scope: r.block for r in b.collect()}
    assert "| [a.md](a.md) | `note` | A line | - |\n| [b.md](b.md) | `note` | B\\|x | h1<br>h2<br>h3 ... |" in got["s"]
    doc = spark.createDataFrame([("# I\r\n\r\nold\n", got["s"])], "d STRING, b STRING")
    one = doc.select(K.put_block(F.col("d"), F.col("b")).alias("d"), "b")
    two = one.select(K.put_block(F.col("d"), F.col("b")).alias("d"))
    assert one.first().d == two.first().d and one.first().d.startswith("# I\n\nold\n\n" + K.BEGIN)
    good = one.first().d
    assert column(spark, [good, good.replace("A line", "A lime"), good.replace(K.END, ""), "none", good.replace("<!-- checksum", "<!-- sum")], K.block_state) == ["ok", "stale", "unbalanced", "none", "no_checksum"]


def test_lint_and_links(spark):
    d = spark.createDataFrame([(1, {"type": "x", "life": "new"}, "# Goal\n"), (2, {}, "text")], "id INT, fields MAP<STRING, STRING>, body STRING")
    got = sorted((r.id, r.code, r.detail) for r in K.lint(d, ["type"], {"life": ["stable"]}, ["Goal"]).collect())
    assert got == [(1, "enum_invalid", "life=new"), (2, "field_missing", "type"), (2, "section_missing", "Goal")]
    assert column(spark, ["b.md#x", "../c.md", "/root.md", "http://x/y", "#only", "./d/../e.md"], lambda t: K.resolve_link(F.lit("docs/sub/a.md"), t)) == ["docs/sub/b.md", "docs/c.md", "root.md", None, None, "docs/sub/e.md"]


def test_stores(spark, tmp_path):
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "a.json").write_text(json.dumps({"prompt_tokens": 3, "requests": 1}))
    (tmp_path / "u" / "b.json").write_text("{broken")
    got = {r.path.rsplit("/", 1)[1]: (r.prompt_tokens, r.corrupt) for r in S.read_usage(spark, str(tmp_path / "u")).collect()}
    assert got == {"a.json": (3, False), "b.json": (None, True)}
    log = str(tmp_path / "log")
    S.append_log(spark.createDataFrame([(1, "a"), (2, "b")], "unit_id INT, v STRING"), log, "unit_id")
    S.append_log(spark.createDataFrame([(1, "c")], "unit_id INT, v STRING"), log, "unit_id")
    assert S.read_log(spark, log, "unit_id INT, v STRING").count() == 3 and S.count_lines(spark, log).first().lines == 3
    cache = S.store_cache(spark.createDataFrame([("k", "t"), ("k", "s"), ("e", " "), (None, "x")], "key STRING, translation STRING"), None)
    cache = S.store_cache(spark.createDataFrame([("k", "new"), ("l", "u")], "key STRING, translation STRING"), cache)
    assert sorted(tuple(r) for r in cache.collect()) == [("k", "s"), ("l", "u")]
    assert {r.key: r.hit for r in S.look_up(spark.createDataFrame([("k",), ("z",), (None,)], "key STRING"), cache).collect()} == {"k": True, "z": False, None: False}
    target = str(tmp_path / "t")
    S.write_new(cache, target)
    try:
        S.write_new(cache.limit(1), target)
        raise AssertionError("written twice")
    except Exception as e:
        assert "exist" in str(e).lower()
    S.replace(cache.limit(1), target)
    assert spark.read.parquet(target).count() == 1
    (tmp_path / "cal.json").write_text(json.dumps({"buckets": {"m": [1.0, 99, -1, 0.01]}}))
    assert sorted(r.ratio for r in S.read_calibration(spark, str(tmp_path / "cal.json")).collect()) == [0.2, 1.0, 8.0]


def test_discover_and_import(spark, tmp_path):
    for name in ("a.pdf", "sub/b.pdf", "x.results/c.pdf", "note.txt"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"1234")
    found = S.discover(spark, str(tmp_path / "in"))
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.pdf", "b.pdf"] and {r.bytes for r in found.collect()} == {4}
    w = tmp_path / "w"
    (w / "chunks").mkdir(parents=True)
    (w / "chunks" / "b00001.source.md").write_text("one")
    (w / "chunks" / "b00001.zh.md").write_text("一")
    (w / "chunks" / "own.md").write_text("two")
    (w / "state.json").write_text(json.dumps({"source_pdf": "/p/doc.pdf", "source_pdf_sha256": "s", "completed": False, "chunks": [{"status": "done"}, {"id": "k2", "source_file": "chunks/own.md", "status": "error"}]}, indent=1))
    file, units = S.import_workspace(spark, str(w))
    assert tuple(file.first()) == ("/p/doc.pdf", "s", "doc.pdf", "translation_running")
    u = {r.unit_key: r for r in units.collect()}
    assert u["b00001"].source_text == "one" and u["b00001"].translation_text == "一" and u["b00001"].status == "done" and u["b00001"].attempt_count == 1
    assert u["k2"].source_text == "two" and u["k2"].status == "failed" and u["k2"].translation_text is None and u["k2"].sequence_index == 2
