from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import markdown as M
from quire.functions.tokens import bytes_estimate, estimate_output, estimate_tokens
from quire.sources import markdown as src

SAMPLE = """# Title

<!-- source-page: 3 -->

Some prose
in two lines.

## Part

```py
a

b
```

$$
x
$$

<table><tr><td>1</td>

<td>2</td></tr></table>

- one
- two

> quoted

| a | b |
| - | - |
| 1 | 2 |

![alt](x.png)

References
"""


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, t {kind}")
    return [r.o for r in df.select("i", f(F.col("t")).alias("o")).orderBy("i").collect()]


def test_blocks_and_types(spark):
    b = M.blocks(SAMPLE)
    assert column(spark, b, M.node_type) == ["heading", "page_marker", "paragraph", "heading", "code", "formula", "html_table", "list", "blockquote", "markdown_table", "image", "reference"]
    assert M.blocks("") == [] and M.blocks("```\nopen\n\nend") == ["```\nopen\n\nend"]
    assert column(spark, ["", None, "  "], M.node_type) == ["unknown"] * 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["`a`", "$x$", "$$y$$", "\\[z\\]", "![a](b)", "http://a.b/c", "<i>", "```\nq\n```", "\n", " word ", "$5 ", "`", "$", "@@PRESERVE_00001@@x"]), max_size=25).map("".join))
def test_protect_round_trip(text):
    if "@@PRESERVE" not in text:
        assert M.restore(*M.protect(text)) == text


def test_protect_needs_each_token_once():
    text, spans = M.protect("see `code` and $x$ and ![a](b.png)")
    assert len(spans) == 3 and M.restore(text.replace("@@PRESERVE_00002@@", ""), spans) is None and M.restore(text + "@@PRESERVE_00001@@", spans) is None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<table><tr></tr></table>", "<div><table></table></div>", "<!-- c -->", "<a id='source-page-3'></a>", "text ", "\n", "<table>"]), max_size=12).map("".join))
def test_passthrough_is_a_partition(text):
    parts = M.passthrough(text)
    assert "".join(v for _, v in parts) == text and all(v for _, v in parts)


def test_normalize():
    assert M.normalize('<div style="text-align: center;"><img src="a.png" alt="A" width="50%" /></div>') == "![A](a.png){width=50%}"
    assert M.normalize("$ 20^{\\circ} $ but $5 and $10") == "$20^{\\circ}$ but $5 and $10"
    assert M.normalize('```\n<img src="a">\n```') == '```\n<img src="a">\n```'
    assert M.normalize("<img alt='no source'>") == "<img alt='no source'>"


def test_bisect():
    assert M.bisect("one\n\ntwo") == ["one", "two"] and M.bisect("short text") is None and M.bisect("") is None
    long = " ".join(["A sentence that is long enough to count for something here."] * 20)
    left, right = M.bisect(long)
    assert left + " " + right == long and abs(len(left) - len(right)) < 100


def test_tables():
    assert M.refill_cells("<td>1</td><th a='b'>2</th><td>3</td>", ["x", "y"]) == "<td>x</td><th a='b'>y</th><td>3</td>"
    assert M.table_shapes("| a | b |\n| - | - |\n| 1 | 2 |\n\nx | y") == ["2x3"]


def test_tokens(spark):
    texts = ["", None, "a", "abcd" * 10, "档案", "档案 abc", "한글ab"]
    want = [0, 0, 1, 12, 2, 3, 2]
    assert column(spark, texts, estimate_tokens) == want
    assert column(spark, texts, bytes_estimate) == [1, 1, 1, 10, 2, 3, 2]
    assert column(spark, [1000, 0], estimate_output, "bigint") == [1812, 512]


def test_unicode_boundaries(spark):
    assert column(spark, ["图3 和第12章 在2020年 5 kg 0.05"], lambda t: M.extract(t, "number")) == [["5", "0.05"]]
    assert column(spark, ["图3 Fig. 7b figure 9"], lambda t: M.extract(t, "figure")) == [["3", "7b", "9"]]


def test_front_matter(spark):
    texts = ["---\na: 1\ntags: [x, y z]\na: 2\nq: \"v: w\"\n---\n# T\n\nBody", "---\nopen", "none", "---\n---\nx"]
    assert column(spark, texts, src.front_state) == ["ok", "unclosed", "missing", "unclosed"]
    m = column(spark, texts[:1], lambda t: src.flat_fields(src.front_matter(t)))[0]
    assert m == {"a": "1", "tags": "[x, y z]", "q": "v: w"}
    assert column(spark, texts[:1], lambda t: src.flow_list(F.element_at(src.flat_fields(src.front_matter(t)), "tags"))) == [["x", "y z"]]
    assert column(spark, texts, lambda t: src.title(src.body(t)))[0] == "T"


def test_text_files(spark, tmp_path):
    (tmp_path / "MEM-1.md").write_bytes("﻿---\na: 1\n---\nx".encode())
    (tmp_path / "MEM-2.md").write_bytes(b"\xff\xfe bad")
    (tmp_path / "other.txt").write_text("x")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.valid) for r in src.read_text_files(spark, str(tmp_path), "MEM-*.md").collect()}
    assert got == {"MEM-1.md": ("---\na: 1\n---\nx", True), "MEM-2.md": (None, False)}


def test_links_sections_slugs(spark):
    assert column(spark, ["[a](b.md#c) `[x](y)` ![i](http://z/q.png) [t](mailto:a@b)"], M.link_targets) == [["b.md", "http://z/q.png", "mailto:a@b"]]
    assert column(spark, ["# A\n## Goal\nline\nmore\n## Next\nx"], lambda t: M.section(t, "Goal")) == ["line\nmore"]
    assert column(spark, ["  A b/C--d! "], M.slug) == ["a-b-c-d"]
    assert column(spark, ["## References x\ntext References"], M.reference_headings) == ["## 参考文献 x\ntext References"]
