"""Packing of nodes, units and blocks, heading paths, and splitting of failed page ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.markdown import ATOMIC_TYPES
from quire.functions.tokens import estimate_tokens
from quire.operators import folds
from quire.operators.hierarchy import title_of
from quire.operators.prefix import running_max_blocks
from quire.operators.state import once
from quire.plans import Plans
from quire.session import table

P = Plans()
QUERIES, SQL = P.queries, P.sql

#: Budgets of the example plans, smaller than the reference's own so that the test tables fill them.
FIRST, TARGET, MOST, CHUNK, CONTEXT = 800, 1_500, 2_000, 4_000, 600

WIDE = "[\\x{3400}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}]"


def estimate_sql(text: str) -> str:
    """DuckDB form of the estimate of tokens."""
    wide = f"(length({text}) - length(regexp_replace({text}, '{WIDE}', '', 'g')))"
    return f"CASE WHEN coalesce({text}, '') = '' THEN 0 ELSE greatest(1, floor({wide} * 0.6::DOUBLE + (length({text}) - {wide}) * 0.3::DOUBLE + 0.999::DOUBLE))::BIGINT END"


@P.add(f"""
WITH RECURSIVE u AS (SELECT id, document_id, coalesce(source_tokens, {estimate_sql("source_text")}) AS tokens, row_number() OVER (PARTITION BY document_id ORDER BY sequence_index, id) AS n
  FROM (SELECT DISTINCT id, document_id, sequence_index, source_tokens, source_text FROM translation_units)),
f(document_id, n, id, part, size, next_part, next_size) AS (
  SELECT document_id, n, id, 1, tokens, CASE WHEN tokens >= {FIRST} THEN 2 ELSE 1 END, CASE WHEN tokens >= {FIRST} THEN 0 ELSE tokens END FROM u WHERE n = 1
  UNION ALL
  SELECT u.document_id, u.n, u.id, g.p, g.s, CASE WHEN g.s >= (CASE WHEN g.p = 1 THEN {FIRST} ELSE {TARGET} END) THEN g.p + 1 ELSE g.p END,
    CASE WHEN g.s >= (CASE WHEN g.p = 1 THEN {FIRST} ELSE {TARGET} END) THEN 0 ELSE g.s END
  FROM f JOIN u ON u.document_id = f.document_id AND u.n = f.n + 1,
    LATERAL (SELECT CASE WHEN next_size > 0 AND next_size + u.tokens > {MOST} THEN next_part + 1 ELSE next_part END AS p,
      CASE WHEN next_size > 0 AND next_size + u.tokens > {MOST} THEN u.tokens ELSE next_size + u.tokens END AS s) g)
SELECT document_id, id AS unit_id, part::BIGINT AS partition_no FROM f
""")
def partition_pack(spark, sf_dir):
    u = once(table(spark, sf_dir, "translation_units"), "id", "document_id", "sequence_index", "source_tokens", "source_text")
    u = u.select("id", "document_id", "sequence_index", F.coalesce("source_tokens", estimate_tokens(F.col("source_text"))).alias("tokens"))
    f = folds.ranged_fold(u, "document_id", ["sequence_index", "id"], ["tokens"], folds.partition_rule(FIRST, TARGET, MOST), "partition_no")
    return f.select("document_id", F.col("id").alias("unit_id"), "partition_no")


@P.add(f"""
WITH RECURSIVE b AS (SELECT id, document_id, length(source_text) + 2 AS len, row_number() OVER (PARTITION BY document_id ORDER BY sequence_index, id) AS n
  FROM (SELECT DISTINCT id, document_id, sequence_index, source_text FROM structural_nodes) WHERE coalesce(source_text, '') <> ''),
f(document_id, n, id, chunk, size) AS (
  SELECT document_id, n, id, 1, len FROM b WHERE n = 1
  UNION ALL
  SELECT b.document_id, b.n, b.id, CASE WHEN size > 0 AND size + len > {CHUNK} THEN chunk + 1 ELSE chunk END, CASE WHEN size > 0 AND size + len > {CHUNK} THEN len ELSE size + len END
  FROM f JOIN b ON b.document_id = f.document_id AND b.n = f.n + 1)
SELECT document_id, id AS node_id, chunk::BIGINT AS chunk_no FROM f
""")
def char_chunk_pack(spark, sf_dir):
    n = once(table(spark, sf_dir, "structural_nodes"), "id", "document_id", "sequence_index", "source_text").filter("coalesce(source_text, '') <> ''")
    n = n.select("id", "document_id", "sequence_index", F.length("source_text").alias("len"))
    f = folds.ranged_fold(n, "document_id", ["sequence_index", "id"], ["len"], folds.chunk_rule(CHUNK), "chunk_no")
    return f.select("document_id", F.col("id").alias("node_id"), "chunk_no")


@P.add(f"""
WITH RECURSIVE c AS (SELECT id, document_id, {estimate_sql("source_text")} AS tokens, node_type = 'heading' AS required, row_number() OVER (PARTITION BY document_id ORDER BY node_type <> 'heading', sequence_index, id) AS n
  FROM (SELECT DISTINCT id, document_id, sequence_index, node_type, source_text FROM structural_nodes)),
f(document_id, n, id, state, used) AS (
  SELECT document_id, n, id, CASE WHEN required OR tokens <= {CONTEXT} THEN 'selected' ELSE 'budget_trimmed' END, CASE WHEN required OR tokens <= {CONTEXT} THEN tokens ELSE 0 END FROM c WHERE n = 1
  UNION ALL
  SELECT c.document_id, c.n, c.id, CASE WHEN required OR used + tokens <= {CONTEXT} THEN 'selected' ELSE 'budget_trimmed' END, CASE WHEN required OR used + tokens <= {CONTEXT} THEN used + tokens ELSE used END
  FROM f JOIN c ON c.document_id = f.document_id AND c.n = f.n + 1)
SELECT document_id, id AS node_id, state FROM f
""")
def budget_select(spark, sf_dir):
    """What fits a token budget of each file: its headings always, then other nodes in order."""
    n = once(table(spark, sf_dir, "structural_nodes"), "id", "document_id", "sequence_index", "node_type", "source_text")
    n = n.select("id", "document_id", "sequence_index", estimate_tokens(F.col("source_text")).alias("tokens"), (F.col("node_type") == "heading").alias("required"))
    f = folds.select_within_budget(n, "document_id", ["sequence_index", "id"], F.col("tokens"), F.col("required"), CONTEXT)
    return f.select("document_id", F.col("id").alias("node_id"), "state")


_ATOMIC = ", ".join(repr(t) for t in ATOMIC_TYPES)


@P.add(f"""
WITH RECURSIVE t AS (SELECT id, document_id, sequence_index, coalesce(nullif(token_count, 0), {estimate_sql("source_text")}) AS tokens, coalesce(node_type IN ({_ATOMIC}), false) AS whole,
  coalesce(node_type = 'heading' AND heading_level <= 2, false) AS top, row_number() OVER (PARTITION BY document_id ORDER BY sequence_index NULLS FIRST, id) AS n
  FROM (SELECT DISTINCT id, document_id, sequence_index, node_type, heading_level, token_count, source_text FROM structural_nodes)),
f(document_id, n, id, tokens, unit, next_unit, size, is_empty) AS (
  SELECT document_id, n, id, tokens, 1, CASE WHEN (NOT whole AND tokens > 2400) OR (tokens >= 1200 AND NOT whole) THEN 2 ELSE 1 END, CASE WHEN (NOT whole AND tokens > 2400) OR (tokens >= 1200 AND NOT whole) THEN 0 ELSE tokens END,
    (NOT whole AND tokens > 2400) OR (tokens >= 1200 AND NOT whole) FROM t WHERE n = 1
  UNION ALL
  SELECT t.document_id, t.n, t.id, t.tokens, g.u, CASE WHEN c.closes THEN g.u + 1 ELSE g.u END, CASE WHEN c.closes THEN 0 ELSE g.s END, c.closes
  FROM f JOIN t ON t.document_id IS NOT DISTINCT FROM f.document_id AND t.n = f.n + 1,
    LATERAL (SELECT NOT f.is_empty AND ((t.top AND f.size >= 150) OR (NOT t.whole AND t.tokens > 2400) OR f.size + t.tokens > 2400) AS opens) o,
    LATERAL (SELECT CASE WHEN o.opens THEN f.next_unit + 1 ELSE f.next_unit END AS u, CASE WHEN o.opens THEN 0 ELSE f.size END + t.tokens AS s) g,
    LATERAL (SELECT (NOT t.whole AND t.tokens > 2400) OR (g.s >= 1200 AND NOT t.whole) AS closes) c)
SELECT document_id, unit::BIGINT AS unit_no, 'u' || lpad(unit::VARCHAR, 5, '0') AS unit_key, count(*) AS nodes, sum(tokens)::BIGINT AS tokens, first(id ORDER BY n) AS first_node FROM f GROUP BY ALL
""")
def unit_pack(spark, sf_dir):
    """(document_id, unit_no, unit_key, nodes, tokens, first_node): units of nodes by the reference's rules, its budgets a tenth."""
    n = once(table(spark, sf_dir, "structural_nodes"), "id", "document_id", "sequence_index", "node_type", "heading_level", "token_count", "source_text")
    tokens = F.coalesce(F.nullif("token_count", F.lit(0)), estimate_tokens(F.col("source_text")))
    n = n.select("id", "document_id", "sequence_index", "node_type", "heading_level", tokens.alias("tokens"))
    rule = folds.unit_rule(1_200, 2_400, 150, frozenset(ATOMIC_TYPES))
    f = folds.ranged_fold(n, "document_id", ["sequence_index", "id"], ["tokens", "node_type", "heading_level"], rule, "unit_no")
    f = f.join(n.select(F.col("id").alias("n_id"), "tokens"), F.col("id") == F.col("n_id"))
    g = f.groupBy("document_id", "unit_no").agg(F.count(F.lit(1)).alias("nodes"), F.sum("tokens").alias("tokens"), F.min_by("id", F.struct("sequence_index", "id")).alias("first_node"))
    return g.withColumn("unit_key", F.concat(F.lit("u"), F.lpad(F.col("unit_no").cast("string"), 5, "0")))


_LEVELS = range(1, 7)
_AT = ", ".join(f"max(CASE WHEN lv = {k} THEN pos END) OVER w AS at_{k}, max(CASE WHEN lv < {k} THEN pos END) OVER w AS above_{k}" for k in _LEVELS)


@P.add(f"""
WITH n AS (SELECT DISTINCT id, document_id, sequence_index, node_type, heading_level, source_text FROM structural_nodes),
p AS (SELECT *, sequence_index * 1000000000 + id AS pos, CASE WHEN node_type = 'heading' AND heading_level BETWEEN 1 AND 6 THEN heading_level END AS lv,
  regexp_replace(regexp_replace(source_text, '^#+', ''), '^\\s+|\\s+$', '', 'g') AS title FROM n WHERE sequence_index IS NOT NULL),
a AS (SELECT *, {_AT} FROM p WINDOW w AS (PARTITION BY document_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT document_id AS t_doc, pos AS t_pos, title AS t_title FROM p WHERE lv IS NOT NULL)
SELECT a.document_id, a.id AS node_id, concat_ws(' / ', {", ".join(f"t{k}.t_title" for k in _LEVELS)}) AS path FROM a
{" ".join(f"LEFT JOIN t t{k} ON t{k}.t_doc = a.document_id AND t{k}.t_pos = a.at_{k} AND a.at_{k} > coalesce(a.above_{k}, -1)" for k in _LEVELS)}
""")
def heading_paths(spark, sf_dir):
    """The path of headings over each node by its place in the file: for each level the last heading, unless a higher one came after it."""
    n = once(table(spark, sf_dir, "structural_nodes"), "id", "document_id", "sequence_index", "node_type", "heading_level", "source_text").filter("sequence_index IS NOT NULL")
    lv = F.when((F.col("node_type") == "heading") & F.col("heading_level").between(1, 6), F.col("heading_level"))
    p = n.select("id", "document_id", "sequence_index", F.struct("sequence_index", "id").alias("pos"), lv.alias("lv"), F.when(lv.isNotNull(), title_of(F.col("source_text"))).alias("title"))
    last = {f"t{k}": F.when(F.col("lv") == k, F.struct("pos", "title")) for k in _LEVELS}
    p = running_max_blocks(p, ["document_id"], F.floor(F.col("sequence_index") / 4096), ["sequence_index", "id"], last)
    titles = [F.when(F.lit(True) if k == 1 else _after(k), F.col(f"t{k}.title")) for k in _LEVELS]
    return p.select("document_id", F.col("id").alias("node_id"), F.concat_ws(" / ", *titles).alias("path"))


def _after(k: int):
    """Whether the last heading of level k stands behind all of higher levels."""
    c = F.lit(True)
    for j in range(1, k):
        c = c & (F.col(f"t{j}.pos").isNull() | (F.col(f"t{k}.pos") > F.col(f"t{j}.pos")))
    return c


@P.add("""
WITH RECURSIVE b AS (SELECT DISTINCT id, document_id, page_start AS a, page_end AS z FROM ocr_batches WHERE status = 'failed' AND page_start <= page_end),
r(id, document_id, a, z, depth) AS (SELECT id, document_id, a, z, 0 FROM b
  UNION ALL SELECT id, document_id, CASE WHEN h = 0 THEN a ELSE a + (z - a + 1) // 2 END, CASE WHEN h = 0 THEN a + (z - a + 1) // 2 - 1 ELSE z END, depth + 1 FROM r, (VALUES (0), (1)) v(h) WHERE z > a)
SELECT id AS batch_id, document_id, a AS page_start, z AS page_end, depth::BIGINT AS depth, CASE WHEN a = z THEN 'page' ELSE 'split' END AS step FROM r
""")
def ocr_retry_ladder(spark, sf_dir):
    """The page ranges that a failed OCR batch is tried again in: halves down to single pages; a range of n pages takes log2(n) rounds."""
    b = once(table(spark, sf_dir, "ocr_batches"), "id", "document_id", "page_start", "page_end", "status").filter("status = 'failed' AND page_start <= page_end")
    level = b.select(F.col("id").alias("batch_id"), "document_id", "page_start", "page_end", F.lit(0).cast("bigint").alias("depth"))
    longest = b.agg(F.max(F.col("page_end") - F.col("page_start") + 1)).first()[0] or 0
    out, depth = level, 0
    mid = F.col("page_start") + F.floor((F.col("page_end") - F.col("page_start") + 1) / 2)
    while longest > 1:
        depth, longest = depth + 1, (longest + 1) // 2
        halves = F.array(F.struct(F.col("page_start").alias("a"), (mid - 1).alias("z")), F.struct(mid.alias("a"), F.col("page_end").alias("z")))
        level = level.filter("page_end > page_start").select("batch_id", "document_id", F.explode(halves).alias("h")).select("batch_id", "document_id", F.col("h.a").alias("page_start"), F.col("h.z").alias("page_end"), F.lit(depth).cast("bigint").alias("depth"))
        out = out.unionByName(level)
    return out.withColumn("step", F.when(F.col("page_start") == F.col("page_end"), "page").otherwise("split"))
