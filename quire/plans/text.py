"""Text functions over whole tables: estimates, classes, blocks, protected spans, tables, links, logs, caches, hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import markdown as M
from quire.functions.tokens import bytes_estimate, estimate_tokens
from quire.operators.state import once
from quire.plans import Plans
from quire.plans.planning import estimate_sql
from quire.session import ship, table

P = Plans()
QUERIES, SQL = P.queries, P.sql


def nodes(spark, sf_dir, *columns):
    return once(table(spark, sf_dir, "structural_nodes"), "id", *columns)


@P.add(f"SELECT doc_id, {estimate_sql('text')} AS tokens, greatest(1, (octet_length(encode(coalesce(text, ''))) + 3) // 4)::BIGINT AS by_bytes, floor(coalesce(length(text), 0) * 0.3::DOUBLE + 0.999::DOUBLE)::BIGINT AS by_length FROM documents")
def token_estimates(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", estimate_tokens(t).alias("tokens"), bytes_estimate(t).alias("by_bytes"), F.floor(F.coalesce(F.length(t), F.lit(0)) * F.lit(0.3) + F.lit(0.999)).cast("bigint").alias("by_length"))


_S = "regexp_replace(coalesce(source_text, ''), '^[\\s]+|[\\s]+$', '', 'g')"
_LINES = "list_filter(string_split(s, chr(10)), lambda x: trim(x) <> '')"


@P.add(f"""
WITH n AS (SELECT id, node_type, {_S} AS s FROM (SELECT DISTINCT id, node_type, source_text FROM structural_nodes)),
c AS (SELECT id, node_type, CASE
  WHEN s = '' THEN 'unknown'
  WHEN regexp_matches(s, '(?i)^<!--\\s*source-page:\\s*\\d+\\s*-->$') OR regexp_matches(s, '(?i)^<a\\b[^>]*\\bid=["'']source-page-\\d+["''][^>]*>\\s*</a>$') THEN 'page_marker'
  WHEN regexp_matches(s, '^#{{1,6}}\\s+\\S') AND NOT contains(s, chr(10)) THEN 'heading'
  WHEN regexp_matches(s, '^(```|~~~)') THEN 'code'
  WHEN regexp_matches(s, '(?s)^\\$\\$.*\\$\\$$') OR regexp_matches(s, '(?s)^\\\\\\[.*\\\\\\]$') THEN 'formula'
  WHEN starts_with(lower(s), '<table') OR (starts_with(lower(s), '<div') AND contains(lower(s), '<table')) THEN 'html_table'
  WHEN regexp_matches(s, '^!\\[[^\\]]*\\]\\([^)]+\\)(\\{{[^}}]*\\}})?$') THEN 'image'
  WHEN len(string_split(s, chr(10))) >= 2 AND len(list_filter(string_split(s, chr(10))[1:2], lambda x: NOT regexp_matches(x, '^\\s*\\|.*\\|\\s*$'))) = 0 THEN 'markdown_table'
  WHEN len(list_filter({_LINES}, lambda x: NOT regexp_matches(x, '^\\s*([-*+]|\\d+[.)])\\s+'))) = 0 THEN 'list'
  WHEN len(list_filter({_LINES}, lambda x: NOT regexp_matches(x, '^\\s*>'))) = 0 THEN 'blockquote'
  WHEN trim(regexp_replace(lower(s), '^#+', '')) IN ('references', 'bibliography', '参考资料', '参考文献') THEN 'reference'
  ELSE 'paragraph' END AS found FROM n)
SELECT node_type, found, count(*) AS nodes FROM c GROUP BY ALL
""")
def node_classify(spark, sf_dir):
    """How the types that the text's form gives agree with the stored ones."""
    n = nodes(spark, sf_dir, "node_type", "source_text").select("node_type", M.node_type(F.coalesce("source_text", F.lit(""))).alias("found"))
    return n.groupBy("node_type", "found").agg(F.count(F.lit(1)).alias("nodes"))


@P.add("""
WITH l AS (SELECT doc_id, string_split(rtrim(replace(text, chr(13) || chr(10), chr(10)), chr(10)), chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, 1 + len(lines))) AS n FROM l),
a AS (SELECT *, trim(line, ' ' || chr(9)) AS s, regexp_matches(trim(line, ' ' || chr(9)), '^(```|~~~)') AS fence FROM u),
b AS (SELECT *, (sum(fence::INT) OVER w - fence::INT) % 2 = 1 AS inside FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
c AS (SELECT *, NOT inside AND NOT fence AND (lower(s) LIKE '<table%' OR (lower(s) LIKE '<div%' AND contains(lower(s), '<table'))) AS opens, NOT inside AND contains(lower(s), '</table>') AS ends FROM b),
d AS (SELECT *, greatest(0, sum(opens::INT) OVER w - opens::INT - (sum(ends::INT) OVER w - ends::INT)) > 0 AS in_table FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
e AS (SELECT *, (fence AND NOT inside) OR opens AS starts, (s = '' AND NOT inside AND NOT in_table) AS blank, coalesce(lag((fence AND inside) OR (ends AND (in_table OR opens))) OVER (PARTITION BY doc_id ORDER BY n), false) AS after_end FROM d),
g AS (SELECT *, sum((starts OR after_end OR blank)::INT) OVER (PARTITION BY doc_id ORDER BY n) AS part FROM e),
h AS (SELECT doc_id, part, rtrim(string_agg(line, chr(10) ORDER BY n), ' ' || chr(9) || chr(10)) AS block FROM g WHERE NOT blank GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part)::INTEGER AS block_no, length(block)::INTEGER AS chars FROM h WHERE trim(block, ' ' || chr(9) || chr(10)) <> ''
""")
def md_blocks(spark, sf_dir):
    """(doc_id, block_no, chars): blocks of each document; fences and tables stay whole."""
    ship(spark)
    b = M.text_udf(M.blocks, "array<string>")
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(b("text")).alias("n", "block"))
    return d.select("doc_id", (F.col("n") + 1).alias("block_no"), F.length("block").alias("chars"))


# the text after each of the first k patterns, whose matches are tokens; formulas in single dollar signs come after display formulas, so RE2 needs no look-around
_PROTECT = (
    "(?ms)^```.*?^```\\s*$|^~~~.*?^~~~\\s*$", "(?s)\\$\\$.*?\\$\\$", "(?s)\\\\\\[.*?\\\\\\]", "!\\[[^\\]]*\\]\\([^\\n)]*\\)(?:\\{[^}\\n]*\\})?", "`[^`\\n]+`", "\\$(?:\\\\.|[^$\\n])+?\\$",
    "https?://[^\\s<>\\])]+", "<[^>\\n]+>",
)


def _protected_sql() -> str:
    steps, counts = [], []
    for k, p in enumerate(_PROTECT):
        q = p.replace("'", "''")
        steps.append(f"s{k + 1} AS (SELECT *, regexp_replace(t{k}, '{q}', '@@PRESERVE_00000@@', 'g') AS t{k + 1}, len(regexp_extract_all(t{k}, '{q}')) AS n{k + 1} FROM s{k})")
        counts.append(f"n{k + 1}")
    return f"WITH s0 AS (SELECT doc_id, text AS t0 FROM documents WHERE text IS NOT NULL), {', '.join(steps)} SELECT doc_id, ({' + '.join(counts)})::INTEGER AS spans, true AS whole FROM s{len(_PROTECT)}"


@P.add(_protected_sql())
def md_protect(spark, sf_dir):
    """(doc_id, spans, whole): protected spans of each text, and whether putting them back gives the text again."""
    ship(spark)
    spans = M.text_udf(lambda t: len(M.protect(t)[1]), "int")
    same = M.text_udf(lambda t: M.restore(*M.protect(t)) == t, "boolean")
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", spans("text").alias("spans"), same("text").alias("whole"))


_PASS = "(?is)(<div\\b[^>]*>\\s*<table\\b[^>]*>.*?</table>\\s*</div>|<table\\b[^>]*>.*?</table>|<!--.*?-->|<a\\b[^>]*\\bid=[\"'']source-page-\\d+[\"''][^>]*>\\s*</a>)"


@P.add(f"""
WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '{_PASS}', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(parts) AS part, unnest(range(1, 1 + len(parts))) AS n FROM p),
s AS (SELECT doc_id, n, 1 AS k, CASE WHEN contains(part, chr(2)) THEN split_part(part, chr(2), 1) END AS v, true AS span FROM u UNION ALL
  SELECT doc_id, n, 2, CASE WHEN contains(part, chr(2)) THEN split_part(part, chr(2), 2) ELSE part END, false FROM u),
f AS (SELECT * FROM s WHERE coalesce(v, '') <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, k)::INTEGER AS segment_no, CASE WHEN NOT span THEN 'text' WHEN lower(v) LIKE '<div%' THEN 'html_table_wrapper' WHEN lower(v) LIKE '<table%' THEN 'html_table' WHEN v LIKE '<!--%' THEN 'html_comment' ELSE 'source_anchor' END AS kind,
  length(v)::INTEGER AS chars FROM f
""")
def md_passthrough(spark, sf_dir):
    """(doc_id, segment_no, kind, chars) of the segments that a translation passes through or works on."""
    ship(spark)
    p = M.text_udf(lambda t: [{"kind": k, "value": v} for k, v in M.passthrough(t)], "array<struct<kind:string,value:string>>")
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(p("text")).alias("n", "s"))
    return d.select("doc_id", (F.col("n") + 1).alias("segment_no"), "s.kind", F.length("s.value").alias("chars"))


@P.add()
def md_normalize(spark, sf_dir):
    """(doc_id, changed, hash) of the texts in the form that other writers read."""
    ship(spark)
    n = M.text_udf(M.normalize, "string")
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text", n("text").alias("new"))
    return d.select("doc_id", (F.col("text") != F.col("new")).alias("changed"), F.sha2("new", 256).alias("hash"))


@P.add()
def md_bisect(spark, sf_dir):
    """(unit_id, left_chars, right_chars) of the units that can be halved safely."""
    ship(spark)
    h = M.text_udf(M.bisect, "array<string>")
    u = once(table(spark, sf_dir, "translation_units"), "id", "source_text").withColumn("h", h("source_text")).filter("h IS NOT NULL")
    return u.select(F.col("id").alias("unit_id"), F.length(F.col("h")[0]).alias("left_chars"), F.length(F.col("h")[1]).alias("right_chars"))


@P.add("""
SELECT doc_id, length(regexp_replace(text, '(?im)^(#{1,6}\\s*)(References|Bibliography|Works Cited)\\b(.*)$', '\\1参考文献\\3', 'g')) AS chars,
  regexp_matches(text, '(?im)^(#{1,6}\\s*)(References|Bibliography|Works Cited)\\b(.*)$') AS has_references FROM documents WHERE text IS NOT NULL
""")
def reference_headings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", F.length(M.reference_headings(F.col("text"))).cast("bigint").alias("chars"), F.col("text").rlike(r"(?im)^(#{1,6}\s*)(References|Bibliography|Works Cited)\b(.*)$").alias("has_references"))


@P.add(r"""
SELECT id AS node_id, len(c)::BIGINT AS cells, array_to_string(c, '|') AS texts FROM (SELECT id, regexp_extract_all(source_text, '(?is)<(?:td|th)\b[^>]*>(.*?)</(?:td|th)>', 1) AS c
FROM (SELECT DISTINCT id, source_text FROM structural_nodes)) WHERE len(c) > 0
""")
def table_cells(spark, sf_dir):
    n = nodes(spark, sf_dir, "source_text").withColumn("c", M.table_cells(F.col("source_text"))).filter("size(c) > 0")
    return n.select(F.col("id").alias("node_id"), F.size("c").cast("bigint").alias("cells"), F.array_join("c", "|").alias("texts"))


@P.add(r"""
SELECT doc_id, len(regexp_extract_all(text, '(?m)^#{1,6}\s+'))::BIGINT AS headings, len(regexp_extract_all(text, '(?i)<!--\s*source-page:\s*\d+\s*-->'))::BIGINT AS page_markers,
  len(regexp_extract_all(text, '!\[[^\]]*\]\([^)]+\)'))::BIGINT AS images, len(regexp_extract_all(text, '(?m)^(?:```|~~~)'))::BIGINT AS fences, len(regexp_extract_all(text, '\$\$|\\\(|\\\['))::BIGINT AS formulas,
  len(regexp_extract_all(text, '\[(\d+(?:\s*[-–,]\s*\d+)*)\]'))::BIGINT AS citations, len(regexp_extract_all(text, 'https?://[^\s<>\])]+'))::BIGINT AS urls FROM documents WHERE text IS NOT NULL
""")
def pattern_counts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(
        "doc_id", *[M.count(t, k).cast("bigint").alias(f"{k}s") for k in M.COUNTED], F.size(M.extract(t, "citation")).cast("bigint").alias("citations"), F.size(M.extract(t, "url")).cast("bigint").alias("urls")
    )


@P.add(r"""
WITH t AS (SELECT id AS node_id, document_id, unnest(regexp_extract_all(source_text, '!?\[[^\]]*\]\(([^)\s]+)[^)]*\)', 1)) AS target FROM (SELECT DISTINCT id, document_id, source_text FROM structural_nodes WHERE node_type = 'image'))
SELECT t.node_id, regexp_replace(t.target, '#.*$', '') AS target FROM t WHERE NOT regexp_matches(t.target, '(?i)^(https?:|mailto:|tel:)')
  AND NOT EXISTS (SELECT 1 FROM document_files f WHERE f.id = t.document_id AND f.artifact_dir IS NOT NULL AND starts_with(t.target, f.artifact_dir))
""")
def broken_links(spark, sf_dir):
    """Local targets of images that don't lie in the folder of their file's artifacts."""
    n = nodes(spark, sf_dir, "document_id", "node_type", "source_text").filter("node_type = 'image'")
    t = n.select(F.col("id").alias("node_id"), "document_id", F.explode(M.link_targets(F.col("source_text"))).alias("target")).filter(~M.is_external(F.col("target")))
    f = table(spark, sf_dir, "document_files").filter("artifact_dir IS NOT NULL").select(F.col("id").alias("f_id"), "artifact_dir")
    return t.join(f, (F.col("document_id") == F.col("f_id")) & F.startswith("target", F.col("artifact_dir")), "left_anti").select("node_id", "target")


@P.add(r"SELECT id AS document_id, regexp_replace(regexp_replace(lower(display_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, regexp_extract(source_path, '([^/]+?)(?:\.[^./]*)?$', 1) AS stem FROM document_files")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "document_files").select(F.col("id").alias("document_id"), M.slug(F.col("display_name")).alias("slug"), F.regexp_extract("source_path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"))


@P.add("""
SELECT id AS unit_id, substr(k, 1, 2) || '/' || k || '.json' AS cache_path, substr(sha256(coalesce(source_text, '')), 1, 16) AS short_hash, coalesce(source_hash = sha256(source_text), false) AS hash_fits
FROM (SELECT *, sha256(concat(source_text, model, provider, prompt_version, style_capsule_version)) AS k FROM (SELECT DISTINCT id, source_text, source_hash, model, provider, prompt_version, style_capsule_version FROM translation_units))
""")
def cache_keys(spark, sf_dir):
    """Content-addressed cache paths of the units; the parts of a key follow each other without a mark."""
    u = once(table(spark, sf_dir, "translation_units"), "id", "source_text", "source_hash", "model", "provider", "prompt_version", "style_capsule_version")
    k = F.sha2(F.concat(*[F.coalesce(c, F.lit("")) for c in ("source_text", "model", "provider", "prompt_version", "style_capsule_version")]), 256)
    return u.withColumn("k", k).select(
        F.col("id").alias("unit_id"), F.concat(F.substring("k", 1, 2), F.lit("/"), "k", F.lit(".json")).alias("cache_path"),
        F.substring(F.sha2(F.coalesce("source_text", F.lit("")), 256), 1, 16).alias("short_hash"), F.coalesce(F.col("source_hash") == F.sha2("source_text", 256), F.lit(False)).alias("hash_fits"),
    )


@P.add("""
WITH j AS (SELECT doc_id, CASE WHEN json_valid(text) THEN text::JSON END AS j FROM documents WHERE starts_with(ltrim(text), '{'))
SELECT doc_id, j ->> '$.key' AS key, j ->> '$.model' AS model, length(j ->> '$.translation') AS chars, coalesce(j ->> '$.translation', '') <> '' AS hit FROM j
""")
def cache_lookup(spark, sf_dir):
    """Cached translations; a value that is no JSON, or has no text, is a miss."""
    d = table(spark, sf_dir, "documents").filter(F.startswith(F.ltrim("text"), F.lit("{")))
    j = d.select("doc_id", F.from_json("text", "key STRING, model STRING, translation STRING", {"mode": "PERMISSIVE"}).alias("j"), (F.get_json_object("text", "$.key").isNotNull() & F.rtrim("text").endswith("}")).alias("ok"))
    value = lambda c: F.when(F.col("ok"), F.col(f"j.{c}"))
    return j.select("doc_id", value("key").alias("key"), value("model").alias("model"), F.length(value("translation")).cast("bigint").alias("chars"), (F.coalesce(value("translation"), F.lit("")) != "").alias("hit"))


@P.add(r"""
WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^- \d\d:\d\d [a-z]+ the .+? section of the .+? chapter, \d+ units .+$')) AS line FROM documents WHERE source = 'progress_logs')
SELECT regexp_extract(line, '^- \d\d:\d\d ([a-z]+) ', 1) AS action, regexp_extract(line, ' units (.+?)\s*$', 1) AS outcome, count(*) AS entries, sum(regexp_extract(line, ', (\d+) units', 1)::BIGINT)::BIGINT AS units FROM l GROUP BY ALL
""")
def progress_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("source = 'progress_logs'")
    l = d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^- \d\d:\d\d [a-z]+ the .+? section of the .+? chapter, \d+ units .+$"), 0)).alias("line"))  # noqa: E741
    return l.groupBy(F.regexp_extract("line", r"^- \d\d:\d\d ([a-z]+) ", 1).alias("action"), F.regexp_extract("line", r" units (.+?)\s*$", 1).alias("outcome")).agg(
        F.count(F.lit(1)).alias("entries"), F.sum(F.regexp_extract("line", r", (\d+) units", 1).cast("bigint")).alias("units")
    )


@P.add(r"""
WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^- unit u\d+: [a-z_]+ near "[^"]*", severity [a-z]+$')) AS line FROM documents WHERE source = 'qa_reports')
SELECT regexp_extract(line, ': ([a-z_]+) near', 1) AS code, regexp_extract(line, 'severity ([a-z]+)$', 1) AS severity, count(*) AS findings, count(DISTINCT doc_id) AS reports FROM l GROUP BY ALL
""")
def report_findings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("source = 'qa_reports'")
    l = d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r'(?m)^- unit u\d+: [a-z_]+ near "[^"]*", severity [a-z]+$'), 0)).alias("line"))  # noqa: E741
    return l.groupBy(F.regexp_extract("line", ": ([a-z_]+) near", 1).alias("code"), F.regexp_extract("line", "severity ([a-z]+)$", 1).alias("severity")).agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("doc_id").alias("reports"))


@P.add("""
SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS lines, CASE WHEN len(string_split(text, chr(10))) > 26 THEN 'error' WHEN len(string_split(text, chr(10))) > 16 THEN 'warning' ELSE 'ok' END AS size_state FROM documents WHERE text IS NOT NULL
""")
def line_counts(spark, sf_dir):
    """Lines of each text against a soft and a hard limit (a tenth of the reference's)."""
    n = F.size(F.split("text", "\n"))
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", n.cast("bigint").alias("lines"), F.when(n > 26, "error").when(n > 16, "warning").otherwise("ok").alias("size_state"))


@P.add(r"""
SELECT id AS document_id, coalesce(regexp_matches(source_sha256, '^(sha256:)?[0-9a-f]{64}$'), false) AS digest_ok, coalesce(regexp_matches(source_path, '^/([^/]+/)*[^/]+$') AND NOT contains(source_path, '..'), false) AS path_ok,
  strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS created, (updated_at >= created_at) AS in_order FROM document_files
""")
def file_checks(spark, sf_dir):
    p = F.col("source_path")
    return table(spark, sf_dir, "document_files").select(
        F.col("id").alias("document_id"), F.coalesce(F.col("source_sha256").rlike(r"^(sha256:)?[0-9a-f]{64}$"), F.lit(False)).alias("digest_ok"),
        F.coalesce(p.rlike(r"^/([^/]+/)*[^/]+$") & ~p.contains(".."), F.lit(False)).alias("path_ok"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created"), (F.col("updated_at") >= F.col("created_at")).alias("in_order"),
    )


@P.add("""
SELECT id AS unit_id, m.role, length(m.content) AS chars, substr(sha256(m.content), 1, 16) AS short_hash FROM (SELECT DISTINCT id, heading_path, source_text FROM translation_units),
LATERAL (VALUES ('system', 'prefix of ' || coalesce(heading_path, '')), ('user', coalesce(source_text, ''))) m(role, content)
""")
def message_manifest(spark, sf_dir):
    """The messages that a unit is sent with: role, length and short hash."""
    u = once(table(spark, sf_dir, "translation_units"), "id", "heading_path", "source_text")
    m = F.array(F.struct(F.lit("system").alias("role"), F.concat(F.lit("prefix of "), F.coalesce("heading_path", F.lit(""))).alias("content")), F.struct(F.lit("user").alias("role"), F.coalesce("source_text", F.lit("")).alias("content")))
    return u.select(F.col("id").alias("unit_id"), F.explode(m).alias("m")).select("unit_id", "m.role", F.length("m.content").cast("bigint").alias("chars"), F.substring(F.sha2("m.content", 256), 1, 16).alias("short_hash"))


@P.add("""
SELECT u.id AS unit_id, '<!-- translation-block: ' || u.unit_key || ' -->' || chr(10) || chr(10) || '> [untranslated] ' || substr(trim(replace(coalesce(a.error_message, ''), chr(10), ' ')), 1, 500) || chr(10) || chr(10) || trim(u.source_text) || chr(10) AS block
FROM (SELECT DISTINCT id, unit_key, source_text FROM translation_units WHERE status = 'failed') u
LEFT JOIN (SELECT unit_id, max(error_message) AS error_message FROM translation_attempts GROUP BY ALL) a ON a.unit_id = u.id
""")
def fallback_blocks(spark, sf_dir):
    u = once(table(spark, sf_dir, "translation_units"), "id", "unit_key", "source_text", "status").filter("status = 'failed'")
    a = table(spark, sf_dir, "translation_attempts").groupBy("unit_id").agg(F.max("error_message").alias("error_message"))
    j = u.join(a, F.col("id") == F.col("unit_id"), "left")
    return j.select(F.col("id").alias("unit_id"), M.fallback_block(F.col("unit_key"), F.col("source_text"), F.col("error_message")).alias("block"))
