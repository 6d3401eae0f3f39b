"""The catalog of notes: records, filters, search, and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import catalog as C
from quire.operators.state import drift
from quire.plans import Plans
from quire.session import table
from quire.sources import markdown as M

P = Plans()
QUERIES, SQL = P.queries, P.sql

# DuckDB: the notes with closed front matter and their fields
NOTES = """
raw AS (SELECT doc_id, text, regexp_extract(text, '(?s)^---[ \\t]*\\r?\\n(.*?)\\r?\\n---[ \\t]*(?:\\r?\\n|$)', 1) AS front,
  regexp_replace(text, '(?s)^---[ \\t]*\\r?\\n(.*?)\\r?\\n---[ \\t]*(?:\\r?\\n|$)', '') AS content FROM documents
  WHERE regexp_matches(text, '(?s)^---[ \\t]*\\r?\\n(.*?)\\r?\\n---[ \\t]*(?:\\r?\\n|$)')),
notes AS (SELECT 'MEM-' || lpad(doc_id::VARCHAR, 10, '0') AS memory_id, doc_id, nullif(regexp_extract(front, '(?m)^memory_type:\\s*(\\S+)\\s*$', 1), '') AS memory_type,
  nullif(regexp_extract(front, '(?m)^status:\\s*(\\S+)\\s*$', 1), '') AS status,
  list_filter(list_transform(string_split(regexp_extract(front, '(?m)^tags:\\s*\\[(.*)\\]\\s*$', 1), ','), lambda x: trim(x)), lambda x: x <> '') AS tags,
  trim(regexp_extract(content, '(?m)^#[ \\t]+(.+?)[ \\t]*$', 1)) AS title, content FROM raw)
"""
TERMS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
DESCRIPTION = """
(SELECT substr(coalesce(first(b ORDER BY n), ''), 1, 280) FROM (SELECT array_to_string(list_filter(list_transform(string_split(u.block, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#')), ' ') AS b, u.n
  FROM (SELECT unnest(string_split(content, chr(10) || chr(10))) AS block, unnest(range(1, 1 + len(string_split(content, chr(10) || chr(10))))) AS n) u) WHERE b <> '')
"""


def notes(spark, sf_dir):
    return M.memory_records(table(spark, sf_dir, "documents"))


@P.add(f"WITH {NOTES} SELECT memory_id, memory_type, status, array_to_string(tags, '|') AS tags, title, length(content) AS content_chars, sha256(content) AS content_hash FROM notes")
def memory_records(spark, sf_dir):
    return notes(spark, sf_dir).select("memory_id", "memory_type", "status", F.array_join("tags", "|").alias("tags"), "title", F.length("content").cast("bigint").alias("content_chars"), F.sha2("content", 256).alias("content_hash"))


@P.add("""
SELECT doc_id, CASE WHEN NOT regexp_matches(text, '^---[ \\t]*\\r?\\n') THEN 'missing' WHEN regexp_matches(text, '(?s)^---[ \\t]*\\r?\\n(.*?)\\r?\\n---[ \\t]*(?:\\r?\\n|$)') THEN 'ok' ELSE 'unclosed' END AS front_state
FROM documents WHERE text IS NOT NULL
""")
def front_matter_state(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", M.front_state(F.col("text")).alias("front_state"))


@P.add(f"WITH {NOTES} SELECT memory_id, 'tags|status' AS matched_fields, 'tag:metals|status:' || status AS match_reasons FROM notes WHERE status IN ('active', 'candidate') AND list_contains(tags, 'metals')")
def memory_filter(spark, sf_dir):
    d = C.direct(notes(spark, sf_dir), C.Request(statuses=("active", "candidate"), tags=("metals",)))
    return d.select("memory_id", F.array_join("matched_fields", "|").alias("matched_fields"), F.array_join("match_reasons", "|").alias("match_reasons"))


@P.add(f"""
WITH {NOTES}, d AS (SELECT *, {DESCRIPTION} AS description FROM notes),
k AS (SELECT memory_id, list_filter([CASE WHEN contains(lower(title), 'selection bias') THEN 'title' END, CASE WHEN contains(lower(description), 'selection bias') THEN 'description' END,
  CASE WHEN contains(lower(content), 'selection bias') THEN 'content' END, CASE WHEN contains(lower(array_to_string(tags, ' ')), 'selection bias') THEN 'tags' END], lambda x: x IS NOT NULL) AS f FROM d WHERE status = 'active')
SELECT memory_id, len(f)::DOUBLE AS score, 'status|' || array_to_string(f, '|') AS matched_fields FROM k WHERE len(f) > 0
""")
def memory_keyword(spark, sf_dir):
    d = C.direct(notes(spark, sf_dir), C.Request(text="Selection bias"))
    return d.select("memory_id", "score", F.array_join("matched_fields", "|").alias("matched_fields"))


@P.add(f"""
WITH {NOTES}, d AS (SELECT *, {DESCRIPTION} AS description FROM notes),
w AS (SELECT memory_id, {TERMS.format('title')} AS a, {TERMS.format('description')} AS b, {TERMS.format('content')} AS c, {TERMS.format("array_to_string(tags, ' ')")} AS t FROM d),
l AS (SELECT memory_id, list_concat(list_concat(a, b), list_concat(c, t)) AS x FROM w), n AS (SELECT count(*) AS n_docs, avg(len(x)) AS avg_len FROM l),
tf AS (SELECT memory_id, len(x) AS len, q.term, len(list_filter(x, lambda y: y = q.term)) AS tf FROM l, (VALUES ('weld'), ('seam')) q(term)),
df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY ALL)
SELECT memory_id, round(greatest(sum((CASE WHEN ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 0), 6) AS score
FROM tf JOIN df USING (term), n WHERE tf > 0 GROUP BY memory_id HAVING count(*) = 2
""")
def memory_bm25(spark, sf_dir):
    return C.bm25(notes(spark, sf_dir), ["weld", "seam"]).select("memory_id", F.round("score", 6).alias("score"))


@P.add(f"WITH {NOTES} SELECT status, memory_type, count(*) AS records, sum(len(tags))::BIGINT AS tags FROM notes GROUP BY ALL")
def catalog_stats(spark, sf_dir):
    return notes(spark, sf_dir).groupBy("status", "memory_type").agg(F.count(F.lit(1)).alias("records"), F.sum(F.size("tags")).alias("tags"))


@P.add(f"WITH {NOTES} SELECT memory_id, (u.n - 1)::BIGINT AS tag_position, u.tag FROM (SELECT memory_id, unnest(tags) AS tag, unnest(range(1, 1 + len(tags))) AS n FROM notes) u")
def tag_index(spark, sf_dir):
    return notes(spark, sf_dir).select("memory_id", F.posexplode("tags").alias("p", "tag")).select("memory_id", F.col("p").cast("bigint").alias("tag_position"), "tag")


@P.add(f"""
WITH {NOTES}, c AS (SELECT doc_id, content FROM notes), k AS (SELECT content, min(doc_id) AS first_id FROM c GROUP BY ALL)
SELECT c.doc_id, 'extra' AS state FROM c JOIN k USING (content) WHERE c.doc_id <> k.first_id
""")
def catalog_drift(spark, sf_dir):
    """The stored catalog against the one that should be, in which a note that repeats another's content has no place."""
    actual = notes(spark, sf_dir).select("doc_id", "content")
    expected = actual.groupBy("content").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "content")
    return drift(expected, actual, ["doc_id"])
