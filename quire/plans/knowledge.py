"""Context selection, indexes and lint of notes, translation by a given function, service values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import records as R
from quire.functions.tokens import bytes_estimate
from quire.operators import context as C
from quire.operators import knowledge as K
from quire.operators import translate as T
from quire.operators.state import once
from quire.plans import Plans
from quire.plans.catalog import NOTES
from quire.session import ship, table
from quire.sources import markdown as M

P = Plans()
QUERIES, SQL = P.queries, P.sql

BUDGET = 20_000


@P.add(f"""
WITH RECURSIVE {NOTES}, c AS (SELECT memory_id, 'memory/' || memory_id || '.md' AS path, status, tags, title || chr(10) || content || chr(10) || array_to_string(tags, chr(10)) AS text FROM notes),
m AS (SELECT *, greatest(1, (octet_length(encode(text)) + 3) // 4) AS tokens, CASE WHEN list_contains(tags, 'well-documented') THEN 2 ELSE 3 END AS best FROM c
  WHERE list_contains(tags, 'well-documented') OR contains(lower(text), 'selection bias')),
r AS (SELECT *, row_number() OVER (ORDER BY best, path, memory_id) AS n FROM m WHERE status = 'active'),
f(n, memory_id, state, used) AS (
  SELECT n, memory_id, CASE WHEN best = 2 OR tokens <= {BUDGET} THEN 'selected' ELSE 'budget_trimmed' END, CASE WHEN best = 2 OR tokens <= {BUDGET} THEN tokens ELSE 0 END FROM r WHERE n = 1
  UNION ALL SELECT r.n, r.memory_id, CASE WHEN best = 2 OR used + tokens <= {BUDGET} THEN 'selected' ELSE 'budget_trimmed' END, CASE WHEN best = 2 OR used + tokens <= {BUDGET} THEN used + tokens ELSE used END
  FROM f JOIN r ON r.n = f.n + 1)
SELECT m.memory_id AS document_id, CASE WHEN m.status <> 'active' THEN 'status_filtered:' || m.status ELSE f.state END AS state, CASE WHEN best = 2 THEN 'required' ELSE 'relevant' END AS priority, m.tokens::BIGINT AS tokens
FROM m LEFT JOIN f USING (memory_id)
""")
def context_select(spark, sf_dir):
    """Notes for a request by symbol and keyword within a budget of tokens, and why others are left out."""
    n = M.memory_records(table(spark, sf_dir, "documents"))
    none = F.lit(None).cast("string")
    text = F.concat_ws("\n", "title", "content", F.array_join("tags", "\n"))
    c = n.select(
        F.col("memory_id").alias("document_id"), "path", F.lit("memory").alias("kind"), text.alias("text"), "tags", F.transform("tags", lambda t: t).alias("symbols"), none.alias("temperature"), none.alias("epistemic_status"),
        none.alias("lifecycle"), "status", F.lit("coding").alias("namespace"), "valid_from", "valid_until",
    ).withColumn("tokens", bytes_estimate(F.col("text")))
    relations = spark.createDataFrame([], "document_id STRING, kind STRING, target_id STRING")
    out = C.select(c, relations, C.ContextRequest(symbols=("Well-documented",), keywords=("selection bias",), budget=BUDGET))
    return out.select("document_id", "state", "priority", "tokens")


@P.add(f"""
WITH {NOTES}, l AS (SELECT doc_id // 1000 AS scope, memory_id AS path, '| [' || memory_id || '](' || memory_id || ') | `' || coalesce(status, '-') || '` | ' || replace(replace(title, '|', chr(92) || '|'), chr(10), ' ') || ' | '
  || CASE WHEN len(tags) = 0 THEN '-' ELSE array_to_string(tags, '<br>') END || ' |' AS line FROM notes),
g AS (SELECT scope, count(*) AS entries, '| Path | Type | Title | Hints |' || chr(10) || '|------|------|-------|-------|' || chr(10) || string_agg(line, chr(10) ORDER BY path) AS inner_text FROM l GROUP BY ALL)
SELECT scope, entries, substr(sha256(inner_text), 1, 16) AS checksum, 'ok' AS state, length(inner_text)::BIGINT AS chars FROM g
""")
def note_index(spark, sf_dir):
    """A generated index of the notes of each shelf of a thousand ids, its checksum, and whether a document that holds it passes the lint."""
    n = M.memory_records(table(spark, sf_dir, "documents"))
    b = K.index_blocks(n.select(F.floor(F.col("doc_id") / 1000).alias("scope"), F.col("memory_id").alias("path"), F.coalesce("status", F.lit("-")).alias("type"), "title", F.col("tags").alias("hints")))
    doc = K.put_block(F.concat(F.lit("# Index\n\nold text\n\n"), F.lit(K.BEGIN + "\nold\n" + K.END + "\n")), F.col("block"))
    inner = F.regexp_replace(F.substring_index(F.substring_index("block", " -->\n", -1), "\n" + K.END, 1), "^$", "")
    return b.withColumn("doc", doc).select("scope", "entries", F.regexp_extract("doc", K.CHECKSUM, 1).alias("checksum"), K.block_state(F.col("doc")).alias("state"), F.length(inner).cast("bigint").alias("chars"))


@P.add(f"""
WITH {NOTES} SELECT doc_id AS id, unnest(list_filter([CASE WHEN coalesce(memory_type, '') = '' THEN 'field_missing:memory_type' END, CASE WHEN coalesce(status, '') = '' THEN 'field_missing:status' END,
  CASE WHEN status NOT IN ('active', 'candidate') THEN 'enum_invalid:status=' || status END], lambda x: x IS NOT NULL)) AS finding FROM notes
""")
def note_lint(spark, sf_dir):
    """Rules that notes break: missing fields, and a status that the (stricter) list doesn't have."""
    d = table(spark, sf_dir, "documents").filter(M.front_state(F.col("text")) == "ok")
    n = d.select(F.col("doc_id").alias("id"), M.flat_fields(M.front_matter(F.col("text"))).alias("fields"), M.body(F.col("text")).alias("body"))
    return K.lint(n, ["memory_type", "status"], {"status": ["active", "candidate"]}).select("id", F.concat_ws(":", "code", "detail").alias("finding"))


@P.add("""
SELECT id, 'done' AS status, 1 AS attempts, length(upper(trim(coalesce(source_text, ''), ' ' || chr(9) || chr(10) || chr(13))))::INTEGER + 1 AS chars
FROM (SELECT DISTINCT id, unit_key, source_text, translation_text, status FROM translation_units) WHERE NOT coalesce(status = 'done' AND length(translation_text) > 0, false)
""")
def translate_pending(spark, sf_dir):
    """(id, status, attempts, chars) of the units still to translate, by a function that stands for the service."""
    ship(spark)
    u = once(table(spark, sf_dir, "translation_units"), "id", "unit_key", "source_text", "translation_text", "status")
    return T.translate(u, T.echo).select("id", "status", "attempts", F.length("translation_text").alias("chars"))


@P.add("""
SELECT document_id, count(*) AS pages, count_if(trim(coalesce(text, '')) = '')::BIGINT AS blank_pages, count_if(trim(coalesce(text, '')) <> '')::BIGINT AS text_pages,
  coalesce(sum(length(trim(text))) FILTER (trim(coalesce(text, '')) <> ''), 0)::BIGINT AS chars FROM documents WHERE source = 'ocr_pages' GROUP BY ALL
""")
def preflight_rollup(spark, sf_dir):
    """Pages of each file with and without text, and their characters."""
    d = table(spark, sf_dir, "documents").filter("source = 'ocr_pages'").select("document_id", F.trim(F.coalesce("text", F.lit(""))).alias("t"))
    return d.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("t") == "").alias("blank_pages"), F.count_if(F.col("t") != "").alias("text_pages"), F.sum(F.length("t")).alias("chars"))


@P.add("""
WITH t AS (SELECT document_id, version, id, unnest(json_keys(terminology_json)) AS term FROM style_capsules WHERE terminology_json IS NOT NULL),
f AS (SELECT document_id, term, min(version) AS first_version FROM t GROUP BY ALL)
SELECT c.document_id, c.version, c.id AS capsule_id, (SELECT count(*) FROM f WHERE f.document_id = c.document_id AND f.first_version <= c.version) AS known_terms FROM style_capsules c
""")
def capsule_chain(spark, sf_dir):
    """How many terms a file's chain of capsules knows at each version, an earlier translation being kept."""
    c = table(spark, sf_dir, "style_capsules").select("document_id", "version", "id", "terminology_json")
    first = c.select("document_id", "version", F.explode(F.map_keys(F.from_json("terminology_json", "map<string,string>"))).alias("term")).groupBy("document_id", "term").agg(F.min("version").alias("first_version"))
    new = first.groupBy(F.col("document_id").alias("n_doc"), "first_version").agg(F.count(F.lit(1)).alias("new_terms"))
    # a running sum over the versions of a file; each term counts at the version that first has it
    sums = c.select("document_id", "version").distinct().join(new, (F.col("document_id") == F.col("n_doc")) & (F.col("version") == F.col("first_version")), "left")
    w = Window.partitionBy("document_id").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select(F.col("document_id").alias("s_doc"), F.col("version").alias("s_version"), F.coalesce(F.sum("new_terms").over(w), F.lit(0)).alias("known_terms"))
    j = c.join(sums, F.col("document_id").eqNullSafe(F.col("s_doc")) & F.col("version").eqNullSafe(F.col("s_version")))
    return j.select("document_id", "version", F.col("id").alias("capsule_id"), "known_terms")


@P.add("""
SELECT id AS attempt_id, CASE WHEN http_status IN (400, 401, 402, 403, 404, 413, 422) THEN 'fatal' WHEN http_status = 429 OR contains(lower(coalesce(error_message, '')), 'rate limit') THEN 'rate_limit'
  WHEN http_status = 503 OR contains(lower(coalesce(error_message, '')), 'unavailable') THEN 'unavailable' WHEN error_type IS NOT NULL THEN 'other' ELSE 'none' END AS error_class,
  least(pow(2.0::DOUBLE, attempt_number - 1), 8.0::DOUBLE) AS backoff_s FROM (SELECT DISTINCT id, http_status, error_type, error_message, attempt_number FROM translation_attempts)
""")
def error_classes(spark, sf_dir):
    """Classes of the errors of attempts, and how long the next would wait."""
    a = once(table(spark, sf_dir, "translation_attempts"), "id", "http_status", "error_type", "error_message", "attempt_number")
    said = lambda w: F.contains(F.lower(F.coalesce("error_message", F.lit(""))), F.lit(w))
    c = F.when(F.col("http_status").isin(400, 401, 402, 403, 404, 413, 422), "fatal").when((F.col("http_status") == 429) | said("rate limit"), "rate_limit")
    c = c.when((F.col("http_status") == 503) | said("unavailable"), "unavailable").when(F.col("error_type").isNotNull(), "other").otherwise("none")
    return a.select(F.col("id").alias("attempt_id"), c.alias("error_class"), R.backoff(F.col("attempt_number")).alias("backoff_s"))


@P.add("""
WITH p AS (SELECT id, document_id, status FROM cache_partitions), u AS (SELECT DISTINCT id, partition_id, status, coalesce(translation_text, '') <> '' AS has_text FROM translation_units WHERE partition_id IS NOT NULL),
g AS (SELECT partition_id, bool_and(status IN ('done', 'fallback')) AS all_over, bool_or(status = 'done') AS any_done, count_if(status IN ('done', 'fallback') AND has_text) AS with_text, count_if(status IN ('running', 'pending')) AS residual FROM u GROUP BY ALL)
SELECT p.document_id, count(*) AS partitions, count_if(coalesce((p.status IN ('ready', 'ready_low_cache', 'degraded') OR (all_over AND any_done)) AND with_text > 0, false))::BIGINT AS complete,
  coalesce(sum(residual), 0)::BIGINT AS residual_units,
  count_if(coalesce((p.status IN ('ready', 'ready_low_cache', 'degraded') OR (all_over AND any_done)) AND with_text > 0, false) AND NOT EXISTS (SELECT 1 FROM style_capsules c WHERE c.source_partition_id = p.id))::BIGINT AS without_capsule
FROM p LEFT JOIN g ON g.partition_id = p.id GROUP BY ALL
""")
def partition_gates(spark, sf_dir):
    """Of each file its partitions, how many are complete, the units that are left over, and complete ones without a capsule."""
    u = once(table(spark, sf_dir, "translation_units").withColumn("has_text", F.coalesce("translation_text", F.lit("")) != ""), "id", "partition_id", "status", "has_text").filter("partition_id IS NOT NULL")
    over = F.col("status").isin("done", "fallback")
    g = u.groupBy(F.col("partition_id").alias("g_id")).agg(F.every(over).alias("all_over"), F.some(F.col("status") == "done").alias("any_done"), F.count_if(over & F.col("has_text")).alias("with_text"), F.count_if(F.col("status").isin("running", "pending")).alias("residual"))
    c = table(spark, sf_dir, "style_capsules").select(F.col("source_partition_id").alias("c_id")).distinct()
    p = table(spark, sf_dir, "cache_partitions").join(g, F.col("id") == F.col("g_id"), "left").join(c, F.col("id") == F.col("c_id"), "left")
    whole = F.coalesce((F.col("status").isin("ready", "ready_low_cache", "degraded") | (F.col("all_over") & F.col("any_done"))) & (F.col("with_text") > 0), F.lit(False))
    return p.groupBy("document_id").agg(F.count(F.lit(1)).alias("partitions"), F.count_if(whole).alias("complete"), F.coalesce(F.sum("residual"), F.lit(0)).alias("residual_units"), F.count_if(whole & F.col("c_id").isNull()).alias("without_capsule"))


@P.add("""
SELECT id AS capsule_id, coalesce(len(json_keys(terminology_json)), 0)::BIGINT AS terms, coalesce(json_array_length(rules_json), 0)::BIGINT AS rules, coalesce(json_array_length(examples_json), 0)::BIGINT AS examples,
  (coalesce(len(json_keys(terminology_json)), 0) + coalesce(json_array_length(rules_json), 0) + coalesce(json_array_length(examples_json), 0)) > 0 AS has_payload FROM style_capsules
""")
def capsule_payload(spark, sf_dir):
    n = lambda c, f: F.coalesce(f(c), F.lit(0)).cast("bigint")
    keys = lambda c: F.size(F.map_keys(F.from_json(c, "map<string,string>")))
    c = table(spark, sf_dir, "style_capsules").select(F.col("id").alias("capsule_id"), F.greatest(n("terminology_json", keys), F.lit(0)).alias("terms"), n("rules_json", F.json_array_length).alias("rules"), n("examples_json", F.json_array_length).alias("examples"))
    return c.withColumn("has_payload", F.col("terms") + F.col("rules") + F.col("examples") > 0)


@P.add("""
SELECT doc_id, sha256(text) AS reply_hash, fetched_at IS NOT NULL AND text IS NOT NULL AS id_ok, false AS changed_id_ok, CASE WHEN n_chars >= 0 THEN least(n_chars, 300)::DOUBLE END AS wait_s, n_chars AS used,
  fetched_at IS NOT NULL AS instant_ok, false AS day_ok FROM documents
""")
def service_values(spark, sf_dir):
    """Identifiers, waiting times, replies and instants of a service, made from the rows of documents and read back."""
    d = table(spark, sf_dir, "documents")
    reply = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    i = R.memory_id(F.col("fetched_at"), F.substring(F.sha2("text", 256), 1, 20))
    usage = F.to_json(F.struct(F.lit(0).alias("prompt_cache_hit_tokens"), F.col("n_chars").alias("cache_hit_tokens")))
    return d.select(
        "doc_id", F.sha2(R.chat_text(reply), 256).alias("reply_hash"), R.is_memory_id(i).alias("id_ok"), R.is_memory_id(F.concat(i, F.lit("0"))).alias("changed_id_ok"), R.retry_after(F.format_string(" %s ", F.col("n_chars"))).alias("wait_s"),
        R.usage_field(usage, "prompt_cache_hit_tokens", "cache_hit_tokens").alias("used"), R.is_instant(F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("instant_ok"), R.is_instant(F.date_format("fetched_at", "yyyy-MM-dd")).alias("day_ok"),
    )
