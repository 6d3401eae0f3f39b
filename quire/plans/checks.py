"""Catalog over whole tables, decoding, stores, fixed orders, plan state, wiring, replies and indexes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import records as R
from quire.functions.markdown import ATOMIC_TYPES
from quire.functions.tokens import bytes_estimate
from quire.operators import catalog as C
from quire.operators import context as X
from quire.operators import knowledge as K
from quire.operators import translate as T
from quire.operators.state import drift, once
from quire.plans import Plans
from quire.plans.catalog import DESCRIPTION, NOTES, notes
from quire.session import Stage, ship, table
from quire.sources import markdown as M
from quire.sources import stores

P = Plans()
QUERIES, SQL = P.queries, P.sql

#: DuckDB: edges between notes, each to the next note in the order of ids that has the same first tag
EDGES = """
edges AS (SELECT memory_id, 'same_topic' AS relation_type, target_memory_id FROM (SELECT memory_id, lead(memory_id) OVER (PARTITION BY tags[1] ORDER BY memory_id) AS target_memory_id FROM notes WHERE len(tags) > 0) WHERE target_memory_id IS NOT NULL)
"""


def edges(n):
    w = Window.partitionBy(F.get("tags", F.lit(0))).orderBy("memory_id")
    return n.filter(F.size("tags") > 0).select("memory_id", F.lit("same_topic").alias("relation_type"), F.lead("memory_id").over(w).alias("target_memory_id")).filter("target_memory_id IS NOT NULL")


@P.add(f"WITH {NOTES}, d AS (SELECT *, {DESCRIPTION} AS description FROM notes) SELECT memory_id, 'memory/' || memory_id || '.md' AS path, memory_type, status, title, description, length(content)::BIGINT AS content_chars, len(tags)::INTEGER AS tags FROM d")
def catalog_scan(spark, sf_dir):
    """The columns that a catalog query reads."""
    return notes(spark, sf_dir).select("memory_id", "path", "memory_type", "status", "title", "description", F.length("content").cast("bigint").alias("content_chars"), F.size("tags").alias("tags"))


@P.add(f"""
WITH {NOTES}, {EDGES}, d AS (SELECT *, {DESCRIPTION} AS description FROM notes),
h AS (SELECT sha256(concat_ws(chr(1), memory_id, sha256(content))) AS h FROM notes),
r AS (SELECT substr(h, 1, 3) AS r, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY ALL)
SELECT 'memories_count' AS key, count(*)::VARCHAR AS stored, true AS ok FROM notes UNION ALL SELECT 'tags_count', sum(len(tags))::BIGINT::VARCHAR, true FROM notes
UNION ALL SELECT 'relations_count', count(*)::VARCHAR, true FROM edges
UNION ALL SELECT 'terms_count', count(*)::VARCHAR, true FROM (SELECT DISTINCT memory_id, field, unnest(list_filter(regexp_split_to_array(strip_accents(lower(t)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS term
  FROM (SELECT memory_id, unnest(['title', 'description', 'content', 'tags']) AS field, unnest([title, description, content, array_to_string(tags, ' ')]) AS t FROM d))
UNION ALL SELECT 'digest', sha256(string_agg(d, '' ORDER BY d)), true FROM r
""")
def catalog_rebuild(spark, sf_dir):
    """The catalog written whole, and its stored figures against those of the tables as they are read back."""
    folder = Stage(spark, "catalog").base
    n = notes(spark, sf_dir)
    C.rebuild(n, edges(n), folder)
    return C.verify(spark, folder).select("key", "stored", "ok")


def _count(words: str) -> str:
    """DuckDB: how often a phrase stands in the four fields of a note."""
    pattern = "".join(f" {w} " for w in words.split())
    spaced = "array_to_string(list_transform(list_filter(regexp_split_to_array(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), lambda x: ' ' || x || ' '), '')"
    parts = [spaced.format(f) for f in ("title", "description", "content", "array_to_string(tags, ' ')")]
    return " + ".join(f"(length({p}) - length(replace({p}, '{pattern}', ''))) // {len(pattern)}" for p in parts)


@P.add(f"""
WITH {NOTES}, d AS (SELECT *, {DESCRIPTION} AS description FROM notes),
c AS (SELECT memory_id, {_count("selection bias")} AS a, {_count("weld")} AS b, {_count("sample")} AS s,
  len(list_filter(regexp_split_to_array(strip_accents(lower(title || ' ' || description || ' ' || content || ' ' || array_to_string(tags, ' '))), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS len FROM d),
n AS (SELECT count(*) AS n, avg(len) AS mean, count_if(a > 0) AS da, count_if(b > 0) AS db, count_if(s > 0) AS ds FROM c),
w AS (SELECT memory_id, len / mean AS l, a, b, s, da, db, ds, n FROM c, n WHERE a > 0 OR (b > 0 AND NOT s > 0)),
i AS (SELECT memory_id, l, unnest([a, b, s]) AS tf, unnest([da, db, ds]) AS df, n FROM w)
SELECT memory_id, round(greatest(sum(CASE WHEN tf > 0 THEN (CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l)) ELSE 0 END), 0), 6) AS score
FROM i GROUP BY memory_id
""")
def memory_match(spark, sf_dir):
    """Full-text search with a phrase, AND, OR, NOT and brackets."""
    return C.match(notes(spark, sf_dir), '"Sélection bias" OR (weld NOT sample)').select("memory_id", F.round("score", 6).alias("score"))


@P.add(f"""
WITH {NOTES}, {EDGES},
d AS (SELECT memory_id, (contains(lower(title), 'selection bias')::INT + contains(lower({DESCRIPTION}), 'selection bias')::INT + contains(lower(content), 'selection bias')::INT + contains(lower(array_to_string(tags, ' ')), 'selection bias')::INT)::DOUBLE AS score FROM notes WHERE status = 'active' AND (contains(lower(title), 'selection bias')::INT + contains(lower({DESCRIPTION}), 'selection bias')::INT + contains(lower(content), 'selection bias')::INT + contains(lower(array_to_string(tags, ' ')), 'selection bias')::INT) > 0),
hop AS (SELECT e.target_memory_id AS memory_id, min(struct_pack(s := -d.score, i := d.memory_id)) AS best FROM edges e JOIN d USING (memory_id) WHERE e.target_memory_id NOT IN (SELECT memory_id FROM d) GROUP BY ALL),
a AS (SELECT 0 AS part, -score AS ord, memory_id AS ord_id, memory_id, score, NULL AS relation_source_id, 'direct' AS how FROM d
  UNION ALL SELECT 1, best.s, best.i, hop.memory_id, NULL, best.i, 'relation:same_topic' FROM hop JOIN notes n USING (memory_id) WHERE n.status = 'active')
SELECT row_number() OVER (ORDER BY part, ord, ord_id, memory_id)::INTEGER AS rank, memory_id, score, relation_source_id, how FROM a QUALIFY rank <= 1000
""")
def memory_related(spark, sf_dir):
    """Direct hits of a keyword and the records one relation away, ranked; the limit is that of the query."""
    n = notes(spark, sf_dir)
    q = C.query(n, edges(n), C.Request(text="selection bias", include_related=True, limit=1000))
    how = F.when(F.col("relation_source_id").isNull(), "direct").otherwise(F.get("match_reasons", F.lit(0)))
    return q.select("rank", "memory_id", "score", "relation_source_id", how.alias("how"))


@P.add(f"""
WITH {NOTES} SELECT memory_id, status = 'active' AS ordinary, CASE WHEN status <> 'active' THEN 'excluded from ordinary queries: status ' || status ELSE '' END AS warnings, 'memory_id:' || memory_id || '|status:' || status AS reasons
FROM notes WHERE status IN ('active', 'candidate', 'superseded', 'archived', 'deprecated')
""")
def memory_explain(spark, sf_dir):
    """Of each record why it matches a request for it, and what speaks against it."""
    d = C.direct(notes(spark, sf_dir), C.Request(statuses=("active", "candidate", "superseded", "archived", "deprecated")))
    return d.select(
        "memory_id", (F.size("warnings") == 0).alias("ordinary"), F.array_join("warnings", "|").alias("warnings"),
        F.concat(F.lit("memory_id:"), "memory_id", F.lit("|"), F.array_join("match_reasons", "|")).alias("reasons"),
    )


@P.add(f"""
WITH {NOTES}, l AS (SELECT doc_id, unnest(string_split(front, chr(10))) AS line FROM raw)
SELECT doc_id, trim(regexp_extract(line, '^([^:]+):', 1)) AS key, CASE WHEN line LIKE '%[%]' THEN array_to_string(list_transform(string_split(regexp_extract(line, '\\[(.*)\\]', 1), ','), lambda x: trim(x)), '|') ELSE trim(regexp_extract(line, ':(.*)$', 1)) END AS value, '' AS problems
FROM l WHERE line LIKE '%:%'
""")
def record_fields(spark, sf_dir):
    """The fields of the notes' front matter, nested or not, and what keeps a note from being decoded."""
    ship(spark)
    d = table(spark, sf_dir, "documents").filter(M.front_state(F.col("text")) == "ok")
    d = d.select("doc_id", M.nested_fields(M.front_matter(F.col("text"))).alias("f"), M.body(F.col("text")).alias("content"))
    problems = M.decode_problems(F.col("f.fields"), F.col("f.error"), F.col("content"), ["memory_type", "status", "tags"], hash_key="content_hash")
    return d.select("doc_id", F.explode("f.fields").alias("x"), F.array_join(problems, "|").alias("problems")).select("doc_id", "x.key", F.coalesce("x.value", F.array_join("x.items", "|")).alias("value"), "problems")


@P.add("""
SELECT 'documents' AS kind, id, row_number() OVER (ORDER BY updated_at DESC NULLS LAST, id DESC)::INTEGER AS place FROM document_files
UNION ALL SELECT 'batches', id, row_number() OVER (PARTITION BY document_id ORDER BY page_start NULLS FIRST, id)::INTEGER FROM (SELECT DISTINCT id, document_id, page_start FROM ocr_batches)
UNION ALL SELECT 'units', id, row_number() OVER (PARTITION BY document_id ORDER BY sequence_index NULLS FIRST, id)::INTEGER FROM (SELECT DISTINCT id, document_id, sequence_index FROM translation_units)
UNION ALL SELECT 'partitions', id, row_number() OVER (PARTITION BY document_id ORDER BY sequence_index NULLS FIRST, id)::INTEGER FROM cache_partitions
UNION ALL SELECT 'capsules', id, row_number() OVER (PARTITION BY document_id ORDER BY version NULLS FIRST, id)::INTEGER FROM style_capsules
""")
def fixed_orders(spark, sf_dir):
    """The place of each row in the fixed order of its list: files by the newest change, batches by page, the rest by sequence or version."""
    t = lambda name: table(spark, sf_dir, name)

    def placed(kind, df, by, *order):
        w = Window.partitionBy(*by).orderBy(*order)
        return df.select(F.lit(kind).alias("kind"), "id", F.row_number().over(w).alias("place"))

    files = t("document_files").select("id", "updated_at")
    out = files.orderBy(F.desc("updated_at"), F.desc("id")).select(F.lit("documents").alias("kind"), "id", F.row_number().over(Window.orderBy(F.desc("updated_at"), F.desc("id"))).alias("place"))
    out = out.unionByName(placed("batches", once(t("ocr_batches"), "id", "document_id", "page_start"), ["document_id"], "page_start", "id"))
    out = out.unionByName(placed("units", once(t("translation_units"), "id", "document_id", "sequence_index"), ["document_id"], "sequence_index", "id"))
    out = out.unionByName(placed("partitions", t("cache_partitions"), ["document_id"], "sequence_index", "id"))
    return out.unionByName(placed("capsules", t("style_capsules"), ["document_id"], "version", "id"))


ADHOC = """
SELECT f.language, count(*) AS files, count(u.document_id) AS with_units, coalesce(sum(u.units), 0) AS units
FROM document_files f LEFT JOIN (SELECT document_id, count(DISTINCT id) AS units FROM translation_units GROUP BY document_id) u ON u.document_id = f.id GROUP BY f.language
"""


@P.add(ADHOC.replace("coalesce(sum(u.units), 0)", "coalesce(sum(u.units), 0)::BIGINT"))
def adhoc_sql(spark, sf_dir):
    """SQL over the tables by their names, as the reference's own surface takes it."""
    return spark.sql(ADHOC.replace("document_files f", "{files} f").replace("FROM translation_units", "FROM {units}"), files=table(spark, sf_dir, "document_files"), units=table(spark, sf_dir, "translation_units"))


@P.add("""
SELECT id AS request_id, array_to_string(list_filter([CASE WHEN unit_count IS NULL OR unit_count NOT BETWEEN 1 AND 1000 THEN 'limit' END, CASE WHEN status IS NULL THEN 'statuses' END,
  CASE WHEN warmup_status IS NOT NULL AND coalesce(actual_probe_hit_tokens, 0) = 0 THEN 'relation_types' END, CASE WHEN user_id LIKE '%-01' THEN 'path' END], lambda x: x IS NOT NULL), '|') AS problems FROM cache_partitions
""")
def request_checks(spark, sf_dir):
    """What is wrong with requests, here made of the fields of partitions."""
    p = table(spark, sf_dir, "cache_partitions")
    some = lambda c: F.when(F.col(c).isNotNull(), F.array(c))
    path = F.when(F.col("user_id").endswith("-01"), F.concat(F.lit("../"), "user_id")).otherwise(F.concat(F.lit("a/"), "user_id"))
    bad = C.request_problems(F.col("unit_count"), some("status"), some("warmup_status"), F.coalesce("actual_probe_hit_tokens", F.lit(0)) > 0, path)
    return p.select(F.col("id").alias("request_id"), F.array_join(bad, "|").alias("problems"))


@P.add("""
WITH p AS (SELECT DISTINCT document_id FROM cache_partitions), n AS (SELECT DISTINCT document_id FROM structural_nodes), o AS (SELECT max(active_config_hash) AS h FROM document_files)
SELECT f.id AS document_id, p.document_id IS NOT NULL AS has_partitions, n.document_id IS NOT NULL AS has_nodes, p.document_id IS NOT NULL AND n.document_id IS NOT NULL AND coalesce(f.active_config_hash = o.h, false) AS is_current,
  coalesce(status = 'failed', false) OR coalesce(translation_status = 'failed', false) OR coalesce(ocr_status = 'failed', false) AS to_retry
FROM document_files f LEFT JOIN p ON p.document_id = f.id LEFT JOIN n ON n.document_id = f.id, o
""")
def plan_current(spark, sf_dir):
    """Whether the plan of a file still holds: it has partitions and nodes and was made with the newest settings; and whether the file failed somewhere."""
    has = lambda name, out: table(spark, sf_dir, name).select(F.col("document_id").alias(out)).distinct()
    f = table(spark, sf_dir, "document_files")
    newest = f.agg(F.max("active_config_hash").alias("newest"))
    j = f.join(has("cache_partitions", "p"), F.col("id") == F.col("p"), "left").join(has("structural_nodes", "n"), F.col("id") == F.col("n"), "left").join(F.broadcast(newest))  # one row
    failed = lambda c: F.coalesce(F.col(c) == "failed", F.lit(False))
    whole = F.col("p").isNotNull() & F.col("n").isNotNull()
    return j.select(
        F.col("id").alias("document_id"), F.col("p").isNotNull().alias("has_partitions"), F.col("n").isNotNull().alias("has_nodes"),
        (whole & F.coalesce(F.col("active_config_hash") == F.col("newest"), F.lit(False))).alias("is_current"), (failed("status") | failed("translation_status") | failed("ocr_status")).alias("to_retry"),
    )


@P.add("SELECT DISTINCT id AS unit_id, coalesce(status = 'done', false) AND coalesce(length(translation_text), 0) > 0 AS is_done FROM (SELECT DISTINCT id, status, translation_text FROM translation_units)")
def done_units(spark, sf_dir):
    u = once(table(spark, sf_dir, "translation_units"), "id", "status", "translation_text")
    return u.select(F.col("id").alias("unit_id"), (F.coalesce(F.col("status") == "done", F.lit(False)) & (F.coalesce(F.length("translation_text"), F.lit(0)) > 0)).alias("is_done")).distinct()


@P.add(f"""
SELECT document_id, count_if(coalesce(node_type IN ({", ".join(repr(t) for t in ATOMIC_TYPES)}), false))::BIGINT AS atomic, count_if(coalesce(trim(source_text), '') <> '' AND coalesce(node_type NOT IN ({", ".join(repr(t) for t in ATOMIC_TYPES)}), true))::BIGINT AS translatable
FROM (SELECT DISTINCT id, document_id, node_type, source_text FROM structural_nodes) GROUP BY ALL
""")
def atomic_nodes(spark, sf_dir):
    """Of each file the nodes that stay whole and those with text to translate."""
    n = once(table(spark, sf_dir, "structural_nodes"), "id", "document_id", "node_type", "source_text")
    whole = F.coalesce(F.col("node_type").isin(*ATOMIC_TYPES), F.lit(False))
    return n.groupBy("document_id").agg(F.count_if(whole).alias("atomic"), F.count_if(~whole & (F.coalesce(F.trim("source_text"), F.lit("")) != "")).alias("translatable"))


@P.add("""
SELECT id AS document_id, 'file:' || coalesce(source_path, source_sha256, display_name, 'unknown') || ' | settings:' || coalesce(active_config_hash, 'unknown') || ' | language:' || coalesce(language, 'unknown') AS provenance FROM document_files
""")
def provenance_summary(spark, sf_dir):
    """Where a file comes from, in one line."""
    none = F.lit(None).cast("string")
    s = lambda kind, uri, i, actor: F.struct(F.lit(kind).alias("type"), uri.alias("uri"), i.alias("id"), actor.alias("actor"))
    sources = F.array(s("file", F.col("source_path"), F.col("source_sha256"), F.col("display_name")), s("settings", none, F.col("active_config_hash"), none), s("language", none, none, F.col("language")))
    return table(spark, sf_dir, "document_files").select(F.col("id").alias("document_id"), C.provenance(sources).alias("provenance"))


@P.add("""
SELECT DISTINCT id AS node_id, CASE WHEN node_type IS NOT NULL THEN node_type ELSE 'related_to' END AS relation, parent_id::VARCHAR AS target FROM structural_nodes WHERE parent_id IS NOT NULL
""")
def relation_split(spark, sf_dir):
    """Relations written as 'kind:target', or the target alone, taken apart."""
    n = once(table(spark, sf_dir, "structural_nodes"), "id", "node_type", "parent_id").filter("parent_id IS NOT NULL")
    kind, target = K.split_relation(F.concat(F.coalesce(F.concat("node_type", F.lit(":")), F.lit("")), F.col("parent_id").cast("string")))
    return n.select(F.col("id").alias("node_id"), kind.alias("relation"), target.alias("target")).distinct()


@P.add("""
SELECT id AS partition_id, sha256('{"prefix":' || coalesce('"' || prefix_hash || '"', 'null') || ',"tokens":' || coalesce(source_tokens::VARCHAR, 'null') || ',"user":' || coalesce('"' || user_id || '"', 'null') || ',"warmup":' || coalesce('"' || warmup_status || '"', 'null') || '}') AS fingerprint
FROM cache_partitions
""")
def fingerprints(spark, sf_dir):
    """SHA-256 of the canonical JSON of a partition's settings, in the order of their names and with nulls."""
    f = R.fingerprint(user=F.col("user_id"), prefix=F.col("prefix_hash"), warmup=F.col("warmup_status"), tokens=F.col("source_tokens"))
    return table(spark, sf_dir, "cache_partitions").select(F.col("id").alias("partition_id"), f.alias("fingerprint"))


@P.add("""
WITH u AS (SELECT DISTINCT id, partition_id, sequence_index, coalesce(source_text, '') AS t FROM translation_units WHERE partition_id IS NOT NULL)
SELECT partition_id, count(*) AS requests, sum(length(t))::BIGINT AS chars, max(length(t))::BIGINT AS longest, sha256(string_agg(substr(sha256(t), 1, 16), ',' ORDER BY sequence_index, id)) AS inventory FROM u GROUP BY ALL
""")
def request_inventory(spark, sf_dir):
    """Of each partition the requests that would leave the house: how many, their characters, and a hash of the hashes of their texts."""
    u = once(table(spark, sf_dir, "translation_units"), "id", "partition_id", "sequence_index", "source_text").filter("partition_id IS NOT NULL")
    t = F.coalesce("source_text", F.lit(""))
    row = F.struct("sequence_index", "id", F.substring(F.sha2(t, 256), 1, 16).alias("h"))
    g = u.groupBy("partition_id").agg(F.count(F.lit(1)).alias("requests"), F.sum(F.length(t)).alias("chars"), F.max(F.length(t)).cast("bigint").alias("longest"), F.array_sort(F.collect_list(row)).alias("rows"))
    return g.select("partition_id", "requests", "chars", "longest", F.sha2(F.array_join(F.transform("rows", lambda x: x["h"]), ","), 256).alias("inventory"))


@P.add("""
WITH n AS (SELECT DISTINCT id, document_id, sequence_index, parent_id FROM structural_nodes WHERE document_id IS NOT NULL AND sequence_index IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY sequence_index, id) AS temp FROM n)
SELECT c.document_id, c.temp::INTEGER AS temp_id, p.temp::INTEGER AS parent_temp_id, p.id AS parent_id FROM t c LEFT JOIN t p ON p.id = c.parent_id AND p.document_id = c.document_id
""")
def parent_wiring(spark, sf_dir):
    """Parents given by temporary numbers inside a file, wired to the ids that the stored nodes have."""
    n = once(table(spark, sf_dir, "structural_nodes"), "id", "document_id", "sequence_index", "parent_id").filter("document_id IS NOT NULL AND sequence_index IS NOT NULL")
    t = n.withColumn("temp_id", F.row_number().over(Window.partitionBy("document_id").orderBy("sequence_index", "id")))
    p = t.select(F.col("id").alias("p_id"), F.col("document_id").alias("p_doc"), F.col("temp_id").alias("parent_temp_id"))
    return t.join(p, (F.col("parent_id") == F.col("p_id")) & (F.col("document_id") == F.col("p_doc")), "left").select("document_id", "temp_id", "parent_temp_id", F.col("p_id").alias("parent_id"))


BUDGET = 1_000


@P.add(f"""
WITH {NOTES}, {EDGES}, c AS (SELECT memory_id, status, tags, title || chr(10) || content || chr(10) || array_to_string(tags, chr(10)) AS text FROM notes),
d AS (SELECT memory_id, status, greatest(1, (octet_length(encode(text)) + 3) // 4) AS tokens, list_contains(tags, 'well-documented') AS symbol, contains(lower(text), 'selection bias') AS word FROM c),
s AS (SELECT memory_id FROM d WHERE (symbol OR word) AND status = 'active'),
hop AS (SELECT target_memory_id AS memory_id, list_sort(list(DISTINCT 'relation_from:' || e.memory_id || ':same_topic')) AS hops FROM edges e JOIN s USING (memory_id) GROUP BY ALL),
m AS (SELECT d.*, CASE WHEN symbol THEN 2 WHEN word THEN 3 ELSE 4 END AS best, list_filter(list_concat([CASE WHEN symbol THEN 'symbol_match:Well-documented' END, CASE WHEN word THEN 'keyword_match:selection bias' END], coalesce(hops, [])), lambda x: x IS NOT NULL) AS reasons
  FROM d LEFT JOIN hop USING (memory_id) WHERE symbol OR word OR hops IS NOT NULL),
required AS (SELECT sum(tokens) FILTER (symbol AND status = 'active') AS t, count_if(status = 'active' AND (symbol OR tokens + coalesce((SELECT sum(tokens) FROM m WHERE symbol AND status = 'active'), 0) <= {BUDGET})) AS taken FROM m)
SELECT memory_id AS document_id, CASE WHEN status <> 'active' THEN 'status_filtered:' || status END AS excluded, CASE best WHEN 2 THEN 'required' WHEN 3 THEN 'relevant' ELSE 'related' END AS priority, array_to_string(reasons, '|') AS reasons,
  CASE WHEN t > {BUDGET} THEN 'required context exceeds budget by ' || (t - {BUDGET})::BIGINT || ' token(s)' WHEN taken = 0 THEN 'no eligible context documents matched the request' ELSE '' END AS warning FROM m, required
""")
def context_related(spark, sf_dir):
    """Context documents with one hop over relations, all reasons in their order, and the warning about the budget."""
    n = notes(spark, sf_dir)
    none = F.lit(None).cast("string")
    text = F.concat_ws("\n", "title", "content", F.array_join("tags", "\n"))
    c = n.select(
        F.col("memory_id").alias("document_id"), "path", F.lit("memory").alias("kind"), text.alias("text"), "tags", F.transform("tags", lambda t: t).alias("symbols"), none.alias("temperature"), none.alias("epistemic_status"),
        none.alias("lifecycle"), "status", F.lit("coding").alias("namespace"), "valid_from", "valid_until",
    ).withColumn("tokens", bytes_estimate(F.col("text")))
    relations = edges(n).select(F.col("memory_id").alias("document_id"), F.col("relation_type").alias("kind"), F.col("target_memory_id").alias("target_id"))
    out = X.select(c, relations, X.ContextRequest(symbols=("Well-documented",), keywords=("selection bias",), budget=BUDGET))
    excluded = F.when(~F.col("state").isin("selected", "budget_trimmed"), F.col("state"))
    warning = X.warnings(out, BUDGET).agg(F.coalesce(F.max("warning"), F.lit("")).alias("warning"))
    return out.select("document_id", excluded.alias("excluded"), "priority", F.array_join("reasons", "|").alias("reasons")).join(F.broadcast(warning))  # one row


@P.add("""
SELECT DISTINCT id AS unit_id, trim(coalesce(translation_text, ''), ' ' || chr(9) || chr(10) || chr(13)) || chr(10) AS reply, octet_length(encode(trim(coalesce(translation_text, ''), ' ' || chr(9) || chr(10) || chr(13))))::INTEGER + 1 AS bytes FROM (SELECT DISTINCT id, unit_key, translation_text FROM translation_units)
""")
def marked_replies(spark, sf_dir):
    """Replies of a service taken out of their marks."""
    u = once(table(spark, sf_dir, "translation_units"), "id", "unit_key", "translation_text")
    raw = F.concat(F.lit("Here it is: <<<UNIT:"), F.coalesce("unit_key", F.lit("")), F.lit(":BEGIN>>>\n"), F.coalesce("translation_text", F.lit("")), F.lit("\n<<<UNIT:"), F.coalesce("unit_key", F.lit("")), F.lit(":END>>> bye"))
    return u.withColumn("reply", T.reply_between_marks(raw, F.coalesce("unit_key", F.lit("")))).select(F.col("id").alias("unit_id"), "reply", F.octet_length("reply").alias("bytes")).distinct()


@P.add(f"""
WITH {NOTES} SELECT memory_id, replace(replace(title, '|', chr(92) || '|'), chr(10), ' ') AS cell, CASE WHEN len(tags) = 0 THEN '-' ELSE array_to_string(tags[1:1], '<br>') || CASE WHEN len(tags) > 1 THEN ' ...' ELSE '' END END AS summary, substr(sha256(content), 1, 16) AS checksum FROM notes
""")
def cell_summaries(spark, sf_dir):
    """Table cells of notes: escaped titles, the first tag and whether there are more, and checksums."""
    n = notes(spark, sf_dir)
    return n.select("memory_id", K.escape_cell(F.col("title")).alias("cell"), K.summarize(F.col("tags"), 1).alias("summary"), F.substring(F.sha2("content", 256), 1, 16).alias("checksum"))


@P.add("""
WITH r AS (SELECT id AS partition_id, unit_count, CASE WHEN coalesce(expected_cache_tokens, 0) <= 0 THEN NULL ELSE coalesce(actual_probe_hit_tokens, 0)::DOUBLE / expected_cache_tokens END AS ratio FROM cache_partitions)
SELECT partition_id, CASE WHEN ratio >= 0.7::DOUBLE THEN 'full' WHEN ratio >= 0.5::DOUBLE THEN 'low' ELSE 'degraded' END AS probe, round(ratio, 6) AS ratio, CASE WHEN ratio >= 0.7::DOUBLE THEN greatest(unit_count, 1) WHEN ratio >= 0.5::DOUBLE THEN 2 ELSE 1 END AS at_a_time FROM r
""")
def cache_probe(spark, sf_dir):
    """How much of a warmed cache a probe hit, and how many requests may then run at a time."""
    expected, hit = F.coalesce("expected_cache_tokens", F.lit(0)), F.coalesce("actual_probe_hit_tokens", F.lit(0))
    ratio = F.when(expected > 0, hit.cast("double") / expected)
    probe = F.when(ratio >= 0.7, "full").when(ratio >= 0.5, "low").otherwise("degraded")
    limit = F.when(ratio >= 0.7, F.greatest("unit_count", F.lit(1))).when(ratio >= 0.5, 2).otherwise(1).cast("bigint")
    return table(spark, sf_dir, "cache_partitions").select(F.col("id").alias("partition_id"), probe.alias("probe"), F.round(ratio, 6).alias("ratio"), limit.alias("at_a_time"))


@P.add("""
WITH a AS (SELECT DISTINCT id, unit_id, http_status, completion_tokens FROM translation_attempts)
SELECT id, unit_id, http_status, completion_tokens, row_number() OVER (ORDER BY http_status IS NOT NULL, id) AS sequence FROM a
""")
def log_appends(spark, sf_dir):
    """A log written by two appends and read again: attempts without an answer first, each numbered on from the last."""
    a = once(table(spark, sf_dir, "translation_attempts"), "id", "unit_id", "http_status", "completion_tokens")
    path = f"{Stage(spark, 'log').base}/log"
    stores.append_log(a.filter("http_status IS NULL"), path, "id")
    stores.append_log(a.filter("http_status IS NOT NULL"), path, "id")
    return stores.read_log(spark, path, "id BIGINT, unit_id BIGINT, http_status BIGINT, completion_tokens BIGINT, sequence BIGINT").drop("_corrupt")


@P.add("""
WITH u AS (SELECT DISTINCT id, source_hash, translation_text FROM translation_units), c AS (SELECT source_hash AS key, min(translation_text) AS cached FROM u WHERE trim(translation_text) <> '' AND source_hash IS NOT NULL GROUP BY ALL)
SELECT u.id AS unit_id, c.key IS NOT NULL AS hit, sha256(cached) AS cached_hash FROM u LEFT JOIN c ON c.key = u.source_hash
""")
def cache_store(spark, sf_dir):
    """Translations stored under the hash of their source, in a table that is replaced whole, and looked up again."""
    u = once(table(spark, sf_dir, "translation_units"), "id", "source_hash", "translation_text")
    path = f"{Stage(spark, 'cache').base}/cache"
    stores.replace(stores.store_cache(u.select(F.col("source_hash").alias("key"), F.col("translation_text").alias("translation")), None), path)
    stores.replace(stores.store_cache(u.select(F.col("source_hash").alias("key"), F.lit("later").alias("translation")).limit(0), spark.read.parquet(path)), path)
    return stores.look_up(u.withColumnRenamed("source_hash", "key"), spark.read.parquet(path)).select(F.col("id").alias("unit_id"), "hit", F.sha2("cached", 256).alias("cached_hash"))


@P.add("""
WITH u AS (SELECT DISTINCT id, '1.' || substr(prompt_version, 2) || '.0' AS has, '1.2.' || coalesce(substr(style_capsule_version, 2), '0') AS wants FROM translation_units)
SELECT id AS unit_id, CASE WHEN has IS NULL THEN 'unknown' WHEN string_split(has, '.')[2]::INT < 2 THEN 'behind' WHEN string_split(wants, '.')[3]::INT > 0 THEN 'behind' ELSE 'same' END AS state FROM u
""")
def version_drift(spark, sf_dir):
    """The version that a unit was made with against the one that it should have."""
    u = once(table(spark, sf_dir, "translation_units"), "id", "prompt_version", "style_capsule_version")
    has = F.concat(F.lit("1."), F.substring("prompt_version", 2, 9), F.lit(".0"))
    wants = F.concat(F.lit("1.2."), F.coalesce(F.substring("style_capsule_version", 2, 9), F.lit("0")))
    return u.select(F.col("id").alias("unit_id"), R.version_state(has, wants).alias("state")).distinct()


@P.add(f"""
WITH {NOTES}, s AS (SELECT doc_id // 1000 AS scope, tags[1] AS topic, count(*) AS n, min(doc_id) AS first_id FROM notes WHERE len(tags) > 0 GROUP BY ALL),
want AS (SELECT doc_id // 1000 AS scope, count(*) AS n FROM notes GROUP BY ALL), have AS (SELECT doc_id // 1000 AS scope, count(*) AS n FROM notes WHERE status = 'active' GROUP BY ALL)
SELECT want.scope, CASE WHEN have.scope IS NULL THEN 'missing' ELSE 'changed' END AS state FROM want LEFT JOIN have USING (scope) WHERE have.n IS DISTINCT FROM want.n
""")
def index_drift(spark, sf_dir):
    """Generated indexes that aren't as they should be; the stored ones here list active notes only."""
    n = notes(spark, sf_dir).withColumn("scope", F.floor(F.col("doc_id") / 1000))
    blocks = lambda d: K.index_blocks(d.select("scope", F.col("memory_id").alias("path"), F.coalesce("memory_type", F.lit("-")).alias("type"), "title", F.col("tags").alias("hints"))).select("scope", "block")
    return drift(blocks(n), blocks(n.filter("status = 'active'")), ["scope"])
