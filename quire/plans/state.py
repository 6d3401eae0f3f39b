"""Versions, merges, coverage, carry-forward and drift on the state tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import state as S
from quire.operators.prefix import running_total_blocks
from quire.plans import Plans
from quire.session import table

P = Plans()
QUERIES, SQL = P.queries, P.sql


@P.add("""
SELECT document_id, version, id AS capsule_id, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY version DESC, id DESC) AS n FROM style_capsules) WHERE n = 1
""")
def latest_capsule(spark, sf_dir):
    c = table(spark, sf_dir, "style_capsules").select("document_id", "version", F.col("id").alias("capsule_id"), "content_hash")
    return S.latest(c, ["document_id"], [F.desc("version"), F.desc("capsule_id")])


@P.add("""
WITH n AS (SELECT document_id AS id, max(page_end) AS page_count, max(config_hash) AS active_config_hash FROM ocr_batches GROUP BY ALL)
SELECT coalesce(n.id, f.id) AS id, f.display_name, coalesce(n.page_count, f.page_count) AS page_count, f.status, coalesce(n.active_config_hash, f.active_config_hash) AS active_config_hash
FROM document_files f FULL JOIN n ON n.id = f.id
""")
def upsert_merge(spark, sf_dir):
    """Files with what their OCR batches know of their pages and settings merged in."""
    new = table(spark, sf_dir, "ocr_batches").groupBy(F.col("document_id").alias("id")).agg(F.max("page_end").alias("page_count"), F.max("config_hash").alias("active_config_hash"))
    return S.upsert(table(spark, sf_dir, "document_files").select("id", "display_name", "page_count", "status", "active_config_hash"), new, "id")


@P.add("""
WITH u AS (SELECT DISTINCT id, document_id, status, attempt_count, source_tokens FROM translation_units),
c AS (SELECT unit_id, max(attempt_number) AS attempt_count, max(prompt_tokens) AS source_tokens FROM translation_attempts GROUP BY ALL)
SELECT u.id, u.document_id, u.status, coalesce(c.attempt_count, u.attempt_count) AS attempt_count, coalesce(c.source_tokens, u.source_tokens) AS source_tokens FROM u LEFT JOIN c ON c.unit_id = u.id
""")
def sparse_update(spark, sf_dir):
    u = S.once(table(spark, sf_dir, "translation_units"), "id", "document_id", "status", "attempt_count", "source_tokens")
    c = table(spark, sf_dir, "translation_attempts").groupBy(F.col("unit_id").alias("id")).agg(F.max("attempt_number").alias("attempt_count"), F.max("prompt_tokens").alias("source_tokens"))
    return S.sparse_update(u, c, "id")


@P.add("""
WITH u AS (SELECT DISTINCT id, document_id, unit_key, sequence_index, source_hash, status, translation_text FROM translation_units),
n AS (SELECT document_id, 'u' || lpad(row_number() OVER (PARTITION BY document_id ORDER BY sequence_index, id)::VARCHAR, 5, '0') AS unit_key, source_hash FROM u),
p AS (SELECT document_id, source_hash, id, status, row_number() OVER (PARTITION BY document_id, source_hash ORDER BY sequence_index DESC, id DESC) AS k FROM u
  WHERE status IN ('done', 'fallback') AND coalesce(length(translation_text), 0) > 0)
SELECT n.document_id, n.unit_key, n.source_hash, coalesce(p.status, 'pending') AS status, p.id AS kept_from FROM n LEFT JOIN p ON p.document_id = n.document_id AND p.source_hash = n.source_hash AND p.k = 1
""")
def replan_preserve(spark, sf_dir):
    """A new plan that numbers the units afresh, with the work that it can keep."""
    u = S.once(table(spark, sf_dir, "translation_units"), "id", "document_id", "unit_key", "sequence_index", "source_hash", "status", "translation_text")
    place = u.withColumn("at", F.coalesce("sequence_index", F.lit(2**62)))
    n = running_total_blocks(place, ["document_id"], F.floor(F.col("at") / 4096), ["at", "id"], F.lit(1).cast("bigint"), "before")
    new = n.select("document_id", F.concat(F.lit("u"), F.lpad((F.col("before") + 1).cast("string"), 5, "0")).alias("unit_key"), "source_hash")
    return S.replan(new, u).drop("translation_text")


@P.add("""
WITH o AS (SELECT source_partition_id AS id, max(version) AS frozen FROM style_capsules GROUP BY ALL)
SELECT p.document_id, p.id AS partition_id, p.sequence_index, o.frozen AS frozen_version,
  last_value(o.frozen IGNORE NULLS) OVER (PARTITION BY p.document_id ORDER BY p.sequence_index, p.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used_version
FROM cache_partitions p LEFT JOIN o ON o.id = p.id
""")
def capsule_asof(spark, sf_dir):
    return S.carry_forward(table(spark, sf_dir, "cache_partitions"), table(spark, sf_dir, "style_capsules"))


@P.add("SELECT id AS partition_id, document_id, status FROM cache_partitions p WHERE NOT EXISTS (SELECT 1 FROM style_capsules c WHERE c.source_partition_id = p.id)")
def capsule_missing(spark, sf_dir):
    c = table(spark, sf_dir, "style_capsules").select(F.col("source_partition_id").alias("c_id"))
    p = table(spark, sf_dir, "cache_partitions")
    return p.join(c, F.col("id") == F.col("c_id"), "left_anti").select(F.col("id").alias("partition_id"), "document_id", "status")


@P.add("""
SELECT id AS document_id, (t.s - 1) // 8 + 1 AS batch_index, t.s AS page_start, least(t.s + 7, page_count) AS page_end
FROM (SELECT id, page_count, unnest(range(1, page_count + 1, 8)) AS s FROM document_files WHERE page_count > 0) t
""")
def page_tiles(spark, sf_dir):
    return S.page_tiles(table(spark, sf_dir, "document_files"))


@P.add("""
WITH need AS (SELECT id AS document_id, unnest(range(1, page_count + 1)) AS page FROM document_files WHERE page_count > 0),
have AS (SELECT DISTINCT document_id, unnest(range(page_start, page_end + 1)) AS page FROM ocr_batches WHERE status LIKE 'done%' OR status = 'skipped_done')
SELECT document_id, page FROM need ANTI JOIN have USING (document_id, page)
""")
def page_coverage(spark, sf_dir):
    return S.uncovered_pages(table(spark, sf_dir, "document_files"), table(spark, sf_dir, "ocr_batches"))


@P.add("""
SELECT f.id AS document_id, coalesce(max((b.page_start - 1) // 8 + 1) + 1, 1) AS next_index, count(DISTINCT b.config_hash) AS settings
FROM document_files f LEFT JOIN ocr_batches b ON b.document_id = f.id AND b.status LIKE 'done%' GROUP BY ALL
""")
def next_batch(spark, sf_dir):
    """Of each file the number of the OCR batch to run next and of the settings that its finished ones had."""
    b = table(spark, sf_dir, "ocr_batches").filter("status LIKE 'done%'")
    f = table(spark, sf_dir, "document_files").select("id").join(b.drop("id"), F.col("id") == F.col("document_id"), "left")
    index = F.floor((F.col("page_start") - 1) / 8) + 1
    return f.groupBy(F.col("id").alias("document_id")).agg(F.coalesce(F.max(index) + 1, F.lit(1)).cast("bigint").alias("next_index"), F.count_distinct("config_hash").alias("settings"))


@P.add("""
WITH t AS (SELECT document_id, version, id, unnest(json_keys(terminology_json)) AS term, terminology_json AS j FROM style_capsules WHERE terminology_json IS NOT NULL)
SELECT document_id, term, arg_min(j::JSON ->> ('$."' || term || '"'), struct_pack(v := version, i := id)) AS translation, count(*) AS capsules FROM t GROUP BY ALL
""")
def capsule_terms(spark, sf_dir):
    """Terms of a file over its capsules; the first translation of a term wins."""
    c = table(spark, sf_dir, "style_capsules").select("document_id", "version", "id", F.explode(F.from_json("terminology_json", "map<string,string>")).alias("term", "zh"))
    return c.groupBy("document_id", "term").agg(F.min_by("zh", F.struct("version", "id")).alias("translation"), F.count(F.lit(1)).alias("capsules"))


@P.add("""
WITH u AS (SELECT DISTINCT id, partition_id, sequence_index, source_text, translation_text FROM translation_units WHERE partition_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY partition_id ORDER BY sequence_index DESC, id DESC) AS n FROM u)
SELECT partition_id, right(string_agg(rtrim(coalesce(source_text, ''), chr(10)), chr(10) || chr(10) ORDER BY sequence_index, id), 2000) AS source_tail,
  right(string_agg(rtrim(coalesce(translation_text, ''), chr(10)), chr(10) || chr(10) ORDER BY sequence_index, id), 2000) AS translation_tail FROM r WHERE n <= 2 GROUP BY ALL
""")
def boundary_tail(spark, sf_dir):
    """The last 2000 characters of each partition's last two units, on both sides."""
    u = S.once(table(spark, sf_dir, "translation_units"), "id", "partition_id", "sequence_index", "source_text", "translation_text").filter("partition_id IS NOT NULL")
    two = S.top_k(u, ["partition_id"], [F.desc("sequence_index"), F.desc("id")], 2)
    text = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\n+\z", "").alias(c)
    g = two.select("partition_id", F.struct("sequence_index", "id", text("source_text"), text("translation_text")).alias("s")).groupBy("partition_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    tail = lambda c: F.right(F.array_join(F.col(f"s.{c}"), "\n\n"), F.lit(2000))
    return g.select("partition_id", tail("source_text").alias("source_tail"), tail("translation_text").alias("translation_tail"))


SEED = r"(?i)<table|(^|\n)\||(^|\n)#+\s*(references|bibliography)"


@P.add(f"""
WITH u AS (SELECT DISTINCT id, document_id, sequence_index, source_tokens, source_text FROM translation_units),
r AS (SELECT *, coalesce(source_tokens, floor(length(source_text) * 0.3::DOUBLE + 0.999::DOUBLE)::BIGINT) AS tokens,
  CASE WHEN trim(coalesce(source_text, '')) <> '' AND NOT regexp_matches(source_text, '{SEED}')
    AND coalesce(source_tokens, floor(length(source_text) * 0.3::DOUBLE + 0.999::DOUBLE)::BIGINT) BETWEEN 200 AND 12000 THEN 0 ELSE 1 END AS unfit FROM u)
SELECT document_id, id AS unit_id, tokens, unfit::BIGINT AS unfit FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY unfit, CASE WHEN unfit = 0 THEN abs(tokens - 4000) END NULLS FIRST, sequence_index NULLS LAST, id) AS n FROM r) WHERE n = 1
""")
def seed_unit(spark, sf_dir):
    """Of each file the prose unit whose length is nearest to 4000 tokens, else its first unit (unfit = 1)."""
    u = S.once(table(spark, sf_dir, "translation_units"), "id", "document_id", "sequence_index", "source_tokens", "source_text")
    tokens = F.coalesce("source_tokens", F.floor(F.length("source_text") * F.lit(0.3) + F.lit(0.999)))
    fit = (F.trim(F.coalesce("source_text", F.lit(""))) != "") & ~F.col("source_text").rlike(SEED) & tokens.between(200, 12000)
    r = u.select("id", "document_id", "sequence_index", tokens.alias("tokens"), F.when(fit, 0).otherwise(1).cast("bigint").alias("unfit"))
    near = F.when(F.col("unfit") == 0, F.abs(F.col("tokens") - 4000))
    best = S.latest(r, ["document_id"], [F.asc("unfit"), near.asc_nulls_first(), F.asc_nulls_last("sequence_index"), F.asc("id")])
    return best.select("document_id", F.col("id").alias("unit_id"), "tokens", "unfit")


@P.add("""
WITH u AS (SELECT DISTINCT id, partition_id, sequence_index, source_text, translation_text FROM translation_units WHERE partition_id IS NOT NULL AND trim(coalesce(source_text, '')) <> ''
  AND trim(coalesce(translation_text, '')) <> '' AND NOT starts_with(trim(translation_text), '>') AND NOT regexp_matches(source_text, '(?i)<table|(^|\\n)\\|'))
SELECT partition_id, id AS unit_id, n AS example_no, substr(trim(source_text), 1, 1200) AS source, substr(trim(translation_text), 1, 1200) AS translation
FROM (SELECT *, row_number() OVER (PARTITION BY partition_id ORDER BY sequence_index, id) AS n FROM u) WHERE n <= 4
""")
def style_examples(spark, sf_dir):
    """The first four units of each partition that can serve as examples, each side cut at 1200 characters."""
    u = S.once(table(spark, sf_dir, "translation_units"), "id", "partition_id", "sequence_index", "source_text", "translation_text")
    fit = u.filter("partition_id IS NOT NULL").filter(
        (F.trim("source_text") != "") & (F.trim("translation_text") != "") & ~F.trim("translation_text").startswith(">") & ~F.col("source_text").rlike(r"(?i)<table|(^|\n)\|")
    )
    four = S.top_k(fit, ["partition_id"], [F.asc("sequence_index"), F.asc("id")], 4)
    n = F.row_number().over(Window.partitionBy("partition_id").orderBy("sequence_index", "id"))
    cut = lambda c: F.substring(F.trim(c), 1, 1200)
    return four.select("partition_id", F.col("id").alias("unit_id"), n.cast("bigint").alias("example_no"), cut("source_text").alias("source"), cut("translation_text").alias("translation"))


@P.add("""
WITH e AS (SELECT partition_id AS id, count(*) AS unit_count FROM (SELECT DISTINCT id, partition_id FROM translation_units WHERE partition_id IS NOT NULL) GROUP BY ALL),
a AS (SELECT id, unit_count FROM cache_partitions)
SELECT coalesce(e.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'extra' ELSE 'changed' END AS state FROM e FULL JOIN a ON a.id = e.id
WHERE a.id IS NULL OR e.id IS NULL OR a.unit_count IS DISTINCT FROM e.unit_count
""")
def partition_drift(spark, sf_dir):
    """Partitions whose stored number of units isn't that of the units."""
    u = S.once(table(spark, sf_dir, "translation_units"), "id", "partition_id").filter("partition_id IS NOT NULL")
    expected = u.groupBy(F.col("partition_id").alias("id")).agg(F.count(F.lit(1)).alias("unit_count"))
    return S.drift(expected, table(spark, sf_dir, "cache_partitions").select("id", "unit_count"), ["id"])


@P.add("""
WITH h AS (SELECT sha256(concat_ws(chr(1), id::VARCHAR, source_sha256)) AS h FROM document_files),
r AS (SELECT substr(h, 1, 3) AS r, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n FROM h GROUP BY ALL)
SELECT sum(n)::BIGINT AS entries, sha256(string_agg(d, '' ORDER BY d)) AS digest FROM r
""")
def set_digest(spark, sf_dir):
    return S.digest(table(spark, sf_dir, "document_files"), F.col("id"), F.col("source_sha256"))


@P.add("""
WITH n AS (SELECT document_id, max(version) + 1 AS version, 'replanned' AS content_hash FROM style_capsules c WHERE EXISTS (SELECT 1 FROM document_files f WHERE f.id = c.document_id AND f.status = 'failed') GROUP BY ALL)
SELECT document_id, version, content_hash FROM style_capsules WHERE document_id NOT IN (SELECT document_id FROM n) UNION ALL SELECT * FROM n
""")
def replace_failed(spark, sf_dir):
    """Capsules in which those of a failed file are replaced by one new version."""
    c = table(spark, sf_dir, "style_capsules").select("document_id", "version", "content_hash")
    f = table(spark, sf_dir, "document_files").filter("status = 'failed'").select(F.col("id").alias("document_id"))
    new = c.join(f, "document_id", "left_semi").groupBy("document_id").agg((F.max("version") + 1).alias("version"), F.lit("replanned").alias("content_hash"))
    return S.replace_groups(c, new, "document_id")


@P.add("""
WITH c AS (SELECT document_id, max(version) AS version FROM style_capsules GROUP BY ALL), n AS (SELECT document_id, version AS expected FROM style_capsules)
SELECT n.document_id, n.expected, (n.expected = c.version) AS accepted FROM n JOIN c USING (document_id)
""")
def compare_and_swap(spark, sf_dir):
    """Changes that each name a version of their file's capsule: only one that names the current one goes in."""
    c = table(spark, sf_dir, "style_capsules")
    current = c.groupBy("document_id").agg(F.max("version").alias("version"))
    changes = c.select("document_id", F.col("version").alias("expected"))
    snapshot, rejected = S.swap(current, changes, "document_id", "version")
    changed = snapshot.join(current.withColumnRenamed("version", "was"), "document_id").filter("version > was")
    return rejected.select("document_id", "expected", F.lit(False).alias("accepted")).unionByName(changed.select("document_id", F.col("was").alias("expected"), F.lit(True).alias("accepted")))


@P.add("""
WITH u AS (SELECT DISTINCT id, document_id, sequence_index, source_text, translation_text FROM translation_units),
t AS (SELECT id, document_id, sequence_index, CASE WHEN coalesce(translation_text, '') <> '' THEN translation_text ELSE coalesce(source_text, '') END AS text, coalesce(translation_text, '') = '' AS fell_back FROM u)
SELECT document_id, sequence_index, id AS unit_id, fell_back, coalesce(sum(length(text) + 2) OVER (PARTITION BY document_id ORDER BY sequence_index, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS text_offset, text FROM t
""")
def assembled_text(spark, sf_dir):
    """The target document as ordered pieces with their places, two characters parting them; a unit without a translation has its source."""
    u = S.once(table(spark, sf_dir, "translation_units"), "id", "document_id", "sequence_index", "source_text", "translation_text")
    empty = F.coalesce("translation_text", F.lit("")) == ""
    t = u.select("id", "document_id", "sequence_index", F.when(~empty, F.col("translation_text")).otherwise(F.coalesce("source_text", F.lit(""))).alias("text"), empty.alias("fell_back"))
    out = running_total_blocks(t, ["document_id"], F.floor(F.coalesce("sequence_index", F.lit(0)) / 4096), ["sequence_index", "id"], (F.length("text") + 2).cast("bigint"), "text_offset")
    return out.select("document_id", "sequence_index", F.col("id").alias("unit_id"), "fell_back", "text_offset", "text")


@P.add("""
WITH u AS (SELECT DISTINCT id, partition_id, sequence_index, unit_key FROM translation_units)
SELECT p.id AS partition_id, p.document_id, string_agg(u.unit_key, ',' ORDER BY u.sequence_index, u.id) AS unit_keys, count(u.id) AS units FROM cache_partitions p LEFT JOIN u ON u.partition_id = p.id GROUP BY ALL
""")
def partition_units(spark, sf_dir):
    """Partitions with the keys of their units in order; a partition is bounded by its token budget."""
    u = S.once(table(spark, sf_dir, "translation_units"), "id", "partition_id", "sequence_index", "unit_key").filter("partition_id IS NOT NULL")
    g = u.groupBy(F.col("partition_id").alias("g_id")).agg(F.sort_array(F.collect_list(F.struct("sequence_index", "id", "unit_key"))).alias("s"))
    p = table(spark, sf_dir, "cache_partitions").select(F.col("id").alias("partition_id"), "document_id")
    return p.join(g, F.col("partition_id") == F.col("g_id"), "left").select("partition_id", "document_id", F.array_join(F.col("s.unit_key"), ",").alias("unit_keys"), F.coalesce(F.size("s"), F.lit(0)).cast("bigint").alias("units"))


@P.add("""
WITH u AS (SELECT DISTINCT * FROM translation_units), n AS (SELECT DISTINCT * FROM structural_nodes)
SELECT 'document_files.source_sha256' AS rule, count(*)::BIGINT AS broken FROM (SELECT source_sha256 FROM document_files WHERE source_sha256 IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'translation_units.unit_key', count(*) FROM (SELECT document_id, unit_key FROM u GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'structural_nodes.sequence_index', count(*) FROM (SELECT document_id, sequence_index FROM n GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'translation_units.partition_id', count(*) FROM u WHERE partition_id IS NOT NULL AND partition_id NOT IN (SELECT id FROM cache_partitions)
UNION ALL SELECT 'translation_attempts.unit_id', count(*) FROM (SELECT DISTINCT * FROM translation_attempts) a WHERE unit_id NOT IN (SELECT id FROM u)
UNION ALL SELECT 'structural_nodes.document_id', count(*) FROM n WHERE document_id NOT IN (SELECT id FROM document_files)
""")
def constraint_checks(spark, sf_dir):
    """Keys that aren't unique and references that lead nowhere, counted for each rule."""
    t = lambda n: table(spark, sf_dir, n)
    u = S.once(t("translation_units"), "id", "document_id", "unit_key", "partition_id")
    n = S.once(t("structural_nodes"), "id", "document_id", "sequence_index")
    many = lambda df, rule, *keys: df.groupBy(*keys).count().filter("count > 1").agg(F.count(F.lit(1)).alias("broken")).select(F.lit(rule).alias("rule"), "broken")

    def lost(df, rule, key, target):
        ids = target.select(F.col("id").alias("t_id"))
        return df.filter(F.col(key).isNotNull()).join(ids, F.col(key) == F.col("t_id"), "left_anti").agg(F.count(F.lit(1)).alias("broken")).select(F.lit(rule).alias("rule"), "broken")

    parts = [
        many(t("document_files").filter("source_sha256 IS NOT NULL"), "document_files.source_sha256", "source_sha256"),
        many(u, "translation_units.unit_key", "document_id", "unit_key"),
        many(n, "structural_nodes.sequence_index", "document_id", "sequence_index"),
        lost(u, "translation_units.partition_id", "partition_id", t("cache_partitions")),
        lost(S.once(t("translation_attempts"), "id", "unit_id"), "translation_attempts.unit_id", "unit_id", u),
        lost(n, "structural_nodes.document_id", "document_id", t("document_files")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@P.add("""
WITH w AS (SELECT DISTINCT source_sha256 AS sha, source_path AS path FROM document_files)
SELECT w.path, f.id AS document_id, CASE WHEN w.sha IS NOT NULL AND f.source_sha256 = w.sha THEN 'sha' ELSE 'path' END AS found_by FROM w JOIN document_files f ON (w.sha IS NOT NULL AND f.source_sha256 = w.sha) OR (w.sha IS NULL AND f.source_path = w.path)
""")
def file_lookup(spark, sf_dir):
    """Files by their hash, and by their path where none is known."""
    f = table(spark, sf_dir, "document_files").select("id", "source_sha256", "source_path")
    w = f.select(F.col("source_sha256").alias("sha"), F.col("source_path").alias("path")).distinct()
    by_sha = w.join(f, F.col("sha") == F.col("source_sha256")).select("path", F.col("id").alias("document_id"), F.lit("sha").alias("found_by"))
    by_path = w.filter("sha IS NULL").join(f, F.col("path") == F.col("source_path")).select("path", F.col("id").alias("document_id"), F.lit("path").alias("found_by"))
    return by_sha.unionByName(by_path)
