"""Usage, attempts, calibration and progress."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators.folds import limit_rule, ranged_fold
from quire.operators.state import once, top_k
from quire.plans import Plans
from quire.session import table

P = Plans()
QUERIES, SQL = P.queries, P.sql

NORMALIZED = """
SELECT id, unit_id, started_at, http_status, coalesce(cache_hit_tokens, 0) AS hit, coalesce(cache_miss_tokens, 0) AS miss,
  CASE WHEN coalesce(prompt_tokens, 0) <> 0 THEN prompt_tokens ELSE coalesce(cache_hit_tokens, 0) + coalesce(cache_miss_tokens, 0) END AS prompt,
  coalesce(completion_tokens, 0) AS completion
FROM (SELECT DISTINCT * FROM translation_attempts)
"""


def normalized(spark, sf_dir):
    """Attempts, each once, with counts where null counts as 0 and a prompt of 0 is hit + miss."""
    a = once(table(spark, sf_dir, "translation_attempts"), "id", "unit_id", "started_at", "http_status", "prompt_tokens", "cache_hit_tokens", "cache_miss_tokens", "completion_tokens")
    hit, miss = F.coalesce("cache_hit_tokens", F.lit(0)), F.coalesce("cache_miss_tokens", F.lit(0))
    return a.select(
        "id", "unit_id", "started_at", "http_status", hit.alias("hit"), miss.alias("miss"),
        F.coalesce(F.nullif("prompt_tokens", F.lit(0)), hit + miss).alias("prompt"), F.coalesce("completion_tokens", F.lit(0)).alias("completion"),
    )


def unit_documents(spark, sf_dir):
    return once(table(spark, sf_dir, "translation_units"), "id", "document_id").select(F.col("id").alias("u_id"), "document_id")


@P.add(f"""
SELECT u.document_id, f.display_name, count(*) AS requests, sum(prompt)::BIGINT AS prompt_tokens, sum(hit)::BIGINT AS hit_tokens,
  sum(miss)::BIGINT AS miss_tokens, sum(completion)::BIGINT AS completion_tokens,
  CASE WHEN sum(prompt) > 0 THEN sum(hit)::DOUBLE / sum(prompt)::DOUBLE END AS hit_ratio
FROM ({NORMALIZED}) a JOIN (SELECT DISTINCT id, document_id FROM translation_units) u ON a.unit_id = u.id
LEFT JOIN document_files f ON f.id = u.document_id GROUP BY ALL
""")
def usage_rollup(spark, sf_dir):
    a = normalized(spark, sf_dir).join(unit_documents(spark, sf_dir), F.col("unit_id") == F.col("u_id"))
    g = a.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("prompt").alias("prompt_tokens"), F.sum("hit").alias("hit_tokens"), F.sum("miss").alias("miss_tokens"), F.sum("completion").alias("completion_tokens")
    )
    f = table(spark, sf_dir, "document_files").select(F.col("id").alias("f_id"), "display_name")
    ratio = F.when(F.col("prompt_tokens") > 0, F.col("hit_tokens").cast("double") / F.col("prompt_tokens").cast("double"))
    return g.join(f, F.col("document_id") == F.col("f_id"), "left").drop("f_id").withColumn("hit_ratio", ratio)


@P.add(NORMALIZED.replace("started_at, http_status, ", ""))
def usage_normalized(spark, sf_dir):
    return normalized(spark, sf_dir).drop("started_at", "http_status")


@P.add("""
SELECT http_status, finish_reason, error_type, count(*) AS attempts, min(latency_ms) AS least_ms, max(latency_ms) AS most_ms,
  quantile_disc(latency_ms, 0.9) AS p90_ms FROM (SELECT DISTINCT * FROM translation_attempts) GROUP BY ALL
""")
def attempt_outcomes(spark, sf_dir):
    a = once(table(spark, sf_dir, "translation_attempts"), "id", "http_status", "finish_reason", "error_type", "latency_ms")
    return a.groupBy("http_status", "finish_reason", "error_type").agg(
        F.count(F.lit(1)).alias("attempts"), F.min("latency_ms").alias("least_ms"), F.max("latency_ms").alias("most_ms"),
        F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY latency_ms)").cast("bigint").alias("p90_ms"),
    )


@P.add("SELECT document_id, status, count(*) AS units FROM (SELECT DISTINCT id, document_id, status FROM translation_units) GROUP BY ALL")
def status_histogram(spark, sf_dir):
    return once(table(spark, sf_dir, "translation_units"), "id", "document_id", "status").groupBy("document_id", "status").agg(F.count(F.lit(1)).alias("units"))


@P.add("""
WITH b AS (SELECT document_id, count(*) AS batches, count_if(status LIKE 'done%' OR status = 'skipped_done') AS batches_ok FROM (SELECT DISTINCT * FROM ocr_batches) GROUP BY ALL),
u AS (SELECT document_id, count(*) AS units, count_if(status = 'done') AS done, count_if(status = 'pending') AS pending, count_if(status = 'fallback') AS fell_back
  FROM (SELECT DISTINCT id, document_id, status FROM translation_units) GROUP BY ALL)
SELECT f.id AS document_id, f.page_count, coalesce(batches, 0) AS batches, coalesce(batches_ok, 0)::BIGINT AS batches_ok, coalesce(units, 0) AS units,
  coalesce(done, 0)::BIGINT AS done, coalesce(pending, 0)::BIGINT AS pending, coalesce(fell_back, 0)::BIGINT AS fell_back
FROM document_files f LEFT JOIN b ON b.document_id = f.id LEFT JOIN u ON u.document_id = f.id
""")
def file_progress(spark, sf_dir):
    b = once(table(spark, sf_dir, "ocr_batches"), "id", "document_id", "status").groupBy(F.col("document_id").alias("b_id")).agg(
        F.count(F.lit(1)).alias("batches"), F.count_if(F.col("status").like("done%") | (F.col("status") == "skipped_done")).alias("batches_ok")
    )
    n = lambda s: F.count_if(F.col("status") == s)
    u = once(table(spark, sf_dir, "translation_units"), "id", "document_id", "status").groupBy(F.col("document_id").alias("u_id")).agg(
        F.count(F.lit(1)).alias("units"), n("done").alias("done"), n("pending").alias("pending"), n("fallback").alias("fell_back")
    )
    j = table(spark, sf_dir, "document_files").join(b, F.col("id") == F.col("b_id"), "left").join(u, F.col("id") == F.col("u_id"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select(F.col("id").alias("document_id"), "page_count", *[zero(c) for c in ("batches", "batches_ok", "units", "done", "pending", "fell_back")])


@P.add("""
SELECT strftime(updated_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS files, count_if(status LIKE 'ocr_complete%' OR contains(status, 'translation_complete') OR status = 'qa_complete')::BIGINT AS completed,
  count_if(status = 'failed')::BIGINT AS failed, count_if(contains(status, 'with_warnings'))::BIGINT AS with_warnings FROM document_files GROUP BY ALL
""")
def nightly_rollup(spark, sf_dir):
    s = F.col("status")
    return table(spark, sf_dir, "document_files").groupBy(F.date_format("updated_at", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(s.startswith("ocr_complete") | s.contains("translation_complete") | (s == "qa_complete")).alias("completed"),
        F.count_if(s == "failed").alias("failed"), F.count_if(s.contains("with_warnings")).alias("with_warnings"),
    )


@P.add("""
WITH u AS (SELECT DISTINCT id, document_id, partition_id, sequence_index, source_tokens, estimated_output_tokens FROM translation_units WHERE partition_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY partition_id ORDER BY sequence_index, id) AS n FROM u)
SELECT document_id, count(*) FILTER (n = 1) AS partitions, coalesce(sum(source_tokens) FILTER (n = 1), 0)::BIGINT AS first_tokens,
  coalesce(sum(source_tokens) FILTER (n > 1), 0)::BIGINT AS rest_tokens, coalesce(sum(estimated_output_tokens), 0)::BIGINT AS output_tokens FROM r GROUP BY ALL
""")
def plan_tokens(spark, sf_dir):
    """Tokens that a plan sends: those of each partition's first unit, which warms the cache, and of the rest."""
    u = once(table(spark, sf_dir, "translation_units"), "id", "document_id", "partition_id", "sequence_index", "source_tokens", "estimated_output_tokens").filter("partition_id IS NOT NULL")
    first = F.col("n") == 1
    r = u.withColumn("n", F.row_number().over(Window.partitionBy("partition_id").orderBy("sequence_index", "id")))
    total = lambda c, w: F.coalesce(F.sum(F.when(w, F.col(c))), F.lit(0))
    return r.groupBy("document_id").agg(
        F.count_if(first).alias("partitions"), total("source_tokens", first).alias("first_tokens"), total("source_tokens", ~first).alias("rest_tokens"), total("estimated_output_tokens", F.lit(True)).alias("output_tokens")
    )


@P.add("""
WITH a AS (SELECT DISTINCT id, unit_id, started_at, completion_tokens FROM translation_attempts WHERE completion_tokens > 0),
u AS (SELECT DISTINCT id, provider, model, source_tokens FROM translation_units WHERE source_tokens > 0),
r AS (SELECT concat_ws('|', u.model, u.provider) AS bucket, least(greatest(a.completion_tokens::DOUBLE / u.source_tokens::DOUBLE, 0.2), 8.0)::DOUBLE AS ratio,
  row_number() OVER (PARTITION BY concat_ws('|', u.model, u.provider) ORDER BY a.started_at DESC, a.id DESC) AS n FROM a JOIN u ON a.unit_id = u.id),
p AS (SELECT bucket, count(*) AS samples, quantile_disc(ratio, 0.9) AS q FROM r WHERE n <= 200 GROUP BY ALL)
SELECT bucket, samples, CASE WHEN samples >= 5 THEN q END AS p90,
  least(greatest(CASE WHEN samples >= 5 THEN floor(1000 * q * 1.2::DOUBLE) ELSE floor(1000 * 1.3::DOUBLE) + 512 END, 256), 32000)::BIGINT AS estimate_of_1000 FROM p
""")
def calibration_p90(spark, sf_dir):
    """Of each bucket of model and provider the 90th percentile of the last 200 output ratios, and what it makes of 1000 tokens."""
    a = once(table(spark, sf_dir, "translation_attempts"), "id", "unit_id", "started_at", "completion_tokens").filter("completion_tokens > 0")
    u = once(table(spark, sf_dir, "translation_units"), "id", "provider", "model", "source_tokens").filter("source_tokens > 0").withColumnRenamed("id", "u_id")
    r = a.join(u, F.col("unit_id") == F.col("u_id")).select(
        "id", "started_at", F.concat_ws("|", "model", "provider").alias("bucket"),
        F.least(F.greatest(F.col("completion_tokens").cast("double") / F.col("source_tokens").cast("double"), F.lit(0.2)), F.lit(8.0)).alias("ratio"),
    )
    last = top_k(r, ["bucket"], [F.desc("started_at"), F.desc("id")], 200)
    p = last.groupBy("bucket").agg(F.count(F.lit(1)).alias("samples"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY ratio)").alias("q"))
    enough = F.col("samples") >= 5
    estimate = F.when(enough, F.floor(1000 * F.col("q") * F.lit(1.2))).otherwise(F.floor(F.lit(1000 * 1.3)) + 512)
    return p.select("bucket", "samples", F.when(enough, F.col("q")).alias("p90"), F.least(F.greatest(estimate, F.lit(256)), F.lit(32000)).cast("bigint").alias("estimate_of_1000"))


@P.add("""
WITH r AS (SELECT id, unit_id, attempt_number, row_number() OVER (PARTITION BY unit_id ORDER BY attempt_number, started_at, id) AS expected FROM (SELECT DISTINCT id, unit_id, attempt_number, started_at FROM translation_attempts))
SELECT id AS attempt_id, unit_id, attempt_number, expected::BIGINT AS expected FROM r WHERE attempt_number IS DISTINCT FROM expected
""")
def attempt_numbering(spark, sf_dir):
    """Attempts whose number isn't the next of their unit."""
    a = once(table(spark, sf_dir, "translation_attempts"), "id", "unit_id", "attempt_number", "started_at")
    w = Window.partitionBy("unit_id").orderBy(F.asc_nulls_last("attempt_number"), F.asc_nulls_last("started_at"), "id")
    r = a.withColumn("expected", F.row_number().over(w).cast("bigint"))
    return r.filter(~F.col("attempt_number").eqNullSafe(F.col("expected"))).select(F.col("id").alias("attempt_id"), "unit_id", "attempt_number", "expected")


@P.add("""
WITH a AS (SELECT DISTINCT id, unit_id, finished_at FROM translation_attempts),
u AS (SELECT DISTINCT id, document_id, status FROM translation_units WHERE status IN ('done', 'fallback')),
m AS (SELECT unit_id, min(finished_at) AS first_at, count(*) AS now FROM a GROUP BY ALL),
b AS (SELECT a.unit_id, count(*) AS before FROM a JOIN m USING (unit_id) WHERE a.finished_at <= m.first_at GROUP BY ALL)
SELECT u.id AS unit_id, u.document_id, before, now FROM u JOIN m ON m.unit_id = u.id JOIN b ON b.unit_id = u.id WHERE now > before
""")
def snapshot_growth(spark, sf_dir):
    """Finished units that have more attempts now than in the snapshot after their first finished one."""
    a = once(table(spark, sf_dir, "translation_attempts"), "id", "unit_id", "finished_at")
    u = once(table(spark, sf_dir, "translation_units"), "id", "document_id", "status").filter(F.col("status").isin("done", "fallback"))
    m = a.groupBy("unit_id").agg(F.min("finished_at").alias("first_at"), F.count(F.lit(1)).alias("now"))
    b = a.join(m, "unit_id").filter("finished_at <= first_at").groupBy("unit_id", "now").agg(F.count(F.lit(1)).alias("before")).filter("now > before")
    return u.join(b, F.col("id") == F.col("unit_id")).select("unit_id", "document_id", "before", "now")


@P.add("""
WITH RECURSIVE a AS (SELECT u.document_id, a.id, a.http_status, row_number() OVER (PARTITION BY u.document_id ORDER BY a.started_at, a.id) AS n
  FROM (SELECT DISTINCT id, unit_id, started_at, http_status FROM translation_attempts WHERE started_at IS NOT NULL) a JOIN (SELECT DISTINCT id, document_id FROM translation_units) u ON a.unit_id = u.id),
f(document_id, n, id, lim, streak) AS (
  SELECT document_id, n, id, CASE http_status WHEN 429 THEN 8 WHEN 503 THEN 12 ELSE 16 END, CASE WHEN http_status = 200 THEN 1 ELSE 0 END FROM a WHERE n = 1
  UNION ALL
  SELECT a.document_id, a.n, a.id,
    CASE WHEN a.http_status = 200 AND streak + 1 >= 5 THEN least(64, lim + 2) WHEN a.http_status = 429 THEN greatest(1, lim // 2) WHEN a.http_status = 503 THEN greatest(1, lim * 3 // 4) ELSE lim END,
    CASE WHEN a.http_status = 200 THEN (CASE WHEN streak + 1 >= 5 THEN 0 ELSE streak + 1 END) WHEN a.http_status IN (429, 503) THEN 0 ELSE streak END
  FROM f JOIN a ON a.document_id = f.document_id AND a.n = f.n + 1)
SELECT document_id, id AS attempt_id, lim::BIGINT AS concurrency FROM f
""")
def adaptive_limit(spark, sf_dir):
    """What an adaptive limit (two more after 5 successes) makes of each file's log of attempts."""
    a = once(table(spark, sf_dir, "translation_attempts"), "id", "unit_id", "started_at", "http_status").filter("started_at IS NOT NULL")
    a = a.join(unit_documents(spark, sf_dir), F.col("unit_id") == F.col("u_id"))
    f = ranged_fold(a, "document_id", ["started_at", "id"], ["http_status"], limit_rule(every=5), "concurrency")
    return f.select("document_id", F.col("id").alias("attempt_id"), "concurrency")
