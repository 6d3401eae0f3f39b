"""Checks of translations over all units."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import qa
from quire.operators.state import latest, once
from quire.plans import Plans
from quire.session import table

P = Plans()
QUERIES, SQL = P.queries, P.sql

UNITS = "(SELECT DISTINCT id, document_id, status, source_text, translation_text, warning_flags FROM translation_units)"


def units(spark, sf_dir):
    return once(table(spark, sf_dir, "translation_units"), "id", "document_id", "status", "source_text", "translation_text", "warning_flags")


@P.add(f"""
SELECT id AS unit_id, length(translation_text)::DOUBLE / greatest(length(source_text), 1)::DOUBLE AS ratio FROM {UNITS} WHERE trim(source_text) <> '' AND trim(translation_text) <> ''
  AND NOT (length(translation_text)::DOUBLE / greatest(length(source_text), 1)::DOUBLE BETWEEN 0.3 AND 3.0)
""")
def qa_length_ratio(spark, sf_dir):
    u = units(spark, sf_dir).filter((F.trim("source_text") != "") & (F.trim("translation_text") != ""))
    return u.select(F.col("id").alias("unit_id"), qa.length_ratio(F.col("source_text"), F.col("translation_text")).alias("ratio")).filter("ratio < 0.3 OR ratio > 3.0")


@P.add(rf"""
WITH u AS (SELECT id, translation_text AS t, regexp_extract_all(source_text, '\[(\d+(?:\s*[-–,]\s*\d+)*)\]', 1) AS c, regexp_extract_all(source_text, 'https?://[^\s<>\])]+') AS w FROM {UNITS} WHERE status = 'done' AND coalesce(translation_text, '') <> ''),
m AS (SELECT id, list_filter(c, lambda x: NOT contains(t, '[' || x || ']')) AS c, list_filter(w, lambda x: NOT contains(t, x)) AS w FROM u)
SELECT id AS unit_id, array_to_string(c, ', ') AS citations, array_to_string(w, ', ') AS urls FROM m WHERE len(c) + len(w) > 0
""")
def qa_references(spark, sf_dir):
    """Citations and addresses of the source that the translation lacks."""
    u = units(spark, sf_dir).filter("status = 'done' AND coalesce(translation_text, '') <> ''")
    s, t = F.col("source_text"), F.col("translation_text")
    m = u.select(F.col("id").alias("unit_id"), qa.missing(s, t, "citation").alias("c"), qa.missing(s, t, "url").alias("w")).filter("size(c) + size(w) > 0")
    return m.select("unit_id", F.array_join("c", ", ").alias("citations"), F.array_join("w", ", ").alias("urls"))


@P.add()
def qa_findings(spark, sf_dir):
    """(unit_id, qa_status, code, severity, detail): one row per finding, terms checked by each file's latest capsule."""
    u = units(spark, sf_dir)
    c = latest(table(spark, sf_dir, "style_capsules").select("document_id", "version", "id", "terminology_json"), ["document_id"], [F.desc("version"), F.desc("id")])
    terms = c.select(F.col("document_id").alias("c_doc"), F.from_json("terminology_json", "map<string,string>").alias("terminology"))
    checked = qa.findings(u.join(terms, F.col("document_id") == F.col("c_doc"), "left").drop("c_doc"))
    return checked.select(F.col("id").alias("unit_id"), "qa_status", F.explode_outer("findings").alias("f")).select("unit_id", "qa_status", "f.code", "f.severity", "f.detail")


@P.add()
def qa_summary(spark, sf_dir):
    return qa.summary(qa.findings(units(spark, sf_dir)))


@P.add("""
WITH c AS (SELECT document_id, terminology_json FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY version DESC, id DESC) AS n FROM style_capsules) WHERE n = 1 AND terminology_json IS NOT NULL),
t AS (SELECT document_id, terminology_json AS j, unnest(json_keys(terminology_json)) AS en FROM c)
SELECT u.id AS unit_id, t.en AS term FROM (SELECT DISTINCT id, document_id, source_text, translation_text FROM translation_units) u JOIN t USING (document_id)
WHERE contains(u.source_text, t.en) AND (t.j::JSON ->> ('$."' || t.en || '"')) <> '' AND NOT contains(u.translation_text, t.j::JSON ->> ('$."' || t.en || '"')) AND contains(u.translation_text, t.en)
""")
def qa_terminology(spark, sf_dir):
    """Terms left in their own language although the file's latest capsule translates them."""
    c = latest(table(spark, sf_dir, "style_capsules").select("document_id", "version", "id", "terminology_json"), ["document_id"], [F.desc("version"), F.desc("id")])
    t = c.select(F.col("document_id").alias("c_doc"), F.explode(F.from_json("terminology_json", "map<string,string>")).alias("term", "zh")).filter("zh <> ''")
    u = once(table(spark, sf_dir, "translation_units"), "id", "document_id", "source_text", "translation_text")
    j = u.join(t, F.col("document_id") == F.col("c_doc"))
    kept = j.filter(F.contains("source_text", "term") & ~F.contains("translation_text", "zh") & F.contains("translation_text", "term"))
    return kept.select(F.col("id").alias("unit_id"), "term")
