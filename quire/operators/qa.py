"""Mechanical checks of translations, as columns: one pass over the units, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import markdown as M
from quire.session import ship


def missing(source: Column, translation: Column, what: str) -> Column:
    """Values of a kind in the source that don't stand in the translation, as often as the source has them."""
    form = (lambda x: F.concat(F.lit("["), x, F.lit("]"))) if what == "citation" else (lambda x: x)
    return F.filter(M.extract(source, what), lambda x: F.instr(translation, form(x)) == 0)


def missing_numbers(source: Column, translation: Column) -> Column:
    """Different numbers of the source that the translation doesn't have as numbers; single digits are let pass."""
    lost = F.array_except(M.extract(source, "number"), M.extract(translation, "number"))
    return F.array_sort(F.filter(lost, lambda n: (F.length(n) >= 2) | F.contains(n, F.lit("."))))


def length_ratio(source: Column, translation: Column) -> Column:
    return F.length(translation) / F.greatest(F.length(source), F.lit(1))


def findings(units: DataFrame) -> DataFrame:
    """The columns of ``units`` and findings ARRAY<STRUCT<code, severity, detail>>, qa_status.

    Nulls count as empty texts.  A unit that fell back has the one finding 'fallback'.  Terms are
    checked where the units have a column terminology MAP<STRING, STRING>.
    """
    ship(units.sparkSession)
    protected = M.text_udf(lambda t: list(M.protect(t)[1].values()), "array<string>")
    shapes = M.text_udf(M.table_shapes, "array<string>")
    u = units.withColumn("__s", F.coalesce("source_text", F.lit(""))).withColumn("__t", F.coalesce("translation_text", F.lit("")))
    u = u.withColumn("__p", protected("__s")).withColumn("__a", shapes("__s")).withColumn("__b", shapes("__t"))
    s, t = F.col("__s"), F.col("__t")

    def one(code: str, severity: str, condition: Column, detail: Column | None = None) -> Column:
        d = F.lit(None).cast("string") if detail is None else detail
        return F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), d.alias("detail")))

    lost = F.filter("__p", lambda x: F.instr(t, x) == 0)
    out = [F.transform(lost, lambda x: F.struct(F.lit("structure_preserve").alias("code"), F.lit("high").alias("severity"), F.substring(x, 1, 120).alias("detail")))]
    a, b = M.html_tables(s), M.html_tables(t)
    single = [
        one("html_table_count", "high", F.size(a) != F.size(b)),
        one("html_table_mutated", "high", (F.size(a) == F.size(b)) & (a != b)),
        one("md_table_shape", "high", (F.size("__a") > 0) & (F.col("__a") != F.col("__b")), F.array_join("__a", ",")),
    ]
    single += [one(f"structure_{k}", "high", (M.count(s, k) > 0) & (M.count(t, k) < M.count(s, k))) for k in M.COUNTED]
    numbers = missing_numbers(s, t)
    single.append(one("number_mismatch", "medium", F.size(numbers) > 0, F.array_join(F.slice(numbers, 1, 12), ", ")))
    for kind, code, top in (("year", "year_mismatch", 8), *((k, f"{k}_mismatch", 10) for k in ("citation", "figure", "table_ref", "equation", "url", "doi"))):
        gone = missing(s, t, kind)
        single.append(one(code, "medium", F.size(gone) > 0, F.array_join(F.slice(gone, 1, top), ", ")))
    ratio = length_ratio(s, t)
    single.append(one("length_ratio", "medium", (F.trim(s) != "") & (F.trim(t) != "") & ((ratio < 0.3) | (ratio > 3.0)), F.format_string("ratio=%.2f", ratio)))
    out.append(F.array_compact(F.array(*single)))
    if "terminology" in units.columns:
        broken = F.filter(F.map_entries("terminology"), lambda e: F.contains(s, e["key"]) & (e["value"] != "") & ~F.contains(t, e["value"]) & F.contains(t, e["key"]))
        out.append(F.coalesce(F.transform(broken, lambda e: F.struct(F.lit("terminology").alias("code"), F.lit("low").alias("severity"), e["key"].alias("detail"))), F.array()))
    fell = (F.col("status") == "fallback") | F.coalesce(F.contains("warning_flags", F.lit("fallback")), F.lit(False))
    fallback = F.array(F.struct(F.lit("fallback").alias("code"), F.lit("high").alias("severity"), F.lit(None).cast("string").alias("detail")))
    u = u.withColumn("findings", F.when(F.coalesce(fell, F.lit(False)), fallback).otherwise(F.concat(*out)))
    status = (
        F.when(F.coalesce(fell, F.lit(False)), "fallback").when(F.exists("findings", lambda x: x["severity"] == "high"), "fail").when(F.size("findings") > 0, "warn").otherwise("pass")
    )
    return u.withColumn("qa_status", status).select(*units.columns, "findings", "qa_status")


def summary(checked: DataFrame) -> DataFrame:
    """(document_id, units, passed, warned, failed, fell_back, verdict) of each document."""
    n = lambda s: F.count_if(F.col("qa_status") == s)
    return checked.groupBy("document_id").agg(F.count(F.lit(1)).alias("units"), n("pass").alias("passed"), n("warn").alias("warned"), n("fail").alias("failed"), n("fallback").alias("fell_back")).withColumn(
        "verdict", F.when(F.col("failed") > 0, "failed").when(F.col("warned") + F.col("fell_back") > 0, "warnings").otherwise("pass")
    )


def repair(units: DataFrame, chat: Callable[[str, str, str], str]) -> DataFrame:
    """The columns of ``units`` with findings and qa_status, each failed unit repaired once by
    chat(source_text, translation_text, codes) where that leaves no finding of high severity; repaired tells where.

    A repair that raises, or gives no text, leaves the unit as it was.  ``units`` has a unique id."""
    checked = findings(units)
    failed = checked.filter("qa_status = 'fail'").select("id", F.coalesce("source_text", F.lit("")).alias("source_text"), F.coalesce("translation_text", F.lit("")).alias("old"), F.array_join(F.transform("findings", lambda x: x["code"]), ",").alias("codes"), "status", *[c for c in ("warning_flags", "terminology") if c in units.columns])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for s, t, c in zip(b["source_text"], b["old"], b["codes"]):
                try:
                    out.append(chat(s, t, c) or None)
                except Exception:  # noqa: BLE001 - a repair that fails leaves the unit as it was
                    out.append(None)
            yield pd.DataFrame({"id": b["id"], "translation_text": out})

    new = failed.select("id", "source_text", "old", "codes").mapInPandas(run, "id BIGINT, translation_text STRING").filter("translation_text IS NOT NULL")
    again = findings(failed.drop("old", "codes").join(new, "id")).filter(~F.exists("findings", lambda x: x["severity"] == "high"))
    again = again.select(F.col("id").alias("r_id"), F.col("translation_text").alias("r_text"), F.col("findings").alias("r_findings"), F.col("qa_status").alias("r_status"))
    j = checked.join(again, F.col("id") == F.col("r_id"), "left")
    taken = F.col("r_id").isNotNull()
    pick = lambda old, new: F.when(taken, F.col(new)).otherwise(F.col(old)).alias(old)
    kept = [pick("translation_text", "r_text") if c == "translation_text" else F.col(c) for c in units.columns]
    return j.select(*kept, pick("findings", "r_findings"), pick("qa_status", "r_status"), taken.alias("repaired"))
