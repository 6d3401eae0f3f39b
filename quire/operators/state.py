"""Operators on the state tables of a document pipeline: merges, updates, versions, coverage, carry-forward.

Each takes and returns DataFrames; a table is replaced by the new one that the function returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.prefix import running_max_blocks


def once(df: DataFrame, *columns: str) -> DataFrame:
    """The rows of a table in which some are delivered a second time, each once; nulls are equal."""
    return (df.select(*columns) if columns else df).distinct()


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int | Column, parts: int = 64) -> DataFrame:
    """Of each group of ``keys`` the first k rows in ``order`` (k may be a column that is equal in a group).  The first k of each of `parts` shares of a
    group come before the group's own, so a hot group isn't sorted whole; null keys form a group."""
    rest = [c for c in df.columns if c not in keys and not _is_nested(df, c)]
    spread = df.withColumn("__part", F.pmod(F.xxhash64(*rest), F.lit(parts)))
    first = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))
    some = spread.withColumn("__n", first).filter(F.col("__n") <= k).drop("__n", "__part")
    return some.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= k).drop("__n")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each group of ``keys`` the first row in ``order``."""
    return top_k(df, keys, order, 1)


def _is_nested(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("map", "variant")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` merged by ``key``: a null in ``new`` keeps the old value, a key that
    only ``new`` has is added.  ``new`` has one row per key; a null key matches nothing and is added."""
    o, n = old.alias("o"), new.alias("n")
    cols = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}").alias(c) for c in old.columns]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*cols)


def sparse_update(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``old`` with the non-null values of ``changes`` (one row per key); keys that ``old`` lacks are ignored."""
    o, n = old.alias("o"), changes.alias("n")
    cols = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in changes.columns and c != key else F.col(f"o.{c}").alias(c) for c in old.columns]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "left").select(*cols)


def replace_groups(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the groups of ``key`` that ``new`` has, and all rows of ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def swap(current: DataFrame, changes: DataFrame, key: str, version: str) -> tuple[DataFrame, DataFrame]:
    """Compare-and-swap: (new snapshot, rejected changes).  A change names the version that it has seen in
    ``expected``; it goes in with version + 1 if that is still the current one, else it is rejected."""
    c, n = current.alias("c"), changes.alias("n")
    both = n.join(c.select(key, version).alias("v"), F.col(f"n.{key}") == F.col(f"v.{key}"), "left")
    fits = F.col("n.expected").eqNullSafe(F.col(f"v.{version}"))
    accepted = both.filter(fits).select(*[F.col(f"n.{x}") for x in current.columns if x != version], (F.coalesce(F.col(f"v.{version}"), F.lit(0)) + 1).alias(version))
    rejected = both.filter(~fits).select("n.*")
    kept = c.join(accepted.select(key), key, "left_anti").select(*current.columns)
    return kept.unionByName(accepted.select(*current.columns)), rejected


def replan(new_units: DataFrame, previous: DataFrame) -> DataFrame:
    """Work kept over a new plan: each new unit with status and translation of the previous unit of the
    same source_hash in its document (of several the one of the highest sequence_index, then id), else of
    the same unit_key if the hash is equal; only done and fallback units with text keep theirs."""
    prev = previous.filter(F.col("status").isin("done", "fallback") & (F.coalesce(F.length("translation_text"), F.lit(0)) > 0))
    by_hash = prev.groupBy(F.col("document_id").alias("h_doc"), F.col("source_hash").alias("h_hash")).agg(
        F.max(F.struct("sequence_index", "id", "status", "translation_text")).alias("h")
    )
    j = new_units.join(by_hash, (F.col("document_id") == F.col("h_doc")) & (F.col("source_hash") == F.col("h_hash")), "left")
    return j.select(*new_units.columns, F.coalesce(F.col("h.status"), F.lit("pending")).alias("status"), F.col("h.translation_text").alias("translation_text"), F.col("h.id").alias("kept_from"))


def page_tiles(files: DataFrame, size: int = 8) -> DataFrame:
    """(document_id, batch_index, page_start, page_end): the pages 1..page_count of each file in tiles; none for null or 0 pages."""
    starts = F.expr(f"sequence(1, page_count, {size})")
    return files.filter("page_count > 0").select(F.col("id").alias("document_id"), "page_count", F.posexplode(starts).alias("p", "page_start")).select(
        "document_id", (F.col("p") + 1).cast("bigint").alias("batch_index"), F.col("page_start").cast("bigint").alias("page_start"),
        F.least(F.col("page_start") + size - 1, F.col("page_count")).cast("bigint").alias("page_end"),
    )


def uncovered_pages(files: DataFrame, batches: DataFrame) -> DataFrame:
    """(document_id, page) of the pages that no finished batch covers; batches of one file may overlap."""
    need = files.filter("page_count > 0").select(F.col("id").alias("document_id"), F.explode(F.expr("sequence(1, page_count)")).alias("page"))
    have = batches.filter("status LIKE 'done%' OR status = 'skipped_done'").filter("page_start <= page_end").select("document_id", F.explode(F.expr("sequence(page_start, page_end)")).alias("page"))
    return need.join(have.distinct(), ["document_id", "page"], "left_anti")


def carry_forward(partitions: DataFrame, capsules: DataFrame) -> DataFrame:
    """As-of join: for each partition the version of the capsule that was last frozen in an earlier
    partition of the same document, null before the first one."""
    own = capsules.groupBy(F.col("source_partition_id").alias("c_id")).agg(F.max("version").alias("frozen"))
    p = partitions.join(own, F.col("id") == F.col("c_id"), "left").select("document_id", "id", "sequence_index", "frozen")
    place = F.struct("sequence_index", "id")
    p = running_max_blocks(p, ["document_id"], F.floor(F.col("sequence_index") / 4096), ["sequence_index", "id"], {"used": F.when(F.col("frozen").isNotNull(), F.struct(place, "frozen"))}, inclusive=False)
    return p.select("document_id", F.col("id").alias("partition_id"), "sequence_index", F.col("frozen").alias("frozen_version"), F.col("used.frozen").alias("used_version"))


def drift(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """(key, state) of the rows in which two tables differ: 'missing' in actual, 'extra', or 'changed'.
    Values are compared by a hash of all columns that aren't keys; one row per key on either side."""
    rest = [c for c in expected.columns if c not in key]
    e = expected.select(*key, F.xxhash64(*rest).alias("e_hash"), F.lit(True).alias("e"))
    a = actual.select(*[F.col(k).alias(f"a_{k}") for k in key], F.xxhash64(*rest).alias("a_hash"), F.lit(True).alias("a"))
    cond = [F.col(k).eqNullSafe(F.col(f"a_{k}")) for k in key]
    j = e.join(a, cond, "full_outer")
    state = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("e_hash") != F.col("a_hash"), "changed")
    return j.withColumn("state", state).filter("state IS NOT NULL").select(*[F.coalesce(k, f"a_{k}").alias(k) for k in key], "state")


def digest(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """(entries, digest) of a set of rows, whatever their order: SHA-256 over the sorted digests of 4096
    ranges of the rows' own hashes, each over its sorted hashes, so that no task sees more than a range."""
    rows = df.select(F.sha2(F.concat_ws("\u0001", key.cast("string"), value.cast("string")), 256).alias("h"))
    ranges = rows.groupBy(F.substring("h", 1, 3).alias("r")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    return ranges.agg(F.sum("n").alias("entries"), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("digest"))
