"""Selection of context documents for a request: exclusions, matches with their reasons, one hop, ranks, a budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.folds import select_within_budget

#: Kinds of reasons in the order of their priority; the first three make a document required.
PREFIXES = ("mandatory_", "path_match:", "symbol_match:", "keyword_match:", "relation_from:")


@dataclass(frozen=True)
class ContextRequest:
    paths: tuple[str, ...] = ()
    symbols: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    scope: tuple[tuple[str, str], ...] = ()
    namespace: str = "coding"
    valid_at: str = "2026-01-01 00:00:00"
    budget: int = 4_000


def exclusion(request: ContextRequest) -> Column:
    """Why a candidate can't be taken, the first cause that holds; null if it can."""
    at = F.lit(request.valid_at).cast("timestamp")
    valid = (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_until").isNull() | (at <= F.col("valid_until")))
    knowledge = F.col("kind") == "knowledge"
    gone = lambda c: F.col(c).isin("deprecated", "rejected")
    c = (
        F.when(knowledge & gone("epistemic_status"), F.concat(F.lit("epistemic_status_filtered:"), "epistemic_status"))
        .when(knowledge & gone("lifecycle"), F.concat(F.lit("lifecycle_filtered:"), "lifecycle"))
        .when(knowledge, F.lit(None))
        .when(F.col("status") != "active", F.concat(F.lit("status_filtered:"), "status"))
        .when(~valid, F.lit(f"validity_filtered:{request.valid_at}"))
        .when(F.col("namespace") != request.namespace, F.concat(F.lit("scope_filtered:namespace:"), "namespace"))
    )
    for name, value in request.scope:  # a level that the record leaves open fits any request
        c = c.when(F.col(name).isNotNull() & (F.col(name) != value), F.concat(F.lit(f"scope_filtered:{name}:"), name))
    return c


def reasons(request: ContextRequest) -> Column:
    """The direct reasons of a candidate: marks of its own, paths, symbols and keywords that match."""
    tagged = lambda p: F.transform(F.filter("tags", lambda t: t.startswith(p)), lambda t: F.substring(t, len(p) + 1, 10_000))
    bare = lambda a: F.transform(a, lambda x: F.regexp_replace(x, "/+$", ""))
    own_paths = bare(F.concat(F.filter("symbols", lambda s: s.contains("/") | s.startswith(".")), tagged("path:")))
    names = F.transform(F.concat("symbols", tagged("symbol:")), lambda s: F.lower(s))
    out = [
        F.when((F.col("kind") == "knowledge") & (F.col("temperature") == "hot"), F.lit("mandatory_hot_document")),
        F.when((F.col("kind") == "memory") & F.array_contains("tags", "mandatory"), F.lit("mandatory_memory")),
    ]
    for p in request.paths:
        e = p.rstrip("/")
        near = F.exists(own_paths, lambda v: (v == e) | F.startswith(F.lit(e), F.concat(v, F.lit("/"))) | v.startswith(e + "/"))
        out.append(F.when((F.col("path") == e) | F.col("path").startswith(e + "/") | near, F.lit(f"path_match:{p}")))
    out += [F.when(F.array_contains(names, s.lower()), F.lit(f"symbol_match:{s}")) for s in request.symbols]
    out += [F.when(F.instr(F.lower("text"), k.lower()) > 0, F.lit(f"keyword_match:{k}")) for k in request.keywords]
    return F.array_distinct(F.array_compact(F.array(*out)))


def reason_rank(reason: Column) -> Column:
    c = F.lit(99)
    for k in range(len(PREFIXES) - 1, -1, -1):
        c = F.when(reason.startswith(PREFIXES[k]), k).otherwise(c)
    return c


def select(candidates: DataFrame, relations: DataFrame, request: ContextRequest) -> DataFrame:
    """(document_id, path, state, priority, tokens, reasons): candidates with any reason; state is 'selected',
    'budget_trimmed' or the cause of exclusion.

    ``candidates`` has document_id, path, kind, text, tokens, tags, symbols, temperature, epistemic_status,
    lifecycle, status, namespace, the levels of the scope, valid_from and valid_until; ``relations`` has
    document_id, kind and target_id.  A candidate that can be taken gives each of its targets a reason,
    even one that can't.  The budget is walked through in the order of the best reason, path and id;
    only what can still fit is walked through, see select_within_budget.
    """
    c = candidates.withColumn("excluded", exclusion(request)).withColumn("direct", reasons(request))
    sources = c.filter((F.size("direct") > 0) & F.col("excluded").isNull()).select(F.col("document_id").alias("s_id"))
    hop = (
        relations.join(sources, F.col("document_id") == F.col("s_id"))
        .groupBy(F.col("target_id").alias("t_id"))
        .agg(F.array_sort(F.collect_set(F.concat(F.lit("relation_from:"), "document_id", F.lit(":"), "kind"))).alias("hops"))
    )
    m = c.join(hop, F.col("document_id") == F.col("t_id"), "left")
    m = m.withColumn("all", F.concat("direct", F.coalesce("hops", F.array().cast("array<string>")))).filter(F.size("all") > 0)
    ranked = F.array_sort(F.transform("all", lambda r: F.struct(reason_rank(r).alias("rank"), r.alias("reason"))))
    m = m.withColumn("ranked", ranked).withColumn("best", F.get("ranked", F.lit(0))["rank"])
    priority = F.when(F.col("best") <= 2, "required").when(F.col("best") == 3, "relevant").otherwise("related")
    m = m.select("document_id", "path", "excluded", "best", "tokens", priority.alias("priority"), F.transform("ranked", lambda x: x["reason"]).alias("reasons"))
    fits = m.filter("excluded IS NULL").select("*", F.lit(1).alias("one"), (F.col("priority") == "required").alias("must"))
    walked = select_within_budget(fits, "one", ["best", "path", "document_id"], F.col("tokens"), F.col("must"), request.budget)
    walked = walked.select(F.col("document_id").alias("w_id"), "state")
    return m.join(walked, F.col("document_id") == F.col("w_id"), "left").select("document_id", "path", F.coalesce("excluded", "state").alias("state"), "priority", "tokens", "reasons")


def warnings(selected: DataFrame, budget: int) -> DataFrame:
    """(warning): the required documents go beyond the budget, or nothing was selected."""
    taken = F.col("state") == "selected"
    g = selected.agg(F.coalesce(F.sum(F.when(taken & (F.col("priority") == "required"), F.col("tokens"))), F.lit(0)).alias("required"), F.count_if(taken).alias("n"))
    over = F.when(F.col("required") > budget, F.concat(F.lit("required context exceeds budget by "), (F.col("required") - budget).cast("string"), F.lit(" token(s)")))
    none = F.when(F.col("n") == 0, F.lit("no eligible context documents matched the request"))
    return g.select(F.explode(F.array_compact(F.array(over, none))).alias("warning"))
