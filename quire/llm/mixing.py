"""Mixing of sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.tokenizer import count_tokens
from quire.operators.prefix import running_total
from quire.session import Stage

#: Ranges of virtual finish time into which the uses are cut, and then that range again in which the budget ends,
RANGES = 1_024
#: until it has at most so many rows, which are sorted.
EDGE_ROWS = 20_000


def _tokens(stage: Stage, documents: DataFrame, targets: DataFrame, path: str | None, pattern: str | None) -> DataFrame:
    t = targets.filter((F.col("target_share") > 0) & F.col("source").isNotNull()).groupBy("source").agg(
        F.max("target_share").alias("share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("repeats")
    )
    # one row for each source of the list, which the caller writes by hand
    rows = documents.select("doc_id", "source", "text").join(F.broadcast(t), "source")
    return stage.write(count_tokens(rows, ["doc_id", "source", "share", "repeats"], path=path, pattern=pattern).filter("tokens > 0"), "tokens")


def _spent_at(known: dict, targets: DataFrame, budget: int) -> float:
    """The virtual time at which the budget would be spent if documents could be cut anywhere."""
    caps = []
    for t in targets.collect():  # one row for each source of the list
        if t.source in known and (t.target_share or 0) > 0:
            repeats = 1 if t.max_repeats is None else max(0, t.max_repeats)
            caps.append((known[t.source].total * repeats / t.target_share, t.target_share))
    left, before, weight = float(budget), 0.0, sum(w for _, w in caps)
    for end, w in sorted(caps):  # until `end` the source takes its weight of each unit of time
        if (end - before) * weight >= left or weight <= 0:
            break
        left -= (end - before) * weight
        before, weight = end, weight - w
    return before + left / weight if weight > 1e-12 else max(before, 1.0)


def _queue(documents: DataFrame, targets: DataFrame, path: str | None, pattern: str | None) -> tuple[DataFrame, DataFrame, int]:
    """(rows used, tokens by source, budget)."""
    stage = Stage(documents.sparkSession, "mixing")
    docs = _tokens(stage, documents, targets, path, pattern)
    per = docs.groupBy("source").agg(F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("n"), F.max("tokens").alias("most"), F.max("share").alias("share"))
    known = per.collect()  # one row for each source of the list
    budget, rows = sum(r.total for r in known), sum(r.n for r in known)
    # What has begun by the fluid time covers the budget, so the cut comes no later than the longest of it ends.
    top = _spent_at({r.source: r for r in known}, targets, budget) + max((r.most / r.share for r in known), default=0.0)
    # start tag of each document within its source, in a shuffled order
    tagged = running_total(docs, ["source"], F.xxhash64("doc_id", F.lit(7)), ["doc_id"], F.col("tokens"), "before", rows)
    start = (F.col("before") + (F.col("repeat_no") - 1) * F.col("total")) / F.col("share")
    passes = (
        tagged.join(F.broadcast(per.select("source", "total")), "source")
        .withColumn("last", F.least(F.col("repeats").cast("bigint"), (F.floor(F.lit(top) * F.col("share") / F.col("total")) + 1).cast("bigint")))
        .filter("last > 0")
        .withColumn("repeat_no", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("last"))))
        .filter(start <= top)
        .withColumn("finish", (F.col("before") + F.col("tokens") + (F.col("repeat_no") - 1) * F.col("total")) / F.col("share"))
        .select("doc_id", "source", "repeat_no", "tokens", "finish")
    )
    queue = stage.write(passes, "queue")
    # the range in which the budget ends, narrowed down by sums until its rows are few
    low, high, spent = None, None, 0
    while True:
        rows_in = queue if low is None else queue.filter((F.col("finish") >= low) & (F.col("finish") <= high))
        a, b = (0.0, top) if low is None else (low, high)
        number = F.least(F.floor((F.col("finish") - F.lit(a)) / F.lit((b - a) / RANGES or 1.0)), F.lit(RANGES - 1))
        sums = rows_in.groupBy(number.alias("range")).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.min("finish").alias("first"), F.max("finish").alias("last")).collect()  # at most RANGES rows
        edge = None
        for r in sorted(sums, key=lambda r: r.range):
            if spent + r.t > budget:
                edge = r
                break
            spent += r.t
        if edge is None:  # the budget covers all
            return queue, per, budget
        low, high = edge.first, edge.last
        if edge.n <= EDGE_ROWS or low == high:
            break
    w = Window.orderBy("finish", "source", "doc_id", "repeat_no").rowsBetween(Window.unboundedPreceding, 0)
    last = queue.filter((F.col("finish") >= low) & (F.col("finish") <= high)).withColumn("sum", F.sum("tokens").over(w)).filter(F.col("sum") <= budget - spent).drop("sum")
    return queue.filter(F.col("finish") < low).unionByName(last), per, budget


def mixture(documents: DataFrame, targets: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, source, repeat_no, tokens, finish): one row for each use of a document.

    The documents of each source are put into a random but fixed order; each use gets a virtual finish
    time, the source's tokens up to its end divided by the source's target share, its uses in pass k
    coming after all of pass k - 1.  Ordered by that time, the uses are taken until the next would go
    beyond the budget, the tokens of all texts of the listed sources.  So each source has its share
    until it runs out of repeats; then the others share what is left by their weights.

    Null and empty texts have no tokens and aren't used; a source that isn't listed, or has
    no positive share, takes no part; max_repeats null counts as 1, 0 as none.  Rows that share a doc_id
    are different records.  Empty tables give no rows.
    """
    return _queue(documents, targets, path, pattern)[0]


def shares(documents: DataFrame, targets: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available_tokens, used_tokens, actual_share) of each listed source."""
    used, per, _ = _queue(documents, targets, path, pattern)
    got = used.groupBy("source").agg(F.sum("tokens").alias("used_tokens"), F.count(F.lit(1)).alias("uses"))
    all_used = got.agg(F.sum("used_tokens").alias("all_used"))
    return (
        targets.select("source", "target_share", "max_repeats")
        .join(per.select("source", F.col("total").alias("available_tokens")), "source", "left")
        .join(got, "source", "left")
        .join(F.broadcast(all_used), F.lit(True), "left")  # one row
        .select(
            "source", "target_share", "max_repeats", F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"),
            F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce("uses", F.lit(0)).alias("uses"),
            (F.coalesce("used_tokens", F.lit(0)) / F.col("all_used")).alias("actual_share"),
        )
    )
