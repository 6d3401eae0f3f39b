"""Prefix sums inside groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A group above max(ROWS_PER_TASK, rows / MAX_HOT) rows is hot, so there are at most MAX_HOT hot groups.
ROWS_PER_TASK = 20_000
MAX_HOT = 1_000


def running_total(
    df: DataFrame,
    keys: list[str],
    order: Column,
    tie: list[str],
    value: Column,
    out: str,
    rows: int,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Exclusive running total of ``value`` in each group of ``keys``, ordered by ``order`` then ``tie``.

    ``order`` must be a uniformly spread BIGINT (a 64-bit hash), as a hot group is cut into ranges of it.
    A hot group has more than max(rows_per_task, rows / MAX_HOT) of the ``rows`` rows; the list of hot
    groups therefore has at most MAX_HOT rows and is broadcast.  Each range of a hot group is summed on
    its own; the totals of the ranges before it are added.  Null keys form a group like any other.
    """
    limit = max(rows_per_task, rows // MAX_HOT)
    hot = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") > limit)
        .select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.ceil(F.col("__n") / F.lit(limit / 2)).cast("int").alias("__parts"))
    )
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__h_{k}"))
        cond = c if cond is None else cond & c
    cut = (
        df.withColumn("__o", order)
        .join(F.broadcast(hot), cond, "left")
        .withColumn("__unit", F.col("__o") / F.lit(2.0**64) + F.lit(0.5))
        .withColumn(
            "__b",
            F.when(F.col("__parts").isNull(), F.lit(0)).otherwise(
                F.least(F.floor(F.col("__unit") * F.col("__parts")).cast("int"), F.col("__parts") - 1)
            ),
        )
        .withColumn("__v", value)
    )
    w = Window.partitionBy(*keys, "__b").orderBy("__o", *tie).rowsBetween(Window.unboundedPreceding, -1)
    inner = cut.withColumn("__in", F.coalesce(F.sum("__v").over(w), F.lit(0)))
    ranges = (
        cut.filter(F.col("__parts").isNotNull())
        .groupBy(*[F.col(k).alias(f"__r_{k}") for k in keys], F.col("__b").alias("__rb"))
        .agg(F.sum("__v").alias("__rv"))
    )
    wr = Window.partitionBy(*[f"__r_{k}" for k in keys]).orderBy("__rb").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.withColumn("__before", F.coalesce(F.sum("__rv").over(wr), F.lit(0))).drop("__rv")
    cond = F.col("__b") == F.col("__rb")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    # at most 4 * MAX_HOT ranges: 2 n / limit <= 2 * MAX_HOT, plus one for each hot group by rounding up
    return (
        inner.join(F.broadcast(before), cond, "left")
        .withColumn(out, F.col("__in") + F.coalesce(F.col("__before"), F.lit(0)))
        .select(*df.columns, out)
    )


def running_total_blocks(df: DataFrame, keys: list[str], block: Column, order: list[str], value: Column, out: str) -> DataFrame:
    """Exclusive running total of ``value`` in each group of ``keys`` in ``order``, where ``block`` is a whole
    number that never falls along that order (a position divided by a block's length).

    Each block is summed on its own; the totals of the blocks before it, one row for each block, are
    added by a join.
    """
    cut = df.withColumn("__b", block.cast("bigint")).withColumn("__v", value)
    w = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = cut.withColumn("__in", F.coalesce(F.sum("__v").over(w), F.lit(0)))
    totals = cut.groupBy(*[F.col(k).alias(f"__r_{k}") for k in keys], F.col("__b").alias("__rb")).agg(F.sum("__v").alias("__rv"))
    wr = Window.partitionBy(*[f"__r_{k}" for k in keys]).orderBy("__rb").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("__before", F.coalesce(F.sum("__rv").over(wr), F.lit(0))).drop("__rv")
    cond = F.col("__b").eqNullSafe(F.col("__rb"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return inner.join(before, cond, "left").withColumn(out, F.col("__in") + F.coalesce(F.col("__before"), F.lit(0))).select(*df.columns, out)


def running_max_blocks(df: DataFrame, keys: list[str], block: Column, order: list[str], values: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """``df`` with running maxima in each group of ``keys`` in ``order``; ``block`` as in running_total_blocks.

    A value that is a struct led by its position makes this the last value that isn't null.  Each block
    is scanned on its own; what the blocks before it carry over, one row for each, comes by a join.
    """
    cut = df.withColumn("__b", block.cast("bigint"))
    for name, c in values.items():
        cut = cut.withColumn(f"__v_{name}", c)
    w = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    inner = cut.select("*", *[F.max(f"__v_{n}").over(w).alias(f"__i_{n}") for n in values])
    tops = cut.groupBy(*[F.col(k).alias(f"__r_{k}") for k in keys], F.col("__b").alias("__rb")).agg(*[F.max(f"__v_{n}").alias(f"__t_{n}") for n in values])
    wr = Window.partitionBy(*[f"__r_{k}" for k in keys]).orderBy("__rb").rowsBetween(Window.unboundedPreceding, -1)
    before = tops.select("*", *[F.max(f"__t_{n}").over(wr).alias(f"__c_{n}") for n in values]).drop(*[f"__t_{n}" for n in values])
    cond = F.col("__b").eqNullSafe(F.col("__rb"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    out = inner.join(before, cond, "left")
    return out.select(*df.columns, *[F.greatest(f"__i_{n}", f"__c_{n}").alias(n) for n in values])
