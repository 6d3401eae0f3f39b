"""Ordered folds: sequential rules over the rows of a group, which no window function expresses.

``ranged_fold`` cuts the rows into ranges of key and order, whatever the groups, so that a group of any
length is worked on by many tasks: each range is run from a guessed state, and where the true state that
comes in from the range before is another, the rule is run again until both runs are in one state, which
for packing rules takes a few rows.  ``ordered_fold`` runs any rule over whole groups, in constant memory.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.prefix import running_total_blocks
from quire.operators.state import top_k
from quire.session import Stage, ship

#: A rule: called with a key for its state; the state's ``send(row)`` gives the output values of a row.
Rule = Callable[[], Callable[[tuple], tuple]]


def ordered_fold(df: DataFrame, key: str, order: list[str], inputs: list[str], rule: Rule, outputs: str) -> DataFrame:
    """``df``'s key, order and ``outputs`` (DDL): for each row of a group, in order, the values that the rule gives.

    ``rule()`` makes the function for one group; it is called with the values of ``inputs`` row by row.
    Rows with equal order values come in any order, so ``order`` should be unique within a group; null
    keys form a group.  An empty table gives no rows.
    """
    ship(df.sparkSession)
    names = [x.split()[0] for x in outputs.split(",")]
    keep = list(dict.fromkeys([key, *order]))
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), outputs])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, step, first = None, None, True
        for b in batches:
            out = []
            for k, values in zip(b[key].tolist(), zip(*(b[c].tolist() for c in inputs))):
                k = None if pd.isna(k) else k
                if first or k != current:
                    current, step, first = k, rule(), False
                out.append(step(tuple(None if _missing(v) else v for v in values)))
            got = pd.DataFrame(out, columns=names, index=b.index)
            yield pd.concat([b[keep], got], axis=1)

    columns = list(dict.fromkeys([*keep, *inputs]))
    return df.select(*columns).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def _missing(v) -> bool:
    return v is None or (isinstance(v, float) and v != v) or v is pd.NA


@dataclass(frozen=True)
class Machine:
    """A rule with an open state: step(state, row) gives the next state and a whole number, which with
    ``numbers`` is 1 where the row opens the next number and 0 where it doesn't.  States are flat tuples;
    ``guess`` is the state that a range is run from before the true one is known."""

    start: tuple
    guess: tuple
    step: Callable[[tuple, tuple], tuple[tuple, int]]
    numbers: bool = True

    def __call__(self) -> Callable[[tuple], tuple]:
        """The rule for one group, row by row."""
        state, number = self.start, 1

        def step(row: tuple) -> tuple:
            nonlocal state, number
            state, value = self.step(state, row)
            if not self.numbers:
                return (value,)
            number += value
            return (number,)

        return step


def ranged_fold(df: DataFrame, key: str, order: list[str], inputs: list[str], machine: Machine, output: str) -> DataFrame:
    """(key, order, ``output`` BIGINT): what the machine gives for each row of a group in order, a number from 1 or its value.

    ``order`` must be unique within a group; null keys form a group, null orders come first.  An empty
    table gives no rows.  What is collected is one row for each range of the shuffle."""
    spark = df.sparkSession
    ship(spark)
    stage = Stage(spark, "fold")
    columns = list(dict.fromkeys([key, *order, *inputs]))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)

    def rows_of(b: pd.DataFrame) -> Iterator[tuple]:
        return zip(*(b[c].tolist() for c in inputs))

    def clean(values: tuple) -> tuple:
        return tuple(None if _missing(v) else v for v in values)

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, at, run, current, state = TaskContext.get().partitionId(), 0, -1, None, None
        for b in batches:
            values, runs = [], []
            for k, row in zip(b[key].tolist(), rows_of(b)):
                k = None if pd.isna(k) else k
                if run < 0 or k != current:
                    run, current = min(run + 1, 1), k
                    state = machine.guess if run == 0 else machine.start
                state, v = machine.step(state, clean(row))
                values.append(v)
                runs.append(run)
            if not values:
                continue
            b = b.assign(__range=task, __at=range(at, at + len(values)), __run=runs, __v=values, __end=None)
            b["__end"] = b["__end"].astype(object)
            b.iloc[-1, b.columns.get_loc("__end")] = json.dumps(state)
            at += len(values)
            yield b

    ranged = df.select(*columns).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    raw = stage.write(ranged.mapInPandas(guess, f"{kinds}, __range INT, __at BIGINT, __run INT, __v BIGINT, __end STRING"), "guess")
    ends = raw.groupBy("__range").agg(
        F.min_by(F.struct(F.col(key).alias("k")), "__at").alias("first"), F.max_by(F.struct(F.col(key).alias("k")), "__at").alias("last"), F.max_by("__end", "__at").alias("end"), F.max("__run").alias("runs")
    ).collect()  # one row for each range
    ends.sort(key=lambda r: r["__range"])
    state_after = {r["__range"]: tuple(json.loads(r["end"])) for r in ends}

    def incoming() -> dict[int, tuple]:
        out, before = {}, None
        for r in ends:
            same = before is not None and before["last"]["k"] == r["first"]["k"]
            out[r["__range"]] = state_after[before["__range"]] if same else machine.start
            before = r
        return out

    single = {r["__range"] for r in ends if r["runs"] == 0}
    settled: dict[int, tuple] = {}  # the state that a range's first run was last run from
    fixes: list[tuple[DataFrame, set[int]]] = []
    while todo := {r: x for r, x in incoming().items() if settled.get(r, machine.guess) != x}:

        def again(batches: Iterator[pd.DataFrame], todo: dict[int, tuple] = todo) -> Iterator[pd.DataFrame]:
            current, true, guessed, synced = None, None, None, False
            for b in batches:
                out = []
                for r, at, row in zip(b["__range"].tolist(), b["__at"].tolist(), rows_of(b)):
                    if r != current:
                        if current is not None and not synced:
                            out.append((current, -1, None, json.dumps(true)))
                        current, true, guessed, synced = r, todo[r], machine.guess, False
                    if synced:
                        continue
                    row = clean(row)
                    (true, v), (guessed, w) = machine.step(true, row), machine.step(guessed, row)
                    if v != w:
                        out.append((r, at, v, None))
                    synced = true == guessed
                yield pd.DataFrame(out, columns=["__range", "__at", "__v", "__end"]).astype({"__v": "Int64"})
            if current is not None and not synced:
                yield pd.DataFrame([(current, -1, None, json.dumps(true))], columns=["__range", "__at", "__v", "__end"]).astype({"__v": "Int64"})

        part = raw.filter((F.col("__run") == 0) & F.col("__range").isin(*todo)).select("__range", "__at", *[c for c in inputs])
        fix = stage.write(part.repartition("__range").sortWithinPartitions("__range", "__at").mapInPandas(again, "__range INT, __at BIGINT, __v BIGINT, __end STRING"), "fix")
        fixes = [(f, has - set(todo)) for f, has in fixes] + [(fix, set(todo))]
        settled |= todo
        unsynced = {r["__range"]: tuple(json.loads(r["__end"])) for r in fix.filter("__at = -1").collect()}  # at most one row for each range
        guessed_ends = {r["__range"]: tuple(json.loads(r["end"])) for r in ends}
        for r in todo:
            if r in single:  # where the runs met, the guessed run's end is the true one
                state_after[r] = unsynced.get(r, guessed_ends[r])
    values = raw.select(*dict.fromkeys([key, *order]), "__range", "__at", "__v")
    better = None
    for f, has in fixes:
        if has:
            f = f.filter((F.col("__at") >= 0) & F.col("__range").isin(*has)).select(F.col("__range").alias("__r"), F.col("__at").alias("__a"), F.col("__v").alias("__new"))
            better = f if better is None else better.unionByName(f)
    if better is not None:
        values = values.join(better, (F.col("__range") == F.col("__r")) & (F.col("__at") == F.col("__a")), "left").withColumn("__v", F.coalesce("__new", "__v")).drop("__r", "__a", "__new")
    if machine.numbers:
        values = running_total_blocks(values, [key], F.col("__range"), ["__at"], F.col("__v"), "__before").withColumn("__v", F.col("__before") + F.col("__v") + 1)
    return values.select(*dict.fromkeys([key, *order]), F.col("__v").cast("bigint").alias(output))


def partition_rule(first: int = 96_000, target: int = 220_000, most: int = 300_000) -> Machine:
    """Packing of units into partitions: one closes before a unit that would lift it above ``most`` and
    after the unit with which it reaches its target; the first has a target of its own."""

    def step(state: tuple, row: tuple) -> tuple[tuple, int]:
        is_first, size, closed = state
        tokens = int(row[0] or 0)
        opens = bool(closed or (size and size + tokens > most))
        is_first, size = is_first and not opens, tokens if opens else size + tokens
        closes = size >= (first if is_first else target)
        return (is_first, 0 if closes else size, closes), int(opens)

    return Machine((True, 0, False), (False, 0, False), step)


def chunk_rule(limit: int = 2_000) -> Machine:
    """Packing of blocks into chunks of at most ``limit`` characters, a block counting two more for its separator."""

    def step(state: tuple, row: tuple) -> tuple[tuple, int]:
        n = int(row[0] or 0) + 2
        opens = bool(state[0] and state[0] + n > limit)
        return (n if opens else state[0] + n,), int(opens)

    return Machine((0,), (0,), step)


def unit_rule(target: int = 12_000, most: int = 24_000, least: int = 1_500, atomic: frozenset[str] = frozenset()) -> Machine:
    """Packing of nodes (tokens, type, level) into units: a heading of level 1 or 2 opens a unit if the open
    one has ``least`` tokens; no unit grows above ``most`` except by its first node; one closes after a
    node that isn't atomic at ``target``.  A longer node that isn't atomic has a unit of its own."""

    def step(state: tuple, row: tuple) -> tuple[tuple, int]:
        size, empty, closed = state
        tokens, kind, level = int(row[0] or 0), row[1], row[2]
        whole = kind in atomic
        alone = not whole and tokens > most
        heads = kind == "heading" and level is not None and level <= 2 and size >= least
        opens = bool(closed or (not empty and (heads or alone or size + tokens > most)))
        size = tokens if opens else size + tokens
        closes = alone or (size >= target and not whole)
        return ((0, True, True) if closes else (size, False, False)), int(opens)

    return Machine((0, True, False), (0, True, False), step)


def budget_rule(budget: int) -> Rule:
    """Selection within a budget: required rows always go in and use it up; any other row goes in if it
    still fits, and the scan goes on behind one that doesn't."""

    def make():
        used = 0

        def step(row: tuple) -> tuple:
            nonlocal used
            tokens, required = int(row[0] or 0), bool(row[1])
            if required or used + tokens <= budget:
                used += tokens
                return ("selected", used)
            return ("budget_trimmed", used)

        return step

    return make


def select_within_budget(df: DataFrame, key: str, order: list[str], tokens: Column, required: Column, budget: int) -> DataFrame:
    """(key, order, state): rows of each group within a budget of tokens, required ones first, then the
    others in ``order``, each if it still fits; state is 'selected' or 'budget_trimmed'.

    Of the rows of one size only as many as the rest of the budget holds of it can be taken, and the
    first ones at that.  So a group's walk has at most budget * (1 + ln budget) rows besides the
    required ones, which are only summed, whatever the group's length; all other rows are trimmed.
    """
    columns = list(dict.fromkeys([key, *order]))
    t = df.select(*columns, F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0)).cast("bigint").alias("__t"), F.coalesce(required, F.lit(False)).alias("__r"))
    t = Stage(df.sparkSession, "budget").write(t, "sizes")  # it is read three times, and sizes may be dear to find
    must = t.filter("__r")
    spent = must.groupBy(F.col(key).alias("__k")).agg(F.sum("__t").alias("__spent"))
    rest = t.filter("NOT __r").join(spent, F.col(key).eqNullSafe(F.col("__k")), "left")
    left = F.greatest(F.lit(budget) - F.coalesce("__spent", F.lit(0)), F.lit(0))
    rest = rest.withColumn("__left", left).withColumn("__most", F.floor(F.col("__left") / F.greatest("__t", F.lit(1))))
    some = top_k(rest.filter("__most > 0 AND __t > 0").select(*columns, "__t", "__left", "__most"), [key, "__t"], [F.asc(c) for c in order], F.col("__most"))

    def walk():
        used = None

        def step(row: tuple) -> tuple:
            nonlocal used
            size, room = int(row[0]), int(row[1])
            used = used or 0
            if used + size <= room:
                used += size
                return ("selected", used)
            return ("budget_trimmed", used)

        return step

    walked = ordered_fold(some, key, order, ["__t", "__left"], walk, "state STRING, walked BIGINT")
    w = walked.filter("state = 'selected'").select(*[F.col(c).alias(f"__w_{c}") for c in columns], "state")
    same = [F.col(c).eqNullSafe(F.col(f"__w_{c}")) for c in columns]
    others = rest.join(w, same, "left").select(*columns, F.when((F.col("__t") == 0) & (F.coalesce("__spent", F.lit(0)) <= budget), "selected").otherwise(F.coalesce("state", F.lit("budget_trimmed"))).alias("state"))
    return must.select(*columns, F.lit("selected").alias("state")).unionByName(others)


def limit_rule(start: int = 16, most: int = 64, every: int = 30) -> Machine:
    """Simulation of an adaptive limit over a log of HTTP codes: two more for each ``every`` successes in a
    row, half after a 429, three quarters after a 503, never below 1; other codes leave it."""

    def step(state: tuple, row: tuple) -> tuple[tuple, int]:
        limit, streak = state
        code = row[0]
        if code == 200:
            streak += 1
            if streak >= every:
                limit, streak = min(most, limit + 2), 0
        elif code == 429:
            limit, streak = max(1, limit // 2), 0
        elif code == 503:
            limit, streak = max(1, limit * 3 // 4), 0
        return (limit, streak), limit

    return Machine((start, 0), (start, 0), step, numbers=False)
