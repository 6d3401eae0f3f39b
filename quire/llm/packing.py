"""Filling of fixed-capacity containers, on histograms of item sizes.

A group of any number of items has at most ``capacity`` different sizes, so its histogram is small and
is packed in one task whatever the group's rows.  The packer returns patterns (how many items of each
size a container takes, and how many containers are filled so); the items then find their container by
their rank among the items of their size, in one join, without ever being gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import count, islice
from random import Random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.tokens import estimate_tokens
from quire.operators.prefix import running_total
from quire.session import Stage, ship

#: Steps of the search one container at a time, after which the search by whole patterns decides.
SEARCH_NODES = 5_000
#: Sizes among which the search by patterns looks for the one with the fewest fillings, failed states it remembers.
LOOK, REMEMBERED = 48, 1_000_000
#: Steps of the first search by patterns; later ones have more, without an end.
FIRST_STEPS = 200

#: Context sizes of the tiers, as shares of the first, which stands for the capacity.
WINDOWS = (8, 4, 2, 1)

Pattern = tuple[int, list[tuple[int, int]]]  # containers, [(size, items of it in each)]


def tier_of(size: int, capacity: int, windows: tuple[int, ...] = WINDOWS) -> int:
    """The tier of an item: 1 for what only the whole capacity holds, then one for each shorter window."""
    return max(k for k, w in enumerate(windows, 1) if size * windows[0] <= w * capacity)


def route(hist: dict[int, int], capacity: int, windows: tuple[int, ...] = WINDOWS) -> list[dict[int, int]]:
    """The histogram of each tier: an item goes to the shortest window that holds it."""
    tiers: list[dict[int, int]] = [{} for _ in windows]
    for size, n in hist.items():
        tiers[tier_of(size, capacity, windows) - 1][size] = n
    return tiers


def _sums(sizes: list[int], counts: dict[int, int], gap: int) -> list[int]:
    """reach[i]: bit set of the sums up to gap of the items of sizes[i:]."""
    mask, reach = (1 << (gap + 1)) - 1, [1] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        r, s, left, step = reach[i + 1], sizes[i], min(counts[sizes[i]], gap // sizes[i]), 1
        while left > 0:
            k = min(step, left)
            r |= (r << (s * k)) & mask
            left -= k
            step *= 2
        reach[i] = r
    return reach


def _fillings(sizes: list[int], counts: dict[int, int], gap: int) -> Iterator[list[tuple[int, int]]]:
    """All ways to fill gap exactly, those of longer tiers first; reach keeps the search free of dead ends."""
    reach = _sums(sizes, counts, gap)
    if not reach[0] >> gap & 1:
        return
    stack: list[tuple[int, int, tuple]] = [(0, gap, ())]
    while stack:
        i, left, chosen = stack.pop()
        if left == 0:
            yield list(chosen)
            continue
        s = sizes[i]
        for k in range(min(counts[s], left // s) + 1):
            if reach[i + 1] >> (left - s * k) & 1:
                stack.append((i + 1, left - s * k, chosen + ((s, k),) if k else chosen))


def _merged(size: int, filling: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = {size: 1}
    for s, k in filling:
        out[s] = out.get(s, 0) + k
    return list(out.items())


def _others(counts: dict[int, int], size: int, gap: int) -> tuple[list[int], dict[int, int]]:
    rest = dict(counts)
    rest[size] -= 1
    return [s for s in sorted(rest, reverse=True) if rest[s] and s <= gap], rest


def _least_containers(hist: dict[int, int], capacity: int) -> int:
    """A lower bound on the containers: for each k, items above capacity - k are alone, other items above
    half the capacity are apart, and what items of k or more can't go beside those needs room of its own."""
    best = 0
    for k in {0, *(s for s in hist if 2 * s <= capacity)}:
        alone = sum(c for s, c in hist.items() if s > capacity - k)
        large = [(s, c) for s, c in hist.items() if capacity // 2 < s <= capacity - k]
        n = sum(c for _, c in large)
        free = n * capacity - sum(s * c for s, c in large)
        small = sum(s * c for s, c in hist.items() if k <= s <= capacity // 2)
        best = max(best, alone + n + max(0, -(-(small - free) // capacity)))
    return best


def _scarcest(counts: dict[int, int], capacity: int, rng: Random | None) -> tuple[int, Iterator[list[tuple[int, int]]]]:
    """A size with few different fillings of its container, and those fillings; none where a size can't be placed."""
    order = sorted(counts, reverse=True)
    if len(order) > LOOK:
        order = order[: LOOK // 2] + order[-LOOK // 2 :]
    best, most = order[0], 8
    for s in order:
        n = sum(1 for _ in islice(_fillings(*_others(counts, s, capacity - s), capacity - s), most))
        if n < most:
            best, most = s, n
        if n == 0:
            break
    sizes, rest = _others(counts, best, capacity - best)
    if rng:
        sizes.sort(key=lambda s: -s * rng.uniform(0.3, 1))
    return best, _fillings(sizes, rest, capacity - best)


def _by_patterns(hist: dict[int, int], capacity: int) -> list[Pattern] | None:
    """A packing without waste, or None if there is none.

    The search begins anew with the fillings in another order and a quarter more steps until it comes to its
    end, so no number of steps decides the answer; states that failed stay known."""
    failed: set[bytes] = set()
    steps, rng = FIRST_STEPS, None
    while True:
        found, ended = _pattern_search(hist, capacity, steps, failed, rng)
        if ended:
            return found
        steps, rng = steps * 5 // 4, rng or Random(0)


def _pattern_search(hist: dict[int, int], capacity: int, steps: int, failed: set[bytes], rng: Random | None) -> tuple[list[Pattern] | None, bool]:
    """(packing without waste or None, whether the search came to its end within the steps).

    All items of one size must be placed, so the search branches on which of its fillings are used and how
    often, the size with the fewest fillings first; its steps don't grow with the counts where few fillings
    are possible.  States that failed are remembered by a digest."""
    counts, path = dict(hist), []

    def digest() -> bytes:
        return blake2b(repr(sorted(counts.items())).encode(), digest_size=16).digest()

    def moves(size: int, made: list, more: Iterator, at: int) -> Iterator[tuple[int, list, int]]:
        """The fillings from place `at` on that fit, each as often as possible first."""
        for j in count(at):
            if j == len(made):
                f = next(more, None)
                if f is None:
                    return
                made.append(_merged(size, f))
            items = made[j]
            for times in range(min(counts.get(s, 0) // k for s, k in items), 0, -1):
                yield times, items, j

    # (moves, size, its fillings so far, further ones, key of the state or None inside a size, pattern that led here)
    frames: list[tuple] = []

    def enter(led: Pattern | None) -> None:
        key = digest()
        least = key not in failed and _least_containers(counts, capacity) * capacity <= sum(s * c for s, c in counts.items())
        size, more = _scarcest(counts, capacity, rng) if least else (0, iter(()))
        made: list = []
        frames.append((moves(size, made, more, 0), size, made, more, key, led))

    enter(None)
    while frames:
        if steps == 0:
            return None, False
        steps -= 1
        it, size, made, more, key, led = frames[-1]
        move = next(it, None)
        if move is None:
            if key is not None:
                if len(failed) >= REMEMBERED:
                    failed.clear()
                failed.add(key)
            frames.pop()
            if led is not None:
                path.pop()
                for s, k in led[1]:
                    counts[s] = counts.get(s, 0) + k * led[0]
            continue
        times, items, j = move
        for s, k in items:
            counts[s] -= k * times
            if not counts[s]:
                del counts[s]
        path.append((times, items))
        if not counts:
            return path, True
        if size in counts:
            frames.append((moves(size, made, more, j + 1), size, made, more, None, (times, items)))
        else:
            enter((times, items))
    return None, True


def exact(hist: dict[int, int], capacity: int) -> list[Pattern] | None:
    """A packing without waste, or None if there is none.

    A quick way comes first: while far more items are left than a container holds, a filling of the largest
    item is repeated as often as the counts allow, and a search one container at a time ends it.  Where that
    fails, the search by patterns decides from the start."""
    if not hist or sum(s * c for s, c in hist.items()) % capacity or max(hist) > capacity:
        return None
    if _least_containers(hist, capacity) * capacity > sum(s * c for s, c in hist.items()):
        return None
    counts, done = dict(hist), []
    # greedy part on plentiful sizes: it leaves at least 64 items for the search to finish with
    while sum(counts.values()) > 96:
        size = max(counts)
        sizes, rest = _others(counts, size, capacity - size)
        f = next(_fillings(sizes, rest, capacity - size), None)
        if f is None:
            break
        items = _merged(size, f)
        spare = (sum(counts.values()) - 64) // sum(k for _, k in items)
        times = max(1, min(min(counts[s] // k for s, k in items), spare))
        for s, k in items:
            counts[s] -= k * times
            if not counts[s]:
                del counts[s]
        done.append((times, items))
    failed, seen = set(), 0

    def search() -> bool:
        nonlocal seen
        frames: list[tuple[Iterator, tuple, list]] = []
        while True:
            if not counts:
                return True
            key = tuple(sorted(counts.items()))
            size = max(counts)
            if key in failed:
                it = iter(())
            else:
                sizes, rest = _others(counts, size, capacity - size)
                it = _fillings(sizes, rest, capacity - size)
            frames.append((it, key, []))
            while frames:
                it, key, used = frames[-1]
                for s, k in used:  # undo the last try of this container
                    counts[s] = counts.get(s, 0) + k
                used.clear()
                seen += 1
                f = next(it, None) if seen < SEARCH_NODES else None
                if f is None:
                    failed.add(key)
                    frames.pop()
                    if frames:
                        path.pop()
                    continue
                size = max(counts)
                items = _merged(size, f)
                for s, k in items:
                    counts[s] -= k
                    if not counts[s]:
                        del counts[s]
                used.extend(items)
                path.append((1, items))
                break
            else:
                return False

    path: list[Pattern] = []
    if search():
        return done + path
    if not done and seen < SEARCH_NODES:  # the whole was searched
        return None
    return _by_patterns(hist, capacity)


def tiered(hist: dict[int, int], capacity: int, windows: tuple[int, ...] = WINDOWS) -> list[Pattern]:
    """A packing with little waste, tier by tier from the longest: the items of a tier open containers, and
    the gap of each is filled from its own tier and then from the shorter ones, as far as their sums allow."""
    tiers, out = route(hist, capacity, windows), []
    for k, own in enumerate(tiers):
        while own:
            size = max(own)
            gap = capacity - size
            own[size] -= 1
            pools = [(s, tier) for tier in tiers[k:] for s in sorted(tier, reverse=True) if tier[s] and s <= gap]
            own[size] += 1
            counts = {s: tier[s] - (s == size) for s, tier in pools}
            sizes = [s for s, _ in pools]
            best = _sums(sizes, counts, gap)[0].bit_length() - 1
            items = _merged(size, next(_fillings(sizes, counts, best), []))
            of = {s: tier for s, tier in pools} | {size: own}
            times = min(of[s][s] // n for s, n in items)  # the same filling for as long as the items last
            for s, n in items:
                of[s][s] -= n * times
                if not of[s][s]:
                    del of[s][s]
            out.append((times, items))
    return out


def pack(hist: dict[int, int], capacity: int) -> tuple[list[Pattern], bool]:
    """(patterns, whether all containers are exactly full)."""
    p = tiered(hist, capacity)
    if all(sum(s * k for s, k in items) == capacity for _, items in p):
        return p, True
    e = exact(hist, capacity)
    return (e, True) if e is not None else (p, False)


def item_sizes(nodes: DataFrame) -> DataFrame:
    """(id, document_id, size) of each node once; size is token_count, or the estimate of source_text
    where that is null or 0.  A node without text and count has size 0 and takes no room."""
    count = F.col("token_count")
    size = F.when(F.coalesce(count, F.lit(0)) > 0, count).otherwise(estimate_tokens(F.col("source_text")))
    rows = nodes.filter(F.col("id").isNotNull()).select("id", F.struct(F.col("document_id"), size.alias("size")).alias("s"))
    return rows.groupBy("id").agg(F.min("s").alias("s")).select("id", "s.document_id", "s.size").filter("size > 0")


def _plans(sizes: DataFrame, capacity: int) -> DataFrame:
    """(document_id, full, perfect, patterns) of each document.  size is cut into `full` whole
    containers and a rest; the histogram of the rests has at most `capacity` bars."""
    rest = F.col("size") - F.col("full") * capacity
    hist = (
        sizes.withColumn("full", F.when(F.col("size") > capacity, F.floor(F.col("size") / capacity)).otherwise(0))
        .withColumn("rest", rest)
        .groupBy("document_id", "rest")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full"))
        .repartition(4 * sizes.sparkSession.sparkContext.defaultParallelism, "document_id")  # little data, much work: AQE would put it into few tasks
        .groupBy("document_id")
        .agg(F.collect_list(F.struct("rest", "n")).alias("bars"), F.sum("full").alias("full"))
    )
    ship(sizes.sparkSession)
    schema = T.StructType.fromDDL(
        "document_id BIGINT, full BIGINT, perfect BOOLEAN, patterns ARRAY<STRUCT<first: BIGINT, times: BIGINT, tokens: INT, tier: INT, items: ARRAY<STRUCT<size: INT, k: INT>>>>"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, full, bars in zip(b["document_id"], b["full"], b["bars"]):
                hist = {int(x["rest"]): int(x["n"]) for x in bars if x["rest"] > 0}
                found, perfect = pack(hist, capacity)
                first, out = int(full) + 1, []
                for times, items in found:
                    out.append({"first": first, "times": times, "tokens": sum(s * k for s, k in items), "tier": tier_of(max(s for s, _ in items), capacity), "items": [{"size": s, "k": k} for s, k in items]})
                    first += times
                rows.append((d, int(full), perfect, out))
            yield pd.DataFrame({"document_id": pd.array([r[0] for r in rows], dtype="Int64"), "full": [r[1] for r in rows], "perfect": [r[2] for r in rows], "patterns": [r[3] for r in rows]})

    return hist.mapInPandas(run, schema)


def containers(nodes: DataFrame, capacity: int = 1024, group: int = 8) -> DataFrame:
    """(document_id, container, fill, step_group, node_id, part, tokens, tier), one row per node and container.

    Each document is packed on its own; a null document_id is a document like any other.  A node above
    the capacity first fills whole containers (part 1, 2, ...) and its rest is packed; all other nodes
    stay whole.  tier is that of the longest item of the container: 1 for the whole context, 2 to 4 for a half,
    a quarter and an eighth of it.  Nodes of size 0, with a null id, and repeats of an id are left out; of rows that share an id and differ the least counts.
    step_group deals the containers of a document out over `group` training steps: patterns come by
    falling length of their longest item, so going back and forth over the steps balances them.
    """
    stage = Stage(nodes.sparkSession, "packing")
    sizes = stage.write(item_sizes(nodes), "sizes")
    plans = stage.write(_plans(sizes, capacity), "plans")
    rows = sizes.count()
    cut = sizes.withColumn("full", F.when(F.col("size") > capacity, F.floor(F.col("size") / capacity)).otherwise(0).cast("bigint"))
    cut = cut.withColumn("rest", (F.col("size") - F.col("full") * capacity).cast("int"))

    # whole containers: numbered 1.. in the order of a hash, by the running total of a node's full containers
    big = running_total(cut.filter("full > 0"), ["document_id"], F.xxhash64("id"), ["id"], F.col("full"), "before", rows)
    whole = big.select("document_id", "id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("full"))).alias("part"), "before").select(
        "document_id", (F.col("before") + F.col("part")).alias("container"), F.lit(capacity).alias("fill"), F.col("id").alias("node_id"), F.col("part").cast("int").alias("part"), F.lit(capacity).alias("tokens"), F.lit(1).alias("tier")
    )

    # of each document and size, which ranks go into which pattern
    uses = plans.select("document_id", F.posexplode("patterns").alias("p_no", "p")).select(
        "document_id", "p_no", "p.first", "p.times", F.col("p.tokens").alias("fill"), "p.tier", F.explode("p.items").alias("i")
    ).select("document_id", "p_no", "first", "times", "fill", "tier", "i.size", "i.k")
    slots = uses.groupBy(F.col("document_id").alias("u_document_id"), F.col("size").alias("u_size")).agg(
        F.sort_array(F.collect_list(F.struct("p_no", "first", "times", "fill", "k", "tier"))).alias("slots")
    )
    # the rank at which each pattern's share of the size begins
    zero = F.struct(F.lit(0).cast("bigint").alias("upto"), F.array().cast("array<struct<lo:bigint,hi:bigint,first:bigint,fill:int,k:int,tier:int>>").alias("a"))
    ranges = F.aggregate(
        "slots", zero,
        lambda acc, x: F.struct(
            (acc["upto"] + x["times"] * x["k"]).alias("upto"),
            F.concat(acc["a"], F.array(F.struct(acc["upto"].alias("lo"), (acc["upto"] + x["times"] * x["k"]).alias("hi"), x["first"].alias("first"), x["fill"].alias("fill"), x["k"].alias("k"), x["tier"].alias("tier")))).alias("a"),
        ),
    )["a"]
    slots = slots.select("u_document_id", "u_size", ranges.alias("ranges"))
    ranked = running_total(cut.filter("rest > 0").select("id", "document_id", "rest", "full"), ["document_id", "rest"], F.xxhash64("id"), ["id"], F.lit(1).cast("bigint"), "rank", rows)
    packed = ranked.join(slots, F.col("document_id").eqNullSafe(F.col("u_document_id")) & (F.col("rest") == F.col("u_size"))).withColumn(
        "r", F.get(F.filter("ranges", lambda x: (x["lo"] <= F.col("rank")) & (F.col("rank") < x["hi"])), F.lit(0))
    ).select(
        "document_id", (F.col("r.first") + F.floor((F.col("rank") - F.col("r.lo")) / F.col("r.k"))).alias("container"), F.col("r.fill").alias("fill"),
        F.col("id").alias("node_id"), (F.col("full") + 1).cast("int").alias("part"), F.col("rest").alias("tokens"), F.col("r.tier").alias("tier"),
    )
    # the patterns come by falling length of their longest item; serpentine over rows of `group` containers
    lap, place = F.floor((F.col("container") - 1) / group), F.pmod(F.col("container") - 1, F.lit(group))
    step = F.when(F.pmod(lap, F.lit(2)) == 0, place).otherwise(group - 1 - place)
    return whole.unionByName(packed).select(
        "document_id", "container", "fill", (step + 1).cast("int").alias("step_group"), "node_id", "part", "tokens", "tier"
    )


def perfect(nodes: DataFrame, capacity: int = 1024) -> DataFrame:
    """(document_id): the documents whose nodes fill all their containers exactly, from the packing.

    A document without a node of positive size has no container and isn't listed; nor is the null document."""
    return _plans(item_sizes(nodes), capacity).filter("perfect AND document_id IS NOT NULL AND full + size(patterns) > 0").select("document_id")
