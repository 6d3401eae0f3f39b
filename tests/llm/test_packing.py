import itertools
import random
from collections import Counter, defaultdict

from quire.llm.packing import _least_containers, containers, exact, pack, perfect, route, tier_of, tiered

SCHEMA = "id BIGINT, document_id BIGINT, token_count BIGINT, source_text STRING, container STRING"


def brute(sizes, cap):
    """Whether the items fill containers exactly, by trying all."""
    if not sizes or sum(sizes) % cap:
        return False
    if sum(sizes) == cap:
        return True
    first, rest = sizes[0], sizes[1:]
    for n in range(len(rest) + 1):
        for c in itertools.combinations(range(len(rest)), n):
            if first + sum(rest[i] for i in c) == cap:
                left = [x for i, x in enumerate(rest) if i not in c]
                if not left or brute(left, cap):
                    return True
    return False


def test_exact_against_brute_force():
    rng, seen = random.Random(2), Counter()
    for _ in range(1500):
        cap = rng.choice([8, 12, 20])
        sizes = [rng.randint(1, cap) for _ in range(rng.randint(1, 8))]
        if rng.random() < 0.6 and sum(sizes) % cap:
            sizes.append(cap - sum(sizes) % cap)
        want = brute(sizes, cap)
        got = exact(dict(Counter(sizes)), cap)
        assert (got is not None) == want
        assert pack(dict(Counter(sizes)), cap)[1] == want
        seen[want] += 1
    assert min(seen.values()) > 100


def test_patterns_use_each_item_once():
    rng = random.Random(4)
    for n in (1, 30, 3000):
        hist = Counter(rng.randint(1, 1024) for _ in range(n))
        for p in (tiered(dict(hist), 1024), pack(dict(hist), 1024)[0]):
            used = Counter()
            for times, items in p:
                assert times > 0 and sum(s * k for s, k in items) <= 1024
                for s, k in items:
                    used[s] += k * times
            assert used == hist
        least = _least_containers(dict(hist), 1024)
        assert least <= sum(t for t, _ in tiered(dict(hist), 1024)) <= 1.12 * least + 1


def test_large_perfect_group():
    rng, sizes = random.Random(7), []
    for _ in range(400):  # each container is cut into parts
        cut = sorted(rng.sample(range(1, 1024), rng.randint(1, 6)))
        sizes += [b - a for a, b in zip([0, *cut], [*cut, 1024])]
    assert exact(dict(Counter(sizes)), 1024) is not None


def test_frames(spark):
    rng = random.Random(9)
    rows = [(i, 1, rng.randint(1, 900), "t", "x") for i in range(1, 400)]
    rows += [(1000, 2, 3000, "t", "x"), (1001, 2, 72, "t", "x"), (1001, 2, 72, "t", "x"), (1002, 3, None, "a" * 100, "x"), (1003, 3, 0, None, "x"), (1004, None, 1024, "t", "x"), (None, 2, 5, "t", "x"), (1005, 4, 2048, "t", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.document_id for r in perfect(df).collect()} == {2, 4}
    out = containers(df).collect()
    fill, parts = defaultdict(int), defaultdict(int)
    for r in out:
        fill[r.document_id, r.container] += r.tokens
        parts[r.node_id] += r.tokens
        assert 1 <= r.step_group <= 8 and 1 <= r.tier <= 4
    assert all(v <= 1024 for v in fill.values()) and all(fill[r.document_id, r.container] == r.fill for r in out)
    want = {r[0]: (r[2] or (30 if r[3] else 0)) for r in rows if r[0] is not None}
    assert dict(parts) == {k: v for k, v in want.items() if v}
    assert perfect(df.limit(0)).count() == 0 and containers(df.limit(0)).count() == 0


def test_no_step_limit_decides():
    """Three fillings without waste that the largest-first part starts wrong; their number doesn't matter."""
    for m in (10, 3000):
        hist = {600: m, 212: 2 * m, 310: m, 238: 3 * m, 114: m, 455: 2 * m}
        found, used = exact(hist, 1024), Counter()
        for times, items in found:
            assert sum(s * k for s, k in items) == 1024
            for s, k in items:
                used[s] += k * times
        assert used == hist


def test_no_perfect_file_is_missed():
    rng = random.Random(3)
    for _ in range(120):
        sizes = []
        for _ in range(rng.choice([10, 20, 30, 50, 80, 120, 200, 300, 500])):
            cut = sorted(rng.sample(range(20, 1004), rng.randint(1, 4)))
            sizes += [b - a for a, b in zip([0, *cut], [*cut, 1024])]
        patterns, full = pack(dict(Counter(sizes)), 1024)
        assert full and sum(t for t, _ in patterns) * 1024 == sum(sizes)


def test_items_are_routed_to_the_shortest_window():
    assert [tier_of(s, 1024) for s in (1024, 513, 512, 257, 256, 129, 128, 1)] == [1, 1, 2, 2, 3, 3, 4, 4]
    assert route({600: 2, 300: 1, 100: 5}, 1024) == [{600: 2}, {300: 1}, {}, {100: 5}]
    # a long window's gap is filled from the shorter tiers before these open containers of their own
    assert tiered({600: 2, 300: 2, 124: 3}, 1024) == [(2, [(600, 1), (300, 1), (124, 1)]), (1, [(124, 1)])]
