from collections import defaultdict

import pytest

pytest.importorskip("public_tokenizers")
from quire.llm.mixing import mixture, shares  # noqa: E402

DOCS = "doc_id BIGINT, source STRING, text STRING, tokens STRING"
TARGETS = "source STRING, target_share DOUBLE, max_repeats BIGINT"


def frames(spark):
    rows = [(i, "big", "word " * (1 + i % 7), "c") for i in range(600)] + [(1000 + i, "small", "word " * 3, "c") for i in range(40)]
    rows += [(2000 + i, "mid", "word word", "c") for i in range(150)] + [(3000, "other", "not listed", "c"), (3001, "big", None, "c"), (3002, "big", "", "c"), (3003, None, "x", "c")]
    rows += [(1, "big", "word", "c")]  # a repeated id is another record
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([("big", 0.4, 2), ("small", 0.3, 3), ("mid", 0.3, 50), ("absent", 0.0, 1)], TARGETS)


def test_shares_and_caps(spark):
    docs, targets = frames(spark)
    used = mixture(docs, targets).collect()
    total, available = defaultdict(int), defaultdict(int)
    uses = defaultdict(list)
    for r in used:
        total[r.source] += r.tokens
        uses[r.source, r.doc_id].append(r.repeat_no)
    report = {r.source: r for r in shares(docs, targets).collect()}
    for s in ("big", "small", "mid"):
        available[s] = report[s].available_tokens
        assert report[s].used_tokens == total[s]
    budget, spent = sum(available.values()), sum(total.values())
    assert budget - 10 <= spent <= budget
    assert total["small"] == 3 * available["small"]  # all of its repeats, still below its share
    rest = budget - total["small"]
    assert abs(total["big"] - rest * 4 / 7) <= 10 and abs(total["mid"] - rest * 3 / 7) <= 10
    assert all(sorted(v)[-1] <= {"big": 2, "small": 3, "mid": 50}[s] for (s, _), v in uses.items())
    assert report["absent"].used_tokens == 0
    assert not {r.doc_id for r in used} & {3000, 3001, 3002, 3003}


def test_passes_come_in_turn_and_result_is_fixed(spark):
    docs, targets = frames(spark)
    a = {(r.doc_id, r.repeat_no) for r in mixture(docs, targets).collect() if r.doc_id != 1}
    assert a == {(r.doc_id, r.repeat_no) for r in mixture(docs.repartition(7), targets).collect() if r.doc_id != 1}
    for d, k in a:
        assert k == 1 or (d, k - 1) in a


def test_brute_force_order(spark):
    docs, targets = frames(spark)
    rows = mixture(docs, targets).orderBy("finish", "source", "doc_id", "repeat_no").collect()
    by = defaultdict(int)
    for r in rows:  # the virtual time is the tokens so far by the share
        by[r.source] += r.tokens
        assert abs(r.finish - by[r.source] / {"big": 0.4, "small": 0.3, "mid": 0.3}[r.source]) < 1e-6


def test_empty(spark):
    docs, targets = frames(spark)
    assert mixture(docs.limit(0), targets).count() == 0 and mixture(docs, targets.limit(0)).count() == 0
    assert shares(docs.limit(0), targets).count() == 4
