import base64
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import tiktoken  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from quire.llm.tokenizer import PerfectHash, count_tokens, default_encoder, encode, merge  # noqa: E402

TEXTS = ["", " ", "Hello  world\n\n  x", "档案中保存了27,552条先验分布读数。", "naïve café ẞ ﬁ", "a" * 500, "🙂🙃‍👩‍👧", "<|endoftext|> x", "​﻿\u0000�", "I'll we've 3.14 ¬\xad", "\r\n\t" * 9]


@pytest.fixture(scope="module")
def others():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    h = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    h.encode_special_tokens = True
    return t, h


def test_equal_to_two_libraries(others):
    t, h = others
    e, rng = default_encoder(), random.Random(3)
    alphabet = "abcdefgh  THE123.,'\n中文字符éß🙂́"
    for text in TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(400)]:
        ids = e.encode(text)
        assert ids == t.encode_ordinary(text) == h.encode(text, add_special_tokens=False).ids
        assert t.decode(ids) == text


def test_every_entry_is_found_or_merged():
    e = default_encoder()
    whole = [k for k in e.ranks if e.table.get(k) is not None]
    assert len(whole) > 0.9 * len(e.ranks)
    for k in random.Random(1).sample(whole, 2000):
        assert e.table.get(k) == e.ranks[k] and (len(k) == 1 or merge(k, e.ranks) == [e.ranks[k]])


def test_perfect_hash_is_minimal_and_rejects_strangers():
    items = {f"k{i}".encode(): i for i in range(3000)}
    h = PerfectHash(items)
    assert len(h.keys) == len(items) and sorted(h.keys) == sorted(items)
    assert all(h.get(k) == v for k, v in items.items()) and all(h.get(f"x{i}".encode()) is None for i in range(3000))
    assert PerfectHash({}).get(b"a") is None


def test_frames(spark):
    rows = [(1, None, "clash"), (2, "", "c"), (3, "word word", "c"), (3, "word word", "c"), (None, "x", "c"), (5, "long " * 50_000, "c")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, ids STRING")
    got = [(r.doc_id, len(r.ids)) for r in encode(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (2, 0), (3, 2), (3, 2), (None, 1), (5, 50_001)], key=str)
    assert encode(df.limit(0)).count() == 0 and encode(df).schema["ids"].dataType.simpleString() == "array<int>"
    assert sorted(r.tokens for r in count_tokens(df, ["doc_id"]).collect()) == [0, 0, 1, 2, 2, 50_001]
