import random
import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.splitting import Estimate, cut_level, cuts, found, split_nodes, split_text

WIDE = re.compile("[㐀-鿿豈-﫿぀-ヿ가-힯]")


def tokens(s):
    if not s:
        return 0
    c = len(WIDE.findall(s))
    return max(1, math.floor(c * 0.6 + (len(s) - c) * 0.3 + 0.999))


def brute_level(text, limit):
    paragraphs = re.split(r"\n(?:[^\S\n]*\n)+", text)
    if all(tokens(p.strip()) <= limit for p in paragraphs):
        return "paragraph"
    sentences = [s for p in paragraphs for s in re.split(r"(?<=[。！？])|(?<=[.!?])(?=\s+[A-Z])", p)]
    if all(tokens(s.strip()) <= limit for s in sentences):
        return "sentence"
    return "word" if all(tokens(w) <= limit for w in text.split()) else "none"


TEXT = st.lists(st.sampled_from(["alpha ", "Beta. ", "gamma", "\n", "\n\n", "\n \n", "档案中", "。", "What? ", "x" * 40, "e.g. this ", "！", " "]), max_size=120).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_level_and_pieces(text):
    limit, overlap = 30, 6
    assert cut_level(text, limit) == brute_level(text, limit)
    e = Estimate(text)
    if e(0, len(text)) <= limit:
        return
    pieces = split_text(text, limit, overlap)
    assert "".join(text[s:z] for _, s, z, _ in pieces) == text
    for k, (b, s, z, _) in enumerate(pieces):
        assert b <= s < z and tokens(text[b:z]) <= limit
        assert tokens(text[b:s]) <= overlap and (k > 0 or b == s == 0)
        if k:
            assert b >= pieces[k - 1][0] and (s == b or tokens(text[max(0, b - 60) : s]) >= min(overlap * 0.5, tokens(text[b:s])))


def test_cuts_are_nested_and_topic_wins():
    text = "\n\n".join(["cats purr and cats sleep and cats purr"] * 4 + ["engines burn fuel and engines roar"] * 4)
    assert set(cuts(text, "paragraph")) <= set(cuts(text, "sentence")) and set(cuts(text, "paragraph")) <= set(cuts(text, "word"))
    first = split_text(text, 70, 0)[0]
    assert text[first[2] :].startswith("engines")


def test_frames(spark):
    long = "Word after word. " * 300
    rows = [
        (1, "paragraph", long, 5, "c"), (1, "paragraph", long, 5, "c"), (2, "code", long, 5, "c"), (3, "paragraph", None, 5, "c"), (4, "paragraph", "", 5, "c"),
        (5, None, "字" * 2_000, None, "c"), (None, "paragraph", long, 5, "c"), (6, "list", "short", 9_999, "c"), (7, "paragraph", "y" * 60_000, 1, "c"),
    ]
    df = spark.createDataFrame(rows, "id BIGINT, node_type STRING, source_text STRING, token_count BIGINT, cut_level STRING")
    assert {(r.node_id, r.cut_level) for r in found(df).collect()} == {(1, "sentence"), (5, "none"), (7, "none")} and found(df).count() == 3
    pieces = split_nodes(df).orderBy("node_id", "piece_no").collect()
    assert all(r.tokens <= 600 and r.tokens == tokens(r.text) for r in pieces)
    assert "".join(long[r.new_start : r.text_end] for r in pieces if r.node_id == 1) == long
    assert found(df.limit(0)).count() == 0


def test_the_cut_lies_between_two_topics():
    rng = random.Random(4)
    topics = ["river bank flood gauge silt plain water erosion slope bed".split(), "token router packet queue buffer link delay cache socket frame".split()]
    hits = 0
    for _ in range(30):
        parts = [" ".join("The " + " ".join(rng.choices(topics[k], k=8)) + "." for _ in range(rng.randint(18, 26))) for k in (0, 1)]
        text = parts[0] + " " + parts[1]
        ends = [end for _, _, end, _ in split_text(text, 600, 60)]
        hits += len(parts[0]) + 1 in ends
    assert hits >= 27
