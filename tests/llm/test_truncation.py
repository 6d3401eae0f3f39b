import json
import random

from quire.llm.truncation import REASONS, by_source, ending, found, judged

SCHEMA = "doc_id BIGINT, source STRING, text STRING, kind STRING"
WORDS = "selection bias residual variance sampling error outlier score confidence interval likelihood ratio prior estimate".split()


def corpus(rng):
    rows, cut, i = [], set(), 0

    def add(source, text, is_cut):
        nonlocal i
        i += 1
        rows.append((i, source, text, "clash"))
        if is_cut:
            cut.add(i)

    def prose(n=3):
        return " ".join(" ".join(["The", *rng.sample(WORDS, 5)]) + "." for _ in range(n))

    for _ in range(120):
        add("prose", prose(), False)
        add("list", prose() + "\n\n" + "\n".join("- " + " ".join(rng.sample(WORDS[:6], 2)) for _ in range(4)), False)
        add("log", "\n".join(f"- {rng.randint(10, 20)}:{rng.randint(10, 59)} checked the {rng.choice(WORDS)} part, {rng.randint(1, 99)} units {rng.choice(['pending', 'finished', 'repaired'])}" for _ in range(8)), False)
        add("head", prose() + "\n\n## Notes on " + rng.choice(WORDS), False)
        add("head", "# Notes on " + rng.choice(WORDS) + "\n\n" + prose(), False)
        add("json", json.dumps({"key": i, "text": prose()}), False)
    full = prose(40)
    for k in range(30):
        add("prose", prose() + " The residual var", True)
        add("prose", prose() + " The selection bias of", True)
        add("log", rows[2][2] + f"\n- 12:{10 + k} checked the bias part, 7 units", True)
        add("log", rows[2][2] + f"\n- 12:{10 + k} checked the like", True)
        add("list", prose() + "\n\n- selection bias\n- residual varia", True)
        add("json", json.dumps({"key": i, "text": prose()})[:-9], True)
        add("limit", full[: 500 + 7 * k], not full[: 500 + 7 * k].rstrip().endswith("."))
    for text, is_cut in (
        ("A\n```\nx = 1", True), ("A\n```\nx = 1\n```", False), ("$$\nx = 1", True), ("$$\nx\n$$", False), ("\\[ x = ", True), ("\\[ x \\]", False), ("| a | b |\n| --- | --- |\n| 1 | 2 |", False),
        ("| a | b |\n| --- | --- |\n| 1 |", True), ("| a | b |\n| --- | --- |\n| 1 | 2", True), ("<table><tr><td>1</td></tr></table>", False), ("<table><tr><td>1", True), ("![a](b.png)", False), ("![a](b.p", True),
        ("---\nstatus: active\n", True), ("---\na: b\n---\n\nDone.", False), ("It stopped in the mid …", True), ("It stopped in the mid [...]", True), ("It stopped in (more)", True), ("- item one ... [...]", True), ("档案中保存了读数。", False), ("样品是干的。档案中保存了读", True), ("档案中保存了读", False), ("档案中保存�", True),
        ("As shown in Fig.", True), ("He said “no.”", False), ("It holds [12].", False), ("Is it?", False), ("   \n", False), ("", False), (None, False),
    ):
        add("forms", text, is_cut)
    return rows, cut


def test_planted_cases(spark):
    rows, cut = corpus(random.Random(11))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id for r in found(df).collect()}
    by = {r[0]: r for r in rows}
    assert not [by[d] for d in got - cut], "flagged"
    assert not [by[d] for d in cut - got], "missed"
    report = {r.source: r for r in by_source(df).collect()}
    assert report["prose"].cut == 60 and report["forms"].texts == 27
    assert judged(df).count() == sum(r.texts for r in report.values())


def test_copies_nulls_and_empty(spark):
    rows = [(1, None, "It stood. It was cut in the mid", "c"), (1, None, "It stood. It was cut in the mid", "c"), (2, "s", "Whole. " * 40_000, "c"), (None, "s", "One end. No end, as", "c"), (3, "s", "x" * 100_000, "c"), (4, "s", "a(" * 50_000, "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id for r in found(df).collect()} == {1, None, 4}
    assert found(df).count() == 3 and found(df.limit(0)).count() == 0


def test_complete_forms_at_a_limit():
    assert ending("x" * 990 + " whole.")[0] == "complete"
    assert ending('{"a": "b",\n "c": "d"\n}')[0] == "complete"
    assert ending('{"a": "b')[0] == "cut"


def test_prose_without_a_stop_is_compared_with_its_source(spark):
    rng, rows, cut = random.Random(3), [], set()

    def phrase():
        return " ".join(["The", *rng.sample(WORDS, 5)])

    def add(text, is_cut):
        rows.append((len(rows), "captions", text, "clash"))
        if is_cut:
            cut.add(rows[-1][0])

    for _ in range(200):  # paragraphs of this source often have no full stop
        add("\n\n".join(phrase() + rng.choice(["", "."]) for _ in range(4)), False)
    for _ in range(10):
        add(phrase() + ".\n\nThe residual confid", True)  # an unknown proper prefix
        add(phrase() + ".\n\nThe residual variance,", True)
    for _ in range(200):
        add((phrase() + ".\n\n" + " ".join(phrase() for _ in range(20)))[:400].rstrip(".").ljust(400, "x")[:392] + " outlier", True)  # a pile-up
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id for r in found(df).collect()}
    assert got == cut


WHOLE = [
    "Dear team, thanks a lot\n\nBest regards,\n{name}", "Thank you for the note.\n\nKind regards,\n{name}", "It was sent on time.\n{name}", "A caption without stop", "Figure {n}: {title}",
    "Approved by the board, {n} May", "{title}", "# {title}\n\nThe end\nof a road\nby the sea", "Roses are red\nViolets are blue\nThe {noun} is old\nAnd so are you", "Signed for the office\n\n{name} {name}",
    "The report is whole. It was read.\n\n{title}", "All units are done.\n\nPrepared by {name}", "图{n} 总体示意图", "全文已经校对。\n\n此致\n敬礼", "The {noun} seen from the north side of the harbour", "{title} by {name}",
]
NAMES = "Anna Bert Selma Residu Vari Esti Prio Olga Kim Noor".split()  # some begin known words
NOUNS = "bias variance error score interval ratio estimate".split()


def whole(rng):
    title = " ".join(rng.choice(["Overview", "Selection", "Residual", "Prior", "Notes", "Outlier"]) for _ in range(rng.randint(2, 4)))
    return rng.choice(WHOLE).format(name=rng.choice(NAMES), n=rng.randint(1, 99), noun=rng.choice(NOUNS), title=title)


def test_whole_texts_without_a_stop_are_no_case(spark):
    rng = random.Random(5)
    rows, cut = corpus(rng)
    first = max(r[0] for r in rows) + 1
    # among the texts of all sources, of which some always end with a stop, and in a source of their own
    rows.append((0, "prose", "They went past the stop.", "clash"))  # else it could only be a part of 'stopped'
    added = [(first + k, rng.choice(["prose", "list", "log", "head", "notes"]), whole(rng), "clash") for k in range(400)]
    flagged = {r.doc_id for r in found(spark.createDataFrame(rows + added, SCHEMA)).collect()}
    assert not [r for r in added if r[0] in flagged]
    assert len(cut & flagged) >= 0.98 * len(cut)


def test_evidence_by_kind(spark):
    rows, cut = corpus(random.Random(2))
    report = by_source(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.cut == sum(r[f"by_{k}"] for k in REASONS) for r in report)
    assert sum(r.by_word for r in report) >= 60


def test_long_lines_and_words_reach_the_trie(spark):
    long = "the " + "very long line of the list " * 8
    word = "a" * 90 + "b" * 30
    rows = [(k, "s", f"Begin.\n\n- {long}part {k % 3}\n- {word} one\n- last one of all {k}", "c") for k in range(6)]
    rows += [(10, "s", f"Begin.\n\n- {long[:139]}", "c"), (11, "s", "Begin.\n\n- " + word[:100], "c"), (12, "s", f"Begin.\n\n- {word} one", "c")]
    assert {r.doc_id: r.reason for r in judged(spark.createDataFrame(rows, SCHEMA)).filter("is_cut").collect()} == {10: "line", 11: "word"}
