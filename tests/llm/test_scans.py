from quire.llm.scans import confusions, found, has_layout, page_number, pages_of, paragraphs, skeleton, skeleton_column

SCHEMA = "id BIGINT, document_id BIGINT, node_type STRING, source_pages STRING, source_text STRING, line_no STRING"
CLEAN = (
    "The discharge curve limits the bank erosion whenever the sediment load is modest, and the same holds for the control group. "
    "A well-documented spillway crest is easier to inspect than a complete channel roughness, although the scatter remains large. "
    "It is tempting to identify the base flow with the gauge height if the sample is dry. "
)
SCAN = """RIVERS AND THEIR RECORDS  3
The discharge curve limits the bank ero-
sion whenever the sediment loacl is modest, and the sarne holds
for the control group. A well-
documented spillway crest is easier to inspect than a com¬
3
Rivers and Their Recorcls
plete channel roughness."""


def rows():
    out = [(i, 1, "paragraph", "1", CLEAN, "c") for i in range(1, 8)]
    out += [(20, 1, "heading", "1", "# Rivers and Their Records\n", "c"), (30, 1, "paragraph", "p. 3", SCAN, "c"), (30, 1, "paragraph", "p. 3", SCAN, "c")]
    out += [(31, 1, "paragraph", "4", "NOTE ON BASE FLOW\n" + CLEAN, "c"), (32, 1, "paragraph", "5", "The counts were:\n8313\n4072\nThe base flow is dry.", "c")]
    out += [(33, 1, "paragraph", None, None, "c"), (34, 1, "paragraph", None, "", "c"), (None, 1, "paragraph", "3", SCAN, "c"), (35, None, "paragraph", "9", "The base flow is modest.\n9", "c")]
    return out


WANT = {
    (30, 1, "header"), (30, 2, "hyphen"), (30, 3, "characters"), (30, 5, "hyphen"), (30, 6, "page_number"), (30, 7, "header"), (35, 2, "page_number"),
}


def test_found_and_paragraphs(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = [tuple(r) for r in found(df).collect()]
    assert len(got) == len(set(got)) and set(got) == WANT
    text = {r.node_id: r.text for r in paragraphs(df).collect() if r.paragraph_no == 1}
    assert text[30] == (
        "The discharge curve limits the bank erosion whenever the sediment load is modest, and the same holds for the control group. "
        "A well- documented spillway crest is easier to inspect than a complete channel roughness."
    ).replace("well- ", "well-")
    assert text[32].startswith("The counts were: 8313 4072")


def test_empty_and_null(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert found(df.limit(0)).count() == 0 and paragraphs(df.limit(0)).count() == 0
    only = spark.createDataFrame([(1, None, None, None, None, None), (2, None, "paragraph", None, "x" * 300_000, None)], SCHEMA)
    assert found(only).count() == 0


def test_parts(spark):
    assert confusions("loacl", "load") == 1 and confusions("sarne", "same") == 1 and confusions("gauge", "gouge") == 1 and confusions("cat", "dog") >= 99
    for line, pages, want in (
        ("163", "163-163", True), ("— 49 —", "49", True), ("  l  ", "1", True), ("[357]", "pp. 357-358", True), ("Page 3 of 15", "3", True), ("Pogc 3", "3", True), ("36l", "361", True),
        ("5373", "5", False), ("3 / 9", "3,4", True), ("p. 170", "170", True), ("第 3 页", "3", True), ("13", None, True), ("5373", None, False), ("Reading", "3", False), ("4", "5–6", False),
    ):
        assert page_number(line, pages_of(pages)) == want, line
    assert has_layout("a\nb") and not has_layout("x" * 101) and not has_layout("字" * 51)
    words = ["modest", "rnodest", "Recorcls", "w!th", "vvith", "hum", "bum", "7he"]
    df = spark.createDataFrame([(w,) for w in words], "w STRING")
    assert [r.s for r in df.select(skeleton_column(df.w).alias("s")).collect()] == [skeleton(w) for w in words]


def test_a_wide_line_does_not_hide_the_others(spark):
    wide = "This line is far wider than any page has room for, as it was put in from a table whose rows stand in one line each of the text."
    word = "w" * 50 + "ood"
    good = " ".join(["the river bank measurement is clean and " + word] * 20)
    rows = [(k, 1, "paragraph", None, good, 0) for k in range(4)]
    rows.append((9, 1, "paragraph", "3", "The river bank measure-\nment is clean\nand thc bank is clean\nand " + word.replace("ood", "o0d") + " is clean\n\n" + wide, 0))
    df = spark.createDataFrame(rows, "id BIGINT, document_id BIGINT, node_type STRING, source_pages STRING, source_text STRING, line_no INT")
    got = {(r.node_id, r.line_no, r.noise_kind) for r in found(df).collect()}
    assert got == {(9, 1, "hyphen"), (9, 3, "characters"), (9, 4, "characters")}


def test_confusions_of_long_words():
    assert confusions("x" * 5000 + "rn" + "y" * 5000, "x" * 5000 + "m" + "y" * 5000) == 1
    assert confusions("bank", "bank") == 0 and confusions("clock", "dock") == 1 and confusions("bonk", "bank") == 1 and confusions("dog", "cat") == 99
