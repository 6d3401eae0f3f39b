from quire.operators import qa

SCHEMA = "id BIGINT, document_id BIGINT, status STRING, source_text STRING, translation_text STRING, warning_flags STRING, terminology MAP<STRING, STRING>"


def check(spark, source, translation, status="done", flags=None, terms=None):
    r = qa.findings(spark.createDataFrame([(1, 1, status, source, translation, flags, terms)], SCHEMA)).first()
    return r.qa_status, [f.code for f in r.findings]


def test_checks(spark):
    table = "<table><tr><td>0.05</td></tr></table>"
    assert check(spark, table, table) == ("pass", [])
    status, codes = check(spark, table, table.replace("0.05", "0.5"))
    assert status == "fail" and "html_table_mutated" in codes
    status, codes = check(spark, "A value of 0.05 was found [12] in Fig. 3.", "发现了 0.5 的值，见图 3。")
    assert status == "warn" and codes == ["number_mismatch", "citation_mismatch"]
    assert check(spark, "text", "", status="fallback") == ("fallback", ["fallback"])
    assert check(spark, "text", "x", flags="fallback_used")[0] == "fallback"
    assert check(spark, "a" * 200, "字")[1] == ["length_ratio"]
    assert check(spark, "# A\n\n# B", "# 甲")[1] == ["structure_heading"]
    assert check(spark, "See https://a.b/c and 1999 data", "见相关的数据说明部分和附录")[1] == ["structure_preserve", "number_mismatch", "year_mismatch", "url_mismatch"]
    assert check(spark, "an affordance here", "此处的affordance很多很多", terms={"affordance": "示能"})[1] == ["terminology"]
    assert check(spark, None, None) == ("pass", [])


def test_summary(spark):
    rows = [(1, 1, "done", "a b", "a b", None, None), (2, 1, "fallback", "a", "a", None, None), (3, 2, "done", "# A", "A", None, None), (4, None, "done", "x", "x", None, None)]
    got = {r.document_id: r.verdict for r in qa.summary(qa.findings(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {1: "warnings", 2: "failed", None: "pass"}
