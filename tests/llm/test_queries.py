from quire.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_every_query_has_its_columns(spark):
    want = {
        "p1_found": {"node_id", "line_no", "noise_kind"}, "p2_found": {"unit_id", "source_no", "target_no"}, "p3_found": {"node_id", "cut_level"}, "p4_found": {"document_id"},
        "p6_ids": {"doc_id", "ids"}, "p8_found": {"doc_id"},
    }
    for name, columns in want.items():
        df = QUERIES[name](spark, SMALL)
        assert set(df.columns) == columns and df.count() > 0, name
    assert QUERIES["p7_shares"](spark, SMALL).count() == 8
