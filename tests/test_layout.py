import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_core_imports_nothing_of_llm():
    files = [ROOT / "__spark_entry__.py", *(p for p in (ROOT / "quire").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts), *(p for p in (ROOT / "tests").glob("*.py"))]
    for p in files:
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not [n for n in names if n.startswith("quire.llm")], p


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
