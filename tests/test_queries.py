"""Every query runs on the smallest tables and, where it has a statement, equals it in DuckDB."""

import subprocess
import sys
from collections import Counter
from decimal import Decimal
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.support import DATA, duck

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def shown(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, Decimal)):
        return round(float(v), 6)
    return str(v)


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


def test_statements_belong_to_queries():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 60


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(shown(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    if name in SQL:
        rel = con.sql(SQL[name])
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert got == Counter(tuple(shown(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["outcome_id", "accession"]


def test_core_stands_without_the_text_subpackage():
    root = Path(__file__).parent.parent
    for p in (root / "ledgerline").rglob("*.py"):
        if "llm" not in p.parts:
            assert "ledgerline.llm" not in p.read_text() and "from ..llm" not in p.read_text()
    code = "import sys; sys.modules['ledgerline.llm'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
