"""The entry module: names, SQL, and that it works without the subpackage llm."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_sql_has_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_llm(tmp_path):
    shutil.copytree(os.path.join(ROOT, "spandrel"), tmp_path / "spandrel", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'orders_summary' in q and not any(n.startswith('op') for n in q if n[2:3].isdigit()) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_queries_against_sql(spark):
    import duckdb

    from spandrel.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    text = lambda rows: sorted(repr(tuple(map(str, r))) for r in rows)
    for name in ("orders_summary", "orders_cells_changed", "lineitem_duplicate_keys", "part_type_changed_cells", "events_null_key_cells", "customer_schema_diff", "events_props_findings", "orders_document_findings", "orders_unordered_findings"):
        got = QUERIES[name](spark, DATA)
        columns = sorted(got.columns)
        want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLE_SQL[name]})").fetchall()
        assert text(got.select(*columns).collect()) == text(want), name
