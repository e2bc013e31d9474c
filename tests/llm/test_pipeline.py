"""The stages of the pipeline on their own input, and the registered queries."""

import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages(spark):
    import corpus_pipeline as c
    from spandrel.llm.queries import held_out
    from spandrel.runtime import table

    docs = table(spark, DATA, "documents")
    kept = {name: None for name, _ in c.STAGES}
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, DATA).persist()
        assert docs.columns == list(c.COLUMNS)
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert kept[name] <= before and len(kept[name]) > 0.5 * len(before)
        before = kept[name]
    packed = c.STAGES[-1][1](spark, docs, DATA)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == before
    empty = docs.where("doc_id < 0")
    for _, stage in c.STAGES:
        assert stage(spark, empty, DATA).count() == 0
    assert docs.where(held_out()).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_url_sql(spark):
    import duckdb

    from spandrel.llm.queries import OP5_SQL, op5_url_filters

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    columns = ["page_id", "host", "path", "rule", "verdict"]
    want = sorted(map(str, con.sql(f"SELECT {', '.join(columns)} FROM ({OP5_SQL})").fetchall()))
    assert sorted(str(tuple(r)) for r in op5_url_filters(spark, DATA).select(*columns).collect()) == want
