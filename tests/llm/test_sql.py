"""Queries of the training-data operators against their SQL, and the pipeline's contract."""

import duckdb
import pytest
from test_queries import SF, compare, duck  # noqa: F401

import __spark_entry__ as entry
import corpus_pipeline
from threadloom.llm import langid, simhash
from threadloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):  # noqa: F811
    compare(spark, duck, QUERIES[name], ORACLES[name])


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_pipeline(spark):
    docs = duckdb.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    table = spark.read.parquet(f"{SF}/documents.parquet")
    columns, now = table.columns, table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, SF)
        assert now.columns == columns, name
        assert now.select("doc_id").subtract(before.select("doc_id")).count() == 0
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) == {r.doc_id for r in now.collect()} and all(r.exact for r in out.values())
    texts = [t for _, t in docs]
    assert len(out) < len(texts) and len({simhash.fingerprint(t, 5) for t in texts}) >= len(out)
    assert not [i for i, t in docs if i in out and not langid._LETTER.search(t or "")]
