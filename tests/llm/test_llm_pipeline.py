"""The pipeline, stage by stage on each stage's own input."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check_oracle import digest
from panelmill.llm import queries
from panelmill.session import materialize

SF = "/root/testdata/sf0.001"


def test_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)} and set(queries.QUERIES) < names and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert digest(queries.QUERIES[name](spark, SF).toPandas()) == digest(db.sql(queries.ORACLES[name]).df())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"] for r in queries.op2_rule_ledger(spark, SF).where("kept").collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        seen.append(docs)
        if name != "pack":
            assert docs.columns == columns
    judged, lines, near, mixed, packed = seen
    assert {r["doc_id"] for r in judged.collect()} == kept and lines.count() == judged.count()
    assert near.count() == near.select("doc_id").distinct().count() <= lines.count()
    clean = {r["doc_id"] for r in near.collect()}
    assert {r["doc_id"] for r in mixed.collect()} <= clean
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in mixed.collect()}
    assert packed.where("start = 0").count() == mixed.count()
    assert packed.agg({"length": "sum"}).first()[0] == packed.where("start = 0").agg({"doc_tokens": "sum"}).first()[0]
