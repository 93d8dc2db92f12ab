import corpus_pipeline
import pytest
from conftest import same_rows

from orrery.llm import queries


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, sf_dir)
        assert out.columns == docs.columns
        rows = out.collect()
        if name != "mix":
            assert {tuple(r) for r in rows} <= {tuple(r) for r in at.collect()}
        kept[name] = rows
        at = spark.createDataFrame(rows, docs.schema)
    assert len(kept["language"]) == docs.count()
    lower = [r["text"].lower() for r in kept["exact"]]
    assert len(set(lower)) == len(lower)
    assert len({r["text"] for r in kept["near"]}) == len(kept["near"])
    pieces = corpus_pipeline.STAGES[-1][1](spark, at, sf_dir).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in kept["mix"]}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(name, spark, duck, sf_dir):
    mine, theirs = same_rows(queries.queries()[name](spark, sf_dir), duck, queries.oracle_sql()[name])
    assert mine == theirs
