"""The registered text queries on the smallest tables: SQL side by side where there is SQL, rows elsewhere."""

import pytest

import corpus_pipeline
from blockloom.llm.queries import ORACLES, QUERIES
from blockloom.sources.compare import difference, duck_connection

SF = "/root/testdata/sf0.001"


def test_thirteen_and_the_pipeline():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, 14)) and "pipeline" in QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert difference(df, duck_connection(SF), ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_pipeline_stages_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns and docs.count() * 0.8 < out.count() <= docs.count()
        empty = stage(spark, docs.where("false"), SF)
        assert empty.columns == columns and empty.count() == 0
        docs = out
