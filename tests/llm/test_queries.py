"""Every registered query runs over a whole small scale, and the pipeline's stages keep their contract."""

import pytest

import corpus_pipeline
from compare import DATA, duck, same
from textgraph.llm import queries

QUERIES = queries.queries()


def test_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in queries.oracle_sql():
        same(spark, duck(), QUERIES[name], queries.oracle_sql()[name])
    else:
        assert QUERIES[name](spark, DATA).count() > 0


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns and 0.7 * before < docs.count() <= before
    again = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, again.drop("sequence_id", "offset").collect())) == sorted(map(tuple, docs.drop("sequence_id", "offset").collect()))
