"""The pipeline's stages and the registered queries."""

import corpus_pipeline
from duoscope.llm import queries
from duoscope.runtime import read

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_shrink(spark, tmp_path):
    docs = read(spark, SF, "documents")
    columns, n = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        path = f"file://{tmp_path}/{k}"
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        assert 0 < out.count() <= n
        n, docs = out.count(), out
    assert docs.filter("not exact").count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
