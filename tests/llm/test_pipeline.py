import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {r["doc_id"] for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, SF).cache()
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= seen
        seen = set(ids)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
    assert seen and {"n_tokens", "token_ids"} <= set(docs.columns)


def test_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 11)} == {n.split("_")[0] + "_" for n in names if n.startswith("op")}
