import os

import pytest

import corpus_pipeline
from cragline.llm import queries
from cragline.llm.decontaminate import contamination
from cragline.llm.near_duplicates import near_duplicates

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def test_each_stage_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.count() == len(after) and set(after) <= set(before)
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
            assert all(labels.get(i, 0) == 0 for i in set(before) - set(after))
            assert sum(labels.get(i, 1) == 0 for i in after) <= 3  # 58 labels to learn from here
        if name == "line_dedup":
            assert set(after) == set(before) and any(after[i] != before[i] for i in after)
            assert all(set((after[i] or "").split("\n")) <= {*before[i].split("\n"), ""} for i in after)
        if name == "near_duplicates":
            found = near_duplicates(docs)
            assert found.filter("n_links > 0").count() == 0
        if name == "decontamination":
            assert contamination(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).count() == 0
        if name != "mixing":
            assert docs.columns == columns
        before = after
    assert {"tokens", "domain_name", "copies"} <= set(docs.columns)


def test_registered_queries():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert len(corpus_pipeline.STAGES) == 5
