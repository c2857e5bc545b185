"""The pipeline and the registered queries on small tables."""

import os

import pytest

import corpus_pipeline
from panelyard.llm import queries
from panelyard.llm.common import written
from tests.llm.test_dedup import brute_groups, brute_near
from tests.oracle import compare, connect

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_all_queries():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    ok, note = compare(spark, connect(SF_DIR), SF_DIR, name, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, note


def test_pipeline_stage_by_stage(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = written(stage(spark, docs, SF_DIR), name)
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == {i for i, _ in before}
            break
        assert out.columns == DOCUMENTS
        after = {r["doc_id"] for r in out.collect()}
        assert after <= {i for i, _ in before}
        if name == "exact_dedup":
            assert after == {g[0] for g in brute_groups(before) if g[3]}
        if name == "near_dedup":
            assert after == {g[0] for g in brute_near(before, 5) if g[3]}
        docs = out


def test_pipeline_of_nothing(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF_DIR}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
