"""All operators and stages on tables with nulls, empty and very long texts, ties, repeated rows, clashing columns, and none."""

import pytest
from conftest_llm import CLASHING, hostile_rows
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm.queries import QUERIES

ROWS = hostile_rows()


@pytest.fixture(scope="module")
def hostile(make, tmp_path_factory):
    return make(tmp_path_factory.mktemp("hostile"), ROWS, [(1, "One two three apples and four pears make a small fruit salad for all of us"), (2, None), (3, "")], {c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def empty(make, tmp_path_factory):
    return make(tmp_path_factory.mktemp("empty"), [])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_hostile(spark, hostile, name):
    found = QUERIES[name](spark, hostile).collect()
    if name != "op7_poisson_mix":  # a row a row
        assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in ROWS)
    assert len({tuple(map(str, r)) for r in found if r["doc_id"] == 2}) == (2 if name in ("op5_minimax_shards",) else min(1, len(found)) if name != "op7_poisson_mix" else len({tuple(map(str, r)) for r in found if r["doc_id"] == 2}))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_stages_keep_columns(spark, hostile, tmp_path):
    docs = spark.read.parquet(f"{hostile}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, hostile)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count() or name == "mixing"
        else:
            assert {"doc_id", "shard", "slot"} <= set(out.columns)
            assert out.count() == docs.count()


def test_pipeline_of_nothing(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []
