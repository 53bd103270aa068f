"""The registered queries and the pipeline on the smallest tables."""

import os

import pytest

import corpus_pipeline
from chronocohort.llm.queries import ORACLES, QUERIES
from tests.compare import connect, difference
from tests.conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert difference(QUERIES[name](spark, DATA), ORACLES[name], connect(DATA)) is None


@pytest.mark.parametrize("name", ["op1_url_filters", "op6_license_scans"])
def test_native_plans_hold_no_python(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_pipeline_filters_and_keeps_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        assert 0 < docs.count() <= before, name
    last = corpus_pipeline.encode(spark, docs, DATA)
    assert last.where("not round_trip").count() == 0 and last.count() == docs.count()
