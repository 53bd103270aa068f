"""Every pipeline stage over odd rows and over no rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronocohort.llm.registry import table

FOLDER = "/root/testdata/sf0.001"
BIG = 10**9
ODD = [
    (None, None, None, None, None), (None, "", "", "", 0), (BIG, None, "en", None, 3), (BIG + 1, "", None, "web", None),
    (BIG + 2, "plain words of no harm at all", "en", "web", 29), (BIG + 2, "plain words of no harm at all", "en", "web", 29),
    (BIG + 3, "quiet " * 40_000, "en", "web", 240_000),
]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_of_odd_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    last = name == corpus_pipeline.STAGES[-1][0]
    whole = table(spark, FOLDER, "documents").select(corpus_pipeline.COLUMNS)
    odd = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").select(corpus_pipeline.COLUMNS)
    out = stage(spark, whole.union(odd), FOLDER)
    if not last:
        assert out.columns == corpus_pipeline.COLUMNS or set(out.columns) == set(corpus_pipeline.COLUMNS)
    ids = Counter(r[0] for r in out.where((F.col("doc_id") >= BIG) | F.col("doc_id").isNull()).select("doc_id").collect())
    assert ids == Counter(r[0] for r in ODD)
    if name == "substring_dedup":
        kept = {r["doc_id"]: r["text"] for r in out.where(f"doc_id between {BIG} and {BIG + 2}").collect()}
        assert kept == {BIG: None, BIG + 1: "", BIG + 2: ODD[4][1]}
    if last:
        assert out.where("not round_trip").count() == 0
    assert stage(spark, whole.limit(0), FOLDER).collect() == []
