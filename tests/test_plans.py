"""Physical plans and the whole feature flow."""

import pytest
from pyspark.sql import functions as F

from chronocohort.operators import aggregates as A, sampling as P
from chronocohort.plans import features as P2, icu_cohort as IC, icu_codes as K, icu_labels as IL
from chronocohort.queries import QUERIES
from chronocohort.queries.icu_sources import icu_tables
from chronocohort.session import durable
from tests.conftest import DATA


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["j_index_window", "j_stay_window", "j_two_sided_proximity", "j_point_in_interval", "j_asof_tolerance", "j_asof_two_source", "j_rank_slice_match", "e_onset_labels"],
)
def test_time_joins_are_equi_joins(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", ["j_suspected_time", "e_onset_labels"])
def test_suspicion_forms_no_pairs(spark, name):
    assert "_bucket" not in plan(QUERIES[name](spark, DATA))


def test_spine_merge_is_one_shuffle(spark, events):
    keys = ["user_id", "event_id"]
    sources = [events.select(*keys, F.col("value").alias(f"v{i}")) for i in range(4)]
    assert plan(A.merge_on_spine(sources, keys)).count("Exchange hashpartitioning") == 1


def test_scan_reads_only_what_it_needs(spark):
    text = plan(QUERIES["a_signed_sum"](spark, DATA))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in text
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)" in plan(QUERIES["j_inner"](spark, DATA))


@pytest.mark.parametrize("name", ["j_rank_slice_match", "k_entity_split", "k_epoch_shuffle", "k_seq_batches"])
def test_ranks_have_no_single_task_window(spark, name):
    """Row windows are partitioned; the only unpartitioned window runs over one row per range."""
    text = plan(QUERIES[name](spark, DATA))
    for line in text.splitlines():
        if "row_number()" in line or "count(1) windowspec" in line:
            assert "_range" in line


@pytest.fixture(scope="module")
def cohort(spark):
    folder = DATA.replace("sf0.001", "sf0.01")
    t = icu_tables(spark, folder, ["chartevents", "labevents"])
    labels = IL.label_tables(t, durable)
    return IC.cohort_tables(t, labels, durable)


def test_feature_flow(spark, cohort):
    series = durable(P2.labelled_series(cohort, horizon=0, min_values=5))
    kept = [c for c in K.SERIES_VARIABLES if c in series.columns]
    assert series.columns[:5] == P2.IDS and kept
    assert {r["label"] for r in series.select("label").distinct().collect()} == {0, 1}
    starts = P2.onset_hours(cohort["case_static"], cohort["control_static"])
    late = series.join(starts, "icustay_id").where((F.col("t") < 0) | (F.col("t") > F.col("onset_hour") + 1e-6)).count()
    assert late == 0

    static = P2.static_features(cohort["case_static"], cohort["control_static"])
    assert {"gender_F", "gender_M"} <= set(static.columns)
    assert static.agg(F.max("admission_age")).first()[0] <= 90
    grouped = P2.grouped_static_features(cohort["case_static"], cohort["control_static"]).columns
    assert "ethnicity_asian" in grouped and "admission_age_60.0" in grouped
    splits = durable(P.entity_split(static, "icustay_id"))
    scaled, aged = P2.normalised(series, static, splits, scale_age=True)
    train = scaled.join(splits.where("split = 'train'"), "icustay_id")
    for c in kept[:3]:
        mean, std, n = train.agg(F.avg(c), F.stddev_samp(c), F.count(c)).first()
        if n > 1 and std:
            assert abs(mean) < 1e-6 and abs(std - 1) < 1e-6
    assert aged.columns == static.columns

    rows, lengths = P2.training_series(scaled, starts, K.SERIES_VARIABLES, n_max=20, n_min=1)
    rows, lengths = durable(rows), durable(lengths)
    sizes = {(r["icustay_id"], r["horizon"]): r["n_obs"] for r in lengths.collect()}
    assert sizes and max(sizes.values()) <= 20 and min(sizes.values()) > 1
    for (stay, h), n in sizes.items():
        if h >= 2 and (stay, h - 1) in sizes:
            assert n <= sizes[(stay, h - 1)]
    assert rows.count() == sum(sizes.values())

    labels = series.groupBy("icustay_id").agg(F.max("label").alias("label"))
    drawn = P2.balanced_training_rows(lengths, labels, batch=4).groupBy("label").count().collect()
    counts = {r["label"]: r["count"] for r in drawn}
    assert counts[0] == counts[1]


def test_targets_follow_onset(spark, cohort):
    for side, target in (("case", "sepsis_target"), ("control", "pseudo_target")):
        onset = "sepsis_onset" if side == "case" else "control_onset_time"
        stays = cohort["cases" if side == "case" else "matched_controls"].select("icustay_id", onset)
        joined = cohort[f"{side}_vitals"].join(stays, "icustay_id")
        wrong = joined.where((F.col("chart_time") < F.col(onset)) != (F.col(target) == 0)).count()
        assert wrong == 0 and joined.count() > 0
