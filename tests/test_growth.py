"""Steps whose tasks must not grow with the input."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronocohort.operators import aggregates as A, models as M, reshape as R, sampling as P
from chronocohort.operators.ordered import KeyedOrder
from chronocohort.plans import icu_codes as K, icu_cohort as IC, icu_labels as IL, labels as L
from chronocohort.queries.icu_sources import icu_tables


def _stays(spark, n):
    start = F.lit("2024-01-01 00:30:00").cast("timestamp_ntz")
    ids = spark.range(n).select(F.col("id").alias("e"), start.alias("a"))
    return ids.withColumn("z", F.col("a") + F.make_dt_interval(F.lit(3)))


def test_spine_tasks_grow_with_the_rows_made(spark, monkeypatch):
    """A spine is made of a few small rows; its 97 hours each (-24 to 72) need a task per TASK_ROWS, not one per core."""
    monkeypatch.setattr(R, "TASK_ROWS", 100)
    stays = _stays(spark, 60)
    assert R.spine_tasks(stays, "a", "z") == math.ceil(60 * 97 / 100)
    spine = R.hour_spine(stays, "e", "a", "z")
    assert spine.count() == 60 * 97 and spine.rdd.getNumPartitions() == math.ceil(60 * 97 / 100)


def test_look_back_and_onset_shuffle_no_spine_row(spark, monkeypatch):
    monkeypatch.setattr(R, "TASK_ROWS", 100)
    stays = _stays(spark, 60)
    scores = spark.createDataFrame([(e, h, s) for e in range(60) for h, s in ((-30, 4), (2, 1), (40, 3))], "e long, hour int, s int")
    windows = stays.select("e", F.col("a").alias("window_start"), F.col("z").alias("window_end"))
    plain = L.look_back_scores(R.hour_spine(stays, "e", "a", "z"), scores, "e", ["s"])
    tasks = R.spine_tasks(stays, "a", "z")
    dealt = L.look_back_scores(R.hour_spine(stays, "e", "a", "z", tasks=tasks), scores, "e", ["s"], tasks=tasks)
    assert dealt.rdd.getNumPartitions() == tasks
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect()))
    first = lambda rows, **how: sorted(map(tuple, L.onset_times(rows, windows, stays, "e", "a", **how).collect()))
    assert first(dealt, tasks=tasks) == first(plain) and len(first(plain)) == 60


@pytest.mark.parametrize("split", [None, False, True])
def test_ordered_rows_are_dealt_over_the_tasks_asked_for(spark, split):
    rows = spark.range(400).select((F.col("id") % 7 - 1).alias("_k"), F.col("id").alias("t"), (F.col("id") * 37 % 11).alias("v"))
    rows = rows.select(F.when(F.col("_k") >= 0, F.col("_k")).alias("e"), "t", "v")

    def ran(**sizing):
        ordered = KeyedOrder(rows, ["e"], ["t"], max_group=20 if split is not False else 1000, split=split, **sizing)
        return ordered.running("max", F.col("v"), "m").previous(F.col("v"), "p").rows()

    dealt = ran(tasks=13)
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, dealt.collect())) == sorted(map(str, ran().collect()))


def test_parts_of_a_score_are_made_apart_and_dealt_by_their_rows(spark, monkeypatch):
    """Small sides of one union would share its tasks by bytes: coma scores and running urine get one per TASK_ROWS rows instead."""
    monkeypatch.setattr(R, "TASK_ROWS", 40)
    at = F.lit("2024-01-01 00:30:00").cast("timestamp_ntz")
    hours = spark.range(600).select((F.col("id") % 30).alias("hadm_id"), (at + F.make_dt_interval(F.lit(0), (F.col("id") / 30).cast("int"))).alias("charttime"), "id")
    chart = hours.select("hadm_id", F.col("hadm_id").alias("icustay_id"), F.lit(454).alias("itemid"), "charttime", F.lit("x").alias("value"), (F.col("id") % 6 + 1.0).alias("valuenum"), F.lit(0).alias("error"))
    stays = spark.range(30).select(F.col("id").alias("hadm_id"), at.alias("admittime"), (at + F.make_dt_interval(F.lit(2))).alias("dischtime"), F.col("id").alias("icustay_id"), at.alias("intime"))
    outputs = hours.select("hadm_id", F.col("hadm_id").alias("icustay_id"), F.lit(40055).alias("itemid"), "charttime", F.lit(1.0).alias("value"))
    tables = {"chartevents": chart, "admissions": stays, "icustays": stays, "outputevents": outputs}
    labels = IL.label_tables(tables)
    for name in ("coma", "running_urine"):
        assert "REPARTITION_BY_NUM" in labels[name]._jdf.queryExecution().executedPlan().toString()
        assert labels[name].rdd.getNumPartitions() == 600 // 40
    plain = IL.coma_hours(stays, chart, hot={})
    assert sorted(map(tuple, labels["coma"].collect())) == sorted(map(tuple, plain.collect())) != []

    kept = []
    keep = lambda df: kept.append(tuple(df.columns)) or df
    empty = lambda columns: spark.createDataFrame([], "hadm_id long, hlos int, " + columns)
    labels = IL.label_tables(tables, keep)
    labels._built |= {"coma": plain, "running_urine": IL.running_urine(labels["urine"]), "pressure": empty("minbp double"),
                      "respiration": empty("pao2fio2_novent_min double, pao2fio2_vent_min double"), "labs": empty("platelet double, bilirubin double, creatinine double"),
                      "pressors": empty(", ".join(f"rate_{k} double" for k in K.PRESSOR_CODES_OLD))}
    scores = labels["scores"]
    assert len(kept) == 7 and ("hadm_id", "hlos", "gcs") in kept and scores.count() == 30 * (25 + 48)


def _icu(spark, folder):
    """Intensive-care tables of 3,000 events of twelve users, a null one among them."""
    i = F.col("id")
    at = F.timestamp_micros((F.lit(1704070800) + (i * 7919 % 40000) * 60) * 1_000_000)
    kinds = F.array(*map(F.lit, ["view", "click", "signup", "purchase", "error"]))
    user = F.when(i % 12 > 0, (i * 5) % 12)
    spark.range(3000).select(
        i.alias("event_id"), at.alias("ts"), user.alias("user_id"), F.get(kinds, (i * 31 % 5).cast("int")).alias("event_type"),
        (i * 13 % 60 + 0.5).alias("value"), F.lit("").alias("props"),
    ).write.parquet(f"{folder}/events.parquet")
    return icu_tables(spark, str(folder))


def _rows(df):
    return sorted(str([round(v, 6) if isinstance(v, float) else v for v in row]) for row in df.collect())


@pytest.mark.parametrize("hot", [{}, {5: 5_000_000, None: 2_000_000}])
def test_label_steps_are_dealt_over_the_tasks_asked_for(spark, tmp_path, hot):
    """Joins, folds and windows of the label tables follow the rows of their source, not the number of shuffle partitions."""
    t = _icu(spark, tmp_path)
    adm, chart, labs = t["admissions"], t["chartevents"], t["labevents"]
    sources = (t["inputevents_cv"], t["inputevents_mv"], chart, IL.echo_weights(t["noteevents"]))
    drugs, kept = IL.antibiotic_drugs(t["prescriptions"]), []
    given, samples = IL.antibiotic_times(t["prescriptions"], drugs), IL.cultures(t["microbiologyevents"])
    steps = {
        "pressors": lambda **o: IL.pressor_hours(adm, *sources, hot=hot, keep=lambda df: kept.append(df) or df, **o),
        "pressure": lambda **o: IL.pressure_hours(adm, chart, hot=hot, **o),
        "coma": lambda **o: IL.coma_hours(adm, chart, hot=hot, **o),
        "labs": lambda **o: IL.lab_hours(adm, labs, hot=hot, **o),
        "gases": lambda **o: IL.blood_gases(adm, labs, hot=hot, **o),
        "spo2": lambda **o: IL._spo2(chart, **o),
        "fio2": lambda **o: IL._fio2(chart, **o),
        "settings": lambda **o: IL.vent_settings(chart, t["procedureevents_mv"], **o),
        "urine": lambda **o: IL.urine_hours(adm, t["outputevents"], t["icustays"], **o),
        "given": lambda **o: IL.antibiotic_times(t["prescriptions"], drugs, **o),
        "samples": lambda **o: IL.cultures(t["microbiologyevents"], **o),
        "suspicions": lambda **o: IL.suspicions(given, samples, adm, pairs=False, **o),
    }
    for name, step in steps.items():
        dealt = step(tasks=13)
        assert dealt.rdd.getNumPartitions() == 13, name
        assert _rows(dealt) == _rows(step()) != [], name
    assert len(kept) == 2  # the weights are one table, read by both recording systems


def test_readings_around_onset_are_dealt_over_the_tasks_asked_for(spark, tmp_path):
    t = _icu(spark, tmp_path)
    stays = t["icustays"].where("hadm_id % 3 > 0").select("icustay_id", (F.col("intime") + F.make_dt_interval(F.lit(3))).alias("onset"))
    for step, source, columns in ((IC.labs_around_onset, "labevents", K.LAB_COLUMNS), (IC.vitals_around_onset, "chartevents", K.VITAL_COLUMNS)):
        means = lambda **o: IC.per_timestamp(step(stays, "onset", t["icustays"], t[source], **o), columns)  # noqa: B023, E731
        dealt = means(tasks=13)
        assert dealt.rdd.getNumPartitions() == 13
        assert _rows(dealt) == _rows(means()) != []


def test_rates_of_a_split_entity_are_dealt_anew(spark):
    rates = spark.range(200).select((F.col("id") % 4).alias("e"), (F.col("id") % 9).alias("h"), F.lit(1).alias("c"), (F.col("id") * 1.5).alias("r"))
    weights = [spark.range(3).select(F.col("id").alias("e"), (F.col("id") + 2.0).alias("weight"))]
    rate = lambda **o: A.weighted_rate(rates, weights, "e", ["e", "h"], "c", "r", {"x": ([1], [])}, **o)
    dealt = rate(hot={1: 3_000_000}, tasks=13)
    assert dealt.rdd.getNumPartitions() == 13
    assert _rows(dealt) == _rows(rate()) and dealt.count() == 36


def test_merge_is_dealt_over_the_tasks_asked_for(spark):
    a = spark.range(100).select(F.col("id").alias("e"), F.lit(1).alias("h"), F.lit(2).alias("x"))
    b = spark.range(50, 150).select(F.col("id").alias("e"), F.lit(1).alias("h"), F.lit(3).alias("y"))
    dealt = A.merge_on_spine([a, b], ["e", "h"], 17)
    assert dealt.rdd.getNumPartitions() == 17
    assert sorted(map(str, dealt.collect())) == sorted(map(str, A.merge_on_spine([a, b], ["e", "h"]).collect()))


def test_global_order_compares_no_row_with_a_list_of_bounds(spark):
    """A row's range is stored with it: the plan of the ranks holds no function over arrays, and reads no source row."""
    ids = spark.range(500).select((F.col("id") % 100).alias("e"))
    first = P.entity_split(ids, "e")
    second = P.resplit(first, "e")
    plan = second._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan and "scalar-subquery" not in plan and "Range (" not in plan
    places = second.groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in places} == {"train": 80, "val": 10, "test": 10}


@pytest.mark.parametrize("rows", [1, 40, 100_000])
def test_entities_in_one_batch_equal_one_by_one(monkeypatch, rows):
    """Entities of all lengths, readings of one time, grid rows that come twice, and cuts at any row."""
    import pandas as pd

    monkeypatch.setattr(M, "BATCH_ROWS", rows)
    monkeypatch.setattr(M, "SEGMENT", 16)
    rng = np.random.default_rng(7)
    params = {**M.starting_params(2, 1), "noise": [0.1, 0.3]}
    whole, want = [], []
    for e, n in enumerate((0, 1, 70, 5, 33, 70)):
        t, v, y = np.round(rng.uniform(0, 20, n), 1), rng.integers(0, 2, n), rng.normal(size=n)
        grid = np.array([0.0, 3.0, 3.0, 9.5, 40.0])
        mean, variance, _ = M._process(params, 0.001)(t, v, y, grid, 0, rng)
        want += [(e, g, f, mean[i, f], variance[i, f]) for i, g in enumerate(grid) for f in range(2)]
        whole.append(pd.DataFrame({"e": e, "t": np.append(t, grid), "var_id": [*v, *[None] * 5], "value": [*y, *[None] * 5]}))
    table = pd.concat(whole)
    parts = (table.iloc[i : i + 17] for i in range(0, len(table), 17))
    got = pd.concat(M._in_batches("e", params, 0.001)(parts)).sort_values(["e", "t", "var_id"], kind="stable").to_numpy(float)
    want = np.array(sorted(want, key=lambda r: r[:3]), float)
    assert np.abs(got - want).max() < 1e-9
