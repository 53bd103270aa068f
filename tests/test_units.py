"""Edge cases against plain Python and numpy."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronocohort.functions import scalars as S, timefn as T
from chronocohort.operators import aggregates as A, cohort as C, evaluate as E, intervals as I, models as M, reshape as R, sampling as P
from chronocohort.plans import icu_codes as K, icu_labels as IL


def at(day, hour=0, minute=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour, minutes=minute)


def month_days(y, m):
    return ((dt.datetime(y + m // 12, m % 12 + 1, 1)) - dt.datetime(y, m, 1)).days


def slow_age_hours(t, ref):
    low, high, sign = (ref, t, 1) if t >= ref else (t, ref, -1)
    months = (high.year - low.year) * 12 + high.month - low.month
    clock = lambda x: dt.timedelta(hours=x.hour, minutes=x.minute, seconds=x.second, microseconds=x.microsecond)
    rest = dt.timedelta(days=high.day - low.day) + clock(high) - clock(low)
    if rest < dt.timedelta(0):
        months, rest = months - 1, rest + dt.timedelta(days=month_days(low.year, low.month))
    whole, left = divmod(rest, dt.timedelta(hours=1))
    return sign * (months * 730 + whole + round((left // dt.timedelta(minutes=1)) / 60))


def test_age_hour_index(spark):
    rng = random.Random(4)
    base = dt.datetime(2023, 12, 31, 23, 30)
    pairs = [(base + dt.timedelta(minutes=rng.randint(-90000, 90000)), base + dt.timedelta(minutes=rng.randint(-900000, 900000), seconds=rng.randint(0, 59))) for _ in range(400)]
    leap = dt.datetime(2024, 2, 29, 12)
    pairs += [(leap, leap), (leap + dt.timedelta(minutes=30), leap), (leap + dt.timedelta(minutes=31), leap), (leap, leap - dt.timedelta(days=31)), (leap - dt.timedelta(minutes=90), leap)]
    df = spark.createDataFrame(pairs, "t timestamp_ntz, r timestamp_ntz")
    got = [r[0] for r in df.select(T.age_hour_index("t", "r")).collect()]
    assert got == [float(slow_age_hours(t, r)) for t, r in pairs]


def test_error_flag_keeps_nulls(spark):
    df = spark.createDataFrame([(0,), (1,), (None,)], "error int")
    assert sorted(str(r[0]) for r in df.where(S.is_not("error", 1)).collect()) == ["0", "None"]


def test_keywords(spark):
    drugs = ["Amoxicillin-Clavulanate", "amoxicillin potassium clavulanate", "Vancomycin Desensitization", "aspirin", None, "Erythromycin Ophth Oint", "TOBI"]
    df = spark.createDataFrame([(d,) for d in drugs], "d string")
    got = [r[0] for r in df.select(S.keyword_any("d", K.ANTIBIOTICS, K.EXCLUDED_DRUG_WORDS)).collect()]
    assert got == [1, 1, 0, 0, 0, 0, 1]
    many = spark.createDataFrame([("a.b",), ("axb",), ("a\nzb",)], "d string")
    assert [r[0] for r in many.select(S.keyword_any("d", ["a.b"])).collect()] == [1, 0, 0]
    assert [r[0] for r in many.select(S.keyword_any("d", ["a%b"])).collect()] == [1, 1, 1]


def test_extract_and_compose(spark):
    text = ["Weight (lb): 150\n", "Weight (lb): [**1**]\n", "nothing", "Weight (lb): heavy\n", "Weight (lb): \n"]
    df = spark.createDataFrame([(t,) for t in text], "t string")
    assert [r[0] for r in df.select(S.extract_number("t", K.ECHO_WEIGHT)).collect()] == [150.0, None, None, None, None]
    stamps = spark.createDataFrame([(at(0), "7:05"), (at(1), "17:45:10"), (at(2), ""), (at(3), None), (at(4), "99:99")], "d timestamp_ntz, c string")
    assert [r[0] for r in stamps.select(T.compose_ts("d", "c")).collect()] == [at(0, 7, 5), at(1, 17, 45), None, None, None]


def test_culture_edges(spark):
    abx = spark.createDataFrame([(i, at(10)) for i in range(1, 6)], "hadm_id int, antibiotic_time timestamp_ntz")
    cultures = spark.createDataFrame(
        [
            (1, at(7), at(7)), (2, at(6), at(6, 23, 59)), (3, at(11), at(11)), (4, at(11), at(11, 0, 1)), (5, at(7), None), (5, at(11), None),
        ],
        "hadm_id int, chartdate timestamp_ntz, charttime timestamp_ntz",
    )
    got = I.two_sided_proximity(abx, cultures, "hadm_id", "antibiotic_time", "charttime", "chartdate").collect()
    seen = {r["hadm_id"]: (r["last_time"], r["next_time"], r["last_kind"], r["next_kind"]) for r in got}
    assert seen == {1: (at(7), None, "time", "date"), 3: (None, at(11), "date", "time"), 5: (at(7), at(11), "date", "date")}


def vent_rows(spark, rows):
    return spark.createDataFrame([(1, at(0, h, m), v, o, e, 0) for h, m, v, o, e in rows], "icustay_id int, charttime timestamp_ntz, mechvent int, oxygentherapy int, extubated int, selfextubated int")


def test_vent_episodes(spark):
    rows = [
        (0, 0, 1, 0, 0), (8, 0, 1, 0, 0),  # exactly 8 h: same episode
        (16, 1, 1, 0, 0), (17, 0, 1, 0, 0),  # over 8 h: new
        (18, 0, 0, 0, 1),  # extubation still belongs to it
        (19, 0, 1, 0, 0), (20, 0, 1, 0, 0),  # restart
        (21, 0, 0, 1, 0),  # oxygen
        (22, 0, 1, 0, 0), (23, 0, 1, 0, 0),  # after oxygen
        (40, 0, 1, 0, 0),  # single row: no episode
    ]
    got = [(r["ventnum"], r["starttime"], r["endtime"], r["duration_hours"]) for r in IL.vent_durations(vent_rows(spark, rows)).orderBy("ventnum").collect()]
    assert got == [
        (1, at(0, 0), at(0, 8), 8.0), (2, at(0, 16, 1), at(0, 18), 119 / 60), (3, at(0, 19), at(0, 20), 1.0), (4, at(0, 22), at(0, 23), 1.0),
    ]


def test_vent_tie(spark):
    rows = [(0, 0, 1, 0, 0), (1, 0, 1, 0, 0), (1, 0, 0, 0, 1), (2, 0, 1, 0, 0), (3, 0, 1, 0, 0)]
    got = [(r["starttime"], r["endtime"]) for r in IL.vent_durations(vent_rows(spark, rows)).orderBy("ventnum").collect()]
    assert got == [(at(0, 0), at(0, 1)), (at(0, 2), at(0, 3))]


def test_coma_edges(spark):
    adm = spark.createDataFrame([(i, at(0), at(20)) for i in range(1, 6)], "hadm_id int, admittime timestamp_ntz, dischtime timestamp_ntz")
    rows = [
        (1, 723, at(1), "1.0 ET/Trach", 1.0),  # intubated now: 15
        (1, 454, at(1, 5), "x", 1.0),  # verbal missing, intubated before: 15
        (2, 223901, at(1), "x", 2.0), (2, 220739, at(1), "x", 1.0), (2, 223900, at(1), "x", 1.0),  # 4
        (2, 454, at(1, 5, 59), "x", 1.0),  # rest from under 6 h ago: 3
        (2, 184, at(1, 12), "x", 3.0),  # over 6 h: 6 + 5 + 3
        (3, 454, at(1), "x", 1.0), (3, 184, at(1, 6), "x", 1.0),  # exactly 6 h: not used
        (4, 723, at(1), "1.0 ET/Trach", 1.0), (4, 723, at(1, 2), "x", 2.0),  # was intubated, now speaks: previous parts unused
    ]
    chart = spark.createDataFrame([(*r, None) for r in rows], "hadm_id int, itemid int, charttime timestamp_ntz, value string, valuenum double, error int")
    got = {(r["hadm_id"], r["hlos"]): r["gcs"] for r in IL.coma_hours(adm, chart).collect()}
    assert got == {
        (1, 24): 15, (1, 29): 15, (2, 24): 4, (2, 30): 3, (2, 36): 14, (3, 24): 1 + 5 + 4, (3, 30): 6 + 5 + 1, (4, 24): 15, (4, 26): 6 + 2 + 4,
    }


def test_ladder_edges(spark):
    names = ["pao2fio2_vent_min", "pao2fio2_novent_min", "platelet", "bilirubin", "creatinine", "minbp", "gcs", "running_uo_24h", "rate_dopamine", "rate_epinephrine", "rate_norepinephrine", "rate_dobutamine", "hlos"]
    cases = [
        ({}, {"sofaresp": None, "sofacoag": None, "sofaliv": None, "sofacardio": None, "sofagcs": 0, "sofaren": None, "renal_uo": 0}),
        ({"rate_epinephrine": 0.0}, {"sofacardio": 3}), ({"rate_dopamine": 0.0}, {"sofacardio": 0}), ({"rate_dobutamine": 0.1}, {"sofacardio": 2}),
        ({"rate_dopamine": 15.0}, {"sofacardio": 3}), ({"rate_dopamine": 15.1}, {"sofacardio": 4}), ({"minbp": 69.9}, {"sofacardio": 1}), ({"minbp": 70.0}, {"sofacardio": 0}),
        ({"pao2fio2_vent_min": 100.0}, {"sofaresp": 3}), ({"pao2fio2_vent_min": 250.0, "pao2fio2_novent_min": 350.0}, {"sofaresp": 1}), ({"pao2fio2_novent_min": 50.0}, {"sofaresp": 2}),
        ({"platelet": 20.0}, {"sofacoag": 3}), ({"platelet": 150.0}, {"sofacoag": 0}), ({"bilirubin": 12.0}, {"sofaliv": 4}), ({"bilirubin": 1.1}, {"sofaliv": 0}),
        ({"creatinine": 3.5}, {"sofaren": 3}), ({"running_uo_24h": 100.0, "hlos": 24.0}, {"sofaren": 0, "renal_uo": 0}), ({"running_uo_24h": 199.0, "hlos": 25.0}, {"renal_uo": 4}),
        ({"running_uo_24h": 200.0, "hlos": 25.0}, {"renal_uo": 3}), ({"gcs": 15.0}, {"sofagcs": 0}), ({"gcs": 12.0}, {"sofagcs": 2}), ({"gcs": 5.0}, {"sofagcs": 4}),
    ]
    df = spark.createDataFrame([tuple(c.get(n) for n in names) for c, _ in cases], ", ".join(f"{n} double" for n in names))
    rows = df.select(*[c.alias(n) for n, c in IL.score_ladders().items()]).collect()
    for (given, want), row in zip(cases, rows):
        assert {k: row[k] for k in want} == want, given


def test_running_urine_and_stays(spark):
    rows = [(1, 10, 5, 5, 10.0), (1, 10, 30, 30, 20.0), (1, 11, 30, 26, 40.0), (1, 10, 29, -1, 999.0), (1, 10, 54, 54, 1.0)]
    df = spark.createDataFrame(rows, "hadm_id int, icustay_id int, hlos int, iculos int, urineoutput double")
    plain = {r["hlos"]: r["running_uo_24h"] for r in IL.running_urine(df).collect()}
    assert plain == {30: 60.0, 54: 61.0}
    assert {r["hlos"]: r["running_uo_24h"] for r in IL.running_urine(df, True).collect()} == {30: 120.0, 54: 61.0}


@pytest.mark.parametrize("n_cases, n_controls", [(3, 10), (7, 5), (4, 4), (9, 100)])
def test_matching(spark, n_cases, n_controls):
    rng = random.Random(n_cases)
    cases = [(100 + i, float(rng.randint(1, 5))) for i in range(n_cases)]
    controls = [(i, float(rng.randint(1, 4)), at(i)) for i in range(n_controls)]
    got = C.match_by_rank(
        spark.createDataFrame(cases, "c int, o double"), spark.createDataFrame(controls, "k int, len double, t timestamp_ntz"), "c", "o", "k", "len", "t"
    ).collect()
    ratio = n_controls / float(n_cases)
    ordered = sorted(controls, key=lambda r: (r[1], r[0]))
    want = set()
    for i, (case, onset) in enumerate(sorted(cases, key=lambda r: (r[1], r[0]))):
        for k, _, start in ordered[int(i * ratio):int(ratio * (i + 1))]:
            want.add((k, case, onset, start + dt.timedelta(hours=onset)))
    assert {(r["k"], r["matched_case"], r["onset_hour"], r["onset_time"]) for r in got} == want


def curves(y, score):
    """ROC and precision-recall points in order of falling score, the latter up to full recall."""
    points, tp, fp = [(0, 0, 1.0)], 0, 0
    for s in sorted(set(score), reverse=True):
        tp += sum(1 for a, b in zip(y, score) if b == s and a == 1)
        fp += sum(1 for a, b in zip(y, score) if b == s and a == 0)
        points.append((tp, fp, tp / (tp + fp)))
    return points, tp, fp


@pytest.mark.parametrize("seed", range(5))
def test_auc_and_curves(spark, seed):
    rng = random.Random(seed)
    y = [rng.randint(0, 1) for _ in range(60)] if seed < 3 else [1] * 20 + [0] * 40
    score = [float(rng.randint(0, 20)) for _ in y] if seed < 3 else [float(i if seed == 3 else -i) for i in range(60, 0, -1)]
    df = spark.createDataFrame([(int(a), b, 0) for a, b in zip(y, score)], "y int, s double, g int")
    points = E.curve_points(df, "y", "s", "g", overall=False)
    got = E.auc_by_group(points).first()
    pts, p, n = curves(y, score)
    fpr, tpr = [b / n for _, b, _ in pts], [a / p for a, _, _ in pts]
    full = next(i for i, q in enumerate(pts) if q[0] == p)
    rec, pre = [a / p for a, _, _ in pts[: full + 1]], [c for _, _, c in pts[: full + 1]]
    assert got["auroc"] == pytest.approx(np.trapezoid(tpr, fpr))
    assert got["aupr"] == pytest.approx(np.trapezoid(pre, rec))
    grid = np.linspace(0, 1, 100)
    want_roc = np.interp(grid, fpr, tpr)
    want_roc[0] = 0.0
    out = E.resample_curves(points).collect()
    for curve, want in (("roc", want_roc), ("pr", np.interp(grid, rec, pre))):
        line = sorted((r["k"], r["value"]) for r in out if r["curve"] == curve)
        assert [k for k, _ in line] == list(range(100))
        # Where an abscissa equals a step of the curve, rounding of the grid decides the side in numpy.
        off = [k for k, v in line if abs(v - want[k]) > 1e-9]
        xs = fpr if curve == "roc" else rec
        assert all(min(abs(x - k / 99) for x in xs) < 1e-12 for k in off)


def test_auc_is_blind_to_monotone_change(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(rng.randint(0, 1), rng.random(), i % 7) for i in range(300)], "y int, s double, g int")
    a, b = (E.auc_by_group(E.curve_points(d, "y", "s", "g")).orderBy("group").collect() for d in (df, df.withColumn("s", F.exp("s") * 3)))
    assert [(r["auroc"], r["aupr"]) for r in a] == [(r["auroc"], r["aupr"]) for r in b]


def test_single_class(spark):
    df = spark.createDataFrame([(0, 0.5, 0), (0, 0.7, 0), (1, 0.9, 1)], "y int, s double, g int")
    got = {r["group"]: (r["auroc"], r["aupr"]) for r in E.auc_by_group(E.curve_points(df, "y", "s", "g", overall=False)).collect()}
    assert got == {0: (None, None), 1: (None, 1.0)}


def test_log_loss(spark):
    rows = [(1, 2.0, -1.0), (0, 800.0, 0.0), (0, -3.0, 2.5)]
    got = E.weighted_log_loss(spark.createDataFrame(rows, "y int, a double, b double"), "y", "a", "b", 4.0).first()["loss"]
    want = [(-(y * (a - np.logaddexp(a, b)) + (1 - y) * (b - np.logaddexp(a, b)))) * (y / 4 + 1 - y) for y, a, b in rows]
    assert got == pytest.approx(np.mean(want))


def test_gp_mean(spark):
    obs = [(1, 0.2, 0, 1.0), (1, 0.9, 0, -0.5), (1, 1.7, 1, 2.0), (1, 0.2, 1, 0.3), (2, 0.0, 1, 1.0)]
    long = spark.createDataFrame(obs, "e int, t double, v int, y double")
    grid = spark.createDataFrame([(1, g) for g in range(3)] + [(2, 0), (3, 0)], "e int, g int")
    params = M.starting_params(2, 1)
    params["fast"][0][1] = params["fast"][1][0] = 0.005
    out = M.gp_interpolate(long, grid, "e", "t", "v", "y", "g", params, draws=3).collect()
    assert {r["e"] for r in out} == {1, 2}
    t, v, y = (np.array([o[i] for o in obs if o[0] == 1]) for i in (1, 2, 3))
    gt, gv = np.tile(np.arange(3), 2), np.repeat([0, 1], 3)

    def k(a, b, va, vb):
        gap = np.abs(a[:, None] - b)
        return np.array(params["fast"])[va][:, vb] * np.exp(-gap / 0.5) + np.array(params["slow"])[va][:, vb] * np.exp(-gap / 10)

    prior = k(t, t, v, v) + np.eye(len(t)) * (math.exp(-2) + 0.001)
    mean = k(gt, t, gv, v) @ np.linalg.inv(prior) @ y
    got = {(r["t"], r["var_id"]): r["value"] for r in out if r["e"] == 1 and r["sample"] == 0}
    assert [got[(float(a), int(b))] for a, b in zip(gt, gv)] == pytest.approx(list(mean))
    assert sum(1 for r in out if r["e"] == 1) == 4 * 6


def test_tail_and_minimum(spark):
    long = spark.createDataFrame([(e, float(i)) for e, n in ((1, 249), (2, 250), (3, 251), (4, 40), (5, 41)) for i in range(n)], "e int, t double")
    sizes = {r["e"]: r["count"] for r in R.tail_n(long, "e", ["t"], 250).groupBy("e").count().collect()}
    assert sizes == {1: 249, 2: 250, 3: 250, 4: 40, 5: 41}
    assert {r["e"] for r in R.min_observations(long, ["e"], 40).select("e").distinct().collect()} == {1, 2, 3, 5}


def test_horizons(spark):
    long = spark.createDataFrame([(1, 7.5), (1, 8.2), (1, 9.9), (2, 9.0)], "e int, t double")
    onsets = spark.createDataFrame([(1, 10.0), (2, 12.0)], "e int, onset double")
    got = R.horizon_expand(long, onsets, "e", "t", "onset", 6)
    lengths = {(r["e"], r["horizon"]): (r["n_obs"], r["grid_len"]) for r in R.horizon_lengths(got, "e", "t").collect()}
    assert lengths == {(1, 0): (3, 11), (1, 1): (2, 1), (1, 2): (1, 0), (2, 0): (1, 10), (2, 1): (1, 0), (2, 2): (1, 0), (2, 3): (1, 0)}


def test_right_align_and_pad(spark):
    grid = spark.createDataFrame([(1, s, float(s + 1)) for s in range(3)] + [(2, s, float(s)) for s in range(7)], "e int, s int, x double")
    rows = R.flatten_vector(R.right_align(grid, "e", "s", 5, ["x"]), "e", "position", ["x"]).collect()
    assert {r["e"]: r["vector"] for r in rows} == {1: [0, 0, 1, 2, 3], 2: [2, 3, 4, 5, 6]}
    arrays = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0, 3.0])], "e int, a array<double>")
    assert [r["a"] for r in R.pad_right(arrays, ["a"]).orderBy("e").collect()] == [[1, 0, 0], [1, 2, 3]]


def test_splits(spark):
    ids = spark.range(1, 1004).withColumnRenamed("id", "e")
    first = P.entity_split(ids.unionAll(ids), "e")
    sizes = {r["split"]: r["count"] for r in first.groupBy("split").count().collect()}
    assert sizes == {"train": 802, "val": 100, "test": 101}
    second = P.resplit(first, "e")
    assert {r["split"]: r["count"] for r in second.groupBy("split").count().collect()} == sizes
    test_ids = [set(r["e"] for r in s.where("split = 'test'").collect()) for s in (first, second)]
    assert test_ids[0] == test_ids[1]
    moved = first.join(second.withColumnRenamed("split", "s2"), "e").where("split != s2").count()
    assert moved > 0


def test_batches(spark):
    rows = spark.range(100).select(F.col("id"), (F.col("id") < 70).cast("int").alias("y"))
    sizes = {(r["y"], r["batch"]): r["count"] for r in P.balanced_batches(rows, "y", "id", 16).groupBy("y", "batch").count().collect()}
    assert sum(sizes.values()) == 100 and sizes[(0, 1)] == 14 and sizes[(1, 4)] == 6


def test_sparse_columns_and_zscore(spark):
    df = spark.createDataFrame([(i, float(i), None if i else 1.0, 5.0) for i in range(10)], "id int, a double, b double, c double")
    assert A.drop_sparse_columns(df, ["a", "b"], 2).columns == ["id", "a", "c"]
    scaled = A.zscore(df, df.where("id < 5"), ["a", "c"]).orderBy("id").collect()
    assert [r["c"] for r in scaled] == [None] * 10
    assert scaled[9]["a"] == pytest.approx((9 - 2) / np.std([0, 1, 2, 3, 4], ddof=1))


def test_ceil_hour_and_phase(spark):
    df = spark.createDataFrame([(at(0, 1), at(0, 1)), (at(0, 1, 1), at(0, 1)), (at(0, 6), at(0, 1)), (at(0, 6, 1), at(0, 1)), (at(0, 0, 59), at(0, 1))], "t timestamp_ntz, t0 timestamp_ntz")
    got = [(r[0], r[1]) for r in df.select(T.ceil_hour("t"), T.phase_label("t", "t0")).collect()]
    assert got == [(at(0, 1), 1), (at(0, 2), 1), (at(0, 6), 1), (at(0, 7), 2), (at(0, 1), 0)]
