"""The model-ready flow: labelled series, static features, scaling, horizons and balanced rows.

A user of the event stream is a stay; every third one is a case, and the last error is the onset. Views, clicks and errors
come from one source, signups and purchases from another.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chronocohort.functions import timefn as T
from chronocohort.operators import aggregates as A, reshape as R, sampling as K
from chronocohort.plans import features as P
from chronocohort.queries.registry import EVENT_TYPES, hash_sql, query, table
from chronocohort.queries.sampling_q import SPLIT
from chronocohort.session import durable

VITALS, LABS = ["view", "click", "error"], ["signup", "purchase"]
AGES = [23.4, 45.0, 67.5, 93.2]
GROUPS = {"ASIAN - CHINESE": "asian", "PORTUGUESE": "white", "MIDDLE EASTERN": "middle eastern", "SOUTH AMERICAN": "SOUTH AMERICAN"}

STAYS = f"""SELECT user_id AS icustay_id, user_id % 3 = 0 AS is_case, min(ts) AS intime, max(CASE WHEN event_type = 'error' THEN ts END) AS onset,
    CASE user_id % 5 WHEN 4 THEN NULL {' '.join(f'WHEN {i} THEN {a}::DOUBLE' for i, a in enumerate(AGES))} END AS admission_age,
    CASE WHEN user_id % 2 = 0 THEN 'F' ELSE 'M' END AS gender, CASE WHEN user_id % 7 < 3 THEN 'MICU' ELSE 'SICU' END AS first_careunit,
    CASE user_id % 4 {' '.join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(GROUPS))} END AS ethnicity FROM events GROUP BY user_id"""


def series_sql(horizon: int, shortest: int, longest: int) -> str:
    means = ", ".join(f"avg(CASE WHEN event_type = '{k}' THEN value END) AS {k}" for k in EVENT_TYPES)
    return f"""SELECT * FROM (
        SELECT is_case::INTEGER AS label, icustay_id, (epoch_us(ts) - epoch_us(intime)) / 3600000000.0::DOUBLE AS t, icustay_id AS subject_id,
          (ts >= onset)::INTEGER AS sepsis_target, {', '.join(EVENT_TYPES)}
        FROM (SELECT user_id AS icustay_id, ts, {means} FROM events GROUP BY 1, 2) JOIN ({STAYS}) USING (icustay_id)
        WHERE ts <= onset - INTERVAL {horizon} HOUR AND epoch_us(onset) - epoch_us(intime) >= {shortest} * 3600000000)
      QUALIFY max(t) OVER (PARTITION BY icustay_id) <= {longest}"""


def stays(spark, d):
    ev, pick = table(spark, d, "events"), lambda by, values: F.get(F.array(*map(F.lit, values)), (F.col("user_id") % by).cast("int"))
    times = ev.groupBy("user_id").agg(F.min("ts").alias("intime"), F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("onset"))
    return times.select(
        F.col("user_id").alias("icustay_id"), "intime", "onset", (F.col("user_id") % 3 == 0).alias("is_case"),
        pick(5, [*AGES, None]).alias("admission_age"), pick(2, "FM").alias("gender"), pick(7, ["MICU"] * 3 + ["SICU"] * 4).alias("first_careunit"),
        pick(4, list(GROUPS)).alias("ethnicity"), T.hours_between("intime", "onset").alias("onset_hour"),
    )


def cohort(spark, d):
    """The six tables of a cohort; ``unmeasured`` is a column without values."""
    ev, tables = table(spark, d, "events"), {}
    for side, is_case, onset, target in (("case", True, "sepsis_onset", "sepsis_target"), ("control", False, "control_onset_time", "pseudo_target")):
        static = stays(spark, d).where(F.col("is_case") == is_case).withColumnRenamed("onset", onset)
        tables[f"{side}_static"] = static.withColumnRenamed("onset_hour", f"{'sepsis' if is_case else side}_onset_hour")
        timed = ev.withColumnRenamed("user_id", "icustay_id").join(static.select("icustay_id", onset), "icustay_id").withColumnRenamed("ts", "chart_time")
        timed = timed.withColumns({"subject_id": F.col("icustay_id"), target: F.when(F.col("chart_time") >= F.col(onset), 1).otherwise(0)})
        keys = ["icustay_id", "chart_time", "subject_id", target]
        for source, kinds in (("vitals", VITALS), ("labs", LABS)):
            wide = R.sparse_wide(timed, keys, "event_type", "value", {k: k for k in kinds})
            tables[f"{side}_{source}"] = A.mean_per_time(wide, keys, kinds)
        tables[f"{side}_labs"] = tables[f"{side}_labs"].withColumn("unmeasured", F.lit(None).cast("double"))
    return tables


def starts(t):
    return P.onset_hours(t["case_static"], t["control_static"])


@query("f_labelled_series", series_sql(2, 24, 715))
def f_labelled_series(spark, d):
    """Cases and controls up to two hours before onset, without short and long stays and empty columns."""
    return P.labelled_series(cohort(spark, d), horizon=2, min_values=1, min_length=24, max_length=715, keep=durable)


STATIC = f"""SELECT icustay_id, CASE WHEN admission_age > 90 THEN 90 ELSE admission_age END AS admission_age, (gender = 'F')::INTEGER AS "gender_F", (gender = 'M')::INTEGER AS "gender_M",
    (first_careunit = 'MICU')::INTEGER AS "first_careunit_MICU", (first_careunit = 'SICU')::INTEGER AS "first_careunit_SICU"
  FROM ({STAYS})"""


def static(spark, d):
    t = cohort(spark, d)
    return P.static_features(t["case_static"], t["control_static"])


@query("f_static_features", STATIC)
def f_static_features(spark, d):
    """Age capped at 90, unknown ages kept as null, and 0/1 columns."""
    return static(spark, d)


_TENS = {20: "admission_age < 30", 40: "admission_age = 45", 70: "admission_age = 67.5", 90: "admission_age > 90"}
_GROUPED = [f'CASE WHEN {test} THEN 1 ELSE 0 END::INTEGER AS "admission_age_{tens}.0"' for tens, test in _TENS.items()]
_GROUPED += [f"""(ethnicity = '{e}')::INTEGER AS "ethnicity_{g}\"""" for e, g in GROUPS.items()]
_GROUPED += [f"""({c} = '{v}')::INTEGER AS "{c}_{v}\"""" for c, v in (("gender", "F"), ("gender", "M"), ("first_careunit", "MICU"), ("first_careunit", "SICU"))]


@query("f_grouped_static_features", f"SELECT icustay_id, {', '.join(_GROUPED)} FROM ({STAYS})")
def f_grouped_static_features(spark, d):
    """The older form: ages in tens, ethnic groups."""
    t = cohort(spark, d)
    return P.grouped_static_features(t["case_static"], t["control_static"])


_SCALED = ", ".join(f"round(({k} - avg_{k}) / std_{k}, 6) AS {k}" for k in EVENT_TYPES)
_STATS = ", ".join(f"avg({k}) AS avg_{k}, stddev_samp({k}) AS std_{k}" for k in EVENT_TYPES)


@query(
    "f_normalised",
    f"""WITH s AS ({series_sql(0, 0, 10000)}), a AS ({STATIC}), tr AS (SELECT user_id FROM ({SPLIT}) WHERE split = 'train'),
          z AS (SELECT {_STATS} FROM s WHERE icustay_id IN (FROM tr)),
          za AS (SELECT avg(admission_age) AS m, stddev_samp(admission_age) AS sd FROM a WHERE icustay_id IN (FROM tr))
        SELECT label, s.icustay_id, t, subject_id, sepsis_target, {_SCALED}, round((admission_age - m) / sd, 6) AS admission_age
        FROM s JOIN a ON s.icustay_id = a.icustay_id, z, za""",
)
def f_normalised(spark, d):
    """Series and age scaled by the training stays."""
    splits = K.entity_split(table(spark, d, "events"), "user_id").withColumnRenamed("user_id", "icustay_id")
    scaled, aged = P.normalised(P.labelled_series(cohort(spark, d), min_values=1, keep=durable), static(spark, d), splits, scale_age=True)
    return scaled.join(aged.select("icustay_id", "admission_age"), "icustay_id").withColumns(
        {c: F.round(c, 6) for c in [*EVENT_TYPES, "admission_age"]}
    )


_CELLS = " UNION ALL ".join(f"SELECT icustay_id, t, label, {i} AS var_id, {k} AS value FROM s WHERE {k} IS NOT NULL" for i, k in enumerate(EVENT_TYPES))
_TRAINING = f"""WITH s AS ({series_sql(0, 0, 10000)}), st AS ({STAYS}),
    k AS (SELECT *, (count(*) OVER (PARTITION BY icustay_id) >= 60)::INTEGER AS cut FROM ({_CELLS})
          QUALIFY row_number() OVER (PARTITION BY icustay_id ORDER BY t DESC, var_id DESC, value DESC) <= 60),
    x AS (SELECT k.*, h::INTEGER AS horizon FROM k JOIN st USING (icustay_id), range(0, 7) AS r(h)
          WHERE h = 0 OR t <= (epoch_us(onset) - epoch_us(intime)) / 3600000000.0::DOUBLE - h),
    e AS (SELECT * FROM x QUALIFY count(*) OVER (PARTITION BY icustay_id, horizon) > 10),
    l AS (SELECT icustay_id, horizon, count(*) AS n_obs, max(t) AS last_time, CASE WHEN max(cut) = 1 THEN floor(min(t)) ELSE 0 END::INTEGER AS grid_start,
            CASE WHEN horizon > 0 THEN ceil(max(t) - min(t)) WHEN max(cut) = 1 THEN floor(max(t)) - floor(min(t)) + 1 ELSE round_even(max(t) + 1, 0) END::INTEGER AS grid_len
          FROM e GROUP BY 1, 2)"""


def training(spark, d):
    t = cohort(spark, d)
    return P.training_series(P.labelled_series(t, min_values=1, keep=durable), starts(t), EVENT_TYPES, n_max=60, n_min=10)


@query(
    "f_training_series",
    f"""{_TRAINING} SELECT e.icustay_id, e.horizon, t, var_id::INTEGER AS var_id, value, label, n_obs, last_time, grid_start, grid_len
        FROM e JOIN l ON e.icustay_id = l.icustay_id AND e.horizon = l.horizon""",
)
def f_training_series(spark, d):
    """The last 60 observations of a stay at every horizon, with the lengths of the series."""
    rows, lengths = training(spark, d)
    joined = rows.join(lengths, ["icustay_id", "horizon"])
    return joined.select("icustay_id", "horizon", "t", "var_id", "value", "label", "n_obs", "last_time", "grid_start", "grid_len")


@query(
    "f_balanced_training_rows",
    f"""{_TRAINING}, w AS (SELECT icustay_id * 8 + horizon AS row_id, icustay_id, horizon, is_case::INTEGER AS label FROM l JOIN st USING (icustay_id)),
          r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {hash_sql('row_id', 3)}, row_id) AS draw FROM w),
          c AS (SELECT count(*) FILTER (label = 1) AS ones, count(*) FILTER (label = 0) AS zeros FROM w),
          big AS (SELECT r.* FROM r, c WHERE label = (ones > zeros)::INTEGER), small AS (SELECT r.* FROM r, c WHERE label <> (ones > zeros)::INTEGER),
          b AS (SELECT row_id, icustay_id, horizon, label, draw FROM big UNION ALL
                SELECT small.row_id, small.icustay_id, small.horizon, small.label, big.draw FROM big, c
                JOIN small ON small.draw = CASE WHEN ones = zeros THEN big.draw ELSE {hash_sql('big.draw', 3)} % least(ones, zeros) + 1 END)
        SELECT *, ((row_number() OVER (PARTITION BY label ORDER BY {hash_sql('draw', 1)}, draw) - 1) // 16)::INTEGER AS batch FROM b""",
)
def f_balanced_training_rows(spark, d):
    """Every (stay, horizon) drawn so that cases and controls are as many, in batches of 16 of each."""
    labels = stays(spark, d).select("icustay_id", F.col("is_case").cast("int").alias("label"))
    rows = P.balanced_training_rows(durable(training(spark, d)[1]), labels, batch=16, epoch=1)
    return rows.select("row_id", "icustay_id", "horizon", "label", "draw", "batch")
