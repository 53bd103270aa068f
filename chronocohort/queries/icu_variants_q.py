"""The other forms of three intensive-care steps: repeated stay rows, a row per diagnosis, every read vital sign."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronocohort.plans import icu_codes as K, icu_cohort as IC, icu_labels as IL
from chronocohort.queries.icu_q import STORED, _in, with_steps
from chronocohort.queries.icu_sources import icu_tables
from chronocohort.queries.registry import age_sql, query

# Even admissions have a second stay that begins six hours after the first, so that hours of both overlap.
_OVERLAPPING = """WITH o AS (SELECT hadm_id, hlos, iculos, urineoutput FROM uo UNION ALL SELECT hadm_id, hlos, iculos - 6, urineoutput FROM uo WHERE hadm_id % 2 = 0)"""


def _after(steps: str, more: str, sql: str) -> str:
    """Further common tables after the named steps."""
    return f"{with_steps(f'SELECT * FROM {steps}').removesuffix(f' SELECT * FROM {steps}')}, {more.removeprefix('WITH ')} {sql}"


@query(
    "icu_running_urine_repeated",
    _after("uo", _OVERLAPPING, """SELECT x.hadm_id, x.hlos, round(sum(y.urineoutput), 4) AS running_uo_24h FROM (SELECT hadm_id, hlos FROM o WHERE iculos >= 24) x
        JOIN o y ON y.hadm_id = x.hadm_id AND y.hlos BETWEEN x.hlos - 24 AND x.hlos AND y.iculos >= 0 GROUP BY 1, 2"""),
)
def icu_running_urine_repeated(spark, d):
    hourly = IL.label_tables(icu_tables(spark, d))["urine"]
    second = hourly.where("hadm_id % 2 = 0").withColumn("iculos", F.col("iculos") - 6)
    summed = IL.running_urine(hourly.unionByName(second), repeat_stays=True)
    return summed.withColumn("running_uo_24h", F.round("running_uo_24h", 4))


@query(
    "icu_onset_stays_fan_out",
    with_steps(f"""SELECT i.icustay_id, i.hadm_id, intime, outtime, suspected_infection_time AS sepsis_onset, {age_sql('suspected_infection_time', 'intime')} AS h_from_intime,
          1 AS septic, ({age_sql('suspected_infection_time', 'intime')} < 7)::INTEGER AS excluded, CASE WHEN icd9_code IN {_in(K.SEPSIS_DIAGNOSES)} THEN 1 ELSE 0 END AS icd_positive
        FROM si JOIN icustays i ON i.hadm_id = si.hadm_id AND suspected_infection_time BETWEEN intime AND outtime LEFT JOIN diagnoses_icd x ON x.hadm_id = i.hadm_id"""),
)
def icu_onset_stays_fan_out(spark, d):
    """Infection times in place of score onsets; a stay has a row for each of its diagnosis rows."""
    t = icu_tables(spark, d)
    windows = IL.label_tables(t)["infection_windows"]
    onset = windows.select("hadm_id", F.col("suspected_infection_time").alias("sepsis_time"))
    return IL.onset_stays(onset, t["icustays"], t["diagnoses_icd"], fan_out=True)


def _rule(codes, low, high, high_in, low_in, _) -> str:
    read = [c for c in codes if c not in K.VITALS_UNREAD_CODES]
    bounds = [f"itemid IN {_in(read)}"]
    if low is not None:
        bounds.append(f"valuenum {'>=' if low_in else '>'} {low}")
    if high is not None:
        bounds.append(f"valuenum {'<=' if high_in else '<'} {high}")
    return "(" + " AND ".join(bounds) + ")"


_VALUES = ", ".join(
    "round(CASE WHEN " + " OR ".join(_rule(*r) for r in K.VITALS if r[-1] == name) + f" THEN CASE WHEN itemid = 223761 THEN (valuenum - 32) / 1.8 ELSE valuenum END END, 8) AS {name}"
    for name in K.VITAL_COLUMNS
)


@query(
    "icu_vitals_every_reading",
    with_steps(f"""SELECT c.icustay_id, i.subject_id, charttime AS chart_time, {_VALUES},
          CASE WHEN charttime < intime + INTERVAL 2 DAY THEN 0 WHEN charttime <= intime + INTERVAL 53 HOUR THEN 1 ELSE 2 END AS sepsis_target
        FROM icustays i JOIN chartevents c ON c.icustay_id = i.icustay_id AND charttime BETWEEN intime AND intime + INTERVAL 55 HOUR
        WHERE error IS DISTINCT FROM 1 AND ({' OR '.join(_rule(*r) for r in K.VITALS)})"""),
)
def icu_vitals_every_reading(spark, d):
    """Readings around the third day of every stay: unmarked errors kept, and rows of concepts without a column."""
    t = icu_tables(spark, d, STORED)
    stays = t["icustays"].select("icustay_id", (F.col("intime") + F.expr("INTERVAL 2 DAYS")).alias("third_day"))
    rows = IC.vitals_around_onset(stays, "third_day", t["icustays"], t["chartevents"], null_error_ok=True, keep_empty=True)
    return rows.select("icustay_id", "subject_id", "chart_time", "sepsis_target", *(F.round(c, 8).alias(c) for c in K.VITAL_COLUMNS))
