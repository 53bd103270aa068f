"""Intensive-care source tables derived from the event stream, in SQL both engines read alike.

A user becomes an admission, ten days of it a stay, and every event a handful of chart, laboratory,
output, infusion, order, culture and note rows whose codes and values follow from the event.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import TimestampType

from chronocohort.plans.tables import Tables
from chronocohort.queries.registry import table
from chronocohort.session import scratch_path

STAY = "user_id * 10 + CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END"


def pick(values: list, by: str) -> str:
    """A CASE choosing one of the values by the remainder of a whole number."""

    def text(v) -> str:
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)

    arms = " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values))
    return f"CASE ({by}) % {len(values)} {arms} END"


CHART_COLUMNS = "hadm_id, subject_id, icustay_id, itemid, charttime, value, valuenum, error"


def _chart(items: list, minutes: int, text: str, number: str, by: str = "event_id") -> str:
    return f"""SELECT user_id AS hadm_id, user_id - user_id % 2 AS subject_id, {STAY} AS icustay_id, {pick(items, by)} AS itemid,
      ts + INTERVAL {minutes} MINUTE AS charttime, {text} AS value, {number} AS valuenum,
      CASE WHEN event_id % 19 = 0 THEN 1 WHEN event_id % 19 = 1 THEN NULL ELSE 0 END AS error FROM {{events}}"""


def _lab(items: list, minutes: int, text: str, number: str, by: str = "event_id") -> str:
    return f"""SELECT user_id AS hadm_id, user_id - user_id % 2 AS subject_id, {pick(items, by)} AS itemid,
      ts + INTERVAL {minutes} MINUTE AS charttime, {text} AS value, {number} AS valuenum FROM {{events}}"""


DEVICES = ["Cannula", "Ventilator", "Face Tent", "None", "Extubated", "Self Extubation", "Other", "Nasal cannula", "SIMV"]
DRUGS = [
    "Vancomycin", "Aspirin", "CefePIME", "Erythromycin Ophth Oint", "amoxicillin 500 clavulanate", "Heparin", "Tobi gel",
    "Metronidazole (FLagyl)",
]
SOURCES: dict[str, str] = {
    "admissions": """SELECT user_id AS hadm_id, user_id - user_id % 2 AS subject_id, min(ts) AS admittime, max(ts) AS dischtime,
        CASE WHEN user_id % 13 = 5 THEN 0 ELSE 1 END AS has_chartevents_data, CASE WHEN user_id % 3 = 0 THEN 'ASIAN' ELSE 'WHITE' END AS ethnicity,
        CASE WHEN user_id % 4 = 0 THEN 'ELECTIVE' ELSE 'EMERGENCY' END AS admission_type, 'CLINIC' AS admission_location
        FROM {events} GROUP BY user_id""",
    "icustays": f"""SELECT user_id AS hadm_id, user_id - user_id % 2 AS subject_id, {STAY} AS icustay_id, min(ts) AS intime, max(ts) AS outtime,
        CASE WHEN user_id % 7 = 3 THEN 'carevue' ELSE 'metavision' END AS dbsource, CASE WHEN user_id % 3 = 1 THEN 'MICU' ELSE 'SICU' END AS first_careunit
        FROM {{events}} GROUP BY user_id, {STAY}""",
    "patients": """SELECT user_id - user_id % 2 AS subject_id, min(CASE WHEN user_id % 10 < 2 THEN ts - INTERVAL 12 YEAR WHEN user_id % 10 < 4 THEN ts - INTERVAL 93 YEAR
        ELSE ts - INTERVAL 57 YEAR END) AS dob, min(CASE WHEN user_id % 4 < 2 THEN 'F' ELSE 'M' END) AS gender FROM {events} GROUP BY user_id - user_id % 2""",
    "services": f"""SELECT user_id AS hadm_id, {pick(['MED', 'SURG', 'CSURG'], 'event_id')} AS curr_service, ts AS transfertime FROM {{events}} WHERE event_type = 'signup'""",
    "diagnoses_icd": """SELECT user_id AS hadm_id, CASE WHEN event_id % 997 = 0 THEN '99591' WHEN event_id % 2 = 0 THEN '4019' ELSE '5849' END AS icd9_code
        FROM {events} WHERE event_type = 'click'""",
    "chartevents": " UNION ALL ".join(
        [
            _chart([720, 223848, 223849, 467, 640, 445, 226732, 459, 224701], 3, pick(DEVICES, "event_id + user_id"), "value"),
            _chart([646, 220277, 3420, 190, 223835, 3422, 223835], 9, "'x'", """CASE WHEN event_id % 7 IN (0, 1) THEN 103 - value / 5
              WHEN event_id % 7 = 3 THEN value / 100 WHEN event_id % 7 = 4 THEN value / 50 ELSE value END"""),
            _chart([456, 52, 220052, 220181, 443], 15, "'x'", "25 + value * 2"),
            _chart([723, 454, 184, 223900, 223901, 220739], 21, """CASE WHEN event_id % 30 = 0 THEN '1.0 ET/Trach' WHEN event_id % 30 = 3 THEN 'No Response-ETT'
              ELSE 'x' END""", "1.0 * (1 + (event_id + user_id) % 5)"),
            _chart([220045, 220179, 220180, 220210, 223761, 223762, 220277, 225664, 224684, 228376, 220052], 27, "'x'", "value + 12"),
            _chart([762, 3581, 3582, 226512, 227444], 33, "'x'", "CASE WHEN event_id % 8 = 0 THEN 0 ELSE value + 55 END"),
        ]
    ),
    "labevents": " UNION ALL ".join(
        [
            _lab([50821], 11, "'x'", "value * 3 + 35"),
            _lab([50800], 11, pick(["ART", "VEN", "MIX", None], "event_id"), "CAST(NULL AS DOUBLE)"),
            _lab([50816, 50811, 50817, 50820, 50813], 11, "'x'", "value + 5"),
            _lab([50818, 50803, 50804, 50801, 50815], 11, "'x'", "value - 2", "event_id + user_id"),
            _lab([51265, 50885, 50912], 41, "'x'", "CASE event_id % 3 WHEN 0 THEN value * 3 WHEN 1 THEN value / 12 ELSE value / 25 END"),
            _lab([50882, 50902, 50931, 51221, 51222, 50971, 51275, 51237, 50983, 51006, 51301, 50960, 50820, 50861, 50868, 50862], 47, "'x'", "value / 4"),
        ]
    ),
    "outputevents": f"""SELECT user_id AS hadm_id, user_id - user_id % 2 AS subject_id, {STAY} AS icustay_id, {pick([40055, 226559, 227488, 226560, 40094, 99999], 'event_id')} AS itemid,
        ts + INTERVAL 5 MINUTE AS charttime, value * 3 AS value FROM {{events}}""",
    "inputevents_cv": f"""SELECT user_id AS hadm_id, {pick([30047, 30120, 30044, 30119, 30043, 30042, 1], 'event_id')} AS itemid, ts + INTERVAL 2 MINUTE AS charttime,
        CASE WHEN event_id % 11 = 0 THEN NULL ELSE value / 100 END AS rate FROM {{events}} WHERE event_type = 'view'""",
    "inputevents_mv": f"""SELECT user_id AS hadm_id, {pick([221906, 221289, 221662, 221653, 2], 'event_id')} AS itemid, ts + INTERVAL 4 MINUTE AS starttime, value / 20 AS rate,
        {pick(['FinishedRunning', 'Rewritten', 'Stopped', None], 'event_id')} AS statusdescription FROM {{events}} WHERE event_type = 'click'""",
    "procedureevents_mv": f"""SELECT {STAY} AS icustay_id, {pick([227194, 225468, 225477, 3], 'event_id')} AS itemid, ts + INTERVAL 3 MINUTE AS starttime
        FROM {{events}} WHERE event_type = 'error' AND value > 20""",
    "microbiologyevents": f"""SELECT user_id AS hadm_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS chartdate, CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts END AS charttime,
        {pick(['BLOOD', 'URINE'], 'event_id')} AS spec_type_desc FROM {{events}} WHERE event_type = 'purchase' AND value > 25""",
    "prescriptions": f"""SELECT user_id AS hadm_id, {pick(DRUGS, 'event_id')} AS drug, {pick(['MAIN', 'BASE', 'ADDITIVE'], 'event_id')} AS drug_type,
        {pick(['IV', 'PO', 'OU', 'LEFT EYE', 'IV DRIP', None, 'Both Ears'], 'event_id')} AS route, ts AS startdate FROM {{events}} WHERE event_type = 'error'""",
    "noteevents": """SELECT event_id AS row_id, user_id AS hadm_id, user_id - user_id % 2 AS subject_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS chartdate,
        CASE WHEN event_id % 3 = 0 THEN 'Nursing' ELSE 'Echo' END AS category,
        'PATIENT/TEST' || chr(10) || 'Weight (lb): ' || CASE WHEN event_id % 5 = 0 THEN '[**1**]' WHEN event_id % 5 = 1 THEN '' ELSE CAST(100 + event_id % 90 AS VARCHAR(10)) END
          || chr(10) || 'Date/Time: [**2101-1-1**] at ' || CAST(hour(ts) AS VARCHAR(10)) || ':' || lpad(CAST(minute(ts) AS VARCHAR(10)), 2, '0') || chr(10) AS text
        FROM {events} WHERE event_type = 'signup'""",
}


def icu_tables(spark: SparkSession, folder: str, stored: Sequence[str] = ()) -> Tables:
    """The derived source tables, with local times as ``timestamp_ntz``.

    Tables named in ``stored`` are written once, as real source tables are, and not derived anew by
    every reader.
    """

    def build(name: str, sql: str):
        def built(_):
            df = spark.sql(sql, events=table(spark, folder, "events"))
            local = [f.name for f in df.schema.fields if isinstance(f.dataType, TimestampType)]
            df = df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in local})
            return stored_copy(df, name) if name in stored else df

        return built

    return Tables({name: build(name, sql) for name, sql in SOURCES.items()})


def stored_copy(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"icu-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
