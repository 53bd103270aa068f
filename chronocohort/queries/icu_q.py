"""The intensive-care tables, from derived sources, against SQL over the same sources."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from chronocohort.plans import icu_cohort as IC, icu_codes as K, icu_labels as IL
from chronocohort.queries.icu_sources import SOURCES, icu_tables
from chronocohort.queries.registry import age_sql, query
from chronocohort.session import durable


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


def _likes(column: str, words) -> str:
    return "(" + " OR ".join(f"lower({column}) LIKE '%{w}%'" for w in words) + ")"


def _hours(a: str, b: str) -> str:
    """Hours from b to a."""
    return f"((epoch_us({a}) - epoch_us({b})) / 3600000000.0::DOUBLE)"


def _hlos(t: str, ref: str = "admittime") -> str:
    return f"({age_sql(t, ref)})::INTEGER"


STAYED = "BETWEEN admittime - INTERVAL 1 DAY AND dischtime"
# One step per derived table; a step may read the sources and other steps by name.
STEPS: dict[str, str] = {
    "drugs": f"""SELECT DISTINCT drug FROM prescriptions WHERE drug_type IN {_in(K.DRUG_TYPES)} AND route NOT IN {_in(K.EXCLUDED_ROUTES)}
        AND NOT {_likes('route', K.EXCLUDED_ROUTE_WORDS)} AND {_likes('drug', K.ANTIBIOTICS)} AND NOT {_likes('drug', K.EXCLUDED_DRUG_WORDS)}""",
    "abx": "SELECT hadm_id, startdate AS antibiotic_time FROM prescriptions WHERE drug IN (FROM drugs) GROUP BY ALL",
    "cult": "SELECT DISTINCT hadm_id, spec_type_desc, chartdate, charttime, coalesce(charttime, chartdate) AS seen FROM microbiologyevents",
    "susp": """SELECT a.hadm_id, a.antibiotic_time, x.seen AS last72_charttime, y.seen AS next24_charttime,
          least(coalesce(x.seen, y.seen), a.antibiotic_time) AS suspected_infection_time FROM abx a
        LEFT JOIN cult x ON x.hadm_id = a.hadm_id AND x.seen BETWEEN a.antibiotic_time - INTERVAL 72 HOUR AND a.antibiotic_time
        LEFT JOIN cult y ON y.hadm_id = a.hadm_id AND y.seen BETWEEN a.antibiotic_time AND a.antibiotic_time + INTERVAL 24 HOUR
        WHERE x.seen IS NOT NULL OR y.seen IS NOT NULL""",
    "si": """SELECT hadm_id, min(suspected_infection_time) AS suspected_infection_time, min(suspected_infection_time) - INTERVAL 48 HOUR AS si_start,
        min(suspected_infection_time) + INTERVAL 24 HOUR AS si_end FROM susp GROUP BY 1""",
    "vset": f"""SELECT icustay_id, charttime,
          max((itemid IN {_in(K.VENT_SETTING_CODES)} OR itemid = 223849 OR (itemid = 467 AND value = 'Ventilator') OR (itemid = 720 AND value != 'Other/Remarks')
               OR (itemid = 223848 AND value != 'Other'))::INTEGER) AS mechvent,
          max(((itemid = 467 AND value IN {_in(K.OXYGEN_DEVICES[467])}) OR (itemid = 226732 AND value IN {_in(K.OXYGEN_DEVICES[226732])}))::INTEGER) AS oxygentherapy,
          max((itemid = 640 AND value IN {_in(K.EXTUBATED_TEXTS)})::INTEGER) AS extubated, max((itemid = 640 AND value = 'Self Extubation')::INTEGER) AS selfextubated
        FROM chartevents WHERE value IS NOT NULL AND error IS DISTINCT FROM 1 AND itemid != 459
          AND itemid IN {_in(K.VENT_SETTING_CODES + [720, 223848, 223849, 467, 640] + K.OTHER_OXYGEN_CODES)} GROUP BY 1, 2
        UNION SELECT icustay_id, starttime, 0, 0, 1, (itemid = 225468)::INTEGER FROM procedureevents_mv WHERE itemid IN {_in(K.EXTUBATION_PROCEDURES)}""",
    "vdur": """SELECT icustay_id, row_number() OVER (PARTITION BY icustay_id ORDER BY num) AS ventnum, min(charttime) AS starttime, max(charttime) AS endtime,
          (epoch_us(max(charttime)) - epoch_us(min(charttime))) / 3600000000.0::DOUBLE AS duration_hours
        FROM (SELECT *, sum(fresh) OVER (PARTITION BY icustay_id ORDER BY charttime) AS num FROM (
          SELECT *, CASE WHEN lag(extubated) OVER (PARTITION BY icustay_id, greatest(mechvent, extubated) ORDER BY charttime, -mechvent, extubated, selfextubated, oxygentherapy) = 1 THEN 1
               WHEN mechvent = 0 AND oxygentherapy = 1 THEN 1
               WHEN mechvent = 1 AND charttime - lag(charttime) OVER (PARTITION BY icustay_id, mechvent ORDER BY charttime, extubated, selfextubated, oxygentherapy) > INTERVAL 8 HOUR THEN 1
               ELSE 0 END AS fresh FROM vset))
        WHERE greatest(mechvent, extubated) = 1 GROUP BY icustay_id, num HAVING min(charttime) < max(charttime) AND max(mechvent) = 1""",
    "gas": "SELECT l.hadm_id, a.subject_id, charttime, "
    + ", ".join(
        "max(CASE WHEN itemid = %d THEN %s END) AS %s" % (c, "value" if n == "specimen" else "v", n) for c, n in K.GAS_LABELS.items()
    )
    + f""" FROM (SELECT *, CASE WHEN valuenum <= 0 OR (itemid = 50816 AND valuenum NOT BETWEEN 20 AND 100) OR (itemid = 50817 AND valuenum > 100)
          OR (itemid = 50815 AND valuenum > 70) OR (itemid = 50821 AND valuenum > 800) THEN NULL ELSE valuenum END AS v FROM labevents) l
        JOIN admissions a ON a.hadm_id = l.hadm_id AND charttime {STAYED} WHERE itemid IN {_in(K.GAS_LABELS)} GROUP BY ALL""",
    "spo2": "SELECT hadm_id, charttime, max(CASE WHEN valuenum > 0 AND valuenum <= 100 THEN valuenum END) AS spo2 FROM chartevents WHERE itemid IN (646, 220277) GROUP BY 1, 2",
    "fio": """SELECT hadm_id, charttime, max(CASE WHEN itemid = 223835 AND valuenum > 0 AND valuenum <= 1 THEN valuenum * 100
          WHEN itemid = 223835 AND valuenum BETWEEN 21 AND 100 THEN valuenum WHEN itemid IN (3420, 3422) THEN valuenum
          WHEN itemid = 190 AND valuenum > 0.2 AND valuenum < 1 THEN valuenum * 100 END) AS f
        FROM chartevents WHERE itemid IN (223835, 3420, 3422, 190) AND error IS DISTINCT FROM 1 GROUP BY 1, 2""",
    "art": """SELECT g.hadm_id, g.subject_id, g.charttime, 100 * po2 / nullif(coalesce(g.fio2, f), 0) AS pao2fio2 FROM gas g
        LEFT JOIN (SELECT g.hadm_id, g.charttime, arg_max_null(spo2, s.charttime) AS spo2 FROM gas g JOIN spo2 s ON s.hadm_id = g.hadm_id
                   AND s.charttime BETWEEN g.charttime - INTERVAL 2 HOUR AND g.charttime GROUP BY 1, 2) s ON s.hadm_id = g.hadm_id AND s.charttime = g.charttime
        LEFT JOIN (SELECT g.hadm_id, g.charttime, arg_max_null(f, s.charttime) AS f FROM gas g JOIN fio s ON s.hadm_id = g.hadm_id
                   AND s.charttime BETWEEN g.charttime - INTERVAL 4 HOUR AND g.charttime GROUP BY 1, 2) f ON f.hadm_id = g.hadm_id AND f.charttime = g.charttime
        WHERE po2 IS NOT NULL AND (specimen = 'ART' OR 1 / (1 + exp(-("""
    + f"{K.ARTERIAL_INTERCEPT}::DOUBLE"
    + "".join(
        f" + {w} * {c}" if m is None else f" + coalesce(({w}) * {'f' if c == 'fio2_chart' else c}, {w * m + adj!r})"
        for c, w, m, adj in K.ARTERIAL_TERMS
    )
    + f"))) > {K.ARTERIAL_CUTOFF})",
    "resp": f"""SELECT p.hadm_id, {_hlos('charttime')} AS hlos, min(CASE WHEN NOT vent THEN pao2fio2 END) AS pao2fio2_novent_min, min(CASE WHEN vent THEN pao2fio2 END) AS pao2fio2_vent_min
        FROM (SELECT *, EXISTS (SELECT 1 FROM vdur v JOIN icustays i ON i.icustay_id = v.icustay_id WHERE i.hadm_id = art.hadm_id AND art.charttime BETWEEN v.starttime AND v.endtime) AS vent
              FROM art) p JOIN admissions a ON a.hadm_id = p.hadm_id GROUP BY 1, 2""",
    "echo": """SELECT row_id, hadm_id, chartdate, chartdate + to_minutes(60 * regexp_extract(text, 'at ([0-9]+):', 1)::INTEGER + regexp_extract(text, 'at [0-9]+:([0-9]+)', 1)::INTEGER) AS charttime,
        TRY_CAST(nullif(regexp_extract(text, 'Weight \\(lb\\): ([0-9]*)', 1), '') AS DOUBLE) AS weight FROM noteevents WHERE category = 'Echo'""",
    "w1": f"""SELECT a.hadm_id, avg(valuenum * CASE itemid WHEN 3581 THEN {K.LB_TO_KG} WHEN 3582 THEN {K.OZ_TO_KG} ELSE 1.0 END::DOUBLE) AS w FROM admissions a JOIN chartevents c ON a.hadm_id = c.hadm_id
        WHERE valuenum != 0 AND itemid IN {_in(K.WEIGHT_FACTORS)} AND error IS DISTINCT FROM 1 AND charttime BETWEEN admittime - INTERVAL 2 MONTH AND dischtime GROUP BY 1""",
    "w2": f"""SELECT a.hadm_id, avg(weight * {K.LB_TO_KG}::DOUBLE) AS w FROM admissions a JOIN echo e ON a.hadm_id = e.hadm_id
        AND charttime > admittime - INTERVAL 7 DAY AND charttime < dischtime GROUP BY 1""",
    "press": f"""WITH o AS (SELECT c.hadm_id, {_hlos('charttime')} AS hlos, itemid, rate, rate / coalesce(w1.w, w2.w) AS per FROM inputevents_cv c
            JOIN admissions a ON a.hadm_id = c.hadm_id AND charttime {STAYED} LEFT JOIN w1 ON w1.hadm_id = c.hadm_id LEFT JOIN w2 ON w2.hadm_id = c.hadm_id WHERE rate IS NOT NULL
              AND itemid IN (30047, 30120, 30044, 30119, 30309, 30043, 30307, 30042, 30306)),
          n AS (SELECT c.hadm_id, {_hlos('starttime')} AS hlos, itemid, rate FROM inputevents_mv c JOIN admissions a ON a.hadm_id = c.hadm_id AND starttime {STAYED}
            WHERE statusdescription != 'Rewritten' AND itemid IN (221906, 221289, 221662, 221653)),
          og AS (SELECT hadm_id, hlos, max(CASE itemid WHEN 30047 THEN per WHEN 30120 THEN rate END) AS a, max(CASE WHEN itemid = 30044 THEN per WHEN itemid IN (30119, 30309) THEN rate END) AS b,
            max(CASE WHEN itemid IN (30043, 30307) THEN rate END) AS c, max(CASE WHEN itemid IN (30042, 30306) THEN rate END) AS d FROM o GROUP BY 1, 2),
          ng AS (SELECT hadm_id, hlos, max(rate) FILTER (itemid = 221906) AS a, max(rate) FILTER (itemid = 221289) AS b, max(rate) FILTER (itemid = 221662) AS c,
            max(rate) FILTER (itemid = 221653) AS d FROM n GROUP BY 1, 2)
        SELECT hadm_id, hlos, coalesce(og.a, ng.a) AS rate_norepinephrine, coalesce(og.b, ng.b) AS rate_epinephrine, coalesce(og.c, ng.c) AS rate_dopamine,
          coalesce(og.d, ng.d) AS rate_dobutamine FROM og FULL JOIN ng USING (hadm_id, hlos)""",
    "bp": f"""SELECT c.hadm_id, {_hlos('charttime')} AS hlos, min(CASE WHEN valuenum > 0 AND valuenum < 300 THEN valuenum END) AS minbp FROM chartevents c
        JOIN admissions a ON a.hadm_id = c.hadm_id AND charttime {STAYED} WHERE itemid IN {_in(K.MEAN_PRESSURE_CODES)} AND error IS DISTINCT FROM 1 GROUP BY 1, 2""",
    "coma": f"""WITH b AS (SELECT c.hadm_id, admittime, charttime, max(CASE WHEN itemid IN (454, 223901) THEN v END) AS m, max(CASE WHEN itemid IN (723, 223900) THEN v END) AS v,
            max(CASE WHEN itemid IN (184, 220739) THEN v END) AS e, row_number() OVER (PARTITION BY c.hadm_id ORDER BY charttime) AS rn
          FROM (SELECT *, CASE WHEN (itemid = 723 AND value = '1.0 ET/Trach') OR (itemid = 223900 AND value = 'No Response-ETT') THEN 0 ELSE valuenum END AS v FROM chartevents) c
          JOIN admissions a ON a.hadm_id = c.hadm_id AND charttime {STAYED} WHERE itemid IN {_in(K.COMA_CODES)} AND error IS DISTINCT FROM 1 GROUP BY 1, 2, 3),
        p AS (SELECT b.hadm_id, b.admittime, b.charttime, b.m, b.v, b.e, q.m AS pm, q.v AS pv, q.e AS pe FROM b LEFT JOIN b q ON q.hadm_id = b.hadm_id AND q.rn = b.rn - 1
              AND q.charttime > b.charttime - INTERVAL 6 HOUR)
        SELECT hadm_id, {_hlos('charttime')} AS hlos, min(CASE WHEN v = 0 OR (v IS NULL AND pv = 0) THEN 15 WHEN pv = 0 THEN coalesce(m, 6) + coalesce(v, 5) + coalesce(e, 4)
          ELSE coalesce(m, pm, 6) + coalesce(v, pv, 5) + coalesce(e, pe, 4) END)::DOUBLE AS gcs FROM p GROUP BY 1, 2""",
    "labh": f"""SELECT l.hadm_id, {_hlos('charttime')} AS hlos, min(CASE WHEN itemid = 51265 AND valuenum <= 10000 THEN valuenum END) AS platelet,
          max(CASE WHEN itemid = 50885 AND valuenum <= 150 THEN valuenum END) AS bilirubin, max(CASE WHEN itemid = 50912 AND valuenum <= 150 THEN valuenum END) AS creatinine
        FROM labevents l JOIN admissions a ON a.hadm_id = l.hadm_id AND charttime {STAYED} WHERE itemid IN (51265, 50885, 50912) AND valuenum > 0 GROUP BY 1, 2""",
    "uo": f"""SELECT o.hadm_id, o.icustay_id, {_hlos('charttime')} AS hlos, {_hlos('charttime', 'intime')} AS iculos,
          sum(CASE WHEN itemid = 227488 AND value > 0 THEN -value ELSE value END) AS urineoutput
        FROM outputevents o JOIN admissions a ON a.hadm_id = o.hadm_id AND charttime {STAYED} JOIN icustays i ON i.icustay_id = o.icustay_id
        WHERE itemid IN {_in(K.URINE_CODES)} GROUP BY 1, 2, 3, 4""",
    "ru": """SELECT x.hadm_id, x.hlos, sum(y.urineoutput) AS running_uo_24h FROM (SELECT DISTINCT hadm_id, hlos FROM uo WHERE iculos >= 24) x
        JOIN uo y ON y.hadm_id = x.hadm_id AND y.hlos BETWEEN x.hlos - 24 AND x.hlos AND y.iculos >= 0 GROUP BY 1, 2""",
    "parts": """WITH m AS (SELECT * FROM resp FULL JOIN press USING (hadm_id, hlos) FULL JOIN bp USING (hadm_id, hlos) FULL JOIN coma USING (hadm_id, hlos)
          FULL JOIN labh USING (hadm_id, hlos) FULL JOIN ru USING (hadm_id, hlos))
        SELECT hadm_id, hlos,
          CASE WHEN pao2fio2_vent_min < 100 THEN 4 WHEN pao2fio2_vent_min < 200 THEN 3 WHEN coalesce(pao2fio2_novent_min, pao2fio2_vent_min) < 300 THEN 2
               WHEN coalesce(pao2fio2_novent_min, pao2fio2_vent_min) < 400 THEN 1 WHEN coalesce(pao2fio2_novent_min, pao2fio2_vent_min) IS NOT NULL THEN 0 END AS r,
          CASE WHEN platelet < 20 THEN 4 WHEN platelet < 50 THEN 3 WHEN platelet < 100 THEN 2 WHEN platelet < 150 THEN 1 WHEN platelet IS NOT NULL THEN 0 END AS c,
          CASE WHEN bilirubin >= 12 THEN 4 WHEN bilirubin >= 6 THEN 3 WHEN bilirubin >= 2 THEN 2 WHEN bilirubin >= 1.2 THEN 1 WHEN bilirubin IS NOT NULL THEN 0 END AS l,
          CASE WHEN rate_dopamine > 15 OR rate_epinephrine > 0.1 OR rate_norepinephrine > 0.1 THEN 4
               WHEN rate_dopamine > 5 OR rate_epinephrine IS NOT NULL OR rate_norepinephrine IS NOT NULL THEN 3 WHEN rate_dopamine > 0 OR rate_dobutamine > 0 THEN 2 WHEN minbp < 70 THEN 1
               WHEN coalesce(minbp, rate_dopamine, rate_dobutamine) IS NOT NULL THEN 0 END AS v,
          CASE WHEN gcs < 6 THEN 4 WHEN gcs <= 9 THEN 3 WHEN gcs >= 10 AND gcs <= 12 THEN 2 WHEN gcs >= 13 AND gcs <= 14 THEN 1 ELSE 0 END AS g,
          CASE WHEN creatinine >= 5 THEN 4 WHEN creatinine >= 3.5 THEN 3 WHEN creatinine >= 2 THEN 2 WHEN creatinine >= 1.2 THEN 1 WHEN coalesce(running_uo_24h, creatinine) IS NOT NULL THEN 0 END AS k,
          CASE WHEN hlos > 24 AND running_uo_24h < 200 THEN 4 WHEN hlos > 24 AND running_uo_24h < 500 THEN 3 ELSE 0 END AS u FROM m""",
    "hrs": f"SELECT hadm_id, unnest(generate_series(-24, ceil({_hours('dischtime', 'admittime')})::BIGINT))::INTEGER AS hlos FROM admissions",
    "score": """WITH g AS (SELECT h.hadm_id, h.hlos, r, c, l, v, g, k, u FROM hrs h LEFT JOIN parts p ON p.hadm_id = h.hadm_id AND p.hlos = h.hlos),
        b AS (SELECT hadm_id, hlos, max(r) OVER w AS r, max(c) OVER w AS c, max(l) OVER w AS l, max(v) OVER w AS v, max(g) OVER w AS g, greatest(max(k) OVER w, u) AS k
              FROM g WINDOW w AS (PARTITION BY hadm_id ORDER BY hlos RANGE BETWEEN 24 PRECEDING AND CURRENT ROW))
        SELECT hadm_id, hlos, r AS sofaresp, c AS sofacoag, l AS sofaliv, v AS sofacardio, g AS sofagcs, k AS sofaren,
          coalesce(r, 0) + coalesce(c, 0) + coalesce(l, 0) + coalesce(v, 0) + coalesce(g, 0) + coalesce(k, 0) AS sofa FROM b""",
    "onset": "WITH s AS (SELECT s.*, a.admittime + to_hours(s.hlos) AS sepsis_time FROM score s JOIN admissions a ON a.hadm_id = s.hadm_id JOIN si ON si.hadm_id = s.hadm_id "
    "WHERE s.hlos >= 0 AND a.admittime + to_hours(s.hlos) BETWEEN si_start - INTERVAL 1 HOUR AND si_end), d AS (SELECT hadm_id, sofa, sepsis_time, "
    + ", ".join(IL.SCORES)
    + ", "
    + ", ".join(f"coalesce({c}, 0) - min(coalesce({c}, 0)) OVER w AS {c}_delta" for c in ["sofa", *IL.SCORES])
    + " FROM s WINDOW w AS (PARTITION BY hadm_id ORDER BY sepsis_time ROWS UNBOUNDED PRECEDING)) SELECT * FROM d WHERE sofa_delta >= 2"
    " QUALIFY row_number() OVER (PARTITION BY hadm_id ORDER BY sepsis_time) = 1",
    "delta": f"""SELECT i.icustay_id, o.hadm_id, intime, outtime, sofa, sepsis_time AS sepsis_onset, sofa_delta AS delta_score, {age_sql('sepsis_time', 'intime')} AS h_from_intime,
          coalesce(positive, 0) AS icd_positive FROM onset o JOIN icustays i ON i.hadm_id = o.hadm_id AND sepsis_time BETWEEN intime AND outtime
        LEFT JOIN (SELECT hadm_id, max((icd9_code IN {_in(K.SEPSIS_DIAGNOSES)})::INTEGER) AS positive FROM diagnoses_icd GROUP BY 1) x ON x.hadm_id = o.hadm_id""",
    "flags": """WITH j AS (SELECT i.*, round(date_diff('day', dob, admittime) / 365.242::DOUBLE, 4) AS a, gender, ethnicity, has_chartevents_data,
            (SELECT arg_min(curr_service, transfertime) FROM services s WHERE s.hadm_id = i.hadm_id) AS first_service, suspected_infection_time AS t,
            row_number() OVER (PARTITION BY i.subject_id ORDER BY intime, icustay_id) AS rn
          FROM icustays i JOIN admissions ad ON ad.hadm_id = i.hadm_id JOIN patients p ON p.subject_id = i.subject_id LEFT JOIN si ON si.hadm_id = i.hadm_id)
        SELECT hadm_id, icustay_id, intime, outtime, CASE WHEN a > 89 THEN 91.4 ELSE a END AS age, gender, ethnicity, first_service, dbsource,
          (t IS NOT NULL)::INTEGER AS suspected_of_infection_poe, t AS suspected_infection_time_poe, (epoch_us(intime) - epoch_us(t)) / 86400000000.0::DOUBLE AS suspected_infection_time_poe_days,
          (rn != 1)::INTEGER AS exclusion_secondarystay_inactive, (a <= 14)::INTEGER AS exclusion_nonadult, (dbsource != 'metavision')::INTEGER AS exclusion_carevue,
          coalesce(t < intime, false)::INTEGER AS exclusion_suspicion_before_intime_inactive, CASE WHEN t > intime + INTERVAL 4 HOUR THEN 1 END AS exclusion_suspicion_after_intime_plus_4_inactive,
          (has_chartevents_data = 0)::INTEGER AS exclusion_bad_data, (a <= 14 OR has_chartevents_data = 0 OR dbsource != 'metavision')::INTEGER AS excluded FROM j""",
    "cases": f"""SELECT DISTINCT d.icustay_id::INTEGER AS icustay_id, f.intime, f.outtime, {_hours('f.outtime', 'f.intime')} AS length_of_stay, delta_score, sepsis_onset,
          (epoch_us(sepsis_onset) - epoch_us(f.intime)) / 86400000000.0::DOUBLE AS sepsis_onset_day, {_hours('sepsis_onset', 'f.intime')} AS sepsis_onset_hour
        FROM delta d JOIN flags f ON f.icustay_id = d.icustay_id WHERE excluded = 0 AND {_hours('sepsis_onset', 'f.intime')} > 0.5""",
    "ctrl": f"""SELECT DISTINCT icustay_id::INTEGER AS icustay_id, hadm_id::INTEGER AS hadm_id, intime, outtime, {_hours('outtime', 'intime')} AS length_of_stay FROM flags
        WHERE excluded = 0 AND icustay_id NOT IN (SELECT icustay_id FROM delta) AND {_hours('outtime', 'intime')} > 0.5
          AND hadm_id NOT IN (SELECT hadm_id FROM diagnoses_icd WHERE icd9_code IN {_in(K.SEPSIS_DIAGNOSES)})""",
    "matched": """WITH ca AS (SELECT icustay_id AS matched_case_icustay_id, sepsis_onset_hour AS control_onset_hour, row_number() OVER (ORDER BY sepsis_onset_hour, icustay_id) - 1 AS i FROM cases),
          co AS (SELECT *, row_number() OVER (ORDER BY length_of_stay, icustay_id) - 1 AS j FROM ctrl),
          r AS (SELECT (SELECT count(*) FROM co) / (SELECT count(*) FROM ca)::DOUBLE AS r)
        SELECT co.icustay_id, hadm_id, intime, outtime, length_of_stay, matched_case_icustay_id, control_onset_hour,
          intime + to_microseconds(round_even(control_onset_hour * 3600000000, 0)::BIGINT) AS control_onset_time
        FROM ca, r JOIN co ON j >= floor(i * r) AND j < floor((i + 1) * r)""",
    "static": """SELECT i.subject_id, i.hadm_id, icustay_id, gender, admittime, round((epoch_us(admittime) - epoch_us(dob)) / 86400000000.0::DOUBLE / 365.242, 4) AS admission_age, ethnicity,
          admission_type, admission_location, first_careunit, dense_rank() OVER a AS hospstay_seq, (dense_rank() OVER a = 1)::INTEGER AS first_hosp_stay, intime, outtime,
          dense_rank() OVER b AS icustay_seq, (dense_rank() OVER b = 1)::INTEGER AS first_icu_stay
        FROM icustays i JOIN admissions ad ON ad.hadm_id = i.hadm_id JOIN patients p ON p.subject_id = i.subject_id WHERE has_chartevents_data = 1
        WINDOW a AS (PARTITION BY i.subject_id ORDER BY admittime), b AS (PARTITION BY i.hadm_id ORDER BY intime)""",
}
STEPS["vitals"] = (
    "SELECT o.icustay_id, i.subject_id, c.charttime AS chart_time, max(CASE WHEN charttime < t0 THEN 0 WHEN charttime <= t0 + INTERVAL 5 HOUR THEN 1 ELSE 2 END) AS target, side"
    + "".join(f", round(avg(CASE WHEN itemid IN {_in(codes)} THEN v END), 8) AS {name}" for codes, name in [
        ([220179, 220050, 225309], "sysbp"), ([220180, 220051, 225310], "diabp"), ([220052, 220181, 225312], "meanbp"), ([220210, 224690], "resprate"),
        ([220045], "heartrate"), ([220277], "spo2_pulsoxy"), ([223761, 223762], "tempc")])
    + """ FROM (SELECT icustay_id, sepsis_onset AS t0, 'case' AS side FROM cases UNION ALL SELECT icustay_id, control_onset_time, 'control' FROM matched) o
      JOIN icustays i ON i.icustay_id = o.icustay_id
      JOIN (SELECT *, CASE WHEN itemid = 223761 THEN (valuenum - 32) / 1.8 ELSE valuenum END AS v FROM chartevents WHERE error = 0 AND valuenum IS NOT NULL AND (
        (itemid = 220045 AND valuenum > 0 AND valuenum < 300) OR (itemid IN (220179, 220050, 225309) AND valuenum > 0 AND valuenum < 400)
        OR (itemid IN (220180, 220051, 225310, 220052, 220181, 225312) AND valuenum > 0 AND valuenum < 300) OR (itemid IN (220210, 224690) AND valuenum > 0 AND valuenum < 70)
        OR (itemid = 223761 AND valuenum > 70 AND valuenum < 120) OR (itemid = 223762 AND valuenum > 10 AND valuenum < 50) OR (itemid = 220277 AND valuenum > 0 AND valuenum <= 100)
        OR itemid IN (228376, 227546, 228380, 228381) OR (itemid IN """
    + _in([228369, 224842, 220088, 227543, 228374, 227547, 224684, 224685, 224686, 220218])
    + " AND valuenum > 0) OR (itemid IN "
    + _in([228375, 224691, 224695, 224700, 223834, 227582, 223835, 227444])
    + """ AND valuenum >= 0))) c
      ON c.icustay_id = o.icustay_id AND charttime BETWEEN t0 - INTERVAL 48 HOUR AND t0 + INTERVAL 7 HOUR GROUP BY ALL"""
)
STEPS["labx"] = (
    "SELECT o.icustay_id, i.subject_id, l.charttime AS chart_time, max(CASE WHEN charttime < t0 THEN 0 WHEN charttime <= t0 + INTERVAL 5 HOUR THEN 1 ELSE 2 END) AS target, side"
    + "".join(
        f", round(avg(CASE WHEN itemid IN {_in([c for c, (n, _) in K.LABS.items() if n == name])} AND valuenum <= {next(h for n, h in K.LABS.values() if n == name)} THEN valuenum END), 8) AS {name}"
        for name in K.LAB_COLUMNS
    )
    + f""" FROM (SELECT icustay_id, sepsis_onset AS t0, 'case' AS side FROM cases UNION ALL SELECT icustay_id, control_onset_time, 'control' FROM matched) o
      JOIN icustays i ON i.icustay_id = o.icustay_id JOIN labevents l ON l.hadm_id = i.hadm_id AND l.charttime BETWEEN t0 - INTERVAL 48 HOUR AND t0 + INTERVAL 7 HOUR
      AND valuenum > 0 AND itemid IN {_in(K.LABS)} GROUP BY ALL"""
)


def with_steps(sql: str) -> str:
    """The SQL with every step and source it reads, directly or not, as leading common tables."""
    ctes: dict[str, str] = {}

    def need(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)\b", text):
            if name in ctes or (name not in STEPS and name not in SOURCES):
                continue
            body = STEPS.get(name) or SOURCES[name].replace("{events}", "events")
            need(body)
            ctes[name] = body

    need(sql)
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({b})" for n, b in ctes.items()) + " " + sql


# Read by most label tables.
STORED = ("chartevents", "labevents")


def _labels(spark, d):
    t = icu_tables(spark, d)
    return t, IL.label_tables(t)


def _stored_labels(spark, d):
    """Labels for the queries that need the whole chain: shared tables are written once."""
    t = icu_tables(spark, d, STORED)
    return t, IL.label_tables(t, durable)


@query("icu_drugs", with_steps("SELECT p.drug, count(*) AS numobs FROM prescriptions p JOIN drugs d ON d.drug = p.drug WHERE drug_type IN ('MAIN','ADDITIVE')"
       " AND route NOT IN ('OU','OS','OD','AU','AS','AD','TP') AND lower(route) NOT LIKE '%ear%' AND lower(route) NOT LIKE '%eye%' GROUP BY 1"))
def icu_drugs(spark, d):
    return IL.antibiotic_drugs(icu_tables(spark, d)["prescriptions"])


@query(
    "icu_suspicions",
    with_steps(f"""SELECT s.hadm_id, admittime, antibiotic_time, {_hours('antibiotic_time', 'admittime')} AS abx_h, last72_charttime, {_hours('last72_charttime', 'admittime')} AS l72_h,
      next24_charttime, {_hours('next24_charttime', 'admittime')} AS n24_h, suspected_infection_time, {_hours('suspected_infection_time', 'admittime')} AS si_h
      FROM susp s LEFT JOIN admissions a ON a.hadm_id = s.hadm_id"""),
)
def icu_suspicions(spark, d):
    return _labels(spark, d)[1]["suspicions"]


@query("icu_infection_windows", with_steps("SELECT hadm_id, suspected_infection_time, si_start, si_end FROM si"))
def icu_infection_windows(spark, d):
    return _labels(spark, d)[1]["infection_windows"]


@query("icu_vent_settings", with_steps("SELECT * FROM vset"))
def icu_vent_settings(spark, d):
    return _labels(spark, d)[1]["vent_settings"]


@query("icu_vent_durations", with_steps("SELECT * FROM vdur"))
def icu_vent_durations(spark, d):
    return _labels(spark, d)[1]["vent_durations"]


@query("icu_blood_gases", with_steps("SELECT * FROM gas"))
def icu_blood_gases(spark, d):
    return _labels(spark, d)[1]["blood_gases"]


@query("icu_respiration", with_steps("SELECT hadm_id, hlos, round(pao2fio2_novent_min, 6) AS pao2fio2_novent_min, round(pao2fio2_vent_min, 6) AS pao2fio2_vent_min FROM resp"))
def icu_respiration(spark, d):
    rows = _labels(spark, d)[1]["respiration"]
    return rows.withColumns({c: F.round(c, 6) for c in ("pao2fio2_novent_min", "pao2fio2_vent_min")})


@query("icu_echo", with_steps("SELECT row_id, hadm_id, chartdate, charttime, weight FROM echo"))
def icu_echo(spark, d):
    return _labels(spark, d)[1]["echo"].drop("subject_id")


@query(
    "icu_pressors",
    with_steps("""SELECT hadm_id, hlos, round(rate_norepinephrine, 8) AS rate_norepinephrine, round(rate_epinephrine, 8) AS rate_epinephrine,
      round(rate_dopamine, 8) AS rate_dopamine, round(rate_dobutamine, 8) AS rate_dobutamine FROM press"""),
)
def icu_pressors(spark, d):
    rows = _labels(spark, d)[1]["pressors"]
    return rows.withColumns({c: F.round(c, 8) for c in rows.columns if c.startswith("rate_")})


@query("icu_pressure", with_steps("SELECT hadm_id, hlos, round(minbp, 6) AS minbp FROM bp"))
def icu_pressure(spark, d):
    return _labels(spark, d)[1]["pressure"].withColumn("minbp", F.round("minbp", 6))


@query("icu_coma", with_steps("SELECT hadm_id, hlos, gcs FROM coma"))
def icu_coma(spark, d):
    return _labels(spark, d)[1]["coma"]


@query("icu_labs", with_steps("SELECT hadm_id, hlos, round(platelet, 6) AS platelet, round(bilirubin, 6) AS bilirubin, round(creatinine, 6) AS creatinine FROM labh"))
def icu_labs(spark, d):
    return _labels(spark, d)[1]["labs"].withColumns({c: F.round(c, 6) for c in ("platelet", "bilirubin", "creatinine")})


@query("icu_urine", with_steps("SELECT hadm_id, icustay_id, hlos, iculos, round(urineoutput, 4) AS urineoutput FROM uo"))
def icu_urine(spark, d):
    return _labels(spark, d)[1]["urine"].withColumn("urineoutput", F.round("urineoutput", 4))


@query("icu_running_urine", with_steps("SELECT hadm_id, hlos, round(running_uo_24h, 4) AS running_uo_24h FROM ru"))
def icu_running_urine(spark, d):
    return _labels(spark, d)[1]["running_urine"].withColumn("running_uo_24h", F.round("running_uo_24h", 4))


@query("icu_hourly_score", with_steps("SELECT * FROM score"))
def icu_hourly_score(spark, d):
    return _stored_labels(spark, d)[1]["scores"]


@query(
    "icu_onset_stays",
    with_steps("""SELECT icustay_id, hadm_id, intime, outtime, sofa, sepsis_onset, delta_score, h_from_intime, 1 AS septic, (h_from_intime < 7)::INTEGER AS excluded, icd_positive FROM delta"""),
)
def icu_onset_stays(spark, d):
    rows = _stored_labels(spark, d)[1]["onset_stays"]
    return rows.drop(*IL.SCORES, *[f"{s}_delta" for s in IL.SCORES])


@query("icu_onsets", with_steps("SELECT hadm_id, sofa, sepsis_time, 1 AS sepsis_onset, sofa_delta AS delta_score, " + ", ".join(f"{s}, {s}_delta" for s in IL.SCORES) + " FROM onset"))
def icu_onsets(spark, d):
    return _stored_labels(spark, d)[1]["onsets"]


@query("icu_cohort_flags", with_steps("SELECT * FROM flags"))
def icu_cohort_flags(spark, d):
    t, labels = _labels(spark, d)
    return IC.cohort_flags(t, labels["infection_windows"])


def _cohort(spark, d):
    t, labels = _stored_labels(spark, d)
    return IC.cohort_tables(t, labels, durable)


@query("icu_cases", with_steps("SELECT * FROM cases"))
def icu_cases(spark, d):
    t, labels = _stored_labels(spark, d)
    return IC.cases(labels["onset_stays"], IC.cohort_flags(t, labels["infection_windows"]))


@query("icu_controls", with_steps("SELECT * FROM ctrl"))
def icu_controls(spark, d):
    t, labels = _stored_labels(spark, d)
    flags = IC.cohort_flags(t, labels["infection_windows"])
    return IC.controls(flags, labels["onset_stays"], t["diagnoses_icd"])


@query("icu_matched_controls", with_steps("SELECT * FROM matched"))
def icu_matched_controls(spark, d):
    return _cohort(spark, d)["matched_controls"]


@query("icu_static", with_steps("SELECT * FROM static"))
def icu_static(spark, d):
    return IC.static_variables(icu_tables(spark, d))


def _both(tables, kind, columns):
    parts = []
    for side, target in (("case", "sepsis_target"), ("control", "pseudo_target")):
        rows = tables[f"{side}_{kind}"].withColumnRenamed(target, "target").withColumn("side", F.lit(side))
        parts.append(rows.withColumns({c: F.round(c, 8) for c in columns}))
    return parts[0].unionByName(parts[1])


@query("icu_vitals", with_steps("SELECT * FROM vitals"))
def icu_vitals(spark, d):
    return _both(_cohort(spark, d), "vitals", K.VITAL_COLUMNS)


@query("icu_lab_series", with_steps("SELECT * FROM labx"))
def icu_lab_series(spark, d):
    return _both(_cohort(spark, d), "labs", K.LAB_COLUMNS)
