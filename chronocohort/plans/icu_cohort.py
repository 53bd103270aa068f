"""Cases, matched controls, static variables and event extraction on the intensive-care schema."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from chronocohort.functions import scalars as S, timefn as T
from chronocohort.operators import aggregates as A, cohort as C, coding as CD, intervals as I, reshape as R, windows as W
from chronocohort.operators.ordered import KeyedOrder, keyed_rank
from chronocohort.plans import icu_codes as K
from chronocohort.plans.icu_labels import Sizes
from chronocohort.plans.tables import Tables


def cohort_flags(t: Mapping[str, DataFrame] | Tables, windows: DataFrame) -> DataFrame:
    """Every intensive-care stay with age, first service, suspicion and the exclusion flags."""
    first_service = W.first_row(
        t["services"].select("hadm_id", "transfertime", "curr_service"), ["hadm_id"], ["transfertime"]
    ).select("hadm_id", F.col("curr_service").alias("first_service"))
    stays = keyed_rank(
        t["icustays"].select("icustay_id", "hadm_id", "subject_id", "intime", "outtime", "dbsource"),
        ["subject_id"], ["intime", "icustay_id"], "_rn",
    )
    joined = (
        stays.join(t["admissions"].select("hadm_id", "admittime", "ethnicity", "has_chartevents_data"), "hadm_id")
        .join(t["patients"].select("subject_id", "dob", "gender"), "subject_id")
        .join(first_service, "hadm_id", "left")
        .join(windows.select("hadm_id", "suspected_infection_time"), "hadm_id", "left")
    )
    raw_age = F.round(F.datediff("admittime", "dob") / F.lit(365.242), 4)
    suspected = F.col("suspected_infection_time")
    rows = joined.withColumn("_age", raw_age)
    minor, missing = F.col("_age") <= K.ADULT_OVER_AGE, F.col("intime").isNull() | F.col("outtime").isNull()
    no_data, other_source = F.col("has_chartevents_data") == 0, F.col("dbsource") != K.DATA_SOURCE
    flags = S.exclusion_flags({"a": minor, "b": no_data, "c": missing, "d": other_source})
    return rows.select(
        "hadm_id", "icustay_id", "intime", "outtime",
        F.when(F.col("_age") > 89, 91.4).otherwise(F.col("_age")).alias("age"),
        "gender", "ethnicity", "first_service", "dbsource",
        F.when(suspected.isNotNull(), 1).otherwise(0).alias("suspected_of_infection_poe"),
        suspected.alias("suspected_infection_time_poe"),
        T.days_between(suspected, "intime").alias("suspected_infection_time_poe_days"),
        F.when(F.col("_rn") == 1, 0).otherwise(1).alias("exclusion_secondarystay_inactive"),
        F.when(minor, 1).otherwise(0).alias("exclusion_nonadult"),
        F.when(other_source, 1).otherwise(0).alias("exclusion_carevue"),
        F.when(suspected < F.col("intime"), 1).otherwise(0).alias("exclusion_suspicion_before_intime_inactive"),
        F.when(suspected > F.col("intime") + T.hours(4), 1).alias("exclusion_suspicion_after_intime_plus_4_inactive"),
        F.when(no_data | missing, 1).otherwise(0).alias("exclusion_bad_data"),
        flags["excluded"].alias("excluded"),
    )


def cases(onset_stays: DataFrame, flags: DataFrame) -> DataFrame:
    """Included stays with an onset more than half an hour after their start."""
    kept = flags.where(F.col("excluded") == 0).select("icustay_id", "intime", "outtime")
    rows = onset_stays.select("icustay_id", "delta_score", "sepsis_onset").join(kept, "icustay_id")
    onset_hour = T.hours_between("intime", "sepsis_onset")
    return rows.where(onset_hour > K.MIN_HOURS).select(
        F.col("icustay_id").cast("int"), "intime", "outtime",
        T.hours_between("intime", "outtime").alias("length_of_stay"),
        F.col("delta_score").cast("int"), "sepsis_onset",
        T.days_between("intime", "sepsis_onset").alias("sepsis_onset_day"),
        onset_hour.alias("sepsis_onset_hour"),
    ).distinct()


def controls(flags: DataFrame, onset_stays: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Included stays without onset and without a sepsis diagnosis, longer than half an hour."""
    diagnosed = diagnoses.where(F.col("icd9_code").isin(K.SEPSIS_DIAGNOSES)).select("hadm_id")
    free = flags.where(F.col("excluded") == 0).join(onset_stays.select("icustay_id"), "icustay_id", "left_anti")
    length = T.hours_between("intime", "outtime")
    return C.not_in(free, diagnosed, "hadm_id").where(length > K.MIN_HOURS).select(
        F.col("icustay_id").cast("int"), F.col("hadm_id").cast("int"), "intime", "outtime", length.alias("length_of_stay")
    ).distinct()


def matched_controls(case_stays: DataFrame, control_stays: DataFrame) -> DataFrame:
    """Controls with the onset hour of the case their slice belongs to."""
    matched = C.match_by_rank(
        case_stays.groupBy("icustay_id").agg(F.min("sepsis_onset_hour").alias("sepsis_onset_hour")),
        control_stays, "icustay_id", "sepsis_onset_hour", "icustay_id", "length_of_stay", "intime",
    )
    return matched.withColumnsRenamed(
        {"matched_case": "matched_case_icustay_id", "onset_hour": "control_onset_hour", "onset_time": "control_onset_time"}
    )


def static_variables(t: Mapping[str, DataFrame] | Tables) -> DataFrame:
    """Facts known at the start of each stay, with visit numbers per patient and per admission."""
    adm = t["admissions"].where(F.col("has_chartevents_data") == 1).select(
        "hadm_id", "admittime", "ethnicity", "admission_type", "admission_location"
    )
    rows = (
        t["icustays"].select("subject_id", "hadm_id", "icustay_id", "first_careunit", "intime", "outtime")
        .join(adm, "hadm_id")
        .join(t["patients"].select("subject_id", "gender", "dob"), "subject_id")
        .withColumn("admission_age", F.round(T.days_between("dob", "admittime") / F.lit(365.242), 4))
    )
    rows = KeyedOrder(rows, ["subject_id"], ["admittime"]).dense_rank("hospstay_seq").rows()
    rows = KeyedOrder(rows, ["hadm_id"], ["intime"]).dense_rank("icustay_seq").rows()
    first = {"first_hosp_stay": "hospstay_seq", "first_icu_stay": "icustay_seq"}
    return rows.drop("dob").withColumns({n: F.when(F.col(c) == 1, 1).otherwise(0) for n, c in first.items()})


def _index(stays: DataFrame, onset: str, icustays: DataFrame) -> DataFrame:
    onsets = stays.select("icustay_id", F.col(onset).alias("_onset")).distinct()
    return onsets.join(icustays.select("icustay_id", "subject_id", "hadm_id"), "icustay_id")


def vitals_around_onset(
    stays: DataFrame, onset: str, icustays: DataFrame, chartevents: DataFrame, target: str = "sepsis_target",
    null_error_ok: bool = False, keep_empty: bool = False, tasks: int | None = None,
) -> DataFrame:
    """Vital signs from 48 h before to 7 h after onset: one filled column per row.

    A missing error mark drops the row unless ``null_error_ok``. ``keep_empty`` keeps rows whose
    concept has no column. With ``tasks`` the rows are dealt over that many tasks by stay and time.
    """
    rules = [
        (code, None if low is None else float(low), None if high is None else float(high), high_in, low_in, name)
        for codes, low, high, high_in, low_in, name in K.VITALS
        for code in codes
        if code not in K.VITALS_UNREAD_CODES
    ]
    read = [r[0] for r in rules]
    sound = S.is_not("error", 1) if null_error_ok else F.col("error") == 0
    rows = chartevents.where(F.col("itemid").isin(read) & sound).select(
        "icustay_id", "itemid", F.col("charttime").alias("chart_time"), "valuenum"
    )
    index = _index(stays, onset, icustays).drop("hadm_id")
    near = _dealt(I.around_index(rows, index, "icustay_id", "chart_time", "_onset", 48, 7, tasks=tasks), tasks)
    coded = CD.map_codes_in_range(near, rules, "itemid", "valuenum")
    celsius = {c: (1 / 1.8, -32 / 1.8) for c in K.FAHRENHEIT_CODES}
    coded = coded.withColumn("_v", S.convert_units("itemid", "valuenum", celsius))
    names = list(dict.fromkeys(n for *_, n in K.VITALS if n != K.VITALS_HIDDEN))
    return _sparse(coded, "concept", names, target, keep_empty)


def labs_around_onset(
    stays: DataFrame, onset: str, icustays: DataFrame, labevents: DataFrame, target: str = "sepsis_target",
    tasks: int | None = None,
) -> DataFrame:
    """Laboratory values from 48 h before to 7 h after onset: one filled column per row.

    With ``tasks`` the rows are dealt over that many tasks by stay and time.
    """
    rows = labevents.where(F.col("itemid").isin(list(K.LABS)) & (F.col("valuenum") > 0)).select(
        "hadm_id", "itemid", F.col("charttime").alias("chart_time"), "valuenum"
    )
    near = _dealt(I.around_index(rows, _index(stays, onset, icustays), "hadm_id", "chart_time", "_onset", 48, 7, tasks=tasks), tasks)
    labelled = CD.label_codes(near, [(c, n) for c, (n, _) in K.LABS.items()], "itemid")
    limits = {c: high for c, (_, high) in K.LABS.items()}
    labelled = labelled.withColumn("_v", S.clamp_null("itemid", "valuenum", limits))
    return _sparse(labelled, "label", list(dict.fromkeys(n for n, _ in K.LABS.values())), target, False)


def _dealt(rows: DataFrame, tasks: int | None) -> DataFrame:
    return rows if tasks is None else rows.repartition(tasks, "icustay_id", "chart_time")


def _sparse(rows: DataFrame, concept: str, names: Sequence[str], target: str, keep_empty: bool) -> DataFrame:
    marked = rows.withColumn(target, T.phase_label("chart_time", "_onset"))
    ids = ["icustay_id", "subject_id", "chart_time", target]
    return R.sparse_wide(marked, ids, concept, "_v", {n: n for n in names}, keep_empty)


def per_timestamp(sparse: DataFrame, columns: Sequence[str], target: str = "sepsis_target") -> DataFrame:
    """One row per stay and time: the mean of every reading of that moment."""
    keys = ["icustay_id", "chart_time"]
    rows = A.mean_per_time(sparse, keys, ["subject_id", target, *columns])
    return rows.withColumns({"subject_id": F.col("subject_id").cast("bigint"), target: F.col(target).cast("int")})


def cohort_tables(t: Mapping[str, DataFrame] | Tables, labels: Tables, keep: Callable = lambda df: df) -> Tables:
    """Cohort and extraction tables from the sources and the label tables, each built when asked for.

    ``keep`` stores the tables that several others read: the cohort flags and the cases.
    """
    chart, analyses = Sizes(t, "chartevents"), Sizes(t, "labevents")
    sides = {"case": ("cases", "sepsis_onset", "sepsis_target"), "control": ("matched_controls", "control_onset_time", "pseudo_target")}

    def vitals(side):
        stays, onset, target = sides[side]
        return lambda own: per_timestamp(
            vitals_around_onset(own[stays], onset, t["icustays"], t["chartevents"], target, tasks=chart.tasks()), K.VITAL_COLUMNS, target
        )

    def labs(side):
        stays, onset, target = sides[side]
        return lambda own: per_timestamp(
            labs_around_onset(own[stays], onset, t["icustays"], t["labevents"], target, analyses.tasks()), K.LAB_COLUMNS, target
        )

    def static(side):
        return lambda own: own["static"].join(own[sides[side][0]].drop("intime", "outtime", "hadm_id"), "icustay_id")

    builders = {
        "flags": lambda own: keep(cohort_flags(t, labels["infection_windows"])),
        "cases": lambda own: keep(cases(labels["onset_stays"], own["flags"])),
        "controls": lambda own: controls(own["flags"], labels["onset_stays"], t["diagnoses_icd"]),
        "matched_controls": lambda own: keep(matched_controls(own["cases"], own["controls"])),
        "static": lambda own: static_variables(t),
    }
    for side in sides:
        builders |= {f"{side}_vitals": vitals(side), f"{side}_labs": labs(side), f"{side}_static": static(side)}
    return Tables(builders)
