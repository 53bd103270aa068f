"""Labels on the intensive-care schema: infection window, six hourly organ scores, onset.

Every function takes source tables as DataFrames and returns one of the derived tables. Times are
``timestamp_ntz``. ``hlos`` is the calendar hour since admission (see ``age_hour_index``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from chronocohort.functions import scalars as S, timefn as T
from chronocohort.operators import aggregates as A, cohort as C, intervals as I, reshape as R, windows as W
from chronocohort.operators.skew import GroupSizes, heavy_keys, key_join
from chronocohort.plans import icu_codes as K, labels as L
from chronocohort.plans.tables import Tables

SCORES = ["sofaresp", "sofacoag", "sofaliv", "sofacardio", "sofagcs", "sofaren"]


def _hour(t: str) -> Column:
    return T.age_hour_index(t, "admittime").cast("int").alias("hlos")


def _admission_spans(admissions: DataFrame) -> DataFrame:
    return admissions.select("hadm_id", "admittime", "dischtime")


def _within_admission(
    events: DataFrame,
    admissions: DataFrame,
    t: str = "charttime",
    lead: Column | None = None,
    hot: Sequence | None = None,
    tasks: int | None = None,
) -> DataFrame:
    return I.in_stay(events, _admission_spans(admissions), "hadm_id", t, "admittime", "dischtime", lead, hot, tasks)


def _dealt(rows: DataFrame, tasks: int | None, *keys: str, hot: Sequence | None = None) -> DataFrame:
    """Rows dealt over ``tasks`` tasks by the keys they are folded by, as they are where no number is given.

    Where ``hot`` names no hot key, the join before has dealt the rows alike.
    """
    return rows if tasks is None or hot == {} else rows.repartition(tasks, *keys)


class Sizes:
    """Group sizes and number of rows of one source table, measured on first use."""

    def __init__(self, tables: Mapping[str, DataFrame] | Tables, name: str):
        self._tables, self._name, self._sizes, self._tasks = tables, name, None, None

    def __call__(self) -> GroupSizes:
        if self._sizes is None:
            self._sizes = GroupSizes(self._tables[self._name])
        return self._sizes

    def tasks(self) -> int:
        """Tasks for the rows of the table, or of a table made of it, in order of a key."""
        if self._tasks is None:
            self._tasks = R.tasks_for(self._tables[self._name], F.lit(1))
        return self._tasks


# --- suspicion of infection -------------------------------------------------------------------
def antibiotic_drugs(prescriptions: DataFrame) -> DataFrame:
    """Drug names that count as systemic antibiotics, with their number of orders, most frequent first."""
    route = F.col("route")
    usable = (
        F.col("drug_type").isin(K.DRUG_TYPES)
        & ~route.isin(K.EXCLUDED_ROUTES)
        & (S.keyword_any(route, K.EXCLUDED_ROUTE_WORDS) == 0)
        & route.isNotNull()
    )
    hit = S.keyword_any("drug", K.ANTIBIOTICS, K.EXCLUDED_DRUG_WORDS) == 1
    counts = prescriptions.where(usable & hit).groupBy("drug").agg(F.count(F.lit(1)).alias("numobs"))
    return counts.orderBy(F.desc("numobs"), "drug")


def antibiotic_times(prescriptions: DataFrame, drugs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Antibiotic orders per admission and start."""
    given = prescriptions.join(drugs.select("drug"), "drug", "left_semi")
    return _dealt(given, tasks, "hadm_id", "startdate").groupBy("hadm_id", F.col("startdate").alias("antibiotic_time")).agg(
        F.count("drug").alias("no_antibiotic")
    )


def cultures(microbiology: DataFrame, tasks: int | None = None) -> DataFrame:
    samples = microbiology.select("hadm_id", "chartdate", "charttime", "spec_type_desc")
    return _dealt(samples, tasks, "hadm_id", "charttime", "chartdate").distinct()


def suspicions(antibiotics: DataFrame, samples: DataFrame, admissions: DataFrame, pairs: bool = True, **sizing) -> DataFrame:
    """Antibiotics with a culture in the 72 h before or the 24 h after, and hours since admission.

    With ``pairs`` there is a row per pair of cultures; the infection window needs only the other form, which takes ``sizing``.
    """
    near = (I.two_sided_proximity if pairs else I.earliest_on_sides)(
        antibiotics.select("hadm_id", "antibiotic_time"), samples, "hadm_id", "antibiotic_time", "charttime", "chartdate", **sizing
    )
    suspected = F.least(F.coalesce("last_time", "next_time"), "antibiotic_time")
    timed = near.withColumn("suspected_infection_time", suspected).join(
        admissions.select("hadm_id", "admittime"), "hadm_id", "left"
    )
    since = {
        "abx_h": "antibiotic_time", "l72_h": "last_time", "n24_h": "next_time", "si_h": "suspected_infection_time",
    }
    hours = {name: T.hours_between("admittime", t) for name, t in since.items()}
    return timed.withColumns(hours).withColumnsRenamed({"last_time": "last72_charttime", "next_time": "next24_charttime"}).drop(
        "last_kind", "next_kind"
    )


def infection_windows(suspected: DataFrame) -> DataFrame:
    """First suspicion per admission with its window from 48 h before to 24 h after."""
    windows = L.infection_windows(suspected, "hadm_id", "suspected_infection_time")
    return windows.withColumnsRenamed(
        {"suspected": "suspected_infection_time", "window_start": "si_start", "window_end": "si_end"}
    )


# --- respiration ------------------------------------------------------------------------------
def vent_settings(chartevents: DataFrame, procedures: DataFrame, tasks: int | None = None) -> DataFrame:
    """Ventilation, oxygen and extubation flags per stay and time, from chart and procedures."""
    code, text = F.col("itemid"), F.col("value")
    read = sorted(
        {c for c in K.VENT_SETTING_CODES if c not in K.VENT_UNREAD_CODES}
        | set(K.VENT_TYPE_CODES) | set(K.OTHER_OXYGEN_CODES)
        | {K.VENT_MODE_CODE, K.OXYGEN_DEVICE_CODE, K.EXTUBATION_CODE}
    )
    vented = code.isin(K.VENT_SETTING_CODES) | (code == K.VENT_MODE_CODE)
    vented = vented | ((code == K.OXYGEN_DEVICE_CODE) & (text == K.VENTILATOR_TEXT))
    for item, other in K.VENT_TYPE_CODES.items():
        vented = vented | ((code == item) & (text != other))
    oxygen = F.lit(False)
    for item, devices in K.OXYGEN_DEVICES.items():
        oxygen = oxygen | ((code == item) & text.isin(devices))
    flags = {
        "mechvent": vented,
        "oxygentherapy": oxygen,
        "extubated": (code == K.EXTUBATION_CODE) & text.isin(K.EXTUBATED_TEXTS),
        "selfextubated": (code == K.EXTUBATION_CODE) & (text == K.SELF_EXTUBATED_TEXT),
    }
    rows = chartevents.where(text.isNotNull() & S.is_not("error", 1) & code.isin(read))
    charted = A.flag_max(_dealt(rows, tasks, "icustay_id", "charttime"), ["icustay_id", "charttime"], flags)
    procedural = procedures.where(F.col("itemid").isin(K.EXTUBATION_PROCEDURES)).select(
        "icustay_id",
        F.col("starttime").alias("charttime"),
        F.lit(0).alias("mechvent"),
        F.lit(0).alias("oxygentherapy"),
        F.lit(1).alias("extubated"),
        F.when(F.col("itemid") == K.SELF_EXTUBATION_PROCEDURE, 1).otherwise(0).alias("selfextubated"),
    )
    return _dealt(charted.union(procedural), tasks, "icustay_id", "charttime").distinct()


def vent_durations(settings: DataFrame, split: bool | None = None, tasks: int | None = None) -> DataFrame:
    """Numbered ventilation episodes per stay. Rows of one time run ventilation first, extubation last."""
    ties = settings.withColumn("_not_vent", 1 - F.col("mechvent"))
    episodes = W.sessionize(
        ties, "icustay_id", "charttime", "mechvent", "oxygentherapy", "extubated", K.VENT_GAP_HOURS,
        ["_not_vent", "extubated", "selfextubated", "oxygentherapy"], split=split, tasks=tasks,
    )
    return episodes.select(
        "icustay_id", F.col("episode").alias("ventnum"), F.col("start").alias("starttime"),
        F.col("finish").alias("endtime"), F.col("hours").alias("duration_hours"),
    )


def blood_gases(admissions: DataFrame, labevents: DataFrame, hot: Sequence | None = None, tasks: int | None = None) -> DataFrame:
    """Blood gas values per admission and time, one column per analyte; implausible values are null."""
    labs = labevents.where(F.col("itemid").isin(list(K.GAS_LABELS))).select("hadm_id", "itemid", "charttime", "value", "valuenum")
    stay = _within_admission(labs, admissions, hot=hot, tasks=tasks)
    stay = key_join(stay, admissions.select("hadm_id", "subject_id"), "hadm_id", hot=hot or {}, tasks=tasks if hot else None)
    v = F.col("valuenum")
    for item, low in K.GAS_LOWER.items():
        v = F.when((F.col("itemid") == item) & (F.col("valuenum") < low), None).otherwise(v)
    kept = stay.withColumn("_v", F.when(F.col("valuenum") <= 0, None).otherwise(S.clamp_null("itemid", v, K.GAS_UPPER)))
    aggs = [
        F.max(F.when(F.col("itemid") == item, F.col("value" if label == "specimen" else "_v"))).alias(label)
        for item, label in K.GAS_LABELS.items()
    ]
    return _dealt(kept, tasks, "hadm_id", "charttime", hot=hot).groupBy("subject_id", "hadm_id", "charttime").agg(*aggs)


def _spo2(chartevents: DataFrame, tasks: int | None = None) -> DataFrame:
    v = F.col("valuenum")
    valid = F.when((v <= 0) | (v > 100), None).otherwise(v)
    rows = chartevents.where(F.col("itemid").isin(K.SPO2_CODES))
    return _dealt(rows, tasks, "hadm_id", "charttime").groupBy("hadm_id", "charttime").agg(F.max(valid).alias("spo2"))


def _fio2(chartevents: DataFrame, tasks: int | None = None) -> DataFrame:
    code, v = F.col("itemid"), F.col("valuenum")
    percent = (
        F.when(code == K.FIO2_BANDED_CODE, S.banded(v, [(0, 1, True, 100), (21, 100, False, 1)]))
        .when(code.isin(K.FIO2_PERCENT_CODES), v)
        .when((code == K.FIO2_FRACTION_CODE) & (v > 0.20) & (v < 1), v * 100)
    )
    codes = [K.FIO2_BANDED_CODE, K.FIO2_FRACTION_CODE, *K.FIO2_PERCENT_CODES]
    rows = chartevents.where(code.isin(codes) & S.is_not("error", 1))
    return _dealt(rows, tasks, "hadm_id", "charttime").groupBy("hadm_id", "charttime").agg(F.max(percent).alias("fio2_read"))


def arterial_ratios(gases: DataFrame, chartevents: DataFrame, split: bool | None = None, tasks: int | None = None) -> DataFrame:
    """PaO2/FiO2 of the arterial samples, with the freshest oxygen setting of the last four hours.

    A sample is arterial if it says so or if the regression on its values exceeds the cutoff.
    """
    rows = gases.where(F.col("po2").isNotNull())
    rows = I.asof(rows, _spo2(chartevents, tasks), "hadm_id", "charttime", "charttime", "spo2", 2, split=split, tasks=tasks)
    rows = I.asof_two_sources(
        rows, "fio2", _fio2(chartevents, tasks), "hadm_id", "charttime", "charttime", "fio2_read", 4, "fio2_val", "fio2_chart",
        split=split, tasks=tasks,
    )
    rows = rows.withColumn("specimen_prob", S.logistic_score(K.ARTERIAL_INTERCEPT, K.ARTERIAL_TERMS))
    arterial = (F.col("specimen") == "ART") | (F.col("specimen_prob") > K.ARTERIAL_CUTOFF)
    return rows.where(arterial).select(
        "subject_id", "hadm_id", "charttime", S.guarded_ratio("po2", "fio2_val").alias("pao2fio2")
    )


def respiration_hours(
    ratios: DataFrame, episodes: DataFrame, icustays: DataFrame, admissions: DataFrame, split: bool | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Lowest PaO2/FiO2 per admission hour, apart for ventilated and free-breathing samples."""
    spans = episodes.join(icustays.select("icustay_id", "hadm_id"), "icustay_id").select("hadm_id", "starttime", "endtime")
    flagged = I.point_in_interval(
        ratios.select("hadm_id", "charttime", "pao2fio2"), spans, "hadm_id", "charttime", "starttime", "endtime", "isvent",
        split=split, tasks=tasks,
    )
    timed = flagged.join(admissions.select("hadm_id", "admittime"), "hadm_id").withColumn("hlos", _hour("charttime"))
    return A.min_by_state(
        timed, ["hadm_id", "hlos"], "isvent", "pao2fio2", {"pao2fio2_novent_min": 0, "pao2fio2_vent_min": 1}
    )


# --- circulation ------------------------------------------------------------------------------
def echo_weights(notes: DataFrame) -> DataFrame:
    """Time and weight (lb) written in the text of echo notes."""
    clock = F.regexp_extract("text", K.ECHO_CLOCK, 1)
    return notes.where(F.col("category") == "Echo").select(
        "row_id", "subject_id", "hadm_id", "chartdate",
        T.compose_ts("chartdate", clock).alias("charttime"),
        S.extract_number("text", K.ECHO_WEIGHT).alias("weight"),
    )


def _weights(admissions: DataFrame, chartevents: DataFrame, echo: DataFrame, hot: Sequence | None, tasks: int | None) -> DataFrame:
    """Weight per admission: the mean of the charted ones, else of those in echo notes."""
    charted = chartevents.where(
        F.col("itemid").isin(list(K.WEIGHT_FACTORS)) & (F.col("valuenum") != 0) & S.is_not("error", 1)
    ).select("hadm_id", "itemid", "charttime", "valuenum")
    stay = _within_admission(charted, admissions, lead=F.make_ym_interval(F.lit(0), F.lit(2)), hot=hot, tasks=tasks)
    scale = L.mean_weight(stay, "hadm_id", "itemid", "valuenum", K.WEIGHT_FACTORS)
    seen = (F.col("charttime") > F.col("admittime") - F.make_dt_interval(F.lit(7))) & (F.col("charttime") < F.col("dischtime"))
    echoed = key_join(echo.select("hadm_id", "charttime", "weight"), _admission_spans(admissions), "hadm_id", seen, tasks=tasks)
    noted = echoed.groupBy("hadm_id").agg(F.avg(F.col("weight") * K.LB_TO_KG).alias("noted"))
    both = A.merge_on_spine([scale, noted], ["hadm_id"])
    return both.select("hadm_id", F.coalesce("weight", "noted").alias("weight"))


def pressor_hours(
    admissions: DataFrame,
    inputs_old: DataFrame,
    inputs_new: DataFrame,
    chartevents: DataFrame,
    echo: DataFrame,
    hot: Sequence | None = None,
    tasks: int | None = None,
    keep: Callable = lambda df: df,
) -> DataFrame:
    """Highest vasopressor rates per admission hour; the older recording system counts first.

    Both systems read the weights, which ``keep`` stores.
    """
    weights = keep(_weights(admissions, chartevents, echo, hot, tasks))
    old_codes = [c for pair in K.PRESSOR_CODES_OLD.values() for codes in pair for c in codes]
    new_codes = [c for pair in K.PRESSOR_CODES_NEW.values() for codes in pair for c in codes]
    old = inputs_old.where(F.col("itemid").isin(old_codes) & F.col("rate").isNotNull()).select(
        "hadm_id", "itemid", "charttime", "rate"
    )
    hot_old = heavy_keys(old, "hadm_id")
    old = _within_admission(old, admissions, hot=hot_old, tasks=tasks).withColumn("hlos", _hour("charttime"))
    new = inputs_new.where(F.col("itemid").isin(new_codes) & (F.col("statusdescription") != K.REWRITTEN)).select(
        "hadm_id", "itemid", "starttime", "rate"
    )
    hot_new = heavy_keys(new, "hadm_id")
    new = _within_admission(new, admissions, "starttime", hot=hot_new, tasks=tasks).withColumn("hlos", _hour("starttime"))
    keys = ["hadm_id", "hlos"]
    old_columns, new_columns = ({f"{s}_{k}": v for k, v in codes.items()} for s, codes in (("old", K.PRESSOR_CODES_OLD), ("new", K.PRESSOR_CODES_NEW)))
    a = A.weighted_rate(old, [weights], "hadm_id", keys, "itemid", "rate", old_columns, hot=hot_old, tasks=tasks)
    b = A.weighted_rate(new, [weights], "hadm_id", keys, "itemid", "rate", new_columns, hot=hot_new, tasks=tasks)
    both = A.merge_on_spine([a, b], keys, tasks)
    return both.select(*keys, *[F.coalesce(f"old_{k}", f"new_{k}").alias(f"rate_{k}") for k in K.PRESSOR_CODES_OLD])


def pressure_hours(admissions: DataFrame, chartevents: DataFrame, hot: Sequence | None = None, tasks: int | None = None) -> DataFrame:
    """Lowest plausible mean arterial pressure per admission hour."""
    v = F.col("valuenum")
    rows = chartevents.where(F.col("itemid").isin(K.MEAN_PRESSURE_CODES) & S.is_not("error", 1)).select(
        "hadm_id", "charttime", F.when((v > 0) & (v < 300), v).alias("v")
    )
    timed = _within_admission(rows, admissions, hot=hot, tasks=tasks).withColumn("hlos", _hour("charttime"))
    return _dealt(timed, tasks, "hadm_id", "hlos", hot=hot).groupBy("hadm_id", "hlos").agg(F.min("v").alias("minbp"))


# --- consciousness ----------------------------------------------------------------------------
def coma_hours(admissions: DataFrame, chartevents: DataFrame, hot: Sequence | None = None, tasks: int | None = None) -> DataFrame:
    """Lowest coma score per admission hour; missing parts come from a reading under six hours old,
    else count as normal, and a verbal score of 0 (intubated) stands for a full score."""
    value = S.sentinel("itemid", "value", "valuenum", K.COMA_SENTINELS)
    rows = chartevents.where(F.col("itemid").isin(list(K.COMA_CODES)) & S.is_not("error", 1)).select(
        "hadm_id", "charttime", S.category_map(F.col("itemid").cast("string"), {
            part: [str(c) for c, p in K.COMA_CODES.items() if p == part] for part in K.COMA_NORMAL
        }).alias("part"), value.alias("v"),
    )
    timed = _within_admission(rows, admissions, hot=hot, tasks=tasks)
    parts = A.conditional_pivot(
        _dealt(timed, tasks, "hadm_id", "charttime", hot=hot), ["hadm_id", "charttime"], "part", "v", {p: ("max", p) for p in K.COMA_NORMAL}
    )
    seen = W.previous_within(parts, "hadm_id", "charttime", list(K.COMA_NORMAL), 6, split=None if hot is None else bool(hot), tasks=tasks)

    def total(with_previous: bool) -> Column:
        cols = [
            F.coalesce(F.col(p), *([F.col(f"{p}_prev")] if with_previous else []), F.lit(float(normal)))
            for p, normal in K.COMA_NORMAL.items()
        ]
        return cols[0] + cols[1] + cols[2]

    intubated_before = F.col("verbal_prev") == 0
    gcs = (
        F.when(F.col("verbal") == 0, float(K.COMA_BEST))
        .when(F.col("verbal").isNull() & intubated_before, float(K.COMA_BEST))
        .when(intubated_before, total(False))
        .otherwise(total(True))
    )
    timed = seen.withColumn("gcs", gcs).join(admissions.select("hadm_id", "admittime"), "hadm_id")
    return timed.groupBy("hadm_id", _hour("charttime")).agg(F.min("gcs").alias("gcs"))


# --- laboratory and kidney --------------------------------------------------------------------
def lab_hours(admissions: DataFrame, labevents: DataFrame, hot: Sequence | None = None, tasks: int | None = None) -> DataFrame:
    """Worst platelet, bilirubin and creatinine value per admission hour, in one pass over the labs."""
    codes = {code: high for code, high, _ in K.SCORE_LABS.values()}
    rows = labevents.where(F.col("itemid").isin(list(codes)) & (F.col("valuenum") > 0)).select(
        "hadm_id", "itemid", "charttime", S.clamp_null("itemid", "valuenum", codes).alias("v")
    )
    timed = _within_admission(rows, admissions, hot=hot, tasks=tasks).withColumn("hlos", _hour("charttime"))
    return A.conditional_pivot(
        _dealt(timed, tasks, "hadm_id", "hlos", hot=hot), ["hadm_id", "hlos"], "itemid", "v", {name: (fn, code) for name, (code, _, fn) in K.SCORE_LABS.items()}
    )


def urine_hours(admissions: DataFrame, outputs: DataFrame, icustays: DataFrame, tasks: int | None = None) -> DataFrame:
    """Net urine per admission, stay and hour (``hlos`` since admission, ``iculos`` since the stay)."""
    rows = outputs.where(F.col("itemid").isin(K.URINE_CODES)).select("hadm_id", "icustay_id", "itemid", "charttime", "value")
    hot = heavy_keys(rows, "icustay_id")
    timed = _within_admission(rows, admissions, tasks=tasks)
    timed = key_join(timed, icustays.select("icustay_id", "intime"), "icustay_id", hot=hot, tasks=tasks)
    keyed = timed.select(
        "hadm_id", "icustay_id", _hour("charttime"),
        T.age_hour_index("charttime", "intime").cast("int").alias("iculos"), "itemid", "value",
    )
    keyed = _dealt(keyed, tasks, "icustay_id", "hlos", hot=hot)
    return A.signed_sum(keyed, ["hadm_id", "icustay_id", "hlos", "iculos"], "itemid", "value", [K.IRRIGANT_IN], "urineoutput")


def running_urine(hourly: DataFrame, repeat_stays: bool = False, tasks: int | None = None) -> DataFrame:
    """Urine of the last 24 h for hours at least a day into a stay.

    ``repeat_stays`` multiplies by the number of such stay rows of the hour, as a join of the table
    with itself does where stays of one admission overlap.
    """
    per_hour = _dealt(hourly, tasks, "hadm_id").groupBy("hadm_id", "hlos").agg(
        F.sum(F.when(F.col("iculos") >= 0, F.col("urineoutput"))).alias("_out"),
        F.sum(F.when(F.col("iculos") >= 24, 1).otherwise(0)).alias("_rows"),
    )
    summed = W.trailing_hours(per_hour, "hadm_id", "hlos", {"running_uo_24h": ("sum", "_out")}, 24)
    out = summed.where(F.col("_rows") > 0)
    if repeat_stays:
        out = out.withColumn("running_uo_24h", F.col("running_uo_24h") * F.col("_rows"))
    return out.select("hadm_id", "hlos", "running_uo_24h")


# --- hourly score -----------------------------------------------------------------------------
def score_ladders() -> dict[str, Column]:
    """Organ sub-scores 0..4 as columns over the merged hourly measurements."""
    vent, free = F.col("pao2fio2_vent_min"), F.col("pao2fio2_novent_min")
    any_ratio = F.coalesce(free, vent)
    respiration = (
        F.when(vent < 100, 4).when(vent < 200, 3).when(any_ratio < 300, 2).when(any_ratio < 400, 1)
        .when(any_ratio.isNull(), None).otherwise(0)
    )
    rate = {k: F.col(f"rate_{k}") for k in K.PRESSOR_CODES_OLD}
    high = (rate["dopamine"] > 15) | (rate["epinephrine"] > 0.1) | (rate["norepinephrine"] > 0.1)
    some = (rate["dopamine"] > 5) | (rate["epinephrine"] <= 0.1) | (rate["norepinephrine"] <= 0.1)
    low = (rate["dopamine"] > 0) | (rate["dobutamine"] > 0)
    circulation = (
        F.when(high, 4).when(some, 3).when(low, 2).when(F.col("minbp") < 70, 1)
        .when(F.coalesce("minbp", *rate.values()).isNull(), None).otherwise(0)
    )
    gcs = F.col("gcs")
    coma = (
        F.when(gcs.between(13, 14), 1).when(gcs.between(10, 12), 2).when(gcs.between(6, 9), 3).when(gcs < 6, 4).otherwise(0)
    )
    creatinine, urine = F.col("creatinine"), F.col("running_uo_24h")
    kidney = (
        F.when(creatinine >= 5, 4).when(creatinine >= 3.5, 3).when(creatinine >= 2, 2).when(creatinine >= 1.2, 1)
        .when(F.coalesce(urine, creatinine).isNull(), None).otherwise(0)
    )
    day_passed = F.col("hlos") > 24
    output = F.when((urine < 200) & day_passed, 4).when((urine < 500) & day_passed, 3).otherwise(0)
    return {
        "sofaresp": respiration,
        "sofacoag": S.threshold_score("platelet", [(20, 4), (50, 3), (100, 2), (150, 1)], below=True),
        "sofaliv": S.threshold_score("bilirubin", [(12, 4), (6, 3), (2, 2), (1.2, 1)], below=False),
        "sofacardio": circulation,
        "sofagcs": coma,
        "sofaren": kidney,
        "renal_uo": output,
    }


def hourly_score(
    admissions: DataFrame,
    respiration: DataFrame,
    pressors: DataFrame,
    pressure: DataFrame,
    coma: DataFrame,
    labs: DataFrame,
    urine: DataFrame,
) -> DataFrame:
    """Organ scores and their sum for every hour of every admission, worst of the last 24 h.

    Low urine output counts in its own hour only, since its measurement already spans a day.
    """
    sources = [respiration, pressors, pressure, coma, labs, urine]
    tasks = R.spine_tasks(admissions, "admittime", "dischtime")
    measured = A.merge_on_spine([s.where(F.col("hlos").isNotNull()) for s in sources], ["hadm_id", "hlos"], tasks)
    ladders = score_ladders()
    scores = measured.select("hadm_id", F.col("hlos").alias("hour"), *[c.alias(n) for n, c in ladders.items()])
    spine = R.hour_spine(admissions, "hadm_id", "admittime", "dischtime", tasks=tasks)
    out = L.look_back_scores(spine, scores, "hadm_id", SCORES, {"sofaren": "renal_uo"}, 24, "sofa", tasks=tasks)
    return out.drop("end_time").withColumnRenamed("hour", "hlos")


# --- onset ------------------------------------------------------------------------------------
def onsets(scores: DataFrame, windows: DataFrame, admissions: DataFrame) -> DataFrame:
    """First rise of the score by two points inside the infection window, per admission."""
    bounds = windows.select("hadm_id", F.col("si_start").alias("window_start"), F.col("si_end").alias("window_end"))
    tasks = R.spine_tasks(admissions, "admittime", "dischtime")
    hourly = scores.withColumnRenamed("hlos", "hour").repartition(tasks, "hadm_id")
    rows = L.onset_times(hourly, bounds, admissions, "hadm_id", "admittime", "sofa", SCORES, tasks=tasks)
    return rows.select(
        "hadm_id", "sofa", *SCORES, F.col("onset_time").alias("sepsis_time"), F.lit(1).alias("sepsis_onset"),
        F.col("sofa_delta").alias("delta_score"), *[f"{s}_delta" for s in SCORES],
    )


def onset_stays(onset: DataFrame, icustays: DataFrame, diagnoses: DataFrame, min_hours: int = 7, fan_out: bool = False) -> DataFrame:
    """Onsets inside an intensive-care stay, with hours since its start and the diagnosis flag."""
    stays = key_join(
        icustays.select("icustay_id", "hadm_id", "intime", "outtime"), onset, "hadm_id",
        F.col("sepsis_time").between(F.col("intime"), F.col("outtime")),
    )
    timed = stays.withColumnRenamed("sepsis_time", "sepsis_onset_time").drop("sepsis_onset")
    timed = timed.withColumnRenamed("sepsis_onset_time", "sepsis_onset").withColumn(
        "h_from_intime", T.age_hour_index("sepsis_onset", "intime")
    )
    flagged = timed.withColumns(
        {
            "septic": F.when(F.col("sepsis_onset").isNull(), 0).otherwise(1),
            "excluded": F.when(F.col("h_from_intime") < min_hours, 1).otherwise(0),
        }
    )
    return C.code_flag(
        flagged, diagnoses.select("hadm_id", "icd9_code"), "hadm_id", "icd9_code", K.SEPSIS_DIAGNOSES, "icd_positive", fan_out
    )


def label_tables(t: Mapping[str, DataFrame] | Tables, keep: Callable = lambda df: df) -> Tables:
    """All derived label tables from the source tables, each built when asked for.

    ``keep`` stores the tables that several others read (pass ``session.durable``): ventilation
    episodes, the weights, the hourly score and the onsets; and the parts of the hourly score, each made by a job
    of its own, since sides of one union share the tasks of a job by their bytes and the smallest get
    one. The chart and the laboratory table are measured for hot admissions and stays once.
    """
    chart, labs, outputs, orders, samplings, rates_old, rates_new, notes = (
        Sizes(t, name) for name in (
            "chartevents", "labevents", "outputevents", "prescriptions", "microbiologyevents", "inputevents_cv",
            "inputevents_mv", "noteevents",
        )
    )

    def given(_):
        return antibiotic_times(t["prescriptions"], antibiotic_drugs(t["prescriptions"]), tasks=orders.tasks())

    def samples():
        return cultures(t["microbiologyevents"], tasks=samplings.tasks())

    def windows(own):
        tasks = orders.tasks() + 2 * samplings.tasks()  # a sample stands twice
        near = suspicions(own["antibiotic_times"], samples(), t["admissions"], pairs=False, tasks=tasks)
        return infection_windows(near)

    def ratios(own):
        split = chart().split("hadm_id") or labs().split("hadm_id")
        return arterial_ratios(own["blood_gases"], t["chartevents"], split=split, tasks=max(chart.tasks(), labs.tasks()))

    def respiration(own):
        split = labs().split("hadm_id")
        return respiration_hours(
            own["arterial_ratios"], own["vent_durations"], t["icustays"], t["admissions"], split=split, tasks=labs.tasks()
        )

    def pressors(own):
        sources = (t["inputevents_cv"], t["inputevents_mv"], t["chartevents"], own["echo"])
        tasks = max(size.tasks() for size in (rates_old, rates_new, chart, notes))
        return pressor_hours(t["admissions"], *sources, hot=chart().hot("hadm_id"), tasks=tasks, keep=keep)

    def scores(own):
        parts = ("respiration", "pressors", "pressure", "coma", "labs", "running_urine")
        return keep(hourly_score(t["admissions"], *[keep(own[p]) for p in parts]))

    return Tables(
        {
            "antibiotic_drugs": lambda own: antibiotic_drugs(t["prescriptions"]),
            "antibiotic_times": given,
            "suspicions": lambda own: suspicions(own["antibiotic_times"], samples(), t["admissions"]),
            "infection_windows": windows,
            "vent_settings": lambda own: vent_settings(t["chartevents"], t["procedureevents_mv"], tasks=chart.tasks()),
            "vent_durations": lambda own: keep(
                vent_durations(own["vent_settings"], split=chart().split("icustay_id"), tasks=chart.tasks())
            ),
            "blood_gases": lambda own: blood_gases(t["admissions"], t["labevents"], hot=labs().hot("hadm_id"), tasks=labs.tasks()),
            "arterial_ratios": ratios,
            "respiration": respiration,
            "echo": lambda own: echo_weights(t["noteevents"]),
            "pressors": pressors,
            "pressure": lambda own: pressure_hours(t["admissions"], t["chartevents"], hot=chart().hot("hadm_id"), tasks=chart.tasks()),
            "coma": lambda own: coma_hours(t["admissions"], t["chartevents"], hot=chart().hot("hadm_id"), tasks=chart.tasks()),
            "labs": lambda own: lab_hours(t["admissions"], t["labevents"], hot=labs().hot("hadm_id"), tasks=labs.tasks()),
            "urine": lambda own: urine_hours(t["admissions"], t["outputevents"], t["icustays"], tasks=outputs.tasks()),
            "running_urine": lambda own: running_urine(own["urine"], tasks=outputs.tasks()),
            "scores": scores,
            "onsets": lambda own: keep(onsets(own["scores"], own["infection_windows"], t["admissions"])),
            "onset_stays": lambda own: onset_stays(own["onsets"], t["icustays"], t["diagnoses_icd"]),
        }
    )
