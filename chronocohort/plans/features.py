"""From extracted events to model-ready series: merge, filter, scale, split, arrays, horizons."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from chronocohort.functions.scalars import category_map, round_tens
from chronocohort.functions.timefn import hours, hours_between
from chronocohort.operators import aggregates as A, reshape as R, sampling as P
from chronocohort.operators.skew import MAX_GROUP_ROWS, heavy_keys, key_join
from chronocohort.plans.icu_codes import ETHNIC_GROUPS
from chronocohort.plans.tables import Tables

IDS = ["label", "icustay_id", "t", "subject_id", "sepsis_target"]


def merge_sources(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both sources by key, with the columns of the side that is missing left null."""
    return a.join(b, list(keys), "full")


def before_horizon(
    events: DataFrame,
    stays: DataFrame,
    key: str,
    t: str,
    start: str,
    onset: str,
    horizon: int = 0,
    hot: dict | DataFrame | None = None,
) -> DataFrame:
    """Events from the start of the stay to ``horizon`` hours before onset, at ``t`` hours since start.

    ``hot`` are the heavy keys as in ``key_join``, for events that are themselves a costly plan.
    """
    index = stays.select(key, F.col(start).alias("_start"), F.col(onset).alias("_onset"))
    inside = F.col(t).between(F.col("_start"), F.col("_onset") - hours(horizon))
    kept = key_join(events, index, key, inside, hot=hot).withColumn("_hours", hours_between("_start", t))
    return kept.drop("_start", "_onset", t).withColumnRenamed("_hours", "t")


def within_lengths(
    events: DataFrame,
    onsets: DataFrame,
    key: str,
    t: str,
    onset_hour: str,
    min_length: float | None = None,
    max_length: float | None = None,
) -> DataFrame:
    """Without entities whose onset comes before ``min_length`` or that have a time past ``max_length``."""
    if min_length is not None:
        events = events.join(onsets.where(F.col(onset_hour) < min_length).select(key), key, "left_anti")
    if max_length is not None:
        longest = events.groupBy(key).agg(F.max(t).alias("_longest"))
        events = events.join(longest.where(F.col("_longest") > max_length).select(key), key, "left_anti")
    return events


def onset_hours(case_static: DataFrame, control_static: DataFrame) -> DataFrame:
    """``(icustay_id, onset_hour)`` of cases and matched controls."""
    return case_static.select("icustay_id", F.col("sepsis_onset_hour").alias("onset_hour")).unionByName(
        control_static.select("icustay_id", F.col("control_onset_hour").alias("onset_hour"))
    )


def labelled_series(
    t: Mapping[str, DataFrame] | Tables,
    horizon: int = 0,
    min_values: int = 500,
    min_length: float | None = None,
    max_length: float | None = None,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Vitals and labs of cases (label 1) and controls (label 0) up to ``horizon`` hours before onset.

    ``t`` are the tables of ``icu_cohort.cohort_tables``. Columns with fewer than ``min_values``
    readings are left out, as are stays shorter or longer than the limits. ``keep`` stores the rows before
    their columns are counted (see ``session.durable``); without it the plan runs once for that alone.
    """
    parts = []
    for side, label, onset, target in (
        ("case", 1, "sepsis_onset", "sepsis_target"),
        ("control", 0, "control_onset_time", "pseudo_target"),
    ):
        labs = t[f"{side}_labs"].dropna(subset=["chart_time"])
        merged = merge_sources(t[f"{side}_vitals"], labs, ["icustay_id", "chart_time", "subject_id", target])
        # A merged stay has no more rows than its sources together, which are cheaper to count than their join.
        hot = heavy_keys(t[f"{side}_vitals"].select("icustay_id").union(labs.select("icustay_id")), "icustay_id")
        inside = before_horizon(merged, t[f"{side}_static"], "icustay_id", "chart_time", "intime", onset, horizon, hot)
        named = inside.withColumnRenamed(target, "sepsis_target").withColumn("label", F.lit(label))
        parts.append(named.select(*IDS, *[c for c in named.columns if c not in IDS]))
    full = parts[0].unionByName(parts[1])
    full = keep(full) if keep else full
    full = A.drop_sparse_columns(full, [c for c in full.columns if c not in IDS], min_values)
    onsets = onset_hours(t["case_static"], t["control_static"])
    return within_lengths(full, onsets, "icustay_id", "t", "onset_hour", min_length, max_length)


def static_features(case_static: DataFrame, control_static: DataFrame, categories: Sequence[str] = ("gender", "first_careunit")) -> DataFrame:
    """Capped age and 0/1 columns of the categories per stay; an unknown age stays unknown."""
    columns = ["icustay_id", "admission_age", *categories]
    rows = case_static.select(*columns).unionByName(control_static.select(*columns))
    rows = rows.withColumn("admission_age", F.when(F.col("admission_age") > 90, 90.0).otherwise(F.col("admission_age")))
    return A.one_hot(rows, list(categories))


def grouped_static_features(case_static: DataFrame, control_static: DataFrame) -> DataFrame:
    """The older form: 0/1 columns for gender, age in tens (capped at 90), ethnic group and care unit.

    A stay of unknown age has 0 in every age column.
    """
    columns = ["icustay_id", "gender", "admission_age", "ethnicity", "first_careunit"]
    rows = case_static.select(*columns).unionByName(control_static.select(*columns))
    tens = round_tens("admission_age")
    age = F.when(tens > 90, 90.0).otherwise(tens).cast("string")
    grouped = rows.withColumns({"admission_age": age, "ethnicity": category_map("ethnicity", ETHNIC_GROUPS)})
    return A.one_hot(grouped, columns[1:])


def normalised(series: DataFrame, static: DataFrame, splits: DataFrame, scale_age: bool = False) -> tuple[DataFrame, DataFrame]:
    """Series (and age, on request) scaled by mean and deviation of the training stays."""
    train = splits.where(F.col("split") == "train").select("icustay_id")
    values = [c for c in series.columns if c not in IDS]
    scaled = A.zscore(series, series.join(train, "icustay_id", "left_semi"), values)
    if scale_age:
        static = A.zscore(static, static.join(train, "icustay_id", "left_semi"), ["admission_age"])
    return scaled, static


def training_series(
    series: DataFrame,
    onsets: DataFrame,
    variables: Sequence[str],
    n_max: int = 250,
    n_min: int = 40,
    horizons: int = 6,
) -> tuple[DataFrame, DataFrame]:
    """Observations per stay and horizon, and their lengths.

    Unpivots the variables, keeps the last ``n_max`` observations of a stay, repeats the series for
    every horizon and keeps those with more than ``n_min`` observations.
    """
    long = R.unpivot_values(series, ["icustay_id", "t", "label"], variables)
    kept = R.tail_n(long, "icustay_id", ["t", "var_id", "value"], n_max)
    sizes = kept.groupBy("icustay_id").agg(F.when(F.count(F.lit(1)) >= n_max, 1).otherwise(0).alias("cut"))
    # No stay has more than n_max rows here, so that none needs to be counted.
    hot = {} if n_max <= MAX_GROUP_ROWS else None
    expanded = R.horizon_expand(kept.join(sizes, "icustay_id"), onsets, "icustay_id", "t", "onset_hour", horizons, hot)
    enough = R.min_observations(expanded, ["icustay_id", "horizon"], n_min)
    return enough, R.horizon_lengths(enough, "icustay_id", "t", "cut")


def balanced_training_rows(lengths: DataFrame, labels: DataFrame, batch: int = 128, epoch: int = 0) -> DataFrame:
    """Every (stay, horizon) of the training split once per draw, classes balanced, in batches."""
    rows = lengths.join(labels.select("icustay_id", "label"), "icustay_id").withColumn(
        "row_id", F.col("icustay_id").cast("bigint") * 8 + F.col("horizon")
    )
    drawn = P.oversample(rows.select("row_id", "icustay_id", "horizon", "label"), "label", "row_id")
    # Draw numbers run per class, so the epoch shuffles them within the class.
    return P.balanced_batches(drawn, "label", "draw", batch, epoch)
