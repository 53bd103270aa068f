"""Case and control cohorts: exclusion, anti joins, code flags and matching by rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from chronocohort.functions.timefn import shift_hours
from chronocohort.operators.ordered import keyed_rank


def not_in(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``listed`` under the null rule of ``NOT IN``: a null key on the
    left never qualifies, and one null in a non-empty list leaves no row."""
    nulls = listed.where(F.col(key).isNull()).limit(1).count()
    if nulls:
        return df.where(F.lit(False))
    # Against an empty list every row qualifies, null keys included.
    if listed.limit(1).count() == 0:
        return df
    keys = listed.select(key).distinct()
    return df.where(F.col(key).isNotNull()).join(keys, key, "left_anti")


def code_flag(
    df: DataFrame, codes: DataFrame, key: str, code: str, wanted: Sequence, name: str, fan_out: bool = False
) -> DataFrame:
    """0/1: does the entity carry one of the wanted codes?

    With ``fan_out`` each row repeats per code of its entity, as a plain left join gives; otherwise
    codes collapse to one row per entity before the join.
    """
    hit = F.when(F.col(code).isin(list(wanted)), 1).otherwise(0)
    if fan_out:
        flagged = codes.select(key, hit.alias(name))
    else:
        flagged = codes.groupBy(key).agg(F.max(hit).alias(name))
    return df.join(flagged, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def match_by_rank(
    cases: DataFrame,
    controls: DataFrame,
    case_id: str,
    onset_hour: str,
    control_id: str,
    length: str,
    start: str,
) -> DataFrame:
    """Give every control the onset of a case: controls ranked by ``length`` are cut in slices
    ``[int(i*r), int((i+1)*r))`` with ``r`` = controls per case, and slice i takes case i by onset hour.

    Ranks come from range-partitioned sorts, ties broken by id. Slice numbers follow from the rank
    by arithmetic, so the match is one equi join on the slice.
    """
    ranked_cases = keyed_rank(
        cases.select(F.col(case_id).alias("matched_case"), F.col(onset_hour).alias("onset_hour")),
        [],
        ["onset_hour", "matched_case"],
        "_n",
    ).select("matched_case", "onset_hour", (F.col("_n") - 1).alias("_slice"))
    ranked = keyed_rank(controls, [], [length, control_id], "_n").withColumn("_j", F.col("_n") - 1)
    # Both sides are stored by now, so counting them reads no more than the stored ranks.
    n_cases, n_controls = ranked_cases.count(), ranked.count()
    if n_cases == 0:
        raise ValueError("no cases to match")
    r = F.lit(n_controls / n_cases)

    def holds(i):
        low = F.floor(i.cast("double") * r)
        high = F.floor((i + 1).cast("double") * r)
        return (low <= F.col("_j")) & (F.col("_j") < high)

    guess = F.ceil((F.col("_j") + 1).cast("double") / r) - 1
    # Rounding of i*r can move a border by one, so the neighbours are tested as well.
    exact = F.coalesce(*[F.when(holds(guess + d), guess + d) for d in (-1, 0, 1)])
    return (
        ranked.withColumn("_slice", exact)
        .join(ranked_cases, "_slice")
        .withColumn("onset_time", shift_hours(start, "onset_hour"))
        .drop("_slice", "_n", "_j")
    )


def matching_summary(cases: DataFrame, controls: DataFrame, case_id: str, control_id: str) -> DataFrame:
    """One row: distinct cases, distinct controls, controls per case and its whole part."""
    tagged = cases.select(F.col(case_id).alias("id"), F.lit(1).alias("side")).unionByName(
        controls.select(F.col(control_id).alias("id"), F.lit(0).alias("side"))
    )
    n_case = F.count_distinct(F.when(F.col("side") == 1, F.col("id")))
    n_control = F.count_distinct(F.when(F.col("side") == 0, F.col("id")))
    out = tagged.agg(n_case.alias("n_cases"), n_control.alias("n_controls"))
    ratio = F.try_divide(F.col("n_controls").cast("double"), F.col("n_cases").cast("double"))
    return out.withColumn("ratio", ratio).withColumn("ratio_floor", F.floor("ratio"))
