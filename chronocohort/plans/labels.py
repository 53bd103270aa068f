"""Time of suspicion, infection window, hourly organ-failure score and onset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from chronocohort.functions.scalars import convert_units, null_as_zero_sum
from chronocohort.functions.timefn import hours, shift_hours
from chronocohort.operators import windows as W
from chronocohort.operators.intervals import earliest_on_sides


def suspected_times(treatments: DataFrame, samples: DataFrame, key: str, t: str, clock: str, day: str, **sizing) -> DataFrame:
    """Treatments near a sample with the time of suspicion: the earlier of sample and treatment.

    The sample of the hours before counts ahead of the one after. The earliest sample of each side
    gives the earliest suspicion, so no pairs of samples are formed.
    """
    near = earliest_on_sides(treatments, samples, key, t, clock, day, **sizing)
    suspected = F.least(F.coalesce("last_time", "next_time"), F.col(t))
    return near.withColumn("suspected", suspected)


def infection_windows(suspected: DataFrame, key: str, time: str = "suspected", before: int = 48, after: int = 24) -> DataFrame:
    """``(key, suspected, window_start, window_end)`` around each entity's first time of suspicion."""
    first = suspected.groupBy(key).agg(F.min(time).alias("suspected"))
    return first.withColumns(
        {"window_start": F.col("suspected") - hours(before), "window_end": F.col("suspected") + hours(after)}
    )


def mean_weight(events: DataFrame, key: str, code: str, value: str, factors: dict) -> DataFrame:
    """Average weight per entity over the weight codes, each converted by its factor."""
    scaled = convert_units(code, value, {k: (f, 0) for k, f in factors.items()})
    return events.where(F.col(code).isin(list(factors))).groupBy(key).agg(F.avg(scaled).alias("weight"))


def score_hours(measured: DataFrame, key: str, ladders: dict[str, Column]) -> DataFrame:
    """Sub-scores per (key, hour) from the merged hourly measurements."""
    return measured.select(key, "hour", *[ladder.alias(name) for name, ladder in ladders.items()])


def look_back_scores(
    spine: DataFrame,
    scores: DataFrame,
    key: str,
    names: Sequence[str],
    current: dict[str, str] | None = None,
    span: int = 24,
    total: str = "total",
    lead: int = 24,
    tasks: int | None = None,
) -> DataFrame:
    """Highest sub-scores of the ``span`` hours up to each spine hour, and their sum.

    ``current`` maps a sub-score to a column of ``scores`` that only counts in its own hour, where the
    larger of the two stands. Missing sub-scores add nothing to the sum. Score rows join the spine rows
    in one ordered stack per entity, so filling the gaps costs no join: one shuffle serves the spine,
    the look-back and the current hour. ``scores`` has one row per (key, hour). ``tasks`` is the number
    of tasks that the spine is dealt over by key: scores are dealt alike, and no spine row is shuffled.
    """
    current = current or {}
    marked, scores = spine.withColumn("_spine", F.lit(1)), scores.where(F.col("hour") >= -lead)
    scores = scores if tasks is None else scores.repartition(tasks, key)
    stacked = marked.unionByName(scores, allowMissingColumns=True)
    back = W.trailing_hours(stacked, key, "hour", {f"_{n}": ("max", n) for n in names}, span)
    own = W.trailing_hours(back, key, "hour", {f"_now_{n}": ("max", c) for n, c in current.items()}, 0)
    # greatest() skips nulls, so an hour without a current value keeps the looked-back one.
    best = {n: F.greatest(f"_{n}", f"_now_{n}") if n in current else F.col(f"_{n}") for n in names}
    out = own.where(F.col("_spine") == 1).select(key, "hour", "end_time", *[c.alias(n) for n, c in best.items()])
    return out.withColumn(total, null_as_zero_sum(*names))


def onset_times(
    scores: DataFrame,
    windows: DataFrame,
    starts: DataFrame,
    key: str,
    start: str,
    total: str = "total",
    names: Sequence[str] = (),
    rise: int = 2,
    tasks: int | None = None,
) -> DataFrame:
    """First hour inside the infection window whose total is ``rise`` above its running minimum.

    Hours run from one before the window to its end and from the start of the stay. Each row keeps the
    scores of that hour and their rise (``<name>_delta``); ``onset_time`` counts whole hours from start.
    ``tasks`` is the number of tasks that the scores are dealt over by key, so that the few rows of
    starts and windows come to them.
    """
    columns = [total, *names]
    spans = starts.select(key, start).join(windows.select(key, "window_start", "window_end"), key)
    spans = spans if tasks is None else spans.repartition(tasks, key)
    timed = scores.where(F.col("hour") >= 0).join(spans, key).withColumn("onset_time", shift_hours(start, "hour"))
    inside = timed.where(F.col("onset_time").between(F.col("window_start") - hours(1), F.col("window_end")))
    rows = inside.select(key, "hour", "onset_time", *columns)
    # The rows of an entity are the hours of its window, so the group is bounded.
    risen = W.running_rise(rows, key, ["onset_time"], columns, split=False)
    return W.first_crossing(risen, key, ["onset_time"], f"{total}_delta", rise)
