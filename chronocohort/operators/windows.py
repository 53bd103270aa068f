"""First/last rows, previous-row lookups, running minima, trailing windows and sessions per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronocohort.functions.timefn import hours, hours_between, micros_between, MICROS_PER_HOUR
from chronocohort.operators.ordered import RANGE, KeyedOrder, carried, labelled
from chronocohort.operators.skew import MAX_GROUP_ROWS


def first_row(df: DataFrame, keys: list[str], order: Sequence[str]) -> DataFrame:
    """The whole first row of each key in ascending ``order``.

    A minimum over packed rows: it combines before the shuffle, so a key of any size is reduced to
    one row per task first. Nulls in the order sort first, as in a window.
    """
    rest = [c for c in df.columns if c not in keys]
    lead = [c for c in order if c not in keys]
    payload = F.struct(*rest)
    best = F.min(F.struct(*lead, payload.alias("_row"))).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best._row.{c}").alias(c) for c in rest])


def latest_row(df: DataFrame, keys: list[str], t: str, tie: Sequence[str] = (), nulls_first: bool = True) -> DataFrame:
    """The whole latest row of each key by ``t``; ``nulls_first`` treats a missing time as latest.

    A maximum over packed rows, combined before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    unknown = F.col(t).isNull() if nulls_first else F.col(t).isNotNull()
    best = F.max(F.struct(unknown.alias("_u"), t, *tie, F.struct(*rest).alias("_row"))).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best._row.{c}").alias(c) for c in rest])


def previous_within(
    df: DataFrame,
    key: str,
    t: str,
    columns: Sequence[str],
    tolerance: int,
    suffix: str = "_prev",
    **sizing,
) -> DataFrame:
    """Columns of the row before, only if it is less than ``tolerance`` hours old."""
    seen = F.struct(F.col(t).alias("at"), *columns)
    rows = KeyedOrder(df, [key], [t], **sizing).previous(seen, "_before").rows()
    near = F.col("_before.at") > F.col(t) - hours(tolerance)
    named = {f"{c}{suffix}": F.when(near, F.col(f"_before.{c}")) for c in columns}
    return rows.withColumns(named).drop("_before")


def trailing_hours(
    hourly: DataFrame, key: str, hour: str, aggregates: dict[str, tuple[str, str]], span: int = 24
) -> DataFrame:
    """Aggregates ``{name: (fn, column)}`` over the ``span`` hours up to each hour, both ends included.

    ``hourly`` has one row per (key, hour), so a window holds an entity's hours, never its raw
    events: the group is bounded by the length of its history however many events fall in an hour.
    """
    w = Window.partitionBy(key).orderBy(hour).rangeBetween(-span, 0)
    fns = {"max": F.max, "min": F.min, "sum": F.sum}
    return hourly.withColumns({n: fns[fn](F.col(c)).over(w) for n, (fn, c) in aggregates.items()})


def hour_step_flag(
    hourly: DataFrame, key: str, hour: str, score: str, step: int = 2, rise: str | None = "flag", fall: str | None = None
) -> DataFrame:
    """0/1: did the score change by ``step`` since exactly one hour earlier, for hours that have one?

    ``rise`` and ``fall`` name the flags for each direction; both come from one window. One row per hour.
    """
    w = Window.partitionBy(key).orderBy(hour)
    change = F.col(score) - F.col("_score")
    flags = {name: F.when(c >= step, 1).otherwise(0) for name, c in ((rise, change), (fall, -change)) if name}
    return (
        hourly.withColumns({"_score": F.lag(score).over(w), "_hour": F.lag(hour).over(w)})
        .where((F.col(hour) - F.col("_hour") == 1) & (F.col(hour) >= 0))
        .withColumns(flags)
        .drop("_score", "_hour")
    )


def running_rise(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    columns: Sequence[str],
    **sizing,
) -> DataFrame:
    """``x_min``: running minimum with missing values as 0; ``x_delta``: rise of ``x`` above it."""
    ordered = KeyedOrder(df, [key], list(order), **sizing)
    for c in columns:
        ordered = ordered.running("min", F.coalesce(F.col(c), F.lit(0)), f"{c}_min", peers=False)
    deltas = {f"{c}_delta": F.coalesce(F.col(c), F.lit(0)) - F.col(f"{c}_min") for c in columns}
    return ordered.rows().withColumns(deltas)


def first_crossing(df: DataFrame, key: str, order: Sequence[str], value: str, threshold: float) -> DataFrame:
    """The first row per key whose value reaches the threshold."""
    return first_row(df.where(F.col(value) >= threshold), [key], order)


def lag_within_state(
    df: DataFrame,
    key: str,
    state: Column,
    t: str,
    value: Column,
    name: str,
    tie: Sequence[str] = (),
    **sizing,
) -> DataFrame:
    """``value`` of the previous row of the same key that is in the same state."""
    staged = df.withColumn("_state", state)
    ordered = KeyedOrder(staged, [key, "_state"], [t, *tie], **sizing)
    return ordered.previous(value, name).rows().drop("_state")


def sessionize(
    df: DataFrame,
    key: str,
    t: str,
    on: str,
    off: str,
    end: str,
    gap: int = 8,
    tie: Sequence[str] = (),
    **sizing,
) -> DataFrame:
    """Episodes of an ``on`` state as ``(key, episode, start, finish, hours)``.

    A new episode starts after an ``end`` marker, at an ``off`` row that is not ``on``, or when two
    ``on`` rows lie more than ``gap`` hours apart. Only ``on`` and ``end`` rows belong to episodes.
    An episode needs an ``on`` row and two distinct times. Rows of one time follow each other in the
    order of the ``tie`` columns, which must make (key, ``t``, tie) unique, and share their episode.
    """
    max_group = sizing.get("max_group", MAX_GROUP_ROWS)
    in_state = (F.col(on) == 1) | (F.col(end) == 1)
    rows, split = labelled(df, [key], [t], max_group, sizing.get("split"), sizing.get("tasks"))
    own = [key, RANGE] if split else [key]
    w = Window.partitionBy(*own).orderBy(t, *tie)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    on_time, end_mark = F.when(F.col(on) == 1, F.col(t)), F.when(in_state, F.coalesce(F.col(end), F.lit(0)))
    # What a row follows within its range: the last "on" time, and the end marker of the last row in the state.
    seen = {"_on": F.last(on_time, ignorenulls=True).over(earlier), "_end": F.last(end_mark, ignorenulls=True).over(earlier)}

    def fresh(on_before: Column, end_before: Column) -> Column:
        waited = micros_between(on_before, F.col(t)) > gap * MICROS_PER_HOUR
        ended = in_state & (end_before == 1)
        return F.when(ended | ((F.col(on) == 0) & (F.col(off) == 1)) | ((F.col(on) == 1) & waited), 1).otherwise(0)

    rows = rows.withColumns(seen)
    if split:
        # A range maps the state that enters it to the one that leaves it and to the sessions it begins; only its first
        # "on" row and its first row in the state can depend on what enters. Maps of earlier ranges are composed.
        alone = F.struct(t, *tie)
        begun = fresh(F.col("_on"), F.col("_end"))
        first = lambda state, what: F.min_by(what, F.when(state, alone))
        parts = {
            "_last_on": F.max(on_time), "_last_end": F.max_by(end_mark, F.when(in_state, alone)), "_begun": F.sum(begun),
            "_on_at": first(F.col(on) == 1, F.col(t)), "_on_new": first(F.col(on) == 1, begun),
            "_in_new": first(in_state, begun), "_same": F.min(F.when(F.col(on) == 1, alone)) == F.min(F.when(in_state, alone)),
        }

        def entering(before: Window) -> dict[str, Column]:
            last = lambda name: F.last(name, ignorenulls=True).over(before)
            return {"_on_in": last("_last_on"), "_end_in": last("_last_end")}

        def more(before: Window) -> dict[str, Column]:
            ended = F.coalesce((F.col("_end_in") == 1) & (F.col("_in_new") == 0), F.lit(False))
            waited = micros_between(F.col("_on_in"), F.col("_on_at")) > gap * MICROS_PER_HOUR
            waited = F.coalesce(waited & (F.col("_on_new") == 0) & ~(ended & F.col("_same")), F.lit(False))
            return {"_more": ended.cast("int") + waited.cast("int")}

        begun_in = lambda before: {"_begun_in": F.sum(F.col("_begun") + F.col("_more")).over(before)}
        rows = carried(rows, [key], parts, entering, more, begun_in)
        rows = rows.withColumns({"_on": F.coalesce("_on", "_on_in"), "_end": F.coalesce("_end", "_end_in")})
    rows = rows.withColumn("_new", fresh(F.col("_on"), F.col("_end")))
    session = F.sum("_new").over(Window.partitionBy(*own).orderBy(t))
    rows = rows.withColumn("_session", session + F.coalesce("_begun_in", F.lit(0)) if split else session)
    episodes = (
        rows.where(in_state)
        .groupBy(key, "_session")
        .agg(F.min(t).alias("start"), F.max(t).alias("finish"), F.max(on).alias("_any_on"))
        .where((F.col("start") != F.col("finish")) & (F.col("_any_on") == 1))
    )
    numbered = KeyedOrder(episodes, [key], ["_session"], max_group=max_group, split=None if split else False).row_number("episode").rows()
    return numbered.select(
        key, "episode", "start", "finish", hours_between("start", "finish").alias("hours")
    )
