"""Spines, long/wide changes, per-entity series and alignment to a fixed window."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronocohort.functions.timefn import ceil_hour, hours_between, shift_hours
from chronocohort.operators.ordered import KeyedOrder
from chronocohort.operators.skew import key_join


# Rows that one task makes of few rows, and then sorts.
TASK_ROWS = 500_000


def tasks_for(df: DataFrame, made: Column) -> int:
    """Tasks for a step that makes ``made`` rows of each row: as many as ``TASK_ROWS`` rows each need, one per core at least.

    The rows before such a step are few and small, so that partitions merged by their size would leave all made rows to
    a task per core.
    """
    total = df.agg(F.sum(F.greatest(made, F.lit(0)))).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_ROWS))


def _last_hour(start: str, end: str) -> Column:
    return F.ceil(hours_between(start, end)).cast("int")


def spine_tasks(stays: DataFrame, start: str, end: str, lead: int = 24) -> int:
    """Tasks for the rows of ``hour_spine``."""
    return tasks_for(stays, _last_hour(start, end).cast("bigint") + (lead + 1))


def hour_spine(stays: DataFrame, key: str, start: str, end: str, lead: int = 24, tasks: int | None = None) -> DataFrame:
    """A row per hour from ``-lead`` to the rounded-up length of the stay, with its clock-hour end.

    Stays are dealt by key over ``tasks`` tasks (see ``spine_tasks``, which is asked where they are not given).
    """
    tasks = spine_tasks(stays, start, end, lead) if tasks is None else tasks
    last = _last_hour(start, end)
    short = stays.where(last >= -lead).select(key, ceil_hour(start).alias("_base"), last.alias("_last")).repartition(tasks, key)
    spine = short.select(key, "_base", F.explode(F.sequence(F.lit(-lead), "_last")).alias("hour"))
    return spine.select(key, "hour", shift_hours("_base", "hour").alias("end_time"))


def gap_fill(spine: DataFrame, scores: DataFrame, key: str, hour: str = "hour") -> DataFrame:
    """Every spine hour with the scores of that hour, null where there are none."""
    return spine.join(scores, [key, hour], "left")


def unpivot_values(wide: DataFrame, ids: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Long rows ``(ids, var_id, value)`` for the non-null cells; ``var_id`` is the list position."""
    present = [v for v in variables if v in wide.columns]
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("var_id"), F.col(v).cast("double").alias("value"))
            for i, v in enumerate(variables)
            if v in present
        ]
    )
    filled = F.filter(cells, lambda cell: cell["value"].isNotNull())
    return wide.select(*ids, F.inline(filled))


def sparse_wide(
    long: DataFrame, ids: Sequence[str], concept: str, value: str, names: dict, keep_empty: bool = False
) -> DataFrame:
    """One column per concept with at most one filled per row; ``names`` maps concept to column."""
    source = long if keep_empty else long.where(F.col(concept).isin(list(names)))
    return source.select(
        *ids, *[F.when(F.col(concept) == k, F.col(value)).alias(n) for k, n in names.items()]
    )


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    n: int,
    split: bool = False,
    salts: int = 64,
) -> DataFrame:
    """The first ``n`` rows per group in ``order``; a leading ``-`` means descending.

    Each task keeps its first ``n`` rows of a group before the shuffle, so a group of any size meets as at most ``n``
    rows per task. For an ``n`` so large that this is too much, ``split`` deals a group over ``salts`` sub-groups first.
    """
    sort = [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]

    def ranked(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*groups).orderBy(*sort))
        return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")

    if split:
        salt = F.pmod(F.xxhash64(*[c.lstrip("-") for c in order]), F.lit(salts))
        df = ranked(df.withColumn("_salt", salt), [*keys, "_salt"]).drop("_salt")
    return ranked(df, keys)


def tail_n(long: DataFrame, key: str, order: Sequence[str], n: int, **sizing) -> DataFrame:
    """The last ``n`` observations per entity."""
    return top_per_group(long, [key], [f"-{c}" for c in order], n, **sizing)


def tail_grid(kept: DataFrame, key: str, t: str) -> DataFrame:
    """Whole hours from the first to the last kept observation of each trimmed entity, as rows."""
    span = kept.groupBy(key).agg(F.floor(F.min(t)).alias("_lo"), F.floor(F.max(t)).alias("_hi"))
    return span.select(key, F.explode(F.sequence("_lo", "_hi")).alias("grid_time"))


def min_observations(long: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Rows of the series that have more than ``n`` observations."""
    kept = long.groupBy(*keys).count().where(F.col("count") > n).select(*keys)
    return long.join(kept, list(keys), "left_semi")


def series_arrays(
    long: DataFrame,
    key: str,
    t: str,
    var: str,
    value: str,
    chunk_rows: int | None = None,
    **sizing,
) -> DataFrame:
    """Observations in time order as arrays ``times, vars, values`` per (entity, chunk).

    One row per entity, in chunk 0. With ``chunk_rows`` chunk 0 holds the first that many observations, chunk 1
    the next, so that no row grows with a series; limit series of unknown length first, or keep them long.
    """
    placed = KeyedOrder(long, [key], [t, var, value], **sizing).row_number("_pos").rows()
    packed = (
        placed.withColumn("chunk", (F.floor((F.col("_pos") - 1) / F.lit(chunk_rows)) if chunk_rows else F.lit(0)).cast("int"))
        .groupBy(key, "chunk")
        .agg(F.sort_array(F.collect_list(F.struct("_pos", t, var, value))).alias("_s"))
    )
    return packed.select(
        key,
        "chunk",
        F.col(f"_s.{t}").alias("times"),
        F.col(f"_s.{var}").alias("vars"),
        F.col(f"_s.{value}").alias("values"),
    )


def entity_grid(ends: DataFrame, key: str, end_time: str) -> DataFrame:
    """Whole hours ``0 .. round(end + 1) - 1`` per entity (rounded half to even), as rows."""
    n = F.rint(F.col(end_time) + 1).cast("int")
    return ends.where(n >= 1).select(key, F.explode(F.sequence(F.lit(0), n - 1)).alias("grid_time"))


def pad_right(df: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """Arrays padded with zeros to the longest one, with ``<name>_len`` keeping the true lengths.

    The longest lengths are one number per column, read in one aggregation.
    """
    longest = df.agg(*[F.max(F.size(a)).alias(a) for a in arrays]).first()

    def padded(a: str) -> Column:
        filler = F.array_repeat(F.lit(0.0), F.lit(longest[a]) - F.size(a))
        return F.concat(F.transform(a, lambda x: x.cast("double")), filler)

    lengths = {f"{a}_len": F.size(a) for a in arrays}
    return df.withColumns(lengths).withColumns({a: padded(a) for a in arrays})


def right_align(
    grid: DataFrame, key: str, step: str, width: int, values: Sequence[str]
) -> DataFrame:
    """The last ``width`` steps of each entity on positions ``0 .. width-1``, zeros on the left.

    Steps are numbered from 0 without gaps. Each entity's missing positions are generated from its
    step count, so no spine is joined.
    """
    shift = F.lit(width) - F.col("_len")
    sizes = grid.groupBy(key).agg((F.max(step) + 1).cast("int").alias("_len"))
    moved = (
        grid.join(sizes, key)
        .withColumn("position", (F.col(step) + shift).cast("int"))
        .where(F.col("position") >= 0)
        .select(key, "position", *values)
    )
    blank = sizes.where(shift > 0).select(key, F.explode(F.sequence(F.lit(0), shift - 1)).alias("position"))
    return moved.unionByName(blank.select(key, "position", *[F.lit(0.0).alias(v) for v in values]))


def feature_order(series: DataFrame, key: str, vars_col: str) -> DataFrame:
    """Permutation that sorts an entity's observations by (feature, position).

    Works inside one array of a length-limited series: ``ind_k`` are the sorted features and
    ``ind_t`` the positions they came from.
    """
    pairs = F.array_sort(
        F.transform(vars_col, lambda v, i: F.struct(v.alias("var"), i.alias("pos")))
    )
    return series.withColumn("_pairs", pairs).select(
        *series.columns, F.col("_pairs.var").alias("ind_k"), F.col("_pairs.pos").alias("ind_t")
    )


def horizon_expand(
    long: DataFrame, onsets: DataFrame, key: str, t: str, onset: str, horizons: int = 6, hot: dict | DataFrame | None = None
) -> DataFrame:
    """Each series once per horizon h = 0..``horizons``: h = 0 keeps every observation, h >= 1 those
    at least h hours before onset. A series without observations at a horizon is absent there. A very long series is
    split (``hot`` as in ``key_join``)."""
    spread = key_join(long, onsets.select(key, onset), key, hot=hot).withColumn(
        "horizon", F.explode(F.sequence(F.lit(0), F.lit(horizons)))
    )
    keep = (F.col("horizon") == 0) | (F.col(t) <= F.col(onset) - F.col("horizon"))
    return spread.where(keep)


def horizon_lengths(expanded: DataFrame, key: str, t: str, trimmed: str | None = None) -> DataFrame:
    """Observations, first grid hour and grid length per (entity, horizon).

    At horizon 0 the grid is the full one: from the first to the last whole hour for a series that
    was cut to its tail (column ``trimmed`` is 1), else from hour 0 to the rounded end. At the other
    horizons it keeps as many hours as the rounded-up time span.
    """
    cut = F.max(trimmed) if trimmed else F.max(F.lit(0))
    agg = expanded.groupBy(key, "horizon").agg(
        F.count(F.lit(1)).alias("n_obs"), F.min(t).alias("_first"), F.max(t).alias("last_time"), cut.alias("_cut")
    )
    full = F.when(F.col("_cut") == 1, F.floor("last_time") - F.floor("_first") + 1).otherwise(
        F.rint(F.col("last_time") + 1)
    )
    span = F.ceil(F.col("last_time") - F.col("_first"))
    start = F.when(F.col("_cut") == 1, F.floor("_first")).otherwise(0)
    return agg.select(
        key,
        "horizon",
        "n_obs",
        "last_time",
        start.cast("int").alias("grid_start"),
        F.when(F.col("horizon") == 0, full).otherwise(span).cast("int").alias("grid_len"),
    )


def repeat_rows(df: DataFrame, n: int, name: str = "sample") -> DataFrame:
    """Each row ``n`` times, numbered from 1."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(n))))


def flatten_vector(aligned: DataFrame, key: str, position: str, values: Sequence[str]) -> DataFrame:
    """One array per entity: all features of position 0, then of position 1, and so on.

    The input has a fixed number of positions per entity (see ``right_align``).
    """
    step = F.struct(F.col(position), F.array(*[F.col(v).cast("double") for v in values]).alias("x"))
    steps = aligned.groupBy(key).agg(F.sort_array(F.collect_list(step)).alias("_s"))
    return steps.select(key, F.flatten(F.col("_s.x")).alias("vector"))


def tail_labels(aligned: DataFrame, position: str, label: str, width: int, last: int) -> DataFrame:
    """Per-step label pair: the last ``last`` positions carry the label, earlier ones are negative."""
    y = F.when(F.col(position) >= width - last, F.col(label)).otherwise(0)
    return aligned.withColumn("y", y).withColumn("not_y", 1 - F.col("y"))


def union_distinct(frames: Sequence[DataFrame]) -> DataFrame:
    """Distinct rows of all frames; one de-duplication at the end, not one per union."""
    return reduce(lambda a, b: a.union(b), frames).distinct()
