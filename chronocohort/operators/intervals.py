"""Joins in time: windows around an index time, membership in intervals, as-of lookups.

``sizing`` is what ``KeyedOrder`` takes: ``split`` where the group sizes are known, or ``max_group``, and ``tasks``.
``hot`` and ``tasks`` are those of ``key_join``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from chronocohort.functions.timefn import hour_bucket, hours
from chronocohort.operators.ordered import KeyedOrder
from chronocohort.operators.skew import key_join


def around_index(
    events: DataFrame,
    index: DataFrame,
    key: str,
    t: str,
    index_time: str,
    before: int = 48,
    after: int = 7,
    hot: Sequence | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Events of each entity from ``before`` hours ahead of its index time to ``after`` hours past it."""
    t0 = F.col(index_time)
    inside = F.col(t).between(t0 - hours(before), t0 + hours(after))
    return key_join(events, index, key, inside, "inner", hot, tasks=tasks)


def in_stay(
    events: DataFrame,
    stays: DataFrame,
    key: str,
    t: str,
    start: str,
    end: str,
    lead: Column | None = None,
    hot: Sequence | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Events between ``start - lead`` (one day by default) and ``end`` of their stay."""
    lead = F.make_dt_interval(F.lit(1)) if lead is None else lead
    inside = F.col(t).between(F.col(start) - lead, F.col(end))
    return key_join(events, stays, key, inside, "inner", hot, tasks=tasks)


def point_in_interval(
    points: DataFrame,
    intervals: DataFrame,
    key: str,
    t: str,
    start: str,
    end: str,
    flag: str = "inside",
    **sizing,
) -> DataFrame:
    """Points with a 0/1 flag: does any interval of the entity hold the point (ends included)?

    A point is covered exactly if the latest end among intervals already started is not before it.
    That is one running maximum over points and starts together, linear in both inputs, where a
    join would visit every pair of point and interval of an entity.
    """
    starts = intervals.select(
        key, F.col(start).alias(t), F.col(end).alias("_until"), F.lit(0).alias("_side")
    ).where(F.col(t).isNotNull())
    both = points.withColumn("_side", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    ordered = KeyedOrder(both, [key], [t, "_side"], **sizing).running("max", F.col("_until"), "_reach")
    return (
        ordered.rows()
        .where(F.col("_side") == 1)
        .withColumn(flag, F.when(F.col("_reach") >= F.col(t), 1).otherwise(0))
        .drop("_side", "_until", "_reach")
    )


def _latest_at(both: DataFrame, key: str, t: str, sources: list[str], **sizing) -> DataFrame:
    """Running 'latest row of source s' for every row, as struct columns named after the sources."""
    ordered = KeyedOrder(both, [key], [t, "_side"], **sizing)
    for source in sources:
        ordered = ordered.running("max", F.col(f"_{source}"), source)
    return ordered.rows()


def asof(
    left: DataFrame,
    right: DataFrame,
    key: str,
    t: str,
    right_t: str,
    value: str,
    tolerance: int,
    name: str | None = None,
    **sizing,
) -> DataFrame:
    """Attach the latest right value at or before each left row, at most ``tolerance`` hours old.

    Right rows that tie in time resolve to the largest value. Both inputs are read once, in order.
    """
    name = name or value
    lookup = right.select(
        key,
        F.col(right_t).alias(t),
        F.struct(F.col(right_t).alias("at"), F.col(value).alias("v")).alias("_found"),
        F.lit(0).alias("_side"),
    ).where(F.col(t).isNotNull())
    both = left.withColumn("_side", F.lit(1)).unionByName(lookup, allowMissingColumns=True)
    rows = _latest_at(both, key, t, ["found"], **sizing).where(F.col("_side") == 1)
    fresh = F.col("found.at") >= F.col(t) - hours(tolerance)
    return rows.withColumn(name, F.when(fresh, F.col("found.v"))).drop("found", "_found", "_side")


def asof_two_sources(
    left: DataFrame,
    own: str,
    other: DataFrame,
    key: str,
    t: str,
    other_t: str,
    value: str,
    tolerance: int,
    name: str,
    other_name: str | None = None,
    **sizing,
) -> DataFrame:
    """The freshest of two readings within ``tolerance`` hours before each left row.

    Source one is column ``own`` of the left rows (a row may use its own reading), source two is
    ``value`` of ``other``. The later reading wins and source one wins a tie in time; if the winner
    is null the other source fills in. ``other_name`` adds source two's own reading.
    """
    lookup = other.select(
        key,
        F.col(other_t).alias(t),
        F.struct(F.col(other_t).alias("at"), F.col(value).alias("v")).alias("_second"),
        F.lit(0).alias("_side"),
    ).where(F.col(t).isNotNull())
    mine = left.withColumn("_first", F.struct(F.col(t).alias("at"), F.col(own).alias("v"))).withColumn(
        "_side", F.lit(1)
    )
    both = mine.unionByName(lookup, allowMissingColumns=True)
    rows = _latest_at(both, key, t, ["first", "second"], **sizing).where(F.col("_side") == 1)
    oldest = F.col(t) - hours(tolerance)
    one = F.when(F.col("first.at") >= oldest, F.col("first"))
    two = F.when(F.col("second.at") >= oldest, F.col("second"))
    pick = (
        F.when(two.isNull(), one["v"])
        .when(one.isNull(), two["v"])
        .when(one["at"] >= two["at"], F.coalesce(one["v"], two["v"]))
        .otherwise(F.coalesce(two["v"], one["v"]))
    )
    extra = {other_name: two["v"]} if other_name else {}
    return rows.withColumns({name: pick, **extra}).drop("first", "second", "_first", "_second", "_side")


def bucketed_window_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_t: str,
    right_t: str,
    back: int,
    forward: int,
    width: int = 24,
) -> DataFrame:
    """Pairs with ``left_t - back <= right_t <= left_t + forward`` (hours) of the same entity.

    Rows meet on (entity, time bucket), so a row is only compared with rows of nearby buckets and
    one entity's rows spread over as many tasks as its history has buckets. Each left row is
    repeated once per bucket it can reach, which is fixed by ``back``, ``forward`` and ``width``.
    """
    lt = F.col(left_t)
    reach = F.sequence(hour_bucket(lt - hours(back), width), hour_bucket(lt + hours(forward), width))
    spread = left.where(lt.isNotNull()).withColumn("_bucket", F.explode(reach))
    other = f"_{key}_right"
    tagged = right.withColumnRenamed(key, other).withColumn("_bucket_right", hour_bucket(right_t, width))
    on = (
        (F.col(key) == F.col(other))
        & (F.col("_bucket") == F.col("_bucket_right"))
        & F.col(right_t).between(lt - hours(back), lt + hours(forward))
    )
    return spread.join(tagged, on).drop(other, "_bucket", "_bucket_right")


def _seen(samples: DataFrame, key: str, clock: str, day: str) -> DataFrame:
    """Samples as (key, ``_seen``, ``_kind``); one without clock time counts at its date."""
    return samples.select(
        F.col(key),
        F.coalesce(clock, day).alias("_seen"),
        F.when(F.col(clock).isNull(), "date").otherwise("time").alias("_kind"),
    )


def earliest_on_sides(
    treatments: DataFrame,
    samples: DataFrame,
    key: str,
    t: str,
    clock: str,
    day: str,
    back: int = 72,
    forward: int = 24,
    **sizing,
) -> DataFrame:
    """Treatments with the earliest sample of the ``back`` hours before and of the ``forward`` hours after.

    A sample stands once at its time and once ``back`` hours later. In falling order the running
    minimum of the first kind is the earliest sample from ``t`` on, that of the second kind the
    earliest from ``t - back`` on: linear in both inputs, with no pairs. Treatments without a sample
    on either side, a key or a time are dropped.
    """
    seen = _seen(samples, key, clock, day).where(F.col(key).isNotNull() & F.col("_seen").isNotNull())
    found = F.struct("_seen", "_kind")
    stand = {"_next": F.col("_seen"), "_last": F.col("_seen") + hours(back)}
    both = treatments.where(F.col(key).isNotNull() & F.col(t).isNotNull()).withColumn("_side", F.lit(1))
    for side, at in stand.items():
        rows = seen.select(key, at.alias(t), F.lit(0).alias("_side"), found.alias(side))
        both = both.unionByName(rows, allowMissingColumns=True)
    ordered = KeyedOrder(both, [key], [f"-{t}"], **sizing)
    for side in stand:
        ordered = ordered.running("min", F.col(side), f"{side}_min")
    limit = {"last": F.col(t), "next": F.col(t) + hours(forward)}
    near = {s: F.when(F.col(f"_{s}_min._seen") <= limit[s], F.col(f"_{s}_min")) for s in limit}
    out = ordered.rows().where(F.col("_side") == 1).withColumns(
        {f"{s}_{part}": near[s][f"_{name}"] for s in limit for part, name in (("time", "seen"), ("kind", "kind"))}
    )
    out = out.where(F.coalesce("last_time", "next_time").isNotNull()).select(
        *treatments.columns, "last_time", "last_kind", "next_time", "next_kind"
    )
    return out.withColumns({f"{s}_kind": F.coalesce(f"{s}_kind", F.lit("date")) for s in limit})


def two_sided_proximity(
    treatments: DataFrame,
    samples: DataFrame,
    key: str,
    t: str,
    clock: str,
    day: str,
    back: int = 72,
    forward: int = 24,
) -> DataFrame:
    """Treatments with every pair of a sample of the ``back`` hours before and one of the ``forward`` hours after.

    A sample without clock time counts at its date. Treatments with no sample on either side are
    dropped. The pairs are the result; where the earliest samples are enough use
    ``earliest_on_sides``, which forms none.
    """
    seen = _seen(samples, key, clock, day)
    base = treatments.select(key, t)
    sides = {"last": (back, 0), "next": (0, forward)}
    out = treatments
    for side, (b, f) in sides.items():
        near = bucketed_window_join(base, seen, key, t, "_seen", b, f)
        found = near.select(key, t, F.col("_seen").alias(f"{side}_time"), F.col("_kind").alias(f"{side}_kind"))
        out = out.join(found, [key, t], "left")
    out = out.where(F.coalesce("last_time", "next_time").isNotNull())
    return out.withColumns({f"{s}_kind": F.coalesce(f"{s}_kind", F.lit("date")) for s in sides})
