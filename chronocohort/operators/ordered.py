"""Ordered computations per key that stay whole when one key holds a large share of the rows.

A plain window puts all rows of a key into one task. Keys that are too large for that are cut into ranges of their order:
bounds are taken from a hashed sample of the key and order columns, and a row's range is the number of bounds it has
reached, so nothing is sorted or stored but the bounds. Ordinary keys are one range. All results come from one window
over (key, range), plus a carry from the ranges before it; the carries of all results come from one aggregation over
the rows of the large keys. Without keys Spark's range partitioning cuts the rows, which are stored with their range. Rows that tie in the order never straddle two ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronocohort.operators.skew import MAX_GROUP_ROWS, large_groups
from chronocohort.session import durable

RANGE = "_range"
# Sampled rows per range, and bounds looked through at each of two levels.
SAMPLES = 64
LEVEL = 256

_MERGE: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, lambda carry, inner: F.coalesce(carry + inner, carry, inner)),
    "count": (F.count, lambda carry, inner: F.coalesce(carry, F.lit(0)) + inner),
    "min": (F.min, lambda carry, inner: F.least(carry, inner)),
    "max": (F.max, lambda carry, inner: F.greatest(carry, inner)),
}


def _sort_expr(name: str) -> Column:
    return F.col(name[1:]).desc() if name.startswith("-") else F.col(name).asc()


def same_keys(keys: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of the keys with their copies named ``<prefix><i>``."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{i}")) for i, k in enumerate(keys)], F.lit(True))


def _reached(order: Sequence[str], bound: Column) -> Column:
    """Is the row at or after the bound in the order? Nulls come first, or last in a falling order."""
    result = F.lit(True)
    for name in reversed(order):
        c, b = F.col(name.lstrip("-")), bound[name.lstrip("-")]
        beyond = (c < b) | (c.isNull() & b.isNotNull()) if name.startswith("-") else (c > b) | (c.isNotNull() & b.isNull())
        result = F.coalesce(beyond, F.lit(False)) | (c.eqNullSafe(b) & result)
    return result


def bounds(df: DataFrame, keys: Sequence[str], order: Sequence[str], large: DataFrame | None, max_group: int) -> DataFrame:
    """One row per large key, or one row without keys (``_b0``, ...): its bounds in order, as lists of at most ``LEVEL`` with the head of each list."""
    plain = [c.lstrip("-") for c in order]
    rate = max(1, max_group // SAMPLES)
    some = df.select(*{c: None for c in [*keys, *plain]}).where(F.pmod(F.xxhash64(*plain), F.lit(rate)) == 0)
    if large is not None:
        some = some.join(large, same_keys(keys, "_h"), "left_semi")
    some = some.groupBy(*{c: None for c in [*keys, *plain]}).agg(F.count("*").alias("_w"))
    w = Window.partitionBy(*keys).orderBy(*[_sort_expr(c) for c in order])
    number = F.floor((F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, -1))) / max(1, max_group // rate))
    heads = some.withColumn("_i", number).withColumn("_last", F.lag("_i").over(w)).where("_i > 0 and _i > coalesce(_last, 0)")
    heads = heads.withColumn("_n", F.row_number().over(w) - 1)
    named = [F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)]
    lists = heads.groupBy(*named, F.floor(F.col("_n") / LEVEL).alias("_l")).agg(F.sort_array(F.collect_list(F.struct("_n", F.struct(*dict.fromkeys(plain)).alias("at")))).alias("_part"))
    return lists.groupBy(*[f"_b{i}" for i in range(len(keys))]).agg(F.sort_array(F.collect_list(F.struct("_l", "_part"))).alias("_lists"))


def labelled(df: DataFrame, keys: Sequence[str], order: Sequence[str], max_group: int, split: bool | None, tasks: int | None = None) -> tuple[DataFrame, bool]:
    """The rows with their range of the key (null for keys of one range), and whether any key has several.

    With ``tasks`` they are dealt by key and range over that many tasks. Otherwise the number follows the bytes shuffled, and
    a side of a union that is a small part of it may be left to one task.
    """
    if tasks is not None and keys:
        rows, split = labelled(df, keys, order, max_group, split)
        return rows.repartition(tasks, *keys, *([RANGE] if split else [])), split
    if split is False:
        return df.withColumn(RANGE, F.lit(None).cast("int")), False
    if not keys:  # one group, dealt over all tasks however small it is; stored, so that a row's range is found once
        ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // max_group))
        return durable(df.repartitionByRange(ranges, *[_sort_expr(c) for c in order]).withColumn(RANGE, F.spark_partition_id())), True
    large = large_groups(df, keys, max_group)
    if large is None:
        return df.withColumn(RANGE, F.lit(None).cast("int")), False
    cut = durable(bounds(df, keys, order, large, max_group))
    lists = F.col("_lists")
    before = F.size(F.filter(lists, lambda x: _reached(order, x["_part"][0]["at"])))
    inside = F.size(F.filter(F.get(lists, before - 1)["_part"], lambda x: _reached(order, x["at"])))
    at = F.when(lists.isNotNull(), F.when(before == 0, 0).otherwise((before - 1) * LEVEL + inside))
    names = [f"_b{i}" for i in range(len(keys))]
    met = df.join(cut, same_keys(keys, "_b"), "left")
    return met.withColumn(RANGE, at).drop("_lists", *names), True


def carried(rows: DataFrame, keys: Sequence[str], parts: dict[str, Column], compose: Callable[[Window], dict[str, Column]], *steps) -> DataFrame:
    """Rows of ``labelled`` joined with what enters their range.

    ``parts`` aggregates a range, one row per range of a large key. ``compose`` and each of ``steps`` turn the window over
    the ranges before into new columns, later ones from earlier ones; the columns join the rows.
    """
    part = rows.where(F.col(RANGE).isNotNull()).groupBy(*keys, RANGE).agg(*[c.alias(n) for n, c in parts.items()])
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    names: list[str] = []
    for step in (compose, *steps):
        columns = step(before)
        part = part.withColumns(columns)
        names += columns
    entering = part.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(RANGE).alias("_r"), *names)
    return rows.join(entering, same_keys(keys, "_k") & (F.col(RANGE) == F.col("_r")), "left").drop("_r", *[f"_k{i}" for i in range(len(keys))])


@dataclass
class _Result:
    """One requested column: from the window, and where keys are split from the part of a range and its carry."""

    name: str
    inner: Callable[[Window], Column]
    part: Column
    carry: Callable[[Column, Window], Column]
    merge: Callable[[Column, Column, Window], Column]


class KeyedOrder:
    """Rows of ``df`` in the order ``order`` within ``keys``; a leading ``-`` means descending.

    Results are asked for one after the other and computed together by ``rows``. ``split=False`` says that no key is too
    large for one task; otherwise the rows of each key are counted. With no keys all rows are one group, always cut.
    ``tasks`` is the number of tasks the rows are dealt over by key, where the caller knows it.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], max_group: int = MAX_GROUP_ROWS, split: bool | None = None, tasks: int | None = None):
        self.keys, self.order = keys, order
        self.df, self.split = labelled(df, keys, order, max_group, split, tasks)
        self.results: list[_Result] = []

    def _window(self):
        return Window.partitionBy(*self.keys, *([RANGE] if self.split else [])).orderBy(*[_sort_expr(c) for c in self.order])

    def running(self, fn: str, value: Column, name: str, peers: bool = True) -> KeyedOrder:
        """Running ``fn`` (sum, count, min, max) of ``value`` up to the current row.

        With ``peers`` rows that tie in the order share one result, otherwise each row counts alone.
        """
        agg, merge = _MERGE[fn]
        combine = _MERGE["sum" if fn == "count" else fn][0]
        frame = lambda w: w if peers else w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        self.results.append(_Result(name, lambda w: agg(value).over(frame(w)), agg(value), lambda p, before: combine(p).over(before), lambda c, inner, w: merge(c, inner)))
        return self

    def row_number(self, name: str) -> KeyedOrder:
        """Position from 1. The order must be unique within a key for a repeatable result."""
        return self.running("count", F.lit(1), name, peers=False)

    def dense_rank(self, name: str) -> KeyedOrder:
        """Rank without gaps. Ties never straddle a range, so ranks of earlier ranges add up."""
        # A missing value is a value of its own here, so every part is a struct.
        ties = F.struct(*[F.struct(c.lstrip("-")) for c in self.order])
        add = lambda c, inner, w: F.coalesce(c, F.lit(0)) + inner
        self.results.append(_Result(name, lambda w: F.dense_rank().over(w).cast("bigint"), F.count_distinct(ties), lambda p, before: F.sum(p).over(before), add))
        return self

    def previous(self, value: Column, name: str) -> KeyedOrder:
        """``value`` of the row before, per key. Ascending, unique orders only."""
        if self.split and any(c.startswith("-") for c in self.order):
            raise ValueError("previous() needs an ascending order")
        last = F.max_by(F.struct(value.alias("v")), F.struct(*self.order))
        first = lambda c, inner, w: F.when(F.row_number().over(w) == 1, c["v"]).otherwise(inner)
        self.results.append(_Result(name, lambda w: F.lag(value).over(w), last, lambda p, before: F.last(p).over(before), first))
        return self

    def rows(self) -> DataFrame:
        w, results = self._window(), list(enumerate(self.results))
        if not self.split:
            return self.df.withColumns({r.name: r.inner(w) for _, r in results}).drop(RANGE)
        parts = {f"_part{i}": r.part for i, r in results}
        df = carried(self.df, self.keys, parts, lambda before: {f"_carry{i}": r.carry(F.col(f"_part{i}"), before) for i, r in results})
        df = df.withColumns({r.name: r.merge(F.col(f"_carry{i}"), r.inner(w), w) for i, r in results})
        return df.drop(RANGE, *[f"_carry{i}" for i, _ in results])


def keyed_rank(df: DataFrame, keys: list[str], order: list[str], name: str, **options) -> DataFrame:
    """Row number per key as one call."""
    return KeyedOrder(df, keys, order, **options).row_number(name).rows()
