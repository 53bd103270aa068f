"""Finding keys that hold too many rows for one task, and joining past them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from chronocohort.session import durable

# Rows of one key that a single task may hold. Beyond it the key is split.
MAX_GROUP_ROWS = 1_000_000
# Hot keys listed in a plan; more of them are a table. Hot keys of a table that is broadcast; more of them are joined by shuffle.
MAX_LISTED = 256
MAX_BROADCAST = 1_000_000


def hot_keys(df: DataFrame, key: str, max_group: int = MAX_GROUP_ROWS) -> dict:
    """Every value of ``key`` (null too) with more than ``max_group`` rows, and its rows: at most rows / max_group entries."""
    counts = df.groupBy(key).count().where(F.col("count") > max_group)
    return {row[0]: row[1] for row in counts.collect()}


def heavy_keys(df: DataFrame, key: str, max_group: int = MAX_GROUP_ROWS, max_listed: int = MAX_LISTED) -> dict | DataFrame:
    """As ``hot_keys`` where there are at most ``max_listed``, else a stored table of the key (``_hot``) and its rows (``_rows``)."""
    counts = df.groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_rows")).where(F.col("_rows") > max_group)
    first = counts.orderBy(F.desc("_rows")).limit(max_listed + 1).collect()
    return durable(counts) if len(first) > max_listed else {row[0]: row[1] for row in first}


def is_hot(hot: dict | DataFrame) -> bool:
    """Are there any hot keys (as ``heavy_keys`` gives them)?"""
    return not isinstance(hot, dict) or bool(hot)


def _dealt_by_table(events: DataFrame, index: DataFrame, key: str, other: str, hot: DataFrame, max_group: int) -> tuple[DataFrame, Column, DataFrame, Column]:
    """Both sides with the number of sub-keys of their key, null where it is not hot."""
    salts = hot.select("_hot", F.ceil(F.col("_rows") / max_group).cast("int").alias("_salts"))
    if hot.count() <= MAX_BROADCAST:
        salts = F.broadcast(salts)
    events = events.join(salts, F.col(key).eqNullSafe(F.col("_hot")), "left").drop("_hot")
    salts = salts.withColumnRenamed("_salts", "_salts_index")
    index = index.join(salts, F.col(other) == F.col("_hot"), "left").drop("_hot")
    return events, F.col("_salts"), index, F.col("_salts_index")


def large_groups(df: DataFrame, keys: Sequence[str], max_group: int = MAX_GROUP_ROWS) -> DataFrame | None:
    """The groups with more than ``max_group`` rows as a stored table (``_h0``, ``_h1``, ...), or None if there are none."""
    counts = df.groupBy(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("_rows"))
    large = durable(counts.where(F.col("_rows") > max_group))
    return None if large.isEmpty() else large


class GroupSizes:
    """Hot keys of a base table, measured once per key and valid for everything filtered from it.

    Operators measure their own input unless they are told; inside a longer plan that would run the
    plan up to that point once more, so a plan measures its base tables and passes the answer on.
    """

    def __init__(self, df: DataFrame, max_group: int = MAX_GROUP_ROWS):
        self._df, self._max_group = df, max_group
        self._hot: dict[str, dict | DataFrame] = {}

    def hot(self, key: str) -> dict | DataFrame:
        if key not in self._hot:
            self._hot[key] = heavy_keys(self._df, key, self._max_group)
        return self._hot[key]

    def split(self, key: str) -> bool:
        return is_hot(self.hot(key))


def key_join(
    events: DataFrame,
    index: DataFrame,
    key: str,
    condition: Column | None = None,
    how: str = "inner",
    hot: dict | DataFrame | None = None,
    max_group: int = MAX_GROUP_ROWS,
    max_listed: int = MAX_LISTED,
    tasks: int | None = None,
) -> DataFrame:
    """Join a long event table to an index table on ``key``, spreading the keys with most events.

    The rows of a hot key are dealt over as many sub-keys as it holds multiples of ``max_group`` rows, and only that
    key's index rows are repeated once per sub-key, so the copy grows with the hot keys and not with the index table.
    ``hot`` gives the hot keys and their rows (see ``heavy_keys``) where they are known; otherwise they are counted first.
    Up to ``max_listed`` hot keys are listed in the plan; more of them are a table that is joined to both sides.
    ``how`` is inner, left, left_semi or left_anti: the event side is never repeated. With ``tasks`` both sides are dealt by key
    and sub-key over that many tasks, which stay dealt by key where none is hot.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    other = f"_{key}_index"
    index = index.withColumnRenamed(key, other)
    on = F.col(key) == F.col(other)
    hot = heavy_keys(events, key, max_group, max_listed) if hot is None else hot
    listed = isinstance(hot, dict)
    dealt_by, repeated_by = [key], [other]
    if is_hot(hot):
        hashed = [F.col(f.name) for f in events.schema.fields if "map<" not in f.dataType.simpleString()]
        if listed:
            salts = {k: -(-rows // max_group) for k, rows in hot.items()}
            # Null keys meet no index row, but an outer or anti join keeps them: they are dealt as well.
            nulls = F.when(F.col(key).isNull(), salts.pop(None, 1))
            known = F.create_map(*[F.lit(x) for pair in salts.items() for x in pair]) if salts else None
            count = lambda c: known[F.col(c)] if salts else F.lit(None).cast("int")
            deal, repeat = F.coalesce(nulls, count(key)), count(other)
        else:
            events, deal, index, repeat = _dealt_by_table(events, index, key, other, hot, max_group)
        dealt = F.pmod(F.xxhash64(*hashed), F.coalesce(deal, F.lit(1))).cast("int")
        every = F.sequence(F.lit(0), F.coalesce(repeat, F.lit(1)) - 1)
        events = events.withColumn("_salt", dealt)
        index = index.withColumn("_salt_index", F.explode(every))
        on = on & (F.col("_salt") == F.col("_salt_index"))
        dealt_by, repeated_by = [key, "_salt"], [other, "_salt_index"]
    if condition is not None:
        on = on & condition
    if tasks is not None:
        events, index = events.repartition(tasks, *dealt_by), index.repartition(tasks, *repeated_by)
    return events.join(index, on, how).drop(other, "_salt", "_salt_index", "_salts", "_salts_index")
