"""Pivots, merged spines, summaries and train-only normalisation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from chronocohort.operators.skew import heavy_keys, is_hot, key_join


def conditional_pivot(
    df: DataFrame, keys: Sequence[str], label: str, value: str, columns: dict[str, tuple[str, str]]
) -> DataFrame:
    """One column per label: ``{name: (fn, label)}`` with fn min or max. One pass, one shuffle."""
    fns = {"min": F.min, "max": F.max}
    aggs = [
        fns[fn](F.when(F.col(label) == wanted, F.col(value))).alias(name)
        for name, (fn, wanted) in columns.items()
    ]
    return df.groupBy(*keys).agg(*aggs)


def signed_sum(df: DataFrame, keys: Sequence[str], code: str, value: str, negative: Sequence, name: str) -> DataFrame:
    """Sum per key in which positive values of the ``negative`` codes count against the total."""
    flipped = F.col(code).isin(list(negative)) & (F.col(value) > 0)
    return df.groupBy(*keys).agg(
        F.sum(F.when(flipped, -F.col(value)).otherwise(F.col(value))).alias(name)
    )


def merge_on_spine(sources: Sequence[DataFrame], keys: Sequence[str], tasks: int | None = None) -> DataFrame:
    """Full merge of sources that each have one row per key: all keys, every source's columns.

    The sources are stacked and folded by one aggregation, a single shuffle however many there are. With ``tasks`` the
    rows are dealt by the first key over that many tasks, and none is folded before.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    stacked = stacked if tasks is None else stacked.repartition(tasks, keys[0])
    values = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])


def mean_per_time(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean of each column per key; rows with a missing key are left out."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def entity_summary(long: DataFrame, key: str, t: str, value: str, label: str) -> DataFrame:
    """End time, label and counts per entity: observations, rows with a time, distinct times."""
    # Distinct times are counted from (key, time) cells, so no entity's times meet in one task.
    cells = long.groupBy(key, t).agg(
        F.count(value).alias("_obs"), F.count(t).alias("_rows"), F.max(label).alias(label)
    )
    return cells.groupBy(key).agg(
        F.max(t).alias("end_time"),
        F.max(label).alias(label),
        F.sum("_obs").alias("n_obs"),
        F.sum("_rows").alias("n_time_rows"),
        F.count(t).alias("n_times"),
    )


def column_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    """Mean and sample standard deviation per column: two numbers each, read to the driver."""
    aggs = [f(c).alias(f"{p}{i}") for i, c in enumerate(columns) for p, f in (("m", F.avg), ("s", F.stddev_samp))]
    row = df.agg(*aggs).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def zscore(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(x - mean) / std`` for all rows with statistics of the training rows."""
    stats = column_stats(train, columns)

    def scaled(c: str) -> Column:
        mean, std = stats[c]
        if mean is None or std is None:
            return F.lit(None).cast("double")
        return F.try_divide(F.col(c) - F.lit(mean), F.lit(std))

    return df.withColumns({c: scaled(c) for c in columns})


def drop_sparse_columns(df: DataFrame, candidates: Sequence[str], min_count: int = 500) -> DataFrame:
    """Without the candidate columns that have fewer than ``min_count`` values (one counting pass)."""
    counts = df.agg(*[F.count(c).alias(c) for c in candidates]).first()
    return df.drop(*[c for c in candidates if counts[c] < min_count])


def one_hot(df: DataFrame, columns: Sequence[str], categories: dict[str, Sequence] | None = None, max_categories: int = 1000) -> DataFrame:
    """A 0/1 column ``name_category`` per category, in place of each listed column.

    ``categories`` names them by column where they are known; otherwise they are read from the data, one job a column,
    and a column with more than ``max_categories`` is refused: its long form is ``one_hot_long``.
    """
    for c in columns:
        known = (categories or {}).get(c)
        if known is None:
            found = df.where(F.col(c).isNotNull()).select(c).distinct().limit(max_categories + 1).collect()
            if len(found) > max_categories:
                raise ValueError(f"column {c} has more than {max_categories} categories; name them or use one_hot_long")
            known = [r[0] for r in found]
        df = df.withColumns({f"{c}_{value}": F.when(F.col(c) == value, 1).otherwise(0) for value in sorted(known)}).drop(c)
    return df


def one_hot_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The ones of ``one_hot`` as rows (keys, feature, category, value): for any number of categories, nothing is collected."""
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in columns))
    long = df.select(*keys, F.explode(pairs).alias("_p")).where(F.col("_p.category").isNotNull())
    return long.select(*keys, "_p.feature", "_p.category", F.lit(1).alias("value"))


def weighted_rate(
    rates: DataFrame,
    weights: Sequence[DataFrame],
    entity: str,
    keys: Sequence[str],
    code: str,
    rate: str,
    columns: dict[str, tuple[Sequence, Sequence]],
    hot: dict | DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Highest rate per key and column ``{name: (codes per weight unit, codes as given)}``.

    Codes of the first list are divided by the entity's first known weight; each table of
    ``weights`` has columns (entity, weight) with one row per entity. An entity with very many rates is split
    (``hot`` as in ``key_join``, counted once where it is not given). ``tasks`` is the number of tasks that the rates are dealt
    over by entity: with split entities they are dealt anew.
    """
    known = []
    hot = heavy_keys(rates, entity) if hot is None else hot
    anew = tasks if is_hot(hot) else None
    for i, table in enumerate(weights):
        rates = key_join(rates, table.select(entity, F.col("weight").alias(f"_w{i}")), entity, how="left", hot=hot, tasks=anew)
        known.append(F.col(f"_w{i}"))
    per_unit = F.try_divide(F.col(rate), F.coalesce(*known))
    aggs = []
    for name, (scaled, given) in columns.items():
        value = F.when(F.col(code).isin(list(scaled)), per_unit) if scaled else None
        if given:
            test = F.col(code).isin(list(given))
            value = F.when(test, F.col(rate)) if value is None else value.when(test, F.col(rate))
        aggs.append(F.max(value).alias(name))
    rates = rates if anew is None else rates.repartition(anew, *keys)
    return rates.groupBy(*keys).agg(*aggs)


def flag_max(df: DataFrame, keys: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """0/1 per key and flag: whether any row of the key meets the test (a null test does not)."""
    return df.groupBy(*keys).agg(*[F.max(F.when(t, 1).otherwise(0)).alias(n) for n, t in flags.items()])


def min_by_state(df: DataFrame, keys: Sequence[str], state: str, value: str, columns: dict[str, int]) -> DataFrame:
    """The lowest value per key within each state, one column ``{name: state}`` each."""
    return df.groupBy(*keys).agg(
        *[F.min(F.when(F.col(state) == s, F.col(value))).alias(name) for name, s in columns.items()]
    )
