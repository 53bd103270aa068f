"""Repeatable splits, balancing, stratified samples and batches, all ordered by a stable hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from chronocohort.functions.scalars import stable_hash
from chronocohort.operators.ordered import keyed_rank
from chronocohort.operators.reshape import top_per_group
from chronocohort.session import durable


def entity_split(ids: DataFrame, key: str, train: float = 0.8, val: float = 0.9, salt: int = 0) -> DataFrame:
    """``(key, split)`` with exact shares: entities in hash order, cut at ``int(n*train)`` and ``int(n*val)``."""
    # Ranking reads its rows several times, and a filter on their place would reach the rows before ``distinct``.
    unique = durable(ids.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_h", stable_hash(key, salt)))
    ranked = keyed_rank(unique, [], ["_h", key], "_n")
    n = unique.count()
    place = F.col("_n") - 1
    split = F.when(place < int(n * train), "train").when(place < int(n * val), "val").otherwise("test")
    return ranked.select(key, split.alias("split"))


def resplit(splits: DataFrame, key: str, salt: int = 1) -> DataFrame:
    """A new train/val division of the same sizes; test entities stay."""
    splits = durable(splits.select(key, "split"))
    sizes = {r["split"]: r["n"] for r in splits.groupBy("split").agg(F.count(key).alias("n")).collect()}
    pool = splits.where(F.col("split") != "test").select(key, stable_hash(key, salt).alias("_h"))
    ranked = keyed_rank(pool, [], ["_h", key], "_n")
    fresh = F.when(F.col("_n") <= sizes.get("train", 0), "train").otherwise("val")
    return ranked.select(key, fresh.alias("split")).unionByName(
        splits.where(F.col("split") == "test").select(key, "split")
    )


def oversample(rows: DataFrame, label: str, row_id: str, salt: int = 3, **sizing) -> DataFrame:
    """Both classes at the size of the larger one, as ``(draw, label, row columns)``.

    Rows of the larger class appear once. For each of them one row of the smaller class is drawn with
    replacement: the place in the smaller class is a hash of the draw number, so a draw is an equi
    join on that place and drawn rows spread evenly over it.
    """
    sizes = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    if not ones or not zeros:
        raise ValueError("balancing needs both classes")
    large = 1 if ones > zeros else 0
    small_size = min(ones, zeros)
    ranked = keyed_rank(
        rows.withColumn("_h", stable_hash(row_id, salt)), [label], ["_h", row_id], "draw", **sizing
    ).drop("_h")
    kept = ranked.where(F.col(label) == large)
    if ones == zeros:
        return ranked
    picks = kept.select("draw", (F.pmod(stable_hash("draw", salt), F.lit(small_size)) + 1).alias("_place"))
    pool = ranked.where(F.col(label) != large).withColumnRenamed("draw", "_place")
    return kept.unionByName(picks.join(pool, "_place").drop("_place"))


def stratified(rows: DataFrame, label: str, row_id: str, k: int, salt: int = 5, **sizing) -> DataFrame:
    """Up to ``k`` rows per class, without replacement."""
    hashed = rows.withColumn("_h", stable_hash(row_id, salt))
    return top_per_group(hashed, [label], ["_h", row_id], k, **sizing).drop("_h")


def epoch_order(rows: DataFrame, keys: Sequence[str], row_id: str, epoch: int, name: str, **sizing) -> DataFrame:
    """Position of each row in the shuffled order of an epoch, within ``keys`` (none: over all rows)."""
    hashed = rows.withColumn("_h", stable_hash(row_id, epoch))
    return keyed_rank(hashed, list(keys), ["_h", row_id], name, **sizing).drop("_h")


def balanced_batches(rows: DataFrame, label: str, row_id: str, size: int, epoch: int = 0, **sizing) -> DataFrame:
    """Batch b holds the b-th slice of ``size`` rows of every class in the epoch's order."""
    placed = epoch_order(rows, [label], row_id, epoch, "_n", **sizing)
    return placed.withColumn("batch", F.floor((F.col("_n") - 1) / F.lit(size)).cast("int")).drop("_n")


def sequential_batches(rows: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Consecutive batches of ``size`` rows in a global order."""
    placed = keyed_rank(rows, [], list(order), "_n")
    return placed.withColumn("batch", F.floor((F.col("_n") - 1) / F.lit(size)).cast("int")).drop("_n")


def late_cohort(rows: DataFrame, key: str, horizon: str, last: int = 6, only_first: bool = False) -> DataFrame:
    """Rows of the entities still present at the furthest horizon, optionally only their horizon 0."""
    late = rows.where(F.col(horizon) == last).select(key).distinct()
    kept = rows.where(F.col(horizon) == 0) if only_first else rows
    return kept.join(late, key, "left_semi")
