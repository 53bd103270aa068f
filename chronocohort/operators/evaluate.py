"""Ranking metrics per class, resampled curves, weighted loss and metric roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from chronocohort.operators.ordered import KeyedOrder

OVERALL = -1


def curve_points(
    scores: DataFrame, label: str, score: str, group: str, overall: bool = True, **sizing
) -> DataFrame:
    """One row per (group, distinct score): positives, negatives and their sums down to that score.

    Rows fold to distinct scores first, before the group for all classes (``OVERALL``) is formed.
    """
    hits = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    misses = F.sum(F.when(F.col(label) == 1, 0).otherwise(1))
    folded = scores.groupBy(F.col(group).cast("int").alias("group"), F.col(score).alias("score")).agg(
        hits.alias("pos"), misses.alias("neg")
    )
    if overall:
        both = F.explode(F.array(F.col("group"), F.lit(OVERALL)))
        folded = (
            folded.select(both.alias("group"), "score", "pos", "neg")
            .groupBy("group", "score")
            .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        )
    ordered = KeyedOrder(folded, ["group"], ["-score"], **sizing)
    return ordered.running("sum", F.col("pos"), "tp").running("sum", F.col("neg"), "fp").rows()


def auc_by_group(points: DataFrame) -> DataFrame:
    """Trapezoid areas under the ROC and the precision-recall curve per group.

    The precision-recall curve starts at (recall 0, precision 1). A group without positives or
    without negatives has no ROC area; without positives no precision-recall area.
    """
    tp, fp, pos, neg = (F.col(c).cast("double") for c in ("tp", "fp", "pos", "neg"))
    before_tp, before_fp = tp - pos, fp - neg
    precision = tp / (tp + fp)
    before = F.when(before_tp + before_fp > 0, before_tp / (before_tp + before_fp)).otherwise(1.0)
    agg = points.groupBy("group").agg(
        F.sum(neg * (tp + before_tp) / 2).alias("_roc"),
        F.sum(pos * (precision + before) / 2).alias("_pr"),
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
    )
    p, n = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    return agg.select(
        "group",
        "n_pos",
        "n_neg",
        F.try_divide(F.col("_roc"), p * n).alias("auroc"),
        F.try_divide(F.col("_pr"), p).alias("aupr"),
    )


def class_slots(areas: DataFrame, classes: Sequence[int]) -> DataFrame:
    """One row per listed class and for all classes together; a class without rows, or without an area, reports 0."""
    slots = areas.sparkSession.range(1).select(F.explode(F.array(*(F.lit(int(c)) for c in (OVERALL, *classes)))).alias("group"))
    return slots.join(areas, "group", "left").fillna(0)


def _piece_values(rows: DataFrame, x: str, total: str, y: Column, before_y: Column, step: str, at_end: Column, n: int) -> DataFrame:
    """Interpolated values on the grid ``k/(n-1)`` of the curve pieces that end in ``rows``.

    A piece runs from the point before (``x - step``) to this one and owns the grid points from its
    left end up to, but without, its right end; the last piece owns the end as well. Both borders
    are whole numbers of the row, so no grid has to be joined.
    """
    steps = n - 1
    right, width = F.col(x).cast("double"), F.col(step).cast("double")
    left, whole = right - width, F.col(total).cast("double")
    low = F.ceil(left * steps / whole)
    closing = F.when(F.col(x) == F.col(total), 0).otherwise(1)
    high = F.ceil(right * steps / whole) - closing
    k = F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("k")
    pieces = rows.where((F.col(step) > 0) & (high >= low)).select(
        "group", k, left.alias("_l"), width.alias("_w"), whole.alias("_t"), y.alias("_y"), before_y.alias("_b"), at_end.alias("_e")
    )
    share = (F.col("k") * F.col("_t") / F.lit(float(steps)) - F.col("_l")) / F.col("_w")
    inside = F.col("_b") + (F.col("_y") - F.col("_b")) * share
    return pieces.select("group", "k", F.when(F.col("k") == steps, F.col("_e")).otherwise(inside).alias("value"))


def resample_curves(points: DataFrame, n: int = 100) -> DataFrame:
    """``(group, curve, k, x, value)``: ROC and precision-recall curves at ``x = k/(n-1)``.

    Where points share an abscissa the curve leaves from the last of them in order of falling score.
    The ROC curve is 0 at 0; the precision-recall curve ends where recall first reaches 1.
    """
    totals = points.groupBy("group").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    rows = points.join(totals, "group").where((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    tp, fp, pos, neg, p = (F.col(c).cast("double") for c in ("tp", "fp", "pos", "neg", "n_pos"))
    seen_before = tp - pos + fp - neg
    precision = tp / (tp + fp)
    precision_before = F.when(seen_before > 0, (tp - pos) / seen_before).otherwise(1.0)
    roc = _piece_values(rows, "fp", "n_neg", tp / p, (tp - pos) / p, "neg", F.lit(1.0), n)
    roc = roc.withColumn("value", F.when(F.col("k") == 0, 0.0).otherwise(F.col("value")))
    pr = _piece_values(rows, "tp", "n_pos", precision, precision_before, "pos", precision, n)
    both = roc.withColumn("curve", F.lit("roc")).unionByName(pr.withColumn("curve", F.lit("pr")))
    return both.select("group", "curve", "k", (F.col("k") / F.lit(float(n - 1))).alias("x"), "value")


def weighted_log_loss(rows: DataFrame, label: str, logit: str, other_logit: str, case_weight: float | None = None) -> DataFrame:
    """Softmax cross-entropy of two logits, averaged over the rows with a non-zero weight.

    The first logit stands for label 1. With ``case_weight`` w, positives count ``1/w`` and negatives 1.
    """
    a, b, y = F.col(logit), F.col(other_logit), F.col(label)
    top = F.greatest(a, b)
    log_sum = top + F.log(F.exp(a - top) + F.exp(b - top))
    loss = log_sum - F.when(y == 1, a).otherwise(b)
    weight = F.lit(1.0) if case_weight is None else F.when(y == 1, 1.0 / case_weight).otherwise(1.0)
    return rows.agg(
        F.try_divide(F.sum(loss * weight), F.sum(F.when(weight != 0, 1.0).otherwise(0.0))).alias("loss"),
        F.count(F.lit(1)).alias("n"),
    )


def metric_rollup(metrics: DataFrame, epoch: str, values: list[str]) -> DataFrame:
    """Mean of each metric over the batches of an epoch."""
    return metrics.groupBy(epoch).agg(*[F.avg(v).alias(v) for v in values])


def mean_sample_score(scores: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """One row per key with the average score of its repeated samples."""
    return scores.groupBy(*keys).agg(F.max(label).alias(label), F.avg(score).alias(score))
