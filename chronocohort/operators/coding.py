"""Mapping item codes to concepts through rule tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from chronocohort.session import inline_table


def map_codes_in_range(
    events: DataFrame,
    rules: Sequence[tuple],
    code: str,
    value: str,
    concept: str = "concept",
    code_type: str = "int",
    keep_unmapped: bool = False,
) -> DataFrame:
    """Concept of the first rule ``(code, low, high, high_included, low_included, concept)`` that the
    row satisfies. Bounds may be None. Rows without concept are dropped unless kept on request.

    Rules for one code must not overlap, so at most one rule meets a row.
    """
    table = inline_table(
        events.sparkSession,
        f"_rule_code {code_type}, _low double, _high double, _high_in int, _low_in int, {concept} "
        + ("string" if isinstance(rules[0][5], str) else "int"),
        [tuple(r) for r in rules],
    )
    v = F.col(value)
    above = (v > F.col("_low")) | ((v == F.col("_low")) & (F.col("_low_in") == 1))
    under = (v < F.col("_high")) | ((v == F.col("_high")) & (F.col("_high_in") == 1))
    test = (
        (F.col(code) == F.col("_rule_code"))
        & (F.col("_low").isNull() | above)
        & (F.col("_high").isNull() | under)
    )
    how = "left" if keep_unmapped else "inner"
    return events.join(table, test, how).drop("_rule_code", "_low", "_high", "_high_in", "_low_in")


def label_codes(
    events: DataFrame,
    labels: Sequence[tuple],
    code: str,
    label: str = "label",
    code_type: str = "int",
    keep_unmapped: bool = False,
) -> DataFrame:
    """Attach the label of each code; several codes may share one label."""
    table = inline_table(
        events.sparkSession, f"_label_code {code_type}, {label} string", [tuple(r) for r in labels]
    )
    how = "left" if keep_unmapped else "inner"
    return events.join(table, F.col(code) == F.col("_label_code"), how).drop("_label_code")
