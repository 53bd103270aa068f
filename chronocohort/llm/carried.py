"""Input columns carried through an operator in one struct, so that none of them meets a name the operator uses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

ROW = "row"


def packed(columns: Sequence[str]) -> Column:
    """The named columns as the struct ``row``."""
    fields = F.struct(*(F.col(f"`{c}`") for c in columns)) if columns else F.lit(None).cast("struct<none:int>")
    return fields.alias(ROW)


def unpacked(columns: Sequence[str]) -> list[Column]:
    """The columns out of ``row`` again."""
    return [F.col(ROW).getField(c).alias(c) for c in columns]
