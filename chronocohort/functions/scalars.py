"""Scalar column functions: scores, conversions, text flags and stable hashes."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

HASH_MODULUS = 4_294_967_296
HASH_MULTIPLIER = 2_654_435_761


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stable_hash(entity: Column | str, salt: int = 0) -> Column:
    """A repeatable pseudo-random number in [0, 2^32) for a whole-number key.

    Multiplication modulo 2^32, so that any SQL engine reproduces the same order.
    """
    base = F.pmod(_col(entity).cast("bigint") + salt * 97, F.lit(2_147_483_648))
    return F.pmod(base * F.lit(HASH_MULTIPLIER) + F.lit(salt), F.lit(HASH_MODULUS))


def is_not(flag: Column | str, value) -> Column:
    """Null-safe inequality: true for null and for every other value."""
    return ~_col(flag).eqNullSafe(F.lit(value))


def clamp_null(code: Column | str, value: Column | str, limits: Mapping) -> Column:
    """The value, or null where it exceeds the upper limit of its code. Codes without limit pass."""
    code, value = _col(code), _col(value)
    out = None
    for item, high in limits.items():
        test = (code == item) & (value > high)
        out = F.when(test, None) if out is None else out.when(test, None)
    return value if out is None else out.otherwise(value)


def convert_units(code: Column | str, value: Column | str, factors: Mapping) -> Column:
    """Linear conversion ``value * scale + offset`` by code; other codes pass unchanged."""
    code, value = _col(code), _col(value)
    out = None
    for item, (scale, offset) in factors.items():
        converted = value * F.lit(float(scale)) + F.lit(float(offset))
        out = F.when(code == item, converted) if out is None else out.when(code == item, converted)
    return value if out is None else out.otherwise(value)


def banded(value: Column | str, bands: Sequence[tuple]) -> Column:
    """Scale by the first band ``(low, high, low_open, scale)`` holding the value, else null.

    The high end of a band is included and the low end only where ``low_open`` is false.
    """
    value = _col(value)
    out = None
    for low, high, low_open, scale in bands:
        inside = ((value > low) if low_open else (value >= low)) & (value <= high)
        scaled = value * F.lit(float(scale))
        out = F.when(inside, scaled) if out is None else out.when(inside, scaled)
    return out


def sentinel(code: Column | str, text: Column | str, value: Column | str, markers: Mapping, to=0.0) -> Column:
    """``to`` where the text is the marker of its code, else the numeric value."""
    code, text = _col(code), _col(text)
    out = None
    for item, marker in markers.items():
        test = (code == item) & (text == marker)
        out = F.when(test, F.lit(to)) if out is None else out.when(test, F.lit(to))
    return out.otherwise(_col(value))


def keyword_any(text: Column | str, include: Sequence[str], exclude: Sequence[str] = ()) -> Column:
    """1 where the lower-cased text contains any keyword and no excluded word, else 0.

    ``%`` inside a keyword stands for any text. One alternation is compiled once per task.
    """

    def pattern(words: Sequence[str]) -> str:
        parts = {".*".join(re.escape(p) for p in w.lower().split("%")) for w in words}
        return "(?s)(" + "|".join(sorted(parts)) + ")"

    low = F.lower(_col(text))
    hit = low.rlike(pattern(include))
    if exclude:
        hit = hit & ~low.rlike(pattern(exclude))
    return F.when(hit, 1).otherwise(0)


def extract_number(text: Column | str, pattern: str, mask: str = "*") -> Column:
    """The first group of ``pattern`` as a double; null if absent, masked or not a number."""
    found = F.regexp_extract(_col(text), pattern, 1)
    kept = F.when((found == "") | found.contains(mask), None).otherwise(F.trim(found))
    return kept.try_cast("double")


def threshold_score(value: Column | str, cuts: Sequence[tuple], below: bool) -> Column:
    """Score ladder: ``cuts`` are (limit, score) in test order, ``value < limit`` if ``below`` else
    ``value >= limit``. A value past every cut scores 0, a missing one stays null."""
    value = _col(value)
    out = None
    for limit, score in cuts:
        test = (value < limit) if below else (value >= limit)
        out = F.when(test, score) if out is None else out.when(test, score)
    return out.when(value.isNull(), None).otherwise(0)


def null_as_zero_sum(*cols: Column | str) -> Column:
    total = F.coalesce(_col(cols[0]), F.lit(0))
    for c in cols[1:]:
        total = total + F.coalesce(_col(c), F.lit(0))
    return total


def logistic_score(intercept: float, terms: Sequence[tuple]) -> Column:
    """``1/(1+exp(-(b + sum)))`` over terms ``(column, weight, mean, adjustment)``.

    A missing column contributes ``weight * mean + adjustment``; with mean None it makes the score null.
    """
    z = F.lit(float(intercept))
    for column, weight, mean, adjustment in terms:
        term = F.lit(float(weight)) * _col(column)
        if mean is not None:
            term = F.coalesce(term, F.lit(float(weight * mean + adjustment)))
        z = z + term
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def guarded_ratio(a: Column | str, b: Column | str, k: float = 100.0) -> Column:
    """``k * a / b``, null where either side is missing or b is zero."""
    return F.try_divide(F.lit(float(k)) * _col(a), _col(b).cast("double"))


def category_map(category: Column | str, groups: Mapping[str, Sequence[str]]) -> Column:
    """The group whose list holds the category; unlisted categories stay as they are."""
    category = _col(category)
    out = None
    for group, members in groups.items():
        test = category.isin(list(members))
        out = F.when(test, group) if out is None else out.when(test, group)
    return out.otherwise(category)


def round_tens(value: Column | str) -> Column:
    """Round to tens, half to even."""
    return F.rint(_col(value) / F.lit(10.0)) * F.lit(10.0)


def exclusion_flags(rules: Mapping[str, Column]) -> dict[str, Column]:
    """0/1 columns per rule, plus ``excluded`` where any rule holds. A null test counts as 0."""
    flags = {name: F.when(test, 1).otherwise(0) for name, test in rules.items()}
    any_rule = None
    for test in rules.values():
        test = F.coalesce(test, F.lit(False))
        any_rule = test if any_rule is None else (any_rule | test)
    flags["excluded"] = F.when(any_rule, 1).otherwise(0)
    return flags
