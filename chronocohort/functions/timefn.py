"""Time arithmetic on ``timestamp_ntz`` columns, all as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 24 * MICROS_PER_HOUR


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros_between(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end))


def hours_between(start: Column | str, end: Column | str) -> Column:
    """Elapsed hours from ``start`` to ``end`` as a double."""
    return micros_between(start, end) / F.lit(float(MICROS_PER_HOUR))


def days_between(start: Column | str, end: Column | str) -> Column:
    return micros_between(start, end) / F.lit(float(MICROS_PER_DAY))


def hours(n: int) -> Column:
    """A constant interval of ``n`` hours."""
    return F.make_dt_interval(F.lit(0), F.lit(n))


def shift_hours(t: Column | str, n: Column | str) -> Column:
    """``t`` moved by a column of (whole or fractional) hours, to the microsecond."""
    micros = F.rint(_col(n).cast("double") * MICROS_PER_HOUR).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, _col(t))


def ceil_hour(t: Column | str) -> Column:
    """The clock hour reached by adding 59 minutes and dropping the rest."""
    shifted = _col(t) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(59))
    return F.date_trunc("hour", shifted).cast("timestamp_ntz")


def hour_bucket(t: Column | str, width: int = 1) -> Column:
    """Number of the ``width``-hour bucket since 1970 that holds ``t``."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(micros_between(epoch, t) / F.lit(float(width * MICROS_PER_HOUR)))


def parse_ts(text: Column | str, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Text to timestamp; text that does not fit the format becomes null."""
    return F.try_to_timestamp(_col(text), F.lit(fmt)).cast("timestamp_ntz")


def compose_ts(day: Column | str, clock: Column | str) -> Column:
    """A date joined with a clock text such as ``7:05`` or ``17:45:10``; null if either is missing."""
    parts = F.regexp_extract(_col(clock), r"^(\d{1,2}):(\d{2})", 0)
    stamp = F.concat(F.date_format(_col(day), "yyyy-MM-dd"), F.lit(" "), F.nullif(parts, F.lit("")))
    return F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd H:mm")).cast("timestamp_ntz")


def age_hour_index(t: Column | str, ref: Column | str) -> Column:
    """Hours from ``ref`` to ``t`` counted on a calendar: years, months, days, hours and minutes
    between the two stamps, with 8760 h per year, 730 h per month, minutes rounded half to even and
    seconds ignored. A borrowed month has the length of the earlier stamp's month.
    """
    # Few references to the inputs: the optimizer may copy the whole expression into a filter or a
    # join condition, where shared parts are computed as often as they are written.
    t, ref = _col(t), _col(ref)
    low = F.when(t <= ref, t).when(t > ref, ref)
    high = F.when(t <= ref, ref).when(t > ref, t)
    low_month, high_month = F.trunc(low, "MM"), F.trunc(high, "MM")
    months = F.months_between(high_month, low_month, roundOff=False)
    # Time into the month of the later stamp minus that of the earlier one.
    gap = micros_between(low, high) - F.datediff(high_month, low_month).cast("bigint") * MICROS_PER_DAY
    month_micros = F.dayofmonth(F.last_day(low)).cast("bigint") * MICROS_PER_DAY
    # 31 minutes or more round up, so adding 29 minutes and cutting to hours gives the rounded hour.
    rounding, hour = F.lit(29 * 60_000_000), F.lit(float(MICROS_PER_HOUR))
    rest = F.when(gap < 0, F.floor((gap + month_micros + rounding) / hour) - 730).otherwise(
        F.floor((gap + rounding) / hour)
    )
    return F.when(t < ref, -1.0).otherwise(1.0) * (months * 730.0 + rest) + F.lit(0.0)


def age_years(birth: Column | str, at: Column | str, over: float = 89, capped: float = 91.4) -> Column:
    """Age in years of 365.242 days, to 4 places; ages above ``over`` become ``capped``."""
    age = F.round(F.datediff(_col(at), _col(birth)) / F.lit(365.242), 4)
    return F.when(age > over, F.lit(capped)).otherwise(age)


def phase_label(t: Column | str, index_time: Column | str, width: int = 5) -> Column:
    """0 before the index time, 1 from it to ``width`` hours after (both included), 2 later."""
    t, t0 = _col(t), _col(index_time)
    return F.when(t < t0, 0).when(t.between(t0, t0 + hours(width)), 1).otherwise(2)
