"""Time columns: parsing, durations, ages, window predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86400

# Accepted time patterns beside those of a cast, tried in this order.
TIME_PATTERNS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]XXX",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]XXX",
)


def to_utc(text: Column) -> Column:
    """Instant of a time text; naive text is UTC, unreadable text is null.

    The cast comes first, as it is many times faster than a pattern and reads
    the same instant where both can read a text.
    """
    tries = [F.try_to_timestamp(text, F.lit(p)) for p in TIME_PATTERNS]
    return F.coalesce(F.try_to_timestamp(text), *tries)


def days_between(start: Column, end: Column) -> Column:
    """Whole 24-hour days, rounded down."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(DAY_SECONDS * 1_000_000)).cast("int")


def age_years(birth: Column, at: Column) -> Column:
    """Days since birth divided by 365, rounded down."""
    return F.floor(days_between(birth.cast("timestamp"), at) / F.lit(365)).cast("int")


def plus_days(ts: Column, days: int | Column) -> Column:
    days = days if isinstance(days, Column) else F.lit(days)
    return ts + F.make_dt_interval(days=days)


def in_window(
    ts: Column,
    lo: Column | None = None,
    hi: Column | None = None,
    lo_incl: bool = True,
    hi_incl: bool = False,
) -> Column:
    """Predicate of a time window; with no bound at all every row passes."""
    keep = F.lit(True)
    if lo is not None:
        keep = keep & ((ts >= lo) if lo_incl else (ts > lo))
    if hi is not None:
        keep = keep & ((ts <= hi) if hi_incl else (ts < hi))
    return keep


def time_text(ts: Column) -> Column:
    """UTC time as printed in samples, fraction only when there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    fraction = F.date_format(ts, ".SSSSSS")
    return F.concat(whole, F.when(fraction == ".000000", F.lit("")).otherwise(fraction), F.lit("+00:00"))
