"""Row-level table operators: filters, projections, keyed de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.times import plus_days


def first_rows(df: DataFrame, keys: list[str], order: list[str] | None = None, last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by ``order``, then by every other column.

    Written as a min/max over a struct so that copies are reduced before the
    shuffle, whatever the size of a group of copies.
    """
    rest = [c for c in df.columns if c not in keys]
    order = [c for c in (order or []) if c not in keys]
    ranked = [*order, *[c for c in rest if c not in order]]
    pick = F.max if last else F.min
    best = df.groupBy(*keys).agg(pick(F.struct(*ranked)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def last_non_null(df: DataFrame, key: str, order: str) -> DataFrame:
    """Per key the newest non-null value of every column."""
    others = [c for c in df.columns if c not in (key, order)]
    aggs = [F.max(order).alias(order)]
    aggs += [
        F.max(F.when(F.col(c).isNotNull(), F.struct(order, c))).getField(c).alias(c) for c in others
    ]
    return df.groupBy(key).agg(*aggs).select(*df.columns)


def select_rename(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(c).alias(name) for c, name in columns.items()])


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table itself, or an empty one when a column does not exist."""
    return df if all(c in df.columns for c in columns) else df.where(F.lit(False))


def filter_date(df: DataFrame, start: Column, end: Column, col: str) -> DataFrame:
    """Closed time interval, sorted by time."""
    return df.where(F.col(col).between(start, end)).orderBy(col)


def window_extract(df: DataFrame, start: Column, end: Column, col: str) -> DataFrame:
    """Closed time interval, newest first."""
    return df.where(F.col(col).between(start, end)).orderBy(F.col(col).desc())


def min_stay(df: DataFrame, days: int = 2, start: str = "start", end: str = "end") -> DataFrame:
    """Stays strictly longer than ``days`` times 24 hours."""
    return df.where(F.col(end) > plus_days(F.col(start), days))


def ongoing(df: DataFrame, now: Column, start: str = "start", end: str = "end") -> DataFrame:
    return df.where((F.col(start) <= now) & (F.col(end) >= now))


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


# States of a record that stays in the cohort.
PROCEDURE_STATES = ("completed", "in-progress", "preparation")
REQUEST_STATES = ("active", "completed", "draft", "unknown")


def status_in(df: DataFrame, states: tuple[str, ...], col: str = "status") -> DataFrame:
    return df.where(F.col(col).isin(*states))


def issued_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("ausgabe_type") == "AUSGABE")


def fetch_related(right: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``right`` whose key is held in ``ids``."""
    return right.join(ids.select(key).distinct(), key, "left_semi")


in_set = fetch_related
