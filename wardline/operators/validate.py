"""Checks on cohort tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.registry import REQUIRED_COLUMNS


def null_counts(df: DataFrame, required: tuple[tuple[str, bool], ...]) -> DataFrame:
    """(column_name, level, nulls, rows) for each required column that exists."""
    present = [(c, level) for c, level in required if c in df.columns]
    counts = df.agg(
        F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c, _ in present]
    )
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit("error" if is_error else "warning").alias("level"),
            F.col(f"n_{c}").alias("nulls"),
            F.col("rows"),
        )
        for c, is_error in present
    ]
    return counts.select(F.inline(F.array(*entries)))


def day_gap_check(df: DataFrame, col: str = "ausgabe_datetime") -> DataFrame:
    """Records per calendar day between the first and the last day, last day left out."""
    per_day = df.where(F.col(col).isNotNull()).groupBy(F.to_date(col).alias("day")).agg(F.count("*").alias("n"))
    span = per_day.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where(F.col("lo") < F.col("hi"))
    spine = span.select(F.explode(F.sequence("lo", F.date_add("hi", -1))).alias("day"))
    return spine.join(per_day, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def validate(tables: dict[str, DataFrame]) -> DataFrame:
    """Null report of every table that has required columns."""
    report = None
    for name, required in REQUIRED_COLUMNS.items():
        if name in tables:
            part = null_counts(tables[name], required).select(F.lit(name).alias("resource"), "*")
            report = part if report is None else report.unionByName(part)
    return report


def raise_on_errors(report: DataFrame) -> None:
    """Fails when a column that must not be null has nulls."""
    bad = report.where((F.col("level") == "error") & (F.col("nulls") > 0)).take(20)
    if bad:
        raise ValueError("; ".join(f"{r.resource}.{r.column_name}: {r.nulls} null" for r in bad))
