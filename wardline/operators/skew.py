"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_HOT = 1000
MIN_HOT_ROWS = 200_000


def most_hot(spark: SparkSession, max_hot: int = MAX_HOT) -> int:
    """How many keys can be hot: ``max_hot``, or the shuffle partitions if there are more."""
    return max(max_hot, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hot_keys(df: DataFrame, keys: list[str], max_hot: int = MAX_HOT, min_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Keys above 1/``max_hot`` of all rows with the number of salts for each.

    With more shuffle partitions than that, a key is hot above the mean rows
    of a partition, so the rows that stay together do not grow with the input
    when the partitions do. The counts add up to the total, so fewer keys than
    the larger of both numbers can qualify: the result is small whatever the
    input size.
    """
    return hot_from_counts(df.groupBy(*keys).agg(F.count("*").alias("n")), keys, max_hot, min_rows)


def hot_from_counts(counts: DataFrame, keys: list[str], max_hot: int = MAX_HOT, min_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """The same from a table that already holds the row count ``n`` per key."""
    total = counts.agg(F.sum("n").alias("t")).select(F.coalesce("t", F.lit(0))).scalar()
    limit = F.greatest(F.lit(min_rows), (total / most_hot(counts.sparkSession, max_hot)).cast("bigint"))
    return counts.where(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("_salts"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str,
    hot: DataFrame | None,
    spread: list[str],
) -> DataFrame:
    """Join where hot keys of ``left`` are cut into salts by ``spread``.

    ``right`` rows of a hot key are repeated once per salt; other rows are not
    repeated. ``how`` must keep or drop left rows only (inner, left,
    left_semi, left_anti). Without ``hot`` it is a plain join.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how} would repeat right rows")
    if hot is None:
        return left.join(right, keys, how)
    salts = F.coalesce("_salts", F.lit(1))
    spread_hash = F.pmod(F.xxhash64(*spread), salts.cast("bigint")).cast("int")
    salted_left = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", spread_hash).drop("_salts")
    salted_right = (
        right.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")
