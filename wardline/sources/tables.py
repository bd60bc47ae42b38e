"""Stored tables, samples and stage outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def store(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def finished(spark: SparkSession, path: str) -> bool:
    """Has a stage written its output completely?"""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def build_or_reuse(spark: SparkSession, path: str, build: Callable[[], DataFrame], rerun: bool = False) -> DataFrame:
    """Output of a stage; built only when it is missing, incomplete or to be rerun."""
    if rerun or not finished(spark, path):
        store(build(), path)
    return load(spark, path)


def read_query(spark: SparkSession, url: str, sql: str, fetch_rows: int = 1000) -> DataFrame:
    """Result of a query in an external database, fetched in chunks."""
    return spark.read.format("jdbc").options(url=url, query=sql, fetchsize=fetch_rows).load()


def write_samples(samples: DataFrame, path: str) -> None:
    """JSON lines, one folder per split."""
    samples.write.mode("overwrite").partitionBy("split").json(path)


def read_samples(
    spark: SparkSession, path: str, split: str, schema: str, limit: int | None = None, key: list[str] | None = None
) -> DataFrame:
    """Samples of one split; with ``limit`` the first rows in key order."""
    rows = spark.read.schema(f"{schema}, split string").json(path).where(F.col("split") == split).drop("split")
    return rows.orderBy(*key).limit(limit) if limit else rows
