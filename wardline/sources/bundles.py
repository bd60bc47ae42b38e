"""FHIR JSON: bundles or single resources to one row per resource, rejects beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Nested objects declared as string keep their JSON text.
BUNDLE = "resourceType string, entry array<struct<resource:string>>, _broken string"
#: where rejects lie among the resource types of a landing
REJECTED = "_rejected"


def parse_bundles(df: DataFrame, json_col: str = "value") -> DataFrame:
    """(resource_type, resource, reason) for every ``entry[].resource`` of the bundles, and for what cannot be read.

    A row with a ``reason`` is a reject: an empty line, one that is no JSON
    object of this form (cut off, say), or no bundle, as a whole; or an entry
    without a resource or a resource without a type, by itself. Its
    ``resource`` is what was found there. The outer explode keeps Spark from
    testing the list for rows beforehand, which would parse each bundle again.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    bundle = df.select(F.col(json_col).alias("raw"), F.from_json(json_col, BUNDLE, options).alias("b"))
    reason = (
        F.when(F.coalesce(F.trim("raw"), F.lit("")) == "", "empty line")
        .when(F.col("b").isNull() | F.col("b._broken").isNotNull(), "not a JSON object of a bundle's form")
        .when(F.coalesce("b.resourceType", F.lit("")) != "Bundle", "not a bundle")
    )
    plain = ~F.contains("raw", F.lit("\\")) & ~F.contains("raw", F.lit("'"))
    marked = bundle.select("raw", reason.alias("whole"), "b.entry", plain.alias("plain"))
    entries = F.when(F.col("whole").isNull(), F.col("entry"))  # a rejected line is one row
    rows = marked.select(F.when(F.col("whole").isNotNull(), F.col("raw")).alias("raw"), "whole", "plain", F.explode_outer(entries).alias("e"))
    rows = rows.where(F.col("whole").isNotNull() | F.col("e").isNotNull()).select("raw", "whole", "plain", F.col("e.resource").alias("resource"))
    # Without backslashes and apostrophes no string of a bundle holds a quote: what begins like an object is one, and its type
    # can be read off without a parse, which filters by the type would repeat.
    start = '{"resourceType":"'
    first = F.col("plain") & F.startswith("resource", F.lit(start))
    name = F.substr(F.substring_index("resource", '"', 4), F.lit(len(start) + 1))
    kind = F.when(first, name).otherwise(F.get_json_object("resource", "$.resourceType"))
    part = F.when(F.col("resource").isNull(), "entry without a resource").when(F.col("kind").isNull(), "resource without a type")
    rows = rows.withColumn("kind", kind).withColumn("reason", F.coalesce("whole", part))
    found = F.when(F.col("whole").isNotNull(), F.col("raw")).otherwise(F.col("resource"))
    typed = F.when(F.col("reason").isNull(), F.col("kind")).otherwise(F.lit(REJECTED))
    return rows.select(typed.alias("resource_type"), found.alias("resource"), "reason")


def read_bundles(df: DataFrame, json_col: str = "value") -> DataFrame:
    """(resource_type, resource) of all that can be read."""
    return parse_bundles(df, json_col).where(F.col("reason").isNull()).drop("reason")


def tag_resources(df: DataFrame, json_col: str = "resource") -> DataFrame:
    """(resource_type, resource) of a column holding one resource per row."""
    return df.select(
        F.get_json_object(json_col, "$.resourceType").alias("resource_type"), F.col(json_col).alias("resource")
    )


def read_bundle_files(spark: SparkSession, path: str) -> DataFrame:
    """Bundles landed as JSON files with one bundle per line."""
    return read_bundles(spark.read.text(path))


def land_bundles(lines: DataFrame, path: str, json_col: str = "value", mode: str = "errorifexists") -> None:
    """Parses bundles once and stores them with a folder per resource type, rejects in one of their own.

    Rebalancing gives files of even size: rare types share a task, a type
    that holds most of the resources is written by many.
    """
    parsed = parse_bundles(lines, json_col)
    parsed.hint("rebalance", "resource_type").write.mode(mode).partitionBy("resource_type").parquet(path)


def landed(spark: SparkSession, path: str) -> DataFrame:
    """(resource_type, resource) of a landing; a flattener reads the folders of its types only."""
    return _landing(spark, path).where(F.col("resource_type") != REJECTED).select("resource_type", "resource")


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """(raw, reason) of what could not be read."""
    return _landing(spark, path).where(F.col("resource_type") == REJECTED).select(F.col("resource").alias("raw"), "reason")


def _landing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("resource string, reason string, resource_type string").parquet(path)
