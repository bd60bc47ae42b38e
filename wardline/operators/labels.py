"""Label rules of the sample builders.

A rule first attaches what it needs to the stays (one row per stay) and then
gives the label of a cut as an expression, so labels of many cuts cost one
join per stay.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.codes import fold_vocabulary, icd_chapter, is_label_code
from wardline.functions.times import plus_days
from wardline.operators.history import events_in_stays

STAY = ["patient_id", "encounter_id"]


def exploded_values(df: DataFrame, name: str) -> DataFrame:
    """The table with a list column turned into one row per value."""
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return df.withColumn(name, F.explode(name))
    return df


@dataclass(frozen=True)
class WindowLabels:
    """Distinct values of a coded resource between the cut and the end of the stay.

    Per stay and value only the latest time is kept: a value is a label of a
    cut when that time is not before the cut.
    """

    resource: str
    time: str
    column: str
    value: Callable[[Column], Column]
    keep: Callable[[Column], Column] = lambda c: c.isNotNull()
    end_inclusive: bool = True
    required: bool = True

    def attach(self, stays: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
        events = exploded_values(tables[self.resource], self.column)
        events = events.where(self.keep(F.col(self.column))).select(
            "patient_id", F.col(self.time).alias("ts"), self.value(F.col(self.column)).alias("label")
        )
        spans = stays.select(*STAY, F.get("cuts", F.lit(0)).alias("_first"), F.col("end").alias("_end"))
        hits = events_in_stays(spans, events, F.col("_first"), F.col("_end"), hi_incl=self.end_inclusive)
        latest = hits.groupBy(*STAY, "label").agg(F.max("ts").alias("last"))
        found = latest.groupBy(*STAY).agg(F.collect_list(F.struct("label", "last")).alias("_labels"))
        return stays.join(found, STAY, "inner" if self.required else "left")

    def value_at(self, cut: Column) -> Column:
        later = F.filter("_labels", lambda x: x["last"] >= cut)
        labels = F.array_sort(F.transform(later, lambda x: x["label"]))
        return F.coalesce(labels, F.array().cast("array<string>"))


def icd_labels() -> WindowLabels:
    return WindowLabels("condition", "condition_date", "icd_code", icd_chapter, is_label_code)


def modality_labels(end_inclusive: bool = True, required: bool = True) -> WindowLabels:
    return WindowLabels(
        "imaging_study",
        "started",
        "modality_code",
        fold_vocabulary,
        end_inclusive=end_inclusive,
        required=required,
    )


def followed_by(stays: DataFrame, days: int = 30) -> DataFrame:
    """Adds ``followed``: does another stay start in (end, end + days]?

    Starts are reduced to their smallest and largest value per patient and
    ``days``-wide bucket. A start after ``end`` in the bucket of ``end`` is
    always near enough, a start in the next bucket always late enough, so two
    unique lookups replace the pairs of a range self join.
    """
    width = F.lit(days * 86400 * 1_000_000)

    def bucket(t):
        return F.floor(F.unix_micros(F.col(t)) / width).cast("bigint")

    # a start tells of its own bucket and of the one before
    told = F.array(
        F.struct(bucket("start").alias("_bucket"), F.col("start").alias("_same"), F.lit(None).cast("timestamp").alias("_next")),
        F.struct((bucket("start") - 1).alias("_bucket"), F.lit(None).cast("timestamp").alias("_same"), F.col("start").alias("_next")),
    )
    near = (
        stays.select("patient_id", F.inline(told))
        .groupBy("patient_id", "_bucket")
        .agg(F.max("_same").alias("_same"), F.min("_next").alias("_next"))
    )
    hit = (F.col("_same") > F.col("end")) | (F.col("_next") <= plus_days(F.col("end"), days))
    return (
        stays.withColumn("_bucket", bucket("end"))
        .join(near, ["patient_id", "_bucket"], "left")
        .withColumn("followed", F.coalesce(hit, F.lit(False)))
        .drop("_bucket", "_same", "_next")
    )


@dataclass(frozen=True)
class Readmission:
    """1 when another stay of the patient starts within ``days`` after the end."""

    days: int = 30

    def attach(self, stays: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
        return followed_by(stays, self.days)

    def value_at(self, cut: Column) -> Column:
        return F.col("followed").cast("int")


@dataclass(frozen=True)
class Death:
    """1 when the patient died between the start and ``grace_days`` after the end."""

    grace_days: int = 1

    def attach(self, stays: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
        return stays

    def value_at(self, cut: Column) -> Column:
        died = F.col("deceased_date").between(F.col("start"), plus_days(F.col("end"), self.grace_days))
        return F.coalesce(died, F.lit(False)).cast("int")


@dataclass(frozen=True)
class MainCode:
    """The one main code recorded in the stay; stays without exactly one are dropped.

    Only stays that also hold a record of ``with_resource`` qualify.
    """

    is_main: Callable[[], Column]
    with_resource: str = "imaging_study"
    with_time: str = "started"

    def attach(self, stays: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
        codes = exploded_values(tables["condition"].where(self.is_main()), "icd_code").select(
            "patient_id", F.col("condition_date").alias("ts"), F.col("icd_code").alias("code")
        )
        others = tables[self.with_resource].select("patient_id", F.col(self.with_time).alias("ts"))
        marks = codes.unionByName(others, allowMissingColumns=True)
        spans = stays.select(*STAY, F.col("start").alias("_from"), F.col("end").alias("_to"))
        hits = events_in_stays(spans, marks, F.col("_from"), F.col("_to"))
        found = hits.groupBy(*STAY).agg(
            F.min("code").alias("_code"),
            F.max("code").alias("_code_max"),
            F.bool_or(F.col("code").isNull()).alias("_other"),
        )
        one = found.where(F.col("_other") & (F.col("_code") == F.col("_code_max"))).drop("_code_max", "_other")
        return stays.join(one, STAY)

    def value_at(self, cut: Column) -> Column:
        return F.array("_code")
