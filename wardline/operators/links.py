"""Linked patient identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.times import days_between
from wardline.operators.rows import fetch_related, first_rows
from wardline.operators.skew import hot_keys, salted_join

PERSON = ("birth_date", "sex", "insurance_type", "deceased_date")


def link_patients(patients: DataFrame) -> DataFrame:
    """Patients left-joined to the patients that name them in ``links``.

    The naming patient's columns carry the suffix ``_meta``.
    """
    names = patients.select(
        F.explode("links").alias("patient_id"),
        F.col("patient_id").alias("patient_id_meta"),
        *[F.col(c).alias(f"{c}_meta") for c in PERSON],
    )
    return patients.join(names, "patient_id", "left")


def _either(name: str) -> Column:
    return F.array(F.col(name), F.col(f"{name}_meta"))


def merge_linked_patients(patients: DataFrame, max_death_gap: int = 3) -> DataFrame:
    """One row per patient id with the ids it is linked to.

    Groups form around each naming patient. A group with more than one birth
    date, or with death dates more than ``max_death_gap`` days after the
    earliest, is left out; so is one that dies before it is born. Patients
    nobody names keep their own id. An id in several groups keeps the first.
    """
    union = link_patients(patients)
    grouped = union.where(F.col("patient_id_meta").isNotNull())
    ids = F.concat(F.array("patient_id", "patient_id_meta"), F.coalesce("links", F.array().cast("array<string>")))
    # one row per group and value: everything below is a min, max or distinct set
    spread = grouped.select(
        "patient_id_meta",
        F.explode(ids).alias("id"),
        F.array_min(_either("birth_date")).alias("birth_lo"),
        F.array_max(_either("birth_date")).alias("birth_hi"),
        F.array_min(_either("deceased_date")).alias("death_lo"),
        F.array_max(_either("deceased_date")).alias("death_hi"),
        F.array_contains(F.array_compact(_either("sex")), "male").alias("male"),
        F.array_contains(F.array_compact(_either("sex")), "female").alias("female"),
        F.array_compact(_either("insurance_type")).alias("insurances"),
    )
    groups = spread.groupBy("patient_id_meta").agg(
        F.array_sort(F.collect_set("id")).alias("ids"),
        F.min("birth_lo").alias("birth_date"),
        F.max("birth_hi").alias("birth_hi"),
        F.min("death_lo").alias("deceased_date"),
        F.max("death_hi").alias("death_hi"),
        F.bool_or("male").alias("male"),
        F.bool_or("female").alias("female"),
        F.array_distinct(F.flatten(F.collect_set("insurances"))).alias("insurances"),
    )
    deaths_agree = F.coalesce(days_between(F.col("deceased_date"), F.col("death_hi")) <= max_death_gap, F.lit(True))
    alive_first = F.coalesce(F.col("deceased_date") >= F.col("birth_date"), F.lit(True))
    sound = groups.where((F.col("birth_date") == F.col("birth_hi")) & deaths_agree & alive_first)
    sex = (
        F.when(F.col("male") & F.col("female"), "unknown")
        .when(F.col("male"), "male")
        .when(F.col("female"), "female")
        .otherwise("other")
    )
    merged = sound.select(
        F.explode("ids").alias("patient_id"),
        F.array_join("ids", ",").alias("linked_patient_id"),
        "birth_date",
        sex.alias("sex"),
        F.array_join(F.array_sort("insurances"), ",").alias("insurance_type"),
        "deceased_date",
        F.lit(0).alias("_rank"),
        F.col("patient_id_meta").alias("_group"),
    )
    alone = union.where(F.col("patient_id_meta").isNull()).select(
        "patient_id",
        F.col("patient_id").alias("linked_patient_id"),
        *PERSON,
        F.lit(1).alias("_rank"),
        F.lit(None).cast("string").alias("_group"),
    )
    return first_rows(merged.unionByName(alone), ["patient_id"], ["_rank", "_group"]).drop("_rank", "_group")


def outer_link(encounter_patients: DataFrame, links: DataFrame) -> DataFrame:
    """Patients and (patient_id, linked_patient_id) pairs, one row per patient.

    Linked ids become a sorted unique comma list; without any the own id.
    """
    joined = encounter_patients.select("patient_id").distinct().join(links.distinct(), "patient_id", "full_outer")
    listed = joined.groupBy("patient_id").agg(F.array_sort(F.collect_set("linked_patient_id")).alias("ids"))
    own = F.when(F.size("ids") > 0, F.array_join("ids", ",")).otherwise(F.col("patient_id"))
    return listed.select("patient_id", own.alias("linked_patient_id"))


def cohort_patients(patients: DataFrame, encounters: DataFrame) -> DataFrame:
    """Patients whose linked id belongs to a patient with an encounter."""
    seen = fetch_related(patients, encounters, "patient_id")
    return fetch_related(patients, seen, "linked_patient_id").select(*patients.columns)


def canonicalise(df: DataFrame, patients: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Rows of cohort patients, re-keyed to the linked id.

    The id of the record stays as ``original_patient_id``.
    """
    dim = patients.select("patient_id", "linked_patient_id")
    joined = salted_join(df, dim, ["patient_id"], "inner", hot, [c for c in df.columns if c != "patient_id"])
    return joined.withColumnRenamed("patient_id", "original_patient_id").withColumnRenamed(
        "linked_patient_id", "patient_id"
    )


def hot_patients(df: DataFrame) -> DataFrame:
    return hot_keys(df, ["patient_id"])
