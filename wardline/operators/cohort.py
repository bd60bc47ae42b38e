"""Cohort tables per resource (each starts from canonical patient ids)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.codes import (
    extract_id,
    first_positional,
    map_insurance,
    map_tumor_type,
    reduce_cardinality,
)
from wardline.functions.times import to_utc
from wardline.operators.links import canonicalise, hot_patients
from wardline.operators.rows import (
    PROCEDURE_STATES,
    REQUEST_STATES,
    drop_missing,
    first_rows,
    issued_only,
    min_stay,
    ongoing,
    require_columns,
    status_in,
)


def _smallest(df: DataFrame, *columns: str) -> DataFrame:
    """List columns reduced to their smallest value; scalar columns stay."""
    lists = [c for c in columns if c in df.columns and df.schema[c].dataType.typeName() == "array"]
    return df.withColumns({c: reduce_cardinality(F.col(c), take_first=True) for c in lists})


def build_encounters(raw: DataFrame, minimum_days: int = 2) -> DataFrame:
    """Raw stays: copies removed, longer than ``minimum_days``, bare ids."""
    stays = min_stay(first_rows(raw, ["encounter_id", "type_code", "v3_act_code"], ["start"]), minimum_days)
    ids = {c: extract_id(F.col(c)) for c in ("patient_id", "practitioner_id") if c in stays.columns}
    return stays.withColumns(ids)


def encounter_cohort(df: DataFrame, patients: DataFrame, now: Column | None = None) -> DataFrame:
    """Stays of the cohort; with ``now`` the latest ongoing stay per patient."""
    rows = canonicalise(df, patients, hot_patients(df))
    if now is None:
        return rows
    return first_rows(ongoing(rows, now), ["patient_id"], ["start", "encounter_id"], last=True)


def patient_cohort(patients: DataFrame) -> DataFrame:
    """One row per linked id, from the smallest of its ids, with the insurance label."""
    rows = patients.withColumnRenamed("patient_id", "_own").withColumnRenamed("linked_patient_id", "patient_id")
    kept = first_rows(rows, ["patient_id"], ["_own"]).drop("_own")
    return kept.withColumn("insurance_type", map_insurance(F.col("insurance_type")))


def condition_cohort(df: DataFrame, patients: DataFrame) -> DataFrame:
    rows = canonicalise(require_columns(df, ["encounter_id", "patient_id", "condition_id"]), patients, hot_patients(df))
    rows = _smallest(rows, "code_diagnosis_type", "code_diagnosis_display")
    return drop_missing(rows, ["encounter_id", "patient_id", "condition_id"])


def performed(df: DataFrame) -> DataFrame:
    """start and end of a procedure from its period, else from its time."""
    return df.withColumns(
        {
            "start": to_utc(F.coalesce("effectivedatetimestart_v1", "effectivedatetimeend_v2")),
            "end": to_utc(F.coalesce("effectivedatetimeend_v1", "effectivedatetimeend_v2")),
        }
    )


def procedure_cohort(df: DataFrame, patients: DataFrame) -> DataFrame:
    rows = canonicalise(drop_missing(df, ["encounter_id"]), patients, hot_patients(df))
    rows = performed(status_in(rows, PROCEDURE_STATES))
    return rows.select(
        "procedure_id",
        "patient_id",
        "encounter_id",
        "code",
        "status",
        "version",
        "display",
        "start",
        "end",
        "location_id",
    )


def imaging_cohort(df: DataFrame, patients: DataFrame) -> DataFrame:
    """One row per study; the series table itself is the input."""
    rows = canonicalise(df, patients, hot_patients(df)).withColumnRenamed("id", "imaging_study_id")
    order = [c for c in ("started", "series_number", "series_instance_uid") if c in rows.columns]
    return first_rows(rows, ["imaging_study_id"], order)


def observation_cohort(df: DataFrame, patients: DataFrame) -> DataFrame:
    rows = drop_missing(require_columns(df, ["value_quantity", "value_unit"]), ["value_quantity", "value_unit"])
    return _smallest(canonicalise(rows, patients, hot_patients(df)), "code", "display")


def episode_cohort(df: DataFrame, patients: DataFrame) -> DataFrame:
    rows = canonicalise(df, patients, hot_patients(df))
    if "treatment_program" in rows.columns:
        rows = rows.withColumn("treatment_program", map_tumor_type(F.col("treatment_program")))
    return rows


def request_cohort(df: DataFrame, patients: DataFrame) -> DataFrame:
    rows = status_in(drop_missing(require_columns(df, ["patient_id", "status"]), ["patient_id"]), REQUEST_STATES)
    return _smallest(canonicalise(rows, patients, hot_patients(df)), "category_code", "category_display")


def report_cohort(df: DataFrame, patients: DataFrame) -> DataFrame:
    """Reports with a date, a first title and one category."""
    rows = canonicalise(df, patients, hot_patients(df))
    titles = F.transform("attachments", lambda a: a["title"])
    types = F.array_compact(F.transform("attachments", lambda a: a["content_type"]))
    return _smallest(
        rows.withColumns(
            {
                "date": F.coalesce("effective_datetime", "issued"),
                "title": first_positional(titles),
                "original_category_display": F.col("category_display"),
                "content_type": reduce_cardinality(types, take_first=True),
            }
        ),
        "category",
    )


def product_cohort(df: DataFrame, patients: DataFrame) -> DataFrame:
    rows = issued_only(canonicalise(df, patients, hot_patients(df)))
    return first_rows(rows, ["bdp_id", "service_request_id"], ["ausgabe_datetime"])


def medication_cohort(df: DataFrame, patients: DataFrame) -> DataFrame:
    return canonicalise(df, patients, hot_patients(df))


COHORTS = {
    "condition": condition_cohort,
    "procedure": procedure_cohort,
    "imaging_study": imaging_cohort,
    "observation": observation_cohort,
    "episode_of_care": episode_cohort,
    "service_request": request_cohort,
    "diagnostic_report": report_cohort,
    "biologically_derived_product": product_cohort,
    "medication": medication_cohort,
}
