"""Prediction records (RiskAssessment) from scored samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardline.functions.codes import sha256_id
from wardline.functions.texts import strip
from wardline.functions.times import plus_days, time_text


@dataclass(frozen=True)
class Outcome:
    system: str
    display: str
    basis: str


# Code system, display and type of the basis records per task.
OUTCOMES = {
    "ds_image": Outcome("imaging-modality", "Predicted Imaging Modality", "ImagingStudy"),
    "ds_icd": Outcome("icd-code", "Predicted ICD Code", "Condition"),
    "ds_readmission": Outcome("readmission", "Predicted Readmission Risk", "Encounter"),
    "ds_mortality": Outcome("mortality", "Predicted Mortality Risk", "Encounter"),
}
OTHER = Outcome("unknown", "Prediction", "Observation")
HISTORY = r"(?s)(?:^|\n)Patient (?:history|journey):[^\n]*\n(.*)"
DATED = r"(?sm)^(\d{4}-\d{2}-\d{2}):(.*?)(?=\n\d{4}-\d{2}-\d{2}:|\z)"


def history_references(text: Column, patient_id: Column, cut: Column, basis: str) -> Column:
    """References to the entries of a history or journey dated up to the cut.

    A line ``date: value`` is one entry; below a line ``date:`` each line up
    to the next date is one.
    """
    history = F.regexp_extract(text, HISTORY, 1)

    def entries(at, told):
        lines = F.split(told, "\n", -1)
        own = F.when(F.length(strip(F.get(lines, F.lit(0)))) > 0, F.slice(lines, 1, 1)).otherwise(lines)
        return F.transform(own, lambda x: F.struct(at.alias("at"), strip(x).alias("value")))

    blocks = (F.regexp_extract_all(history, F.lit(DATED), F.lit(group)) for group in (1, 2))
    dated = F.flatten(F.zip_with(*blocks, entries))
    told = F.filter(dated, lambda e: (e["at"] <= cut) & (F.length(e["value"]) > 0))

    def reference(e):
        key = sha256_id(patient_id, F.lit(":"), e["at"], F.lit(":"), e["value"])
        return F.struct(
            F.concat(F.lit(f"{basis}/"), key).alias("reference"),
            F.concat(e["value"], F.lit(" on "), e["at"]).alias("display"),
            F.lit(basis).alias("type"),
        )

    return F.transform(told, reference)


def risk_assessment(
    predictions: DataFrame, task: str, model: str, now: Column, base_url: str = "", id_prefix: str = "wardline"
) -> DataFrame:
    """One nested record per prediction.

    ``predictions`` has patient_id, encounter_id, sample_start, text,
    prediction and probability.
    """
    outcome = OUTCOMES.get(task, OTHER)
    patient, label = F.col("patient_id"), F.col("prediction").cast("string")
    shown = F.concat(F.lit(f"{outcome.display}: "), label)
    stay = F.struct(
        F.concat(F.lit("Encounter/"), F.col("encounter_id")).alias("reference"),
        F.concat(F.lit("Encounter for patient "), patient).alias("display"),
        F.lit("Encounter").alias("type"),
    )
    history = history_references(F.col("text"), patient, time_text(F.col("sample_start")), outcome.basis)
    coded = F.struct(
        F.lit(f"{base_url}/fhir/ml/{outcome.system}").alias("system"),
        label.alias("code"),
        shown.alias("display"),
        F.lit("1.0").alias("version"),
    )
    method = F.struct(
        F.lit(f"{base_url}/fhir/ml/models").alias("system"),
        F.lit(model).alias("code"),
        F.lit(f"ML Model: {model}").alias("display"),
        F.lit("1.0").alias("version"),
    )
    period = F.struct(time_text(now).alias("start"), time_text(plus_days(now, 1)).alias("end"))
    cut = time_text(F.col("sample_start"))
    return predictions.select(
        F.lit("RiskAssessment").alias("resourceType"),
        sha256_id(F.lit(id_prefix), patient, F.lit(model), F.col("encounter_id"), cut, label, time_text(now)).alias("id"),
        F.lit("final").alias("status"),
        F.lit("en").alias("language"),
        F.struct(
            F.concat(F.lit("Patient/"), patient).alias("reference"),
            F.concat(F.lit("Patient "), patient).alias("display"),
            F.lit("Patient").alias("type"),
        ).alias("subject"),
        time_text(now).alias("occurrenceDateTime"),
        F.struct(F.array(method).alias("coding"), F.lit(f"ML Model: {model}").alias("text")).alias("method"),
        F.concat(F.array(stay), F.coalesce(history, F.array())).alias("basis"),
        F.array(F.struct(F.concat(F.lit("Input text: "), F.col("text")).alias("text"))).alias("note"),
        F.array(
            F.struct(
                F.col("probability").cast("double").alias("probabilityDecimal"),
                period.alias("whenPeriod"),
                F.struct(F.array(coded).alias("coding"), shown.alias("text")).alias("qualitativeRisk"),
            )
        ).alias("prediction"),
    )


def record_schema(spark: SparkSession) -> StructType:
    """Columns of the records."""
    predictions = "patient_id string, encounter_id string, sample_start timestamp, text string, prediction string, probability double"
    return risk_assessment(spark.createDataFrame([], predictions), "", "", F.current_timestamp()).schema


def publishable(predictions: DataFrame) -> DataFrame:
    """Adds ``reject_reason``: which key a prediction lacks, null when it has all."""
    keys = ("patient_id", "encounter_id", "sample_start")
    lacking = F.concat_ws(",", *[F.when(F.col(k).isNull(), F.lit(k)) for k in keys])
    return predictions.withColumn("reject_reason", F.when(F.length(lacking) > 0, F.concat(F.lit("missing "), lacking)))


def publish_batch(predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) predictions."""
    marked = publishable(predictions)
    accepted = marked.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return accepted, marked.where(F.col("reject_reason").isNotNull())


def publish_counts(predictions: DataFrame) -> DataFrame:
    ok = F.col("reject_reason").isNull()
    return publishable(predictions).agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))


def write_risk_assessments(records: DataFrame, path: str) -> None:
    """One JSON record per line."""
    records.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
