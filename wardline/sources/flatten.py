"""FHIR resources to flat tables with declared schemas.

Each function takes (resource_type, resource) rows and returns the columns of
its table. Missing fields are null, repeated codings are lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.codes import code_in_system, extension_value, extract_id, safe_get, strip_ref
from wardline.functions.times import to_utc
from wardline.operators.rows import first_rows
from wardline.session import cut_lineage

CODING = "struct<system:string,version:string,code:string,display:string>"
CONCEPT = f"struct<coding:array<{CODING}>,text:string>"
REF = "struct<reference:string>"
PERIOD = "struct<start:string,end:string>"

# Fixed value: identifier system of study uids.
DICOM_UID = "urn:dicom:uid"

# Code systems and extension urls differ by site: neutral examples, replaced by the ``urls`` of a flattener.
PRODUCT_KIND = "urn:example:product:kind"
PRODUCT_OUTPUT = "urn:example:product:output"
PRODUCT_USE = "urn:example:product:use"
TUMOR_CERT = "urn:example:tumor:cert"
TUMOR_PRIMARY = "urn:example:tumor:primary-case"
TUMOR_YEAR = "urn:example:tumor:primary-year"
TUMOR_FIRST_DATE = "urn:example:tumor:first-diagnosis"
TUMOR_ID = "urn:example:tumor:identifier"
TUMOR_FORM = "urn:example:tumor:form"

SCHEMAS = {
    "Encounter": (
        "id string, status string, class struct<code:string,display:string>, "
        f"type array<{CONCEPT}>, serviceType {CONCEPT}, subject {REF}, period {PERIOD}, "
        f"participant array<struct<type:array<{CONCEPT}>,individual:{REF}>>, "
        f"hospitalization struct<admitSource:{CONCEPT},dischargeDisposition:struct<coding:array<{CODING}>,"
        "extension:array<struct<extension:array<struct<valueCoding:struct<code:string,display:string>>>>>>>, "
        "meta struct<extension:array<struct<valueString:string>>>"
    ),
    "Patient": (
        "id string, birthDate string, gender string, deceasedDateTime string, "
        f"identifier array<struct<type:{CONCEPT}>>, link array<struct<other:{REF}>>"
    ),
    "Procedure": (
        f"id string, status string, subject {REF}, encounter {REF}, code {CONCEPT}, location {REF}, "
        f"performedPeriod {PERIOD}, performedDateTime string"
    ),
    "Condition": (
        f"id string, subject {REF}, encounter {REF}, asserter {REF}, recordedDate string, code {CONCEPT}, "
        f"category array<{CONCEPT}>"
    ),
    "Observation": (
        f"id string, subject {REF}, encounter {REF}, effectiveDateTime string, issued string, code {CONCEPT}, "
        "valueQuantity struct<value:double,unit:string>"
    ),
    "ImagingStudy": (
        "id string, status string, identifier array<struct<system:string,value:string>>, "
        f"subject {REF}, encounter {REF}, basedOn array<{REF}>, description string, started string, "
        f"numberOfSeries int, numberOfInstances int, modality array<{CODING}>, "
        f"procedureCode array<{CONCEPT}>, reasonCode array<{CONCEPT}>, "
        f"series array<struct<uid:string,number:int,numberOfInstances:int,description:string,"
        f"modality:{CODING},bodySite:{CODING}>>"
    ),
    "DiagnosticReport": (
        f"id string, subject {REF}, encounter {REF}, imagingStudy array<{REF}>, effectiveDateTime string, "
        f"issued string, category array<{CONCEPT}>, "
        "presentedForm array<struct<title:string,data:string,contentType:string,url:string>>"
    ),
    "EpisodeOfCare": (
        f"id string, period {PERIOD}, patient {REF}, extension array<struct<url:string,valueString:string,"
        "valueBoolean:boolean,valueDateTime:string,extension:array<struct<url:string,valueString:string>>>>"
    ),
    "ServiceRequest": (
        "id string, status string, intent string, priority string, authoredOn string, "
        f"subject {REF}, basedOn array<{REF}>, code {CONCEPT}, category array<{CONCEPT}>, "
        "requester struct<extension:array<struct<valueString:string>>>"
    ),
    "MedicationAdministration": (
        f"id string, status string, medicationReference {REF}, subject {REF}, context {REF}, effectiveDateTime string"
    ),
    "Medication": f"id string, code {CONCEPT}",
    "BiologicallyDerivedProduct": (
        f"id string, request array<{REF}>, storage array<struct<duration:struct<end:string>>>, "
        f"extension array<struct<url:string,valueString:string>>, productCode {CONCEPT}"
    ),
}


def parsed(df: DataFrame, resource_type: str) -> DataFrame:
    """The resources of one type as typed columns."""
    rows = df.where(F.col("resource_type") == resource_type)
    return rows.select(F.from_json("resource", SCHEMAS[resource_type]).alias("r")).select("r.*")


def _together(df: DataFrame, **tables: tuple[str, str, list[Column]]) -> list[DataFrame]:
    """Tables of several resource types, taken from ``df`` in one pass and stored.

    A table is named by (type, schema, columns); the columns read the parsed
    resource under the table's name. Without the store each table would read
    and parse all of ``df`` again, and so would whoever reads them twice.
    """
    kind = F.col("resource_type")
    rows = df.where(kind.isin([t for t, _, _ in tables.values()]))
    rows = rows.select(kind, *[F.when(kind == t, F.from_json("resource", schema)).alias(name) for name, (t, schema, _) in tables.items()])
    rows = cut_lineage(rows.select(kind, *[F.when(kind == t, F.struct(*columns)).alias(name) for name, (t, _, columns) in tables.items()]))
    return [rows.where(kind == t).select(f"{name}.*") for name, (t, _, _) in tables.items()]


def _ref(name: str, resource: str) -> Column:
    return strip_ref(F.col(f"{name}.reference"), resource)


def _first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def _codings(concepts: Column) -> Column:
    """Codings of a list of concepts as one list."""
    return F.flatten(F.filter(F.transform(concepts, lambda c: c["coding"]), lambda c: c.isNotNull()))


def _site(urls: dict[str, str] | None):
    return lambda url: (urls or {}).get(url, url)


def flatten_encounter(df: DataFrame) -> DataFrame:
    participant = _first(F.col("participant"))
    role = _first(_codings(participant["type"]))
    kind = _first(_first(F.col("type"))["coding"])
    service = _first(F.col("serviceType.coding"))
    source = _first(F.col("hospitalization.admitSource.coding"))
    disposition = F.col("hospitalization.dischargeDisposition")
    place = _first(_first(disposition["extension"])["extension"])["valueCoding"]
    return parsed(df, "Encounter").select(
        F.col("id").alias("encounter_id"),
        _ref("subject", "Patient").alias("patient_id"),
        "status",
        F.col("class.code").alias("v3_act_code"),
        F.col("class.display").alias("v3_act_code_display"),
        kind["code"].alias("type_code"),
        kind["display"].alias("type_display"),
        service["code"].alias("fachabteilungsschluessel_code"),
        service["display"].alias("fachabteilungsschluessel"),
        role["code"].alias("v3_ParticipantTypeCode_code"),
        role["display"].alias("v3_ParticipantTypeCode_display"),
        participant["individual"]["reference"].alias("practitioner_id"),
        to_utc(F.col("period.start")).alias("start"),
        to_utc(F.col("period.end")).alias("end"),
        source["code"].alias("aufnahmeanlass_code"),
        source["display"].alias("aufnahmeanlass_display"),
        place["code"].alias("discharge_text"),
        place["display"].alias("discharge_place_code"),
        _first(disposition["coding"])["display"].alias("discharge_place_display"),
        F.get(F.col("meta.extension"), F.lit(1))["valueString"].alias("kind"),
    )


def flatten_patient(df: DataFrame) -> DataFrame:
    """One row per patient; all links folded to one list of ids."""
    links = F.transform("link", lambda x: strip_ref(x["other"]["reference"], "Patient"))
    insurance = _first(F.get(F.col("identifier"), F.lit(1))["type"]["coding"])
    rows = parsed(df, "Patient").select(
        F.col("id").alias("patient_id"),
        F.to_date(to_utc(F.col("birthDate"))).alias("birth_date"),
        F.col("gender").alias("sex"),
        insurance["code"].alias("insurance_type"),
        to_utc(F.col("deceasedDateTime")).alias("deceased_date"),
        F.coalesce(F.filter(links, lambda x: x.isNotNull()), F.array().cast("array<string>")).alias("links"),
    )
    return first_rows(rows, ["patient_id"])


def flatten_procedure(df: DataFrame) -> DataFrame:
    return parsed(df, "Procedure").select(
        F.col("id").alias("procedure_id"),
        _ref("subject", "Patient").alias("patient_id"),
        _ref("encounter", "Encounter").alias("encounter_id"),
        safe_get(F.col("code.coding"), "code").alias("code"),
        "status",
        safe_get(F.col("code.coding"), "version").alias("version"),
        safe_get(F.col("code.coding"), "display").alias("display"),
        F.col("performedPeriod.start").alias("effectivedatetimestart_v1"),
        F.col("performedPeriod.end").alias("effectivedatetimeend_v1"),
        F.col("performedDateTime").alias("effectivedatetimestart_v2"),
        F.col("performedDateTime").alias("effectivedatetimeend_v2"),
        _ref("location", "Location").alias("location_id"),
    )


def flatten_condition(df: DataFrame) -> DataFrame:
    categories = _codings(F.col("category"))
    return parsed(df, "Condition").select(
        F.col("id").alias("condition_id"),
        _ref("subject", "Patient").alias("patient_id"),
        _ref("encounter", "Encounter").alias("encounter_id"),
        F.col("asserter.reference").alias("practitioner_id"),
        to_utc(F.col("recordedDate")).alias("condition_date"),
        safe_get(F.col("code.coding"), "code").alias("icd_code"),
        safe_get(F.col("code.coding"), "display").alias("icd_display"),
        safe_get(F.col("code.coding"), "version").alias("icd_version"),
        safe_get(categories, "code").alias("code_diagnosis_type"),
        safe_get(categories, "display").alias("code_diagnosis_display"),
    )


def flatten_observation(df: DataFrame) -> DataFrame:
    return parsed(df, "Observation").select(
        F.col("id").alias("observation_id"),
        to_utc(F.col("effectiveDateTime")).alias("effectivedatetime"),
        to_utc(F.col("issued")).alias("issued"),
        _ref("subject", "Patient").alias("patient_id"),
        _ref("encounter", "Encounter").alias("encounter_id"),
        safe_get(F.col("code.coding"), "code").alias("code"),
        safe_get(F.col("code.coding"), "display").alias("display"),
        F.col("valueQuantity.value").alias("value_quantity"),
        F.col("valueQuantity.unit").alias("value_unit"),
    )


def flatten_imaging_study(df: DataFrame) -> DataFrame:
    """One row per series; studies without a series give no row."""
    uid = _first(F.filter("identifier", lambda i: i["system"] == DICOM_UID))["value"]
    procedure = _first(_codings(F.col("procedureCode")))
    reason = _first(_codings(F.col("reasonCode")))
    studies = parsed(df, "ImagingStudy").select(
        "id",
        "status",
        uid.alias("study_instance_uid"),
        _ref("subject", "Patient").alias("patient_id"),
        _ref("encounter", "Encounter").alias("encounter_id"),
        strip_ref(_first(F.col("basedOn"))["reference"], "ServiceRequest").alias("service_request_id"),
        "description",
        to_utc(F.col("started")).alias("started"),
        F.col("numberOfSeries").alias("number_series"),
        F.col("numberOfInstances").alias("number_instances"),
        safe_get(F.col("modality"), "code").alias("modality_code"),
        safe_get(F.col("modality"), "version").alias("modality_version"),
        procedure["version"].alias("procedure_code_version"),
        procedure["display"].alias("procedure_code_display"),
        procedure["code"].alias("procedure_code"),
        reason["display"].alias("reason_code_display"),
        reason["version"].alias("reason_code_version"),
        F.explode_outer("series").alias("s"),
    )
    return studies.where(F.col("s").isNotNull()).select(
        "*",
        F.col("s.uid").alias("series_instance_uid"),
        F.col("s.number").alias("series_number"),
        F.col("s.numberOfInstances").alias("series_instances"),
        F.col("s.description").alias("series_description"),
        F.col("s.modality.version").alias("series_modality_version"),
        F.col("s.modality.code").alias("series_modality"),
        F.col("s.bodySite.code").alias("series_body_site"),
    ).drop("s")


def flatten_diagnostic_report(df: DataFrame) -> DataFrame:
    """Attachments stay together as one list of (title, data, content_type, url)."""
    categories = _codings(F.col("category"))
    form = F.transform(
        "presentedForm",
        lambda p: F.struct(
            p["title"].alias("title"),
            p["data"].alias("data"),
            p["contentType"].alias("content_type"),
            p["url"].alias("url"),
        ),
    )
    return parsed(df, "DiagnosticReport").select(
        F.col("id").alias("diagnostic_report_id"),
        to_utc(F.col("effectiveDateTime")).alias("effective_datetime"),
        to_utc(F.col("issued")).alias("issued"),
        _ref("subject", "Patient").alias("patient_id"),
        _ref("encounter", "Encounter").alias("encounter_id"),
        strip_ref(_first(F.col("imagingStudy"))["reference"], "ImagingStudy").alias("imaging_study_id"),
        safe_get(categories, "code").alias("category"),
        safe_get(categories, "display").alias("category_display"),
        form.alias("attachments"),
    )


def flatten_episode_of_care(df: DataFrame, urls: dict[str, str] | None = None) -> DataFrame:
    """Episodes with their tumour extensions; ``urls`` maps the example urls to a site's own."""
    extensions, site = F.col("extension"), _site(urls)
    form = extension_value(extension_value(extensions, site(TUMOR_ID), "extension"), site(TUMOR_FORM))
    return parsed(df, "EpisodeOfCare").select(
        "id",
        to_utc(F.col("period.start")).alias("start"),
        to_utc(F.col("period.end")).alias("end"),
        _ref("patient", "Patient").alias("patient_id"),
        extension_value(extensions, site(TUMOR_CERT)).alias("cert"),
        extension_value(extensions, site(TUMOR_PRIMARY), "valueBoolean").alias("primary_case"),
        extension_value(extensions, site(TUMOR_YEAR)).alias("primary_year"),
        extension_value(extensions, site(TUMOR_FIRST_DATE), "valueDateTime").alias("first_diagnosis_date"),
        form.alias("treatment_program"),
    )


def flatten_service_request(df: DataFrame) -> DataFrame:
    categories = _codings(F.col("category"))
    return parsed(df, "ServiceRequest").select(
        "id",
        "status",
        "intent",
        "priority",
        to_utc(F.col("authoredOn")).alias("authored"),
        _ref("subject", "Patient").alias("patient_id"),
        strip_ref(_first(F.col("basedOn"))["reference"], "ServiceRequest").alias("based_service_request_id"),
        safe_get(F.col("code.coding"), "code").alias("code"),
        safe_get(F.col("code.coding"), "display").alias("code_display"),
        safe_get(categories, "code").alias("category_code"),
        safe_get(categories, "display").alias("category_display"),
    )


def join_medication(administrations: DataFrame, medications: DataFrame) -> DataFrame:
    return administrations.dropna(subset=["medication_id"]).join(medications, "medication_id")


def flatten_medication(df: DataFrame) -> DataFrame:
    """Administrations with the name of their medication."""
    given = [
        _ref("given.medicationReference", "Medication").alias("medication_id"),
        _ref("given.subject", "Patient").alias("patient_id"),
        _ref("given.context", "Encounter").alias("encounter_id"),
        F.col("given.status").alias("status"),
        to_utc(F.col("given.effectiveDateTime")).alias("datetime"),
    ]
    names = [F.col("names.id").alias("medication_id"), F.col("names.code.text").alias("medication")]
    given, names = _together(
        df,
        given=("MedicationAdministration", SCHEMAS["MedicationAdministration"], given),
        names=("Medication", "id string, code struct<text:string>", names),
    )
    return join_medication(given, names)


def join_requests(products: DataFrame, requests: DataFrame) -> DataFrame:
    return products.join(requests, "service_request_id", "left")


def flatten_bdp(df: DataFrame, urls: dict[str, str] | None = None) -> DataFrame:
    """Blood products with the patient and the requester of their request.

    ``urls`` maps the example urls to a site's own.
    """
    site = _site(urls)
    kind = code_in_system(F.col("product.productCode.coding"), site(PRODUCT_KIND))
    products = [
        F.col("product.id").alias("bdp_id"),
        extract_id(_first(F.col("product.request"))["reference"]).alias("service_request_id"),
        to_utc(_first(F.col("product.storage"))["duration"]["end"]).alias("ausgabe_datetime"),
        extension_value(F.col("product.extension"), site(PRODUCT_USE)).alias("ausgabe_type"),
        kind["code"].alias("code"),
        kind["display"].alias("display"),
        extension_value(F.col("product.extension"), site(PRODUCT_OUTPUT)).alias("output_to"),
    ]
    extension = F.col("request.requester.extension")
    both = F.size(extension) > 1
    requests = [
        F.col("request.id").alias("service_request_id"),
        _ref("request.subject", "Patient").alias("patient_id"),
        F.when(both, F.get(extension, F.lit(0))["valueString"]).alias("output_to_einskurz"),
        F.when(both, F.get(extension, F.lit(1))["valueString"]).alias("output_to_einscode"),
    ]
    products, requests = _together(
        df,
        product=("BiologicallyDerivedProduct", SCHEMAS["BiologicallyDerivedProduct"], products),
        request=("ServiceRequest", f"id string, subject {REF}, requester struct<extension:array<struct<valueString:string>>>", requests),
    )
    return join_requests(products, requests)


FLATTENERS = {
    "encounter": flatten_encounter,
    "patient": flatten_patient,
    "procedure": flatten_procedure,
    "condition": flatten_condition,
    "observation": flatten_observation,
    "imaging_study": flatten_imaging_study,
    "diagnostic_report": flatten_diagnostic_report,
    "episode_of_care": flatten_episode_of_care,
    "service_request": flatten_service_request,
    "medication": flatten_medication,
    "biologically_derived_product": flatten_bdp,
}


def custom_extract(df: DataFrame, extractor, schema: str, explode: list[str] | None = None) -> DataFrame:
    """Rows of a user extractor ``dict -> list[dict]`` over the resource JSON.

    Runs Arrow batches in the workers, for what ``column_extract`` cannot
    express. ``explode`` turns parallel list columns into rows.
    """
    import json

    import pandas as pd

    def run(batches):
        for batch in batches:
            rows = [row for text in batch["resource"] for row in extractor(json.loads(text))]
            yield pd.DataFrame(rows)

    return _exploded(df.select("resource").mapInPandas(run, schema), explode)


def column_extract(
    df: DataFrame, resource_type: str, schema: str, columns: dict[str, str], explode: list[str] | None = None
) -> DataFrame:
    """A table of one's own by SQL expressions: column name to an expression over the parsed resource ``r``.

    ``schema`` declares the fields of the resource that are read. Nothing
    leaves the JVM, and only the folder of the type is read of a landing.
    """
    rows = df.where(F.col("resource_type") == resource_type).select(F.from_json("resource", schema).alias("r"))
    return _exploded(rows.select(*[F.expr(x).alias(name) for name, x in columns.items()]), explode)


def _exploded(out: DataFrame, explode: list[str] | None) -> DataFrame:
    if not explode:
        return out
    zipped = out.withColumn("_z", F.explode(F.arrays_zip(*explode)))
    return zipped.select(*[F.col(f"_z.{c}").alias(c) if c in explode else F.col(c) for c in out.columns])
