"""Source checks (SRC-01..15): views to JSON, read back and flattened."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.views import list_sql, ts_sql, with_views
from wardline.functions.codes import category_name
from wardline.operators import cohort as C
from wardline.operators import links as K
from wardline.operators import validate as V
from wardline.session import scratch_path
from wardline.sources import bundles as B
from wardline.sources import documents as D
from wardline.sources import flatten as X

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"


def iso(col):
    return f'date_format({col}, "{ISO}")'


def concept(code, display="null", version="null", system="null"):
    return (
        f"named_struct('coding', array(named_struct('system', {system}, 'version', {version}, 'code', {code},"
        f" 'display', {display})))"
    )


def ref(kind, col):
    return f"named_struct('reference', concat('{kind}/', {col}))"


def bundled(df, **fields):
    """Each row as a bundle with one resource; read back as tagged resources."""
    body = ", ".join(f"'{k}', {x}" for k, x in fields.items())
    text = f"to_json(named_struct('resourceType', 'Bundle', 'entry', array(named_struct('resource', named_struct({body})))))"
    return B.read_bundles(df.selectExpr(f"{text} as value"))


def encounter_resources(v):
    return bundled(
        v.encounter,
        resourceType="'Encounter'",
        id="encounter_id",
        status="status",
        **{"class": "named_struct('code', v3_act_code)"},
        type=f"array({concept('type_code', 'type_display')})",
        serviceType=concept("'S'", "fachabteilungsschluessel"),
        subject=ref("Patient", "patient_id"),
        period=f"named_struct('start', {iso('start')}, 'end', {iso('end')})",
        participant="array(named_struct('type', array("
        + concept("'ATND'", "'attender'")
        + "), 'individual', named_struct('reference', concat('Practitioner/', type_code))))",
        hospitalization="named_struct('admitSource', "
        + concept("'A'", "aufnahmeanlass_display")
        + ", 'dischargeDisposition', named_struct('coding', array(named_struct('display', type_display)), 'extension', array(named_struct('extension',"
        " array(named_struct('valueCoding', named_struct('code', type_code, 'display', status)))))))",
        meta="named_struct('extension', array(named_struct('valueString', 'x'), named_struct('valueString', status)))",
    )


@check(
    "src01_read_bundles",
    """SELECT 'Encounter' AS resource_type, count(*) AS n FROM orders UNION ALL SELECT 'Patient', count(*) FROM customer
  UNION ALL SELECT 'Medication', count(*) FROM customer""",
)
def _(v):
    rows = v.raw("customer").selectExpr(
        "to_json(named_struct('resourceType', 'Bundle', 'entry', array(named_struct('resource', named_struct('resourceType',"
        " 'Patient', 'id', cast(c_custkey as string))), named_struct('resource', named_struct('resourceType', 'Medication', 'id', c_name))))) as value"
    )
    empty = v.raw("customer").selectExpr("to_json(named_struct('resourceType', 'Bundle')) as value")
    path = scratch_path(v.spark, "bundles")
    rows.unionByName(empty).write.text(path)
    both = B.read_bundle_files(v.spark, path).unionByName(encounter_resources(v))
    return both.groupBy("resource_type").agg(F.count("*").alias("n"))


_LINE = """'{"resourceType":"Bundle","entry":[{"resource":{"resourceType":"Patient","id":"' || c_custkey || '"}},{"resource":{"id":"' || c_name || '"}}]}'"""


@check(
    "src01_rejected_bundles",
    f"""WITH lines AS (SELECT c_custkey AS k, c_name, {_LINE} AS line FROM customer)
  SELECT md5(CASE k % 8 WHEN 1 THEN left(line, length(line) - 7) WHEN 2 THEN 'no json ' || k WHEN 3 THEN '{{"resourceType":"Patient","id":"' || k || '"}}' ELSE '' END) AS content,
    CASE k % 8 WHEN 3 THEN 'not a bundle' WHEN 4 THEN 'empty line' ELSE 'not a JSON object of a bundle''s form' END AS outcome FROM lines WHERE k % 8 IN (1, 2, 3, 4)
  UNION ALL SELECT md5('{{"id":"' || c_name || '"}}'), 'resource without a type' FROM lines WHERE k % 8 NOT IN (1, 2, 3, 4)
  UNION ALL SELECT k::VARCHAR, 'Patient' FROM lines WHERE k % 8 NOT IN (1, 2, 3, 4)""",
)
def _(v):
    lines = v.raw("customer").selectExpr("c_custkey as k", f"{_LINE} as line").selectExpr(
        "case k % 8 when 1 then left(line, length(line) - 7) when 2 then 'no json ' || k when 3 then '{\"resourceType\":\"Patient\",\"id\":\"' || k || '\"}' when 4 then '' else line end as value"
    )
    landing, files = scratch_path(v.spark, "landing"), scratch_path(v.spark, "bundles")
    lines.write.text(files)
    B.land_bundles(v.spark.read.text(files), landing)
    rejects = B.rejected(v.spark, landing).select(F.md5("raw").alias("content"), F.col("reason").alias("outcome"))
    return rejects.union(X.flatten_patient(B.landed(v.spark, landing)).select("patient_id", F.lit("Patient")))


@check(
    "src02_flatten_encounter",
    with_views("encounter")
    + f"""SELECT encounter_id, patient_id, status, v3_act_code, NULL::VARCHAR AS v3_act_code_display, type_code, type_display,
  'S' AS fachabteilungsschluessel_code, fachabteilungsschluessel, 'ATND' AS "v3_ParticipantTypeCode_code",
  'attender' AS "v3_ParticipantTypeCode_display", 'Practitioner/' || type_code AS practitioner_id, {ts_sql('start')} AS start,
  {ts_sql('"end"')} AS "end", 'A' AS aufnahmeanlass_code, aufnahmeanlass_display, type_code AS discharge_text,
  status AS discharge_place_code, type_display AS discharge_place_display, status AS kind FROM encounter""",
)
def _(v):
    return X.flatten_encounter(encounter_resources(v))


@check(
    "src03_flatten_patient",
    with_views("initial_patient")
    + f"""SELECT patient_id, birth_date::VARCHAR AS birth_date, sex, insurance_type, {ts_sql('deceased_date')} AS deceased_date,
  {list_sql('links')} AS links FROM initial_patient""",
)
def _(v):
    df = bundled(
        v.initial_patient,
        resourceType="'Patient'",
        id="patient_id",
        birthDate="date_format(birth_date, 'yyyy-MM-dd')",
        gender="sex",
        deceasedDateTime=iso("deceased_date"),
        identifier=f"array(named_struct('type', {concept('patient_id')}), named_struct('type', {concept('insurance_type')}))",
        link=f"transform(links, x -> named_struct('other', {ref('Patient', 'x')}))",
    )
    return X.flatten_patient(df)


@check(
    "src04_flatten_procedure",
    with_views("procedure_t")
    + f"""SELECT procedure_id, patient_id, encounter_id, code || ',extra' AS code, status, 'v1,v2' AS version, display || ',more' AS display,
  strftime(start, '%Y-%m-%dT%H:%M:%S.000Z') AS effectivedatetimestart_v1, strftime("end", '%Y-%m-%dT%H:%M:%S.000Z') AS effectivedatetimeend_v1,
  NULL::VARCHAR AS effectivedatetimestart_v2, NULL::VARCHAR AS effectivedatetimeend_v2, 'L1' AS location_id FROM procedure_t""",
)
def _(v):
    df = bundled(
        v.procedure,
        resourceType="'Procedure'",
        id="procedure_id",
        status="status",
        subject=ref("Patient", "patient_id"),
        encounter=ref("Encounter", "encounter_id"),
        code="named_struct('coding', array(named_struct('version', 'v1', 'code', code, 'display', display),"
        " named_struct('version', 'v2', 'code', 'extra', 'display', 'more')))",
        location=ref("Location", "'L1'"),
        performedPeriod=f"named_struct('start', {iso('start')}, 'end', {iso('end')})",
    )
    return X.flatten_procedure(df)


def condition_resources(v):
    return bundled(
        v.condition,
        resourceType="'Condition'",
        id="condition_id",
        subject=ref("Patient", "patient_id"),
        encounter=ref("Encounter", "encounter_id"),
        asserter=ref("Practitioner", "icd_version"),
        recordedDate=iso("condition_date"),
        code=concept("icd_code", "icd_display", "icd_version"),
        category=f"array({concept('code_diagnosis_type', chr(39) + 'd' + chr(39))})",
    )


@check(
    "src05_flatten_condition",
    with_views("condition")
    + f"""SELECT condition_id, patient_id, encounter_id, 'Practitioner/' || icd_version AS practitioner_id, {ts_sql('condition_date')} AS condition_date,
  icd_code, coalesce(icd_display, 'NULL') AS icd_display, icd_version, code_diagnosis_type, 'd' AS code_diagnosis_display FROM condition""",
)
def _(v):
    return X.flatten_condition(condition_resources(v))


def observation_resources(v):
    return bundled(
        v.observation,
        resourceType="'Observation'",
        id="observation_id",
        subject=ref("Patient", "patient_id"),
        effectiveDateTime=iso("effectivedatetime"),
        issued=iso("effectivedatetime + interval 1 hour"),
        code=concept("code", "display"),
        valueQuantity="named_struct('value', value_quantity, 'unit', value_unit)",
    )


@check(
    "src06_flatten_observation",
    with_views("observation")
    + f"""SELECT observation_id, {ts_sql('effectivedatetime')} AS effectivedatetime, {ts_sql('effectivedatetime + INTERVAL 1 HOUR')} AS issued,
  patient_id, NULL::VARCHAR AS encounter_id, code, display, round(value_quantity, 6) AS value_quantity, value_unit FROM observation""",
)
def _(v):
    return X.flatten_observation(observation_resources(v))


def imaging_resources(v):
    series = (
        "named_struct('uid', concat(imaging_study_id, '.{n}'), 'number', {n}, 'numberOfInstances', 10, 'description', description,"
        " 'modality', named_struct('code', modality_code), 'bodySite', named_struct('code', 'B{n}'))"
    )
    return bundled(
        v.imaging_study,
        resourceType="'ImagingStudy'",
        id="imaging_study_id",
        status="'available'",
        identifier="array(named_struct('system', 'other', 'value', 'x'), named_struct('system', 'urn:dicom:uid', 'value', concat('uid-', imaging_study_id)))",
        subject=ref("Patient", "patient_id"),
        encounter=ref("Encounter", "encounter_id"),
        basedOn=f"array({ref('ServiceRequest', 'encounter_id')})",
        description="description",
        started=iso("started"),
        numberOfSeries="2",
        modality="array(named_struct('code', modality_code))",
        procedureCode=f"array({concept('procedure_code', 'description')})",
        series="case when modality_code = 'KO' then array() else array(" + series.format(n=1) + ", " + series.format(n=2) + ") end",
    )


@check(
    "src07_flatten_imaging_study",
    with_views("imaging_study")
    + f"""SELECT imaging_study_id AS id, 'available' AS status, 'uid-' || imaging_study_id AS study_instance_uid, patient_id, encounter_id,
  encounter_id AS service_request_id, description, {ts_sql('started')} AS started, 2 AS number_series, NULL::INT AS number_instances,
  modality_code, 'NULL' AS modality_version, NULL::VARCHAR AS procedure_code_version, description AS procedure_code_display, procedure_code,
  NULL::VARCHAR AS reason_code_display, NULL::VARCHAR AS reason_code_version, imaging_study_id || '.' || n AS series_instance_uid, n AS series_number,
  10 AS series_instances, description AS series_description, NULL::VARCHAR AS series_modality_version, modality_code AS series_modality,
  'B' || n AS series_body_site FROM imaging_study, (SELECT unnest([1, 2]) AS n) WHERE modality_code <> 'KO'""",
)
def _(v):
    return X.flatten_imaging_study(imaging_resources(v))


def report_resources(v):
    forms = (
        "case int(diagnostic_report_id) % 4 when 0 then array(named_struct('title', title, 'data', base64(encode(text, 'UTF-8')), 'contentType', 'text/plain', 'url', null))"
        " when 1 then array(named_struct('title', title, 'data', null, 'contentType', 'application/pdf', 'url', 'u/pdf'),"
        " named_struct('title', title, 'data', null, 'contentType', 'application/msword', 'url', 'u/word'))"
        " when 2 then array(named_struct('title', title, 'data', null, 'contentType', 'image/png', 'url', 'u/png')) end"
    )
    return bundled(
        v.diagnostic_report,
        resourceType="'DiagnosticReport'",
        id="diagnostic_report_id",
        subject=ref("Patient", "patient_id"),
        encounter=ref("Encounter", "encounter_id"),
        issued=iso("date"),
        category="array(named_struct('coding', array(named_struct('code', 'c', 'display', 'Lab report'), named_struct('code', 'b', 'display', category_display))))",
        presentedForm=forms,
    )


@check(
    "src08_flatten_diagnostic_report",
    with_views("diagnostic_report")
    + f"""SELECT diagnostic_report_id, NULL::VARCHAR AS effective_datetime, {ts_sql('date')} AS issued, patient_id, encounter_id,
  NULL::VARCHAR AS imaging_study_id, 'c,b' AS category, 'Lab report,' || category_display AS category_display,
  CASE diagnostic_report_id::INT % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS forms FROM diagnostic_report""",
)
def _(v):
    flat = X.flatten_diagnostic_report(report_resources(v))
    return flat.withColumn("forms", F.coalesce(F.size("attachments"), F.lit(0))).drop("attachments")


def episode_resources(v):
    ext = (
        f"filter(array(named_struct('url', '{X.TUMOR_CERT}', 'valueString', cert, 'valueBoolean', cast(null as boolean), 'valueDateTime', cast(null as string), 'extension', cast(null as array<struct<url:string,valueString:string>>)),"
        f" named_struct('url', '{X.TUMOR_PRIMARY}', 'valueString', null, 'valueBoolean', primary_case, 'valueDateTime', null, 'extension', null),"
        f" named_struct('url', '{X.TUMOR_YEAR}', 'valueString', primary_year, 'valueBoolean', null, 'valueDateTime', null, 'extension', null),"
        f" named_struct('url', '{X.TUMOR_FIRST_DATE}', 'valueString', null, 'valueBoolean', null, 'valueDateTime', first_diagnosis_date, 'extension', null),"
        f" named_struct('url', '{X.TUMOR_ID}', 'valueString', null, 'valueBoolean', null, 'valueDateTime', null, 'extension',"
        f" array(named_struct('url', 'x', 'valueString', 'y'), named_struct('url', '{X.TUMOR_FORM}', 'valueString', treatment_program)))), e -> true)"
    )
    form = "case treatment_program when 'Magen-Darm Tumoren' then 'DCP01BASIS' when 'Hauttumoren' then 'DCP08BASIS' when 'Augentumoren' then 'DCP11BASIS' end"
    return bundled(
        v.episode_of_care.selectExpr("* except (treatment_program)", f"{form} as treatment_program"),
        resourceType="'EpisodeOfCare'",
        id="id",
        period=f"named_struct('start', {iso('start')})",
        patient=ref("Patient", "patient_id"),
        extension=ext,
    )


EPISODE = f"""SELECT id, {ts_sql('start')} AS start, NULL::VARCHAR AS "end", patient_id, cert, primary_case, primary_year, first_diagnosis_date,
  CASE treatment_program WHEN 'Magen-Darm Tumoren' THEN 'DCP01BASIS' WHEN 'Hauttumoren' THEN 'DCP08BASIS' WHEN 'Augentumoren' THEN 'DCP11BASIS' END
  AS treatment_program FROM episode_of_care"""


@check("src09_flatten_episode_of_care", with_views("episode_of_care") + EPISODE)
def _(v):
    return X.flatten_episode_of_care(episode_resources(v))


def request_resources(v):
    return bundled(
        v.service_request,
        resourceType="'ServiceRequest'",
        id="id",
        status="status",
        intent="'order'",
        priority="'routine'",
        authoredOn=iso("authored"),
        subject=ref("Patient", "patient_id"),
        basedOn=f"array({ref('ServiceRequest', 'id')})",
        code=concept("'k'", "code_display"),
        category=f"array({concept('substr(category_display, 1, 1)', 'category_display')})",
        requester="named_struct('extension', array(named_struct('valueString', category_display), named_struct('valueString', status)))",
    )


@check(
    "src10_flatten_service_request",
    with_views("service_request")
    + f"""SELECT id, status, 'order' AS intent, 'routine' AS priority, {ts_sql('authored')} AS authored, patient_id, id AS based_service_request_id,
  'k' AS code, code_display, substr(category_display, 1, 1) AS category_code, category_display FROM service_request""",
)
def _(v):
    return X.flatten_service_request(request_resources(v))


@check(
    "src11_flatten_medication",
    with_views("medication")
    + f"SELECT medication_id, medication, patient_id, encounter_id, status, {ts_sql('datetime')} AS datetime FROM medication",
)
def _(v):
    given = bundled(
        v.medication,
        resourceType="'MedicationAdministration'",
        status="status",
        medicationReference=ref("Medication", "medication_id"),
        subject=ref("Patient", "patient_id"),
        context=ref("Encounter", "encounter_id"),
        effectiveDateTime=iso("datetime"),
    )
    names = bundled(
        v.raw("part"), resourceType="'Medication'", id="cast(p_partkey as string)", code="named_struct('text', p_name)"
    )
    return X.flatten_medication(given.unionByName(names))


def product_resources(v):
    products = bundled(
        v.biologically_derived_product,
        resourceType="'BiologicallyDerivedProduct'",
        id="bdp_id",
        request=f"array({ref('ServiceRequest', 'service_request_id')})",
        storage=f"array(named_struct('duration', named_struct('end', {iso('ausgabe_datetime')})))",
        extension=f"array(named_struct('url', '{X.PRODUCT_OUTPUT}', 'valueString', output_to_einskurz), named_struct('url', '{X.PRODUCT_USE}', 'valueString', ausgabe_type))",
        productCode=f"named_struct('coding', array(named_struct('system', 'x', 'code', 'y', 'display', 'z'), named_struct('system', '{X.PRODUCT_KIND}', 'code', code, 'display', display)))",
    )
    return products.unionByName(request_resources(v))


PRODUCTS = """SELECT bdp_id, service_request_id, ausgabe_datetime, ausgabe_type, code, display, output_to_einskurz AS output_to,
  o_custkey::VARCHAR AS patient_id, o_orderpriority AS output_to_einskurz,
  CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'completed' ELSE 'revoked' END AS output_to_einscode
  FROM bdp JOIN orders ON o_orderkey::VARCHAR = service_request_id"""


@check(
    "src12_flatten_bdp",
    with_views("bdp", more={"p": PRODUCTS}) + f"SELECT * REPLACE ({ts_sql('ausgabe_datetime')} AS ausgabe_datetime) FROM p",
)
def _(v):
    return X.flatten_bdp(product_resources(v))


DECODED = """SELECT diagnostic_report_id, CASE diagnostic_report_id::INT % 4 WHEN 0 THEN text END AS text,
  CASE diagnostic_report_id::INT % 4 WHEN 1 THEN 'u/word' END AS url, CASE diagnostic_report_id::INT % 4 WHEN 1 THEN 'application/msword' END AS content_type,
  category_display AS category_name, diagnostic_report_id::INT % 4 IN (2, 3) AS failed FROM diagnostic_report"""


@check("src13_decode_attachments", with_views("diagnostic_report") + f"SELECT * REPLACE (md5(text) AS text) FROM ({DECODED})")
def _(v):
    out = D.decode_attachments(X.flatten_diagnostic_report(report_resources(v)))
    return out.select("diagnostic_report_id", F.md5("text").alias("text"), "url", "content_type", "category_name", "failed")


@check(
    "src14_category_name",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN source WHEN 2 THEN 'Lab_report' ELSE 'unknown' END AS category FROM documents""",
)
def _(v):
    xs = F.expr(
        "case doc_id % 4 when 0 then array(source) when 1 then array('Lab report', source) when 2 then array('Lab report')"
        " else cast(array() as array<string>) end"
    )
    return v.raw("documents").select("doc_id", category_name(xs).alias("category"))


@check(
    "src15_write_documents",
    with_views("diagnostic_report")
    + "SELECT diagnostic_report_id, category_display AS category, md5(text) AS text FROM diagnostic_report WHERE diagnostic_report_id::INT % 4 = 0",
)
def _(v):
    path = scratch_path(v.spark, "documents")
    D.write_documents(D.decode_attachments(X.flatten_diagnostic_report(report_resources(v))), path)
    return v.spark.read.parquet(path).select("diagnostic_report_id", "category", F.md5("text").alias("text"))


# Cohorts over linked ids: customers with key % 10 = 1 are named by the key before them.
LINK = "CASE WHEN c_custkey % 10 = 0 THEN c_custkey || ',' || (c_custkey + 1) WHEN c_custkey % 10 = 1 THEN (c_custkey - 1) || ',' || c_custkey ELSE c_custkey::VARCHAR END"
DIM = f"SELECT c_custkey::VARCHAR AS patient_id, {LINK} AS linked FROM customer"


def dim(v):
    return v.initial_patient.drop("links").withColumn(
        "linked_patient_id",
        F.expr(
            "case when int(patient_id) % 10 = 0 then concat(patient_id, ',', int(patient_id) + 1)"
            " when int(patient_id) % 10 = 1 then concat(int(patient_id) - 1, ',', patient_id) else patient_id end"
        ),
    )


@check(
    "cf01_build_encounters",
    with_views("encounter")
    + f"""SELECT encounter_id, patient_id, type_code AS practitioner_id, {ts_sql('start')} AS start FROM encounter WHERE "end" - start > INTERVAL 2 DAY""",
)
def _(v):
    raw = X.flatten_encounter(encounter_resources(v))
    return C.build_encounters(raw).select("encounter_id", "patient_id", "practitioner_id", "start")


NOW = "1997-06-15 12:00:00"


@check(
    "cf02_encounter_cohort_live",
    with_views("encounter", more={"dim": DIM})
    + f"""SELECT linked AS patient_id, encounter_id, e.patient_id AS original_patient_id FROM encounter e JOIN dim USING (patient_id)
  WHERE start <= TIMESTAMP '{NOW}' AND "end" >= TIMESTAMP '{NOW}'
  QUALIFY row_number() OVER (PARTITION BY linked ORDER BY start DESC, encounter_id DESC) = 1""",
)
def _(v):
    out = C.encounter_cohort(v.encounter, dim(v), F.lit(NOW).cast("timestamp"))
    return out.select("patient_id", "encounter_id", "original_patient_id")


@check(
    "cf03_patient_cohort",
    with_views("initial_patient", more={"dim": DIM})
    + """SELECT linked AS patient_id, sex, CASE insurance_type WHEN 'PKV' THEN 'privat' WHEN 'GKV' THEN 'gesetzlich' ELSE 'unbekannt' END AS insurance_type
  FROM initial_patient JOIN dim USING (patient_id) QUALIFY row_number() OVER (PARTITION BY linked ORDER BY patient_id) = 1""",
)
def _(v):
    return C.patient_cohort(dim(v)).select("patient_id", "sex", "insurance_type")


@check(
    "cf04_condition_cohort",
    with_views("condition", more={"dim": DIM})
    + """SELECT linked AS patient_id, icd_code, code_diagnosis_type, code_diagnosis_display, count(*) AS n FROM (SELECT *, 'd' AS code_diagnosis_display FROM condition)
  JOIN dim USING (patient_id) GROUP BY ALL""",
)
def _(v):
    out = C.condition_cohort(X.flatten_condition(condition_resources(v)), dim(v))
    keys = ["patient_id", "icd_code", "code_diagnosis_type", "code_diagnosis_display"]
    return out.groupBy(*keys).agg(F.count("*").alias("n"))


@check(
    "cf05_procedure_cohort",
    with_views("procedure_t", more={"dim": DIM})
    + f"""SELECT linked AS patient_id, procedure_id, code, status, {ts_sql('start')} AS start, {ts_sql('"end"')} AS "end" FROM procedure_t JOIN dim USING (patient_id)
  WHERE status IN ('completed', 'in-progress', 'preparation')""",
)
def _(v):
    raw = v.procedure.selectExpr(
        "procedure_id", "patient_id", "encounter_id", "code", "status", "cast(null as string) as version", "display",
        f"{iso('start')} as effectivedatetimestart_v1", f"{iso('end')} as effectivedatetimeend_v1",
        "cast(null as string) as effectivedatetimestart_v2", "cast(null as string) as effectivedatetimeend_v2",
        "cast(null as string) as location_id",
    )
    out = C.procedure_cohort(raw, dim(v))
    return out.select("patient_id", "procedure_id", "code", "status", "start", "end")


@check(
    "cf06_imaging_cohort",
    with_views("imaging_study")
    + """SELECT imaging_study_id, min(imaging_study_id || '.1') AS series_instance_uid FROM imaging_study WHERE modality_code <> 'KO' GROUP BY 1""",
)
def _(v):
    series = X.flatten_imaging_study(imaging_resources(v))
    return C.imaging_cohort(series, dim(v)).select("imaging_study_id", "series_instance_uid")


@check(
    "cf07_observation_cohort",
    with_views("observation", more={"dim": DIM})
    + "SELECT linked AS patient_id, observation_id, code, display FROM observation JOIN dim USING (patient_id) WHERE value_quantity IS NOT NULL AND value_unit IS NOT NULL",
)
def _(v):
    out = C.observation_cohort(X.flatten_observation(observation_resources(v)), dim(v))
    return out.select("patient_id", "observation_id", "code", "display")


@check(
    "cf08_episode_cohort",
    with_views("episode_of_care", more={"dim": DIM})
    + "SELECT linked AS patient_id, id, treatment_program FROM episode_of_care JOIN dim USING (patient_id)",
)
def _(v):
    out = C.episode_cohort(X.flatten_episode_of_care(episode_resources(v)), dim(v))
    return out.select("patient_id", "id", "treatment_program")


@check(
    "cf09_request_cohort",
    with_views("service_request", more={"dim": DIM})
    + """SELECT linked AS patient_id, id, status, substr(category_display, 1, 1) AS category_code, category_display FROM service_request
  JOIN dim USING (patient_id) WHERE status IN ('active', 'completed', 'draft', 'unknown')""",
)
def _(v):
    out = C.request_cohort(X.flatten_service_request(request_resources(v)), dim(v))
    return out.select("patient_id", "id", "status", "category_code", "category_display")


@check(
    "cf10_report_cohort",
    with_views("diagnostic_report", more={"dim": DIM})
    + f"""SELECT linked AS patient_id, diagnostic_report_id, {ts_sql('date')} AS date, 'b' AS category,
  CASE WHEN diagnostic_report_id::INT % 4 < 3 THEN title END AS title, 'Lab report,' || category_display AS original_category_display,
  CASE diagnostic_report_id::INT % 4 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'application/msword' WHEN 2 THEN 'image/png' END AS content_type
  FROM diagnostic_report JOIN dim USING (patient_id)""",
)
def _(v):
    out = C.report_cohort(X.flatten_diagnostic_report(report_resources(v)), dim(v))
    return out.select("patient_id", "diagnostic_report_id", "date", "category", "title", "original_category_display", "content_type")


@check(
    "cf11_product_cohort",
    with_views("bdp", more={"dim": DIM, "p": PRODUCTS})
    + f"""SELECT bdp_id, service_request_id, {ts_sql('min(ausgabe_datetime)')} AS ausgabe_datetime FROM p WHERE ausgabe_type = 'AUSGABE' GROUP BY 1, 2""",
)
def _(v):
    out = C.product_cohort(X.flatten_bdp(product_resources(v)), dim(v))
    return out.select("bdp_id", "service_request_id", "ausgabe_datetime")


@check(
    "cf12_medication_cohort",
    with_views("medication", more={"dim": DIM})
    + "SELECT linked AS patient_id, medication, count(*) AS n FROM medication JOIN dim USING (patient_id) GROUP BY 1, 2",
)
def _(v):
    out = C.medication_cohort(v.medication, dim(v))
    return out.groupBy("patient_id", "medication").agg(F.count("*").alias("n"))


@check(
    "cf13_validate",
    with_views("condition", "encounter", "patient", "procedure_t", "observation", "imaging_study", "medication", "bdp", "service_request", "episode_of_care", "diagnostic_report")
    + " UNION ALL ".join(
        f"SELECT '{r}' AS resource, '{c}' AS column_name, '{lvl}' AS level, count_if({c} IS NULL) AS nulls, count(*) AS rows FROM {t}"
        for r, t, c, lvl in (
            ("condition", "condition", "patient_id", "error"),
            ("condition", "condition", "icd_code", "error"),
            ("encounter", "encounter", "patient_id", "error"),
            ("biologically_derived_product", "bdp", "ausgabe_datetime", "warning"),
            ("patient", "patient", "patient_id", "error"),
            ("procedure", "procedure_t", "patient_id", "warning"),
            ("observation", "observation", "patient_id", "error"),
            ("observation", "observation", "value_quantity", "error"),
            ("imaging_study", "imaging_study", "patient_id", "error"),
            ("episode_of_care", "episode_of_care", "patient_id", "error"),
            ("service_request", "service_request", "patient_id", "error"),
            ("diagnostic_report", "diagnostic_report", "patient_id", "error"),
            ("medication", "medication", "patient_id", "error"),
        )
    ),
)
def _(v):
    return V.validate(v.tables)


@check(
    "so05_cohort_patients",
    f"""WITH dim AS ({DIM}), seen AS (SELECT DISTINCT linked FROM dim WHERE patient_id IN (SELECT o_custkey::VARCHAR FROM orders))
  SELECT patient_id, linked AS linked_patient_id FROM dim WHERE linked IN (SELECT linked FROM seen)""",
)
def _(v):
    return K.cohort_patients(dim(v), v.encounter).select("patient_id", "linked_patient_id")


@check("ud01_custom_extract", "SELECT o_orderkey::VARCHAR AS id, n AS part FROM orders, (SELECT unnest([1, 2]) AS n)")
def _(v):
    def extractor(resource):
        return [{"id": resource["id"], "part": [1, 2]}]

    return X.custom_extract(encounter_resources(v), extractor, "id string, part array<int>", explode=["part"])


@check(
    "ud01_column_extract",
    with_views("encounter")
    + """SELECT encounter_id AS id, status, 'Practitioner/' || type_code AS person, 'ATND' AS role FROM encounter""",
)
def _(v):
    fields = "id string, status string, participant array<struct<type:array<struct<coding:array<struct<code:string>>>>,individual:struct<reference:string>>>"
    columns = {
        "id": "r.id",
        "person": "transform(r.participant, p -> p.individual.reference)",
        "status": "r.status",
        "role": "transform(r.participant, p -> p.type[0].coding[0].code)",
    }
    return X.column_extract(encounter_resources(v), "Encounter", fields, columns, explode=["person", "role"])
