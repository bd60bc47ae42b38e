"""Sample builder checks (TB-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.views import list_sql, ts_sql, with_views
from wardline.plans import tasks as T

# Printed line of each resource, as SQL: source view, time, unique key, cells.
LINES = {
    "condition": ("condition", "condition_date", "condition_id", ["icd_code", "icd_display"]),
    "procedure": ("procedure_t", "start", "procedure_id", ["code", "display"]),
    "imaging_study": ("imaging_study", "started", "imaging_study_id", ["description", "procedure_code"]),
    "biologically_derived_product": ("bdp", "ausgabe_datetime", None, ["output_to_einskurz", "display"]),
    "observation": ("observation", "effectivedatetime", None, ["display", "value_quantity::VARCHAR", "value_unit"]),
    "service_request": ("service_request", "authored", None, ["code_display", "category_display"]),
    "medication": ("medication", "datetime", None, ["medication", "status"]),
    "episode_of_care": (
        "episode_of_care",
        "start",
        None,
        ["cert", "CASE WHEN primary_case THEN 'True' ELSE 'False' END", "primary_year", "first_diagnosis_date", "treatment_program"],
    ),
    "diagnostic_report": ("diagnostic_report", "date", None, ["category_display", "title"]),
}
IMAGE = {**LINES, "imaging_study": ("imaging_study", "started", "imaging_study_id", ["description", "modality_code", "procedure_code"])}

def timeline_sql(resources, lines=LINES) -> str:
    parts = []
    for name in resources:
        view, time, key, cells = lines[name]
        version = "icd_version" if name == "condition" else "NULL::VARCHAR"
        line = f"concat_ws(', ', {', '.join(cells)})"
        # copies of one record id: the first by time, line and version
        order = f"{time}, {line}, {version}"
        dedup = f" QUALIFY row_number() OVER (PARTITION BY patient_id, {key} ORDER BY {order}) = 1" if key else ""
        parts.append(
            f"SELECT patient_id, {time} AS ts, '{name}' AS resource, {line} AS line, "
            f"{version} AS icd_version FROM {view} WHERE {time} IS NOT NULL{dedup}"
        )
    return " UNION ALL ".join(parts)


STAYS = """SELECT e.*, date_diff('microsecond', start, "end") // 86400000000 AS duration, birth_date, sex, insurance_type, deceased_date,
  'Patient metadata:' || chr(10) || 'age' || chr(9) || ((date_diff('microsecond', birth_date::TIMESTAMP, start) // 86400000000) // 365) || chr(10)
  || 'gender' || chr(9) || sex || chr(10) || 'insurance_type' || chr(9) || insurance_type || chr(10) || chr(10) || 'Encounter:' || chr(10)
  || concat_ws(chr(10), 'Beginn' || chr(9) || strftime(start, '%Y-%m-%d %H:%M:%S') || '+00:00', 'Kontakt Art' || chr(9) || type_display,
     'Art' || chr(9) || v3_act_code, 'Fachabteilungsschlüssel' || chr(9) || fachabteilungsschluessel,
     'Aufnahmeanlass' || chr(9) || aufnahmeanlass_display) || chr(10) || chr(10) AS head
  FROM encounter e JOIN patient USING (patient_id)"""

RESOURCE_VIEWS = [v[0] for v in LINES.values()]


def history_sql(where: str, cuts: str = "cuts") -> dict[str, str]:
    """Baseline: every (cut, record) pair, then two levels of aggregation."""
    return {
        "pairs": f"""SELECT c.patient_id, c.encounter_id, c.cut, t.ts, t.resource, t.line, t.icd_version
  FROM {cuts} c JOIN tl t ON t.patient_id = c.patient_id AND {where}""",
        "lined": """SELECT patient_id, encounter_id, cut, ts::DATE AS day, resource, line, count(*) AS n, min(ts) AS first_ts
  FROM pairs GROUP BY ALL""",
        "blocked": """SELECT patient_id, encounter_id, cut, day, resource, strftime(day, '%Y-%m-%d') || ':' || chr(10) ||
  string_agg(CASE WHEN n > 1 THEN n || 'x ' ELSE '' END || line, chr(10) ORDER BY first_ts, line) AS block
  FROM lined GROUP BY 1,2,3,4,5""",
        "history": """SELECT patient_id, encounter_id, cut, string_agg(block, chr(10) ORDER BY day DESC, resource DESC) AS hist
  FROM blocked GROUP BY 1,2,3""",
        "version": """SELECT patient_id, encounter_id, cut, max({'ts': ts, 'v': icd_version}).v AS icd
  FROM pairs WHERE resource = 'condition' GROUP BY 1,2,3""",
        "told": f"""SELECT c.*, h.hist, coalesce(v.icd, 'unknown') AS icd FROM {cuts} c
  JOIN history h USING (patient_id, encounter_id, cut) LEFT JOIN version v USING (patient_id, encounter_id, cut)""",
    }


NL = "chr(10)"
DAILY = """SELECT s.*, unnest(generate_series(start + INTERVAL 1 DAY, "end" - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS cut
  FROM stays s WHERE duration > 2"""
UNCHANGED = """SELECT * FROM told WINDOW w AS (PARTITION BY patient_id, encounter_id ORDER BY cut)
  QUALIFY lag(hist) OVER w IS DISTINCT FROM hist OR lag(labels) OVER w IS DISTINCT FROM labels"""
SAMPLE_OUT = f"""patient_id, encounter_id, {ts_sql('start')} AS encounter_start, {ts_sql('cut')} AS sample_start, duration"""
ALL = list(LINES)


def with_text_hash(df):
    return df.withColumn("text", F.md5("text"))


TB01 = with_views("patient", "encounter", "condition", "procedure_t", more={
    "tl": timeline_sql(["condition", "procedure"]),
    "stays": STAYS,
    "daily": DAILY,
    "cuts": """SELECT d.*, l.labels FROM daily d JOIN (SELECT patient_id, encounter_id, cut,
  list_sort(list(DISTINCT split_part(icd_code, '.', 1))) AS labels FROM daily JOIN condition c USING (patient_id)
  WHERE c.condition_date BETWEEN cut AND "end" AND NOT regexp_matches(icd_code, '^(GB|GROUPBOX|PATSTURZ)')
  GROUP BY 1,2,3) l USING (patient_id, encounter_id, cut)""".replace("JOIN condition c USING (patient_id)", "JOIN (SELECT patient_id, condition_date, icd_code FROM condition) c USING (patient_id)"),
    **history_sql("t.ts < c.cut"),
    "kept": UNCHANGED,
})


@check("tb01_ds_icd", TB01 + f"""SELECT {SAMPLE_OUT}, {list_sql('labels')} AS labels, md5(head || 'Duration: ' || duration || {NL}
  || 'ICD Version: ' || icd || {NL} || {NL} || 'Patient journey:' || {NL} || hist) AS text FROM kept""")
def tb01(v):
    return with_text_hash(T.build_samples(v.tables, T.ds_icd()))


TB02 = with_views("patient", "encounter", "condition", "procedure_t", "imaging_study", "episode_of_care", "diagnostic_report", more={
    "tl": timeline_sql(["condition", "procedure", "imaging_study", "diagnostic_report", "episode_of_care"], IMAGE),
    "stays": STAYS,
    "daily": f"SELECT * FROM ({DAILY}) QUALIFY row_number() OVER (PARTITION BY encounter_id ORDER BY cut) <= 30",
    "cuts": """SELECT d.*, l.labels FROM daily d JOIN (SELECT patient_id, encounter_id, cut,
  list_sort(list(DISTINCT CASE WHEN modality_code IN ('CR','CT','MR','US','XA','NM','OT') THEN modality_code ELSE 'OT' END)) AS labels
  FROM daily JOIN (SELECT patient_id, started, modality_code FROM imaging_study) i USING (patient_id)
  WHERE started BETWEEN cut AND "end" GROUP BY 1,2,3) l USING (patient_id, encounter_id, cut)""",
    **history_sql("t.ts < c.cut"),
    "kept": UNCHANGED,
})


@check("tb02_ds_image_sliding", TB02 + f"""SELECT {SAMPLE_OUT}, {list_sql('labels')} AS labels,
  md5(head || 'Patient history:' || {NL} || hist) AS text FROM kept""")
def tb02(v):
    return with_text_hash(T.build_samples(v.tables, T.ds_image()))


TB03 = with_views("patient", "encounter", "condition", "procedure_t", "imaging_study", "episode_of_care", "diagnostic_report", more={
    "tl": timeline_sql(["condition", "procedure", "imaging_study", "diagnostic_report", "episode_of_care"], IMAGE),
    "stays": STAYS,
    "first_day": """SELECT s.*, start + INTERVAL 1 DAY AS cut FROM stays s
  WHERE patient_id IN (SELECT patient_id FROM imaging_study)""",
    "cuts": """SELECT d.*, coalesce(l.labels, []) AS labels FROM first_day d LEFT JOIN (SELECT patient_id, encounter_id,
  list_sort(list(DISTINCT CASE WHEN modality_code IN ('CR','CT','MR','US','XA','NM','OT') THEN modality_code ELSE 'OT' END)) AS labels
  FROM first_day JOIN (SELECT patient_id, started, modality_code FROM imaging_study) i USING (patient_id)
  WHERE started >= cut AND started < "end" GROUP BY 1,2) l USING (patient_id, encounter_id)""",
    **history_sql("t.ts < c.cut"),
})


@check("tb03_ds_image_one_day", TB03 + f"""SELECT {SAMPLE_OUT}, {list_sql('labels')} AS labels,
  md5(head || 'Patient history:' || {NL} || hist) AS text FROM told""")
def tb03(v):
    return with_text_hash(T.build_samples(v.tables, T.ds_image_one_day()))


TB04 = with_views("patient", "encounter", *RESOURCE_VIEWS, more={
    "tl": timeline_sql(ALL),
    "stays": STAYS,
    "cuts": """SELECT s.*, "end" AS cut, EXISTS (SELECT 1 FROM encounter n WHERE n.patient_id = s.patient_id
  AND n.start > s."end" AND n.start <= s."end" + INTERVAL 30 DAY)::INTEGER AS labels FROM stays s""",
    **history_sql("t.ts <= c.cut"),
})


@check("tb04_ds_readmission", TB04 + f"""SELECT patient_id, encounter_id, {ts_sql('start')} AS encounter_start_date, labels,
  md5(head || 'ICD Version: ' || icd || {NL} || {NL} || 'Patient history:' || {NL} || hist) AS text FROM told""")
def tb04(v):
    return with_text_hash(T.build_samples(v.tables, T.ds_readmission()))


TB05 = with_views("patient", "encounter", *RESOURCE_VIEWS, more={
    "tl": timeline_sql(ALL),
    "stays": STAYS,
    "cuts": """SELECT s.*, start + INTERVAL 2 DAY AS cut,
  coalesce(deceased_date BETWEEN start AND "end" + INTERVAL 1 DAY, false)::INTEGER AS labels FROM stays s""",
    **history_sql("t.ts < c.cut"),
})


@check("tb05_ds_mortality", TB05 + f"""SELECT {SAMPLE_OUT}, {ts_sql('"end"')} AS encounter_end, labels,
  md5(head || 'Patient history:' || {NL} || hist) AS text FROM told""")
def tb05(v):
    return with_text_hash(T.build_samples(v.tables, T.ds_mortality()))


TB06 = with_views("patient", "encounter", *RESOURCE_VIEWS, more={
    "tl": timeline_sql(ALL),
    "stays": STAYS,
    "cuts": """SELECT s.*, "end" AS cut, m.label FROM stays s JOIN (SELECT e.patient_id, e.encounter_id, min(icd_code) AS label
  FROM encounter e JOIN condition c ON c.patient_id = e.patient_id AND condition_date BETWEEN start AND "end"
  WHERE code_diagnosis_type = 'HD' GROUP BY 1,2 HAVING count(DISTINCT icd_code) = 1) m USING (patient_id, encounter_id)
  WHERE duration > 2 AND EXISTS (SELECT 1 FROM imaging_study i WHERE i.patient_id = s.patient_id AND started BETWEEN start AND "end")""",
    **history_sql('t.ts BETWEEN c.start AND c."end"'),
})


@check("tb06_ds_main_icd", TB06 + f"""SELECT patient_id, encounter_id, label, md5(head || 'Duration: ' || duration || {NL} || {NL}
  || 'ICD Version: ' || icd || {NL} || {NL} || 'Patient journey:' || {NL} || hist) AS text FROM told""")
def tb06(v):
    return with_text_hash(T.build_samples(v.tables, T.ds_main_icd(lambda: F.col("code_diagnosis_type") == "HD")))


TB07 = with_views("patient", "encounter", *RESOURCE_VIEWS, more={
    "tl": timeline_sql(ALL),
    "stays": STAYS,
    "cuts": 'SELECT s.*, "end" AS cut FROM stays s',
    **history_sql('t.ts BETWEEN c.start AND c."end"'),
    "tumor": """SELECT patient_id, 'Tumor history: ' || string_agg(concat_ws(' ', first_diagnosis_date, treatment_program), ', ' ORDER BY start)
  || chr(10) || chr(10) AS tumor FROM episode_of_care WHERE treatment_program IS NOT NULL GROUP BY 1""",
})


@check("tb07_pretrain_fhir", TB07 + f"""SELECT patient_id, encounter_id, md5(head || 'Duration: ' || duration || {NL} || {NL}
  || coalesce(tumor, '') || 'ICD Version: ' || icd || {NL} || {NL} || 'Patient journey in stay:' || {NL} || hist) AS text
  FROM told LEFT JOIN tumor USING (patient_id)""")
def tb07(v):
    return with_text_hash(T.build_samples(v.tables, T.pretrain_fhir()))
