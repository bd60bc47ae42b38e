"""Scalar function checks (SC-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.views import ts_sql, with_views
from wardline.functions import codes as C
from wardline.functions import scores as S
from wardline.functions import texts as X
from wardline.functions import times as D
from wardline.operators.cohort import performed
from wardline.operators.rows import select_rename

ENC = with_views("encounter")
COND = with_views("condition")


@check("sc01_strip_ref", ENC + "SELECT encounter_id, patient_id FROM encounter")
def _(v):
    ref = F.concat(F.lit("Patient/"), "patient_id")
    return v.encounter.select("encounter_id", C.strip_ref(ref, "Patient").alias("patient_id"))


@check("sc02_extract_id", ENC + "SELECT encounter_id, patient_id FROM encounter")
def _(v):
    ref = F.concat(F.lit("https://host/base/Patient/"), "patient_id")
    return v.encounter.select("encounter_id", C.extract_id(ref).alias("patient_id"))


LISTS = (
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [source] WHEN 2 THEN [source, lang] END AS xs"
    " FROM documents"
)


def _lists(v):
    xs = "case doc_id % 4 when 0 then cast(array() as array<string>) when 1 then array(source) when 2 then array(source, lang) end"
    return v.raw("documents").selectExpr("doc_id", f"{xs} as xs")


@check(
    "sc03_reduce_cardinality",
    f"SELECT doc_id, list_min(xs) AS taken, CASE WHEN len(xs) = 1 THEN xs[1] END AS only_one, "
    f"CASE WHEN len(xs) > 0 THEN array_to_string(xs, ',') END AS kept FROM ({LISTS})",
)
def _(v):
    xs = F.col("xs")
    return _lists(v).select(
        "doc_id",
        C.reduce_cardinality(xs, take_first=True).alias("taken"),
        C.reduce_cardinality(xs, set_to_none=True).alias("only_one"),
        C.reduce_cardinality(xs).alias("kept"),
    )


@check("sc04_first_positional", f"SELECT doc_id, xs[1] AS first FROM ({LISTS})")
def _(v):
    return _lists(v).select("doc_id", C.first_positional(F.col("xs")).alias("first"))


@check(
    "sc05_to_utc",
    f"""SELECT o_orderkey, {ts_sql("CASE o_orderkey % 4 WHEN 0 THEN o_orderdate - to_hours(2) WHEN 1 THEN o_orderdate WHEN 2 THEN o_orderdate END")} AS ts FROM orders""",
)
def _(v):
    text = F.expr(
        "case o_orderkey % 4 when 0 then date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss.SSS'+02:00'\")"
        " when 1 then date_format(o_orderdate, \"yyyy-MM-dd HH:mm:ss.S'+00:00'\")"
        " when 2 then date_format(o_orderdate, 'yyyy-MM-dd') else 'garbage' end"
    )
    return v.raw("orders").select("o_orderkey", D.to_utc(text).alias("ts"))


@check(
    "sc06_combine_first",
    f"""SELECT o_orderkey, {ts_sql("o_orderdate")} AS start, CASE WHEN o_orderkey % 3 = 0 THEN {ts_sql("o_orderdate + to_hours(1)")}
  ELSE {ts_sql("o_orderdate")} END AS "end" FROM orders""",
)
def _(v):
    day = "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    later = "date_format(o_orderdate + interval 1 hour, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    rows = v.raw("orders").selectExpr(
        "o_orderkey",
        f"case when o_orderkey % 3 = 0 then {day} end as effectivedatetimestart_v1",
        f"case when o_orderkey % 3 = 0 then {later} end as effectivedatetimeend_v1",
        f"case when o_orderkey % 3 > 0 then {day} end as effectivedatetimestart_v2",
        f"case when o_orderkey % 3 > 0 then {day} end as effectivedatetimeend_v2",
    )
    return performed(rows).select("o_orderkey", "start", "end")


@check(
    "sc07_report_date",
    f"SELECT event_id, {ts_sql('CASE WHEN event_id % 2 = 0 THEN ts ELSE ts + INTERVAL 1 DAY END')} AS date FROM events",
)
def _(v):
    rows = v.raw("events").selectExpr(
        "event_id", "case when event_id % 2 = 0 then ts end as effective_datetime", "ts + interval 1 day as issued"
    )
    return rows.select("event_id", F.coalesce("effective_datetime", "issued").alias("date"))


@check("sc08_map_insurance", with_views("patient") + "SELECT patient_id, insurance_type FROM patient")
def _(v):
    return v.patient.select("patient_id", "insurance_type")


@check(
    "sc09_map_tumor_type",
    """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Magen-Darm Tumoren' WHEN 1 THEN 'Hauttumoren' WHEN 2 THEN 'Lebertumoren'
  WHEN 3 THEN 'Leukämien, Lymphome und Myelome' END AS tumor FROM part""",
)
def _(v):
    form = F.expr(
        "element_at(array('DCP01BASIS','DCP08BASIS3','DCP14BASIS2','DCP03BASIS','X'), int(p_size % 5) + 1)"
    )
    return v.raw("part").select("p_partkey", C.map_tumor_type(form).alias("tumor"))


def _concepts(v):
    return v.raw("documents").selectExpr(
        "doc_id",
        "case when doc_id % 5 = 0 then null else named_struct('coding', array(named_struct('system', 'a', 'code', source,"
        " 'display', lang), named_struct('system', 'b', 'code', lang, 'display', source))) end as concept",
        "case when doc_id % 3 = 0 then null else array(named_struct('url', 'u1', 'valueString', source),"
        " named_struct('url', 'u2', 'valueString', lang), named_struct('url', 'u2', 'valueString', 'later')) end as extension",
    )


@check(
    "sc10_safe_get",
    "SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN source || ',' || lang END AS codes FROM documents",
)
def _(v):
    return _concepts(v).select("doc_id", C.safe_get(F.col("concept.coding"), "code").alias("codes"))


@check("sc11_first_coding", "SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN source END AS code FROM documents")
def _(v):
    return _concepts(v).select("doc_id", C.first_coding(F.col("concept"), "code").alias("code"))


@check(
    "sc12_extension_value",
    "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN lang END AS hit, NULL::VARCHAR AS miss FROM documents",
)
def _(v):
    ext = F.col("extension")
    return _concepts(v).select(
        "doc_id", C.extension_value(ext, "u2").alias("hit"), C.extension_value(ext, "u3").alias("miss")
    )


@check(
    "sc13_code_in_system",
    "SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN lang END AS code, CASE WHEN doc_id % 5 > 0 THEN source END AS display FROM documents",
)
def _(v):
    return _concepts(v).select("doc_id", C.code_in_system(F.col("concept.coding"), "b").alias("c")).select("doc_id", "c.*")


@check(
    "sc14_age_years",
    with_views("encounter", "patient")
    + """SELECT encounter_id, (date_diff('microsecond', birth_date::TIMESTAMP, start) // 86400000000) // 365 AS age
  FROM encounter JOIN patient USING (patient_id)""",
)
def _(v):
    return v.encounter.join(v.patient, "patient_id").select(
        "encounter_id", D.age_years(F.col("birth_date"), F.col("start")).alias("age")
    )


@check(
    "sc15_stay_days",
    ENC + """SELECT encounter_id, date_diff('microsecond', start, "end") // 86400000000 AS days FROM encounter""",
)
def _(v):
    return v.encounter.select("encounter_id", D.days_between(F.col("start"), F.col("end")).alias("days"))


@check("sc16_icd_chapter", COND + "SELECT icd_code, split_part(icd_code, '.', 1) AS stem, count(*) AS n FROM condition GROUP BY 1, 2")
def _(v):
    rows = v.condition.select("icd_code", C.icd_chapter(F.col("icd_code")).alias("stem"))
    return rows.groupBy("icd_code", "stem").agg(F.count("*").alias("n"))


@check(
    "sc17_fold_vocabulary",
    with_views("imaging_study")
    + """SELECT modality_code, CASE WHEN modality_code IN ('CR','CT','MR','US','XA','NM','OT') THEN modality_code ELSE 'OT' END
  AS folded, count(*) AS n FROM imaging_study GROUP BY 1, 2""",
)
def _(v):
    rows = v.imaging_study.select("modality_code", C.fold_vocabulary(F.col("modality_code")).alias("folded"))
    return rows.groupBy("modality_code", "folded").agg(F.count("*").alias("n"))


@check(
    "sc18_kv_text",
    "SELECT doc_id, 'lang' || chr(9) || lang || chr(10) || 'chars' || chr(9) || n_chars AS text FROM documents",
)
def _(v):
    return v.raw("documents").select(
        "doc_id", X.kv_text([("lang", F.col("lang")), ("none", F.lit(None)), ("chars", F.col("n_chars"))]).alias("text")
    )


@check(
    "sc19_patient_text",
    with_views("encounter", "patient")
    + """SELECT encounter_id, 'age' || chr(9) || ((date_diff('microsecond', birth_date::TIMESTAMP, start) // 86400000000) // 365)
  || chr(10) || 'gender' || chr(9) || sex || chr(10) || 'insurance_type' || chr(9) || insurance_type AS text
  FROM encounter JOIN patient USING (patient_id)""",
)
def _(v):
    text = X.patient_text(F.col("birth_date"), F.col("sex"), F.col("insurance_type"), F.col("start"))
    return v.encounter.join(v.patient, "patient_id").select("encounter_id", text.alias("text"))


@check(
    "sc20_encounter_text",
    ENC
    + """SELECT encounter_id, concat_ws(chr(10), 'Beginn' || chr(9) || strftime(start, '%Y-%m-%d %H:%M:%S') || '+00:00',
  'Kontakt Art' || chr(9) || type_display, 'Art' || chr(9) || v3_act_code, 'Fachabteilungsschlüssel' || chr(9) || fachabteilungsschluessel,
  'Aufnahmeanlass' || chr(9) || aufnahmeanlass_display) AS text FROM encounter""",
)
def _(v):
    return v.encounter.select(
        "encounter_id", X.encounter_text({c: F.col(c) for c in v.encounter.columns}).alias("text")
    )


@check("sc21_select_rename", "SELECT o_orderkey AS encounter_id, o_custkey AS patient_id FROM orders")
def _(v):
    return select_rename(v.raw("orders"), {"o_orderkey": "encounter_id", "o_custkey": "patient_id"})


LOGITS = "[(doc_id % 7) / 7.0 - 0.5, (doc_id % 5) / 5.0 - 0.4, (doc_id % 3) / 3.0 - 0.3]"


def _logits(v):
    xs = "array(double((doc_id % 7) / 7.0D - 0.5D), double((doc_id % 5) / 5.0D - 0.4D), double((doc_id % 3) / 3.0D - 0.3D))"
    return v.raw("documents").selectExpr("doc_id", f"{xs} as xs")


@check(
    "sc23_sigmoid_softmax_argmax",
    f"""WITH l AS (SELECT doc_id, {LOGITS}::DOUBLE[] AS xs FROM documents),
  e AS (SELECT doc_id, xs, list_transform(xs, lambda x: exp(x - list_max(xs))) AS es FROM l)
  SELECT doc_id, round(1 / (1 + exp(-xs[1])), 6) AS sig, round(es[2] / list_sum(es), 6) AS soft,
  list_position(xs, list_max(xs)) - 1 AS best FROM e""",
)
def _(v):
    xs = F.col("xs")
    return _logits(v).select(
        "doc_id",
        F.get(S.sigmoid(xs), F.lit(0)).alias("sig"),
        F.get(S.softmax(xs), F.lit(1)).alias("soft"),
        S.argmax(xs).alias("best"),
    )


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@check(
    "sc24_binarize",
    """SELECT p_partkey, concat_ws(',', (p_type = 'ECONOMY')::INT, (p_type = 'LARGE')::INT, (p_type = 'MEDIUM')::INT,
  (p_type = 'PROMO')::INT, (p_type = 'SMALL' OR p_size % 2 = 0)::INT, (p_type = 'STANDARD')::INT) AS bits,
  list_position(['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'], p_type) - 1 AS idx FROM part""",
)
def _(v):
    classes = F.array(*[F.lit(t) for t in TYPES])
    labels = F.when(F.col("p_size") % 2 == 0, F.array("p_type", F.lit("SMALL"))).otherwise(F.array("p_type"))
    return v.raw("part").select(
        "p_partkey", S.binarize(labels, classes).alias("bits"), S.class_index(F.col("p_type"), classes).alias("idx")
    )


@check(
    "sc25_label_combo_id",
    """SELECT p_partkey, (list_position(c, p_type) - 1) * 6 + 4 * 12 AS combo
  FROM (SELECT *, ['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'] AS c FROM part)""",
)
def _(v):
    classes = F.array(*[F.lit(t) for t in TYPES])
    labels = F.array("p_type", F.lit("SMALL"))
    return v.raw("part").select("p_partkey", S.label_combo_id(labels, classes).alias("combo"))


@check(
    "sc26_label_ids",
    """SELECT p_partkey, list_position(['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'], p_type) - 1 AS id,
  p_type AS label FROM part""",
)
def _(v):
    classes = F.array(*[F.lit(t) for t in TYPES])
    rows = v.raw("part").select("p_partkey", S.label_to_id(F.col("p_type"), classes).alias("id"))
    return rows.withColumn("label", S.id_to_label(F.col("id"), classes))


@check("sc27_sha256_id", "SELECT doc_id, sha256(source || lang || doc_id) AS id FROM documents")
def _(v):
    return v.raw("documents").select(
        "doc_id", C.sha256_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("id")
    )
