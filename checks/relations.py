"""Filter, join, aggregation, window and set checks (FL-*, JN-*, AG-*, WN-*, SO-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.tasks import ALL, LINES, NL, RESOURCE_VIEWS, TB01, TB02, timeline_sql
from checks.views import list_sql, ts_sql, with_views
from wardline.functions.codes import is_label_code
from wardline.functions.times import days_between, in_window, plus_days
from wardline.operators import history as H
from wardline.operators import labels as L
from wardline.operators import links as K
from wardline.operators import rows as R
from wardline.operators import splits as S
from wardline.operators import validate as V
from wardline.plans import tasks as T
from wardline.session import cut_lineage
from wardline.sources import documents, flatten

ENC = with_views("encounter")
COND = with_views("condition")

LO, HI = "1996-03-01 00:00:00", "1997-03-01 00:00:00"


def _t(text):
    return F.lit(text).cast("timestamp")


@check(
    "fl01_filter_date",
    ENC + f"SELECT encounter_id, {ts_sql('start')} AS start FROM encounter WHERE start BETWEEN TIMESTAMP '{LO}' AND TIMESTAMP '{HI}'",
)
def _(v):
    return R.filter_date(v.encounter, _t(LO), _t(HI), "start").select("encounter_id", "start")


@check(
    "fl02_select_window",
    ENC + f"""SELECT encounter_id, (start >= TIMESTAMP '{LO}' AND start < TIMESTAMP '{HI}') AS half_open,
  (start > TIMESTAMP '{LO}' AND start <= TIMESTAMP '{HI}') AS upper_closed, (start < TIMESTAMP '{HI}') AS open_start, true AS unbounded
  FROM encounter""",
)
def _(v):
    ts = F.col("start")
    return v.encounter.select(
        "encounter_id",
        in_window(ts, _t(LO), _t(HI)).alias("half_open"),
        in_window(ts, _t(LO), _t(HI), lo_incl=False, hi_incl=True).alias("upper_closed"),
        in_window(ts, hi=_t(HI)).alias("open_start"),
        in_window(ts).alias("unbounded"),
    )


@check("fl03_min_stay", ENC + """SELECT encounter_id FROM encounter WHERE "end" - start > INTERVAL 2 DAY""")
def _(v):
    return R.min_stay(v.encounter).select("encounter_id")


@check(
    "fl04_status_in",
    with_views("procedure_t", "service_request")
    + """SELECT 'procedure' AS resource, procedure_id AS id, status FROM procedure_t WHERE status IN ('completed','in-progress','preparation')
  UNION ALL SELECT 'service_request', id, status FROM service_request WHERE status IN ('active','completed','draft','unknown')""",
)
def _(v):
    a = R.status_in(v.procedure, R.PROCEDURE_STATES)
    b = R.status_in(v.service_request, R.REQUEST_STATES)
    return a.select(F.lit("procedure").alias("resource"), F.col("procedure_id").alias("id"), "status").unionByName(
        b.select(F.lit("service_request").alias("resource"), "id", "status")
    )


@check(
    "fl05_drop_missing",
    COND + "SELECT icd_code, count(*) AS n FROM condition WHERE icd_display IS NOT NULL AND patient_id IS NOT NULL GROUP BY 1",
)
def _(v):
    return R.drop_missing(v.condition, ["icd_display", "patient_id"]).groupBy("icd_code").agg(F.count("*").alias("n"))


@check(
    "fl06_issued_only",
    with_views("bdp") + "SELECT code, count(*) AS n FROM bdp WHERE ausgabe_type = 'AUSGABE' GROUP BY 1",
)
def _(v):
    return R.issued_only(v.biologically_derived_product).groupBy("code").agg(F.count("*").alias("n"))


NOW = "1997-06-15 12:00:00"


@check(
    "fl07_ongoing",
    ENC + f"""SELECT encounter_id FROM encounter WHERE start <= TIMESTAMP '{NOW}' AND "end" >= TIMESTAMP '{NOW}'""",
)
def _(v):
    return R.ongoing(v.encounter, _t(NOW)).select("encounter_id")


@check(
    "fl08_exclude_prefixes",
    COND + "SELECT icd_code, count(*) AS n FROM condition WHERE NOT regexp_matches(icd_code, '^(GB|GROUPBOX|PATSTURZ)') GROUP BY 1",
)
def _(v):
    return v.condition.where(is_label_code(F.col("icd_code"))).groupBy("icd_code").agg(F.count("*").alias("n"))


@check(
    "fl09_long_stay",
    ENC + """SELECT encounter_id FROM encounter WHERE date_diff('microsecond', start, "end") // 86400000000 > 2""",
)
def _(v):
    return v.encounter.where(days_between(F.col("start"), F.col("end")) > 2).select("encounter_id")


@check(
    "fl10_has_history_and_label",
    with_views("encounter", "condition")
    + """SELECT encounter_id, list_sort(list(DISTINCT split_part(icd_code, '.', 1)))[1] AS first_label FROM encounter e JOIN
  (SELECT patient_id, condition_date, icd_code FROM condition) c USING (patient_id)
  WHERE condition_date BETWEEN start AND "end" AND NOT regexp_matches(icd_code, '^(GB|GROUPBOX|PATSTURZ)')
  AND EXISTS (SELECT 1 FROM condition h WHERE h.patient_id = e.patient_id AND h.condition_date < e.start) GROUP BY 1""",
)
def _(v):
    rule = L.icd_labels()
    stays = v.encounter.withColumn("cuts", F.array("start"))
    stays = H.history_steps(rule.attach(stays, v.tables), H.resource_lines(v.condition, "condition"))
    stays = stays.where(F.col("_first_ts") < F.col("start")).withColumn("labels", rule.value_at(F.col("start")))
    return stays.where(F.size("labels") > 0).select("encounter_id", F.get("labels", F.lit(0)).alias("first_label"))


@check(
    "fl11_require_columns",
    "SELECT 'present' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'absent', 0",
)
def _(v):
    df = v.raw("orders")
    one = R.require_columns(df, ["o_orderkey"]).agg(F.count("*").alias("n")).select(F.lit("present").alias("kind"), "n")
    return one.unionByName(
        R.require_columns(df, ["nope"]).agg(F.count("*").alias("n")).select(F.lit("absent").alias("kind"), "n")
    )


@check(
    "fl12_valid_dates",
    "SELECT o_orderkey::VARCHAR AS encounter_id FROM orders WHERE o_orderkey % 6 > 0",
)
def _(v):
    bad = v.encounter.withColumn("end", F.expr("case when int(encounter_id) % 6 > 0 then end end"))
    return T.valid_stays(bad).select("encounter_id")


def _cohort_sql():
    names = ("condition", "imaging_study", "episode_of_care")
    return with_views("condition", "imaging_study", "episode_of_care", more={"tl": timeline_sql(names)}) + (
        "SELECT resource, count(*) AS n FROM tl GROUP BY 1"
    )


@check("fl13_resource_subset", _cohort_sql())
def _(v):
    from wardline.registry import resources_for

    off = {"procedure": False, "diagnostic_report": False}
    lines = H.timeline(v.tables, resources_for("ds_image", off), "ds_icd")
    return lines.groupBy("resource").agg(F.count("*").alias("n"))


@check(
    "jn01_link_patients",
    with_views("initial_patient")
    + """SELECT p.patient_id, m.patient_id AS patient_id_meta, m.sex AS sex_meta FROM initial_patient p
  LEFT JOIN initial_patient m ON list_contains(m.links, p.patient_id)""",
)
def _(v):
    return K.link_patients(v.initial_patient).select("patient_id", "patient_id_meta", "sex_meta")


LINKED = """SELECT m.patient_id AS grp, list_sort([m.patient_id, p.patient_id]) AS ids, m.birth_date AS b1, p.birth_date AS b2,
  m.deceased_date AS d1, p.deceased_date AS d2, m.sex AS s1, p.sex AS s2, m.insurance_type AS i1, p.insurance_type AS i2
  FROM initial_patient m JOIN initial_patient p ON list_contains(m.links, p.patient_id)"""
# the derived birth dates never agree, so the check gives linked patients the date of the naming one
SAME_BIRTH = """SELECT * REPLACE (CASE WHEN (patient_id::BIGINT) % 20 = 1 THEN DATE '1920-01-01' + (((patient_id::BIGINT - 1) * 37) % 20000)::INTEGER
  ELSE birth_date END AS birth_date) FROM initial_patient_0"""


def _people_sql(*names, more):
    text = with_views("initial_patient", *names)
    return text.replace("initial_patient AS (", "initial_patient_0 AS (").rstrip() + ",\n" + ",\n".join(
        f"{n} AS ({b})" for n, b in {"initial_patient": SAME_BIRTH, **more}.items()
    ) + "\n"


def _people(v):
    same = F.expr("date_add(date'1920-01-01', int(((bigint(patient_id) - 1) * 37) % 20000))")
    return v.initial_patient.withColumn(
        "birth_date", F.when(F.expr("bigint(patient_id) % 20 = 1"), same).otherwise(F.col("birth_date"))
    )


MERGED = {
    "pairs": LINKED,
    "sound": """SELECT *, least(d1, d2) AS death FROM pairs WHERE b1 = b2 AND
  (d1 IS NULL OR d2 IS NULL OR abs(date_diff('microsecond', d1, d2)) // 86400000000 <= 3) AND coalesce(least(d1, d2) >= b1, true)""",
    "merged": """SELECT unnest(ids) AS patient_id, array_to_string(ids, ',') AS linked_patient_id, b1 AS birth_date,
  CASE WHEN s1 = 'male' AND s2 = 'female' OR s1 = 'female' AND s2 = 'male' THEN 'unknown' WHEN 'male' IN (s1, s2) THEN 'male'
    WHEN 'female' IN (s1, s2) THEN 'female' ELSE 'other' END AS sex,
  array_to_string(list_sort(list_distinct([i1, i2])), ',') AS insurance_type, death AS deceased_date FROM sound
  UNION ALL
  SELECT patient_id, patient_id, birth_date, sex, insurance_type, deceased_date FROM initial_patient p
  WHERE patient_id NOT IN (SELECT unnest(ids) FROM sound) AND NOT EXISTS (SELECT 1 FROM initial_patient m WHERE list_contains(m.links, p.patient_id))""",
}


@check(
    "ag02_merge_linked_patients",
    _people_sql(more=MERGED)
    + f"SELECT patient_id, linked_patient_id, birth_date::VARCHAR AS birth_date, sex, insurance_type, {ts_sql('deceased_date')} AS deceased_date FROM merged",
)
def _(v):
    return K.merge_linked_patients(_people(v))


@check(
    "jn02_canonicalise",
    _people_sql("encounter", more=MERGED)
    + """SELECT encounter_id, e.patient_id AS original_patient_id, linked_patient_id AS patient_id FROM encounter e
  JOIN merged USING (patient_id)""",
)
def _(v):
    patients = K.merge_linked_patients(_people(v))
    rows = K.canonicalise(v.encounter, patients, K.hot_patients(v.encounter))
    return rows.select("encounter_id", "original_patient_id", "patient_id")


@check(
    "jn03_product_request",
    """SELECT l_orderkey || '-' || l_linenumber AS bdp_id, CASE WHEN o_orderkey IS NOT NULL THEN o_custkey END AS patient
  FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey""",
)
def _(v):
    products = v.raw("lineitem").selectExpr("concat(l_orderkey, '-', l_linenumber) as bdp_id", "l_orderkey as service_request_id")
    requests = v.raw("orders").where("o_orderstatus <> 'P'").selectExpr("o_orderkey as service_request_id", "o_custkey as patient")
    return flatten.join_requests(products, requests).select("bdp_id", "patient")


@check(
    "jn04_administration_medication",
    """SELECT p_name AS medication, l_linestatus AS status, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey
  WHERE p_size > 10 GROUP BY 1, 2""",
)
def _(v):
    given = v.raw("lineitem").selectExpr("l_partkey as medication_id", "l_linestatus as status")
    names = v.raw("part").where("p_size > 10").selectExpr("p_partkey as medication_id", "p_name as medication")
    return flatten.join_medication(given, names).groupBy("medication", "status").agg(F.count("*").alias("n"))


@check(
    "jn05_in_set",
    with_views("patient", "encounter") + "SELECT patient_id, sex FROM patient WHERE patient_id IN (SELECT patient_id FROM encounter)",
)
def _(v):
    return R.in_set(v.patient, v.encounter, "patient_id").select("patient_id", "sex")


@check(
    "jn06_history_bounds",
    with_views("encounter", *RESOURCE_VIEWS, more={"tl": timeline_sql(ALL)})
    + """SELECT encounter_id, count_if(ts < start) AS before_start, count_if(ts <= "end") AS until_end,
  count_if(ts >= start AND ts <= "end") AS during, count_if(ts > "end" AND ts <= "end" + INTERVAL 30 DAY) AS after_end
  FROM encounter e JOIN tl USING (patient_id) GROUP BY 1 HAVING min(ts) <= any_value("end") + INTERVAL 30 DAY""",
)
def _(v):
    lines = H.timeline(v.tables, tuple(ALL), by_patient=True)
    days = H.patient_days(lines, tuple(ALL)).select("patient_id", F.expr("transform(_days, d -> struct(d.day, d.n))").alias("_days"))
    # a record is before the start if it is not after the microsecond before it, so all three cuts can be inclusive
    bounds = {"before_start": F.col("start") - F.expr("interval 1 microsecond"), "until_end": F.col("end"), "until_30": plus_days(F.col("end"), 30)}
    cuts = F.array(*[F.struct(F.lit(name).alias("bound"), cut.alias("cut")) for name, cut in bounds.items()])
    cuts = v.encounter.select("patient_id", "encounter_id", F.inline(cuts))
    # rows before a cut: whole days of the patient plus the part of the own day
    told = H.own_days(cuts, lines, tuple(ALL), inclusive=True).join(days, "patient_id")
    past = F.filter("_days", lambda d: d["day"] < F.to_date("cut"))
    whole = F.aggregate(past, F.lit(0).cast("bigint"), lambda acc, d: acc + d["n"])
    counts = cut_lineage(told.select("encounter_id", "bound", (whole + F.coalesce(F.col("_own")["n"], F.lit(0))).alias("n")))

    def counted(name):
        return counts.where(F.col("bound") == name).select("encounter_id", F.col("n").alias(name))

    out = counted("before_start").join(counted("until_end"), "encounter_id").join(counted("until_30"), "encounter_id")
    return out.where("until_30 > 0").select(
        "encounter_id",
        "before_start",
        "until_end",
        (F.col("until_end") - F.col("before_start")).alias("during"),
        (F.col("until_30") - F.col("until_end")).alias("after_end"),
    )


@check(
    "jn07_label_window",
    with_views("encounter", "imaging_study")
    + """SELECT encounter_id, modality_code, count(*) AS n FROM encounter e JOIN (SELECT patient_id, started, modality_code FROM imaging_study) i
  USING (patient_id) WHERE started >= start + INTERVAL 1 DAY AND started < "end" GROUP BY 1, 2""",
)
def _(v):
    stays = v.encounter.select("patient_id", "encounter_id", "start", "end")
    events = v.imaging_study.select("patient_id", F.col("started").alias("ts"), "modality_code")
    rows = H.events_in_stays(stays, events, plus_days(F.col("start"), 1), F.col("end"), hi_incl=False)
    return rows.groupBy("encounter_id", "modality_code").agg(F.count("*").alias("n"))


@check(
    "jn08_followed_by",
    ENC
    + """SELECT encounter_id, EXISTS (SELECT 1 FROM encounter n WHERE n.patient_id = e.patient_id AND n.start > e."end"
  AND n.start <= e."end" + INTERVAL 30 DAY) AS followed FROM encounter e""",
)
def _(v):
    return L.followed_by(v.encounter).select("encounter_id", "followed")


@check(
    "jn09_outer_link",
    """SELECT coalesce(o.patient_id, l.patient_id) AS patient_id, coalesce(l.ids, o.patient_id) AS linked_patient_id FROM
  (SELECT DISTINCT o_custkey::VARCHAR AS patient_id FROM orders) o FULL JOIN
  (SELECT c_custkey::VARCHAR AS patient_id, string_agg(DISTINCT c_nationkey::VARCHAR, ',' ORDER BY c_nationkey::VARCHAR) AS ids
   FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1) l ON l.patient_id = o.patient_id""",
)
def _(v):
    links = v.raw("customer").where("c_mktsegment <> 'BUILDING'")
    links = links.selectExpr("cast(c_custkey as string) as patient_id", "cast(c_nationkey as string) as linked_patient_id")
    return K.outer_link(v.encounter, links)


@check(
    "jn10_drop_components",
    """SELECT doc_id FROM documents d WHERE doc_id = (SELECT min(doc_id) FROM documents e WHERE e.text = d.text)""",
)
def _(v):
    from wardline.operators.components import connected_components
    from wardline.operators.neardup import drop_components

    docs = v.raw("documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("h"))
    lowest = docs.groupBy("h").agg(F.min("id").alias("dst"))
    edges = docs.withColumnRenamed("id", "src").join(lowest, "h").where("src <> dst").select("src", "dst")
    return drop_components(docs, connected_components(edges)).select(F.col("id").alias("doc_id"))


@check(
    "jn11_text_by_report",
    "SELECT doc_id::VARCHAR AS diagnostic_report_id, length(text) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def _(v):
    reports = v.raw("labels").selectExpr("cast(doc_id as string) as diagnostic_report_id")
    docs = v.raw("documents").selectExpr("cast(doc_id as string) as diagnostic_report_id", "text")
    return documents.text_by_report(reports, docs).select("diagnostic_report_id", F.length("text").alias("n"))


@check(
    "ag01_first_of_copies",
    COND
    + f"""SELECT patient_id, condition_id, {ts_sql('condition_date')} AS condition_date, icd_code FROM condition
  QUALIFY row_number() OVER (PARTITION BY patient_id, condition_id ORDER BY condition_date, icd_code) = 1""",
)
def _(v):
    rows = v.condition.select("patient_id", "condition_id", "condition_date", "icd_code")
    return R.first_rows(rows, ["patient_id", "condition_id"], ["condition_date"])


DAYTEXT = {
    "lined": "SELECT patient_id, ts::DATE AS day, resource, line, count(*) AS n, min(ts) AS first_ts FROM tl GROUP BY ALL",
    "blocked": f"""SELECT patient_id, day, resource, sum(n)::BIGINT AS n, strftime(day, '%Y-%m-%d') || ':' || {NL} || string_agg(
  CASE WHEN n > 1 THEN n || 'x ' ELSE '' END || line, {NL} ORDER BY first_ts, line) AS block FROM lined GROUP BY 1, 2, 3""",
}
ALL_VIEWS = [x[0] for x in LINES.values()]
ALL_TL = with_views(*ALL_VIEWS, more={"tl": timeline_sql(list(LINES)), **DAYTEXT})


@check("ag03_day_block", ALL_TL + "SELECT patient_id, strftime(day, '%Y-%m-%d') AS day, resource, n, block FROM blocked")
def _(v):
    return H.day_blocks(H.timeline(v.tables, tuple(LINES), by_patient=True), ["patient_id"]).drop("icd")


@check(
    "ag04_history_text",
    ALL_TL + f"""SELECT patient_id, sum(n)::BIGINT AS n_rows, md5(string_agg(block, {NL} ORDER BY day DESC, resource DESC)) AS history
  FROM blocked GROUP BY 1""",
)
def _(v):
    days = H.day_texts(H.timeline(v.tables, tuple(LINES), by_patient=True), ["patient_id"])
    return H.history_texts(days, ["patient_id"]).select("patient_id", "n_rows", F.md5("history").alias("history"))


@check(
    "ag05_distinct_labels",
    with_views("encounter", "condition")
    + f"""SELECT encounter_id, {list_sql("list_sort(list(DISTINCT split_part(icd_code, '.', 1)))")} AS labels FROM encounter JOIN
  (SELECT patient_id, condition_date, icd_code FROM condition) c USING (patient_id)
  WHERE condition_date BETWEEN start AND "end" AND NOT regexp_matches(icd_code, '^(GB|GROUPBOX|PATSTURZ)') GROUP BY 1""",
)
def _(v):
    rule = L.icd_labels()
    stays = rule.attach(v.encounter.withColumn("cuts", F.array("start")), v.tables)
    return stays.select("encounter_id", rule.value_at(F.col("start")).alias("labels"))


@check(
    "ag06_latest_value",
    with_views("encounter", "condition", more={"tl": timeline_sql(["condition"])})
    + """SELECT encounter_id, max({'ts': ts, 'v': t.icd_version}).v AS icd_version FROM encounter e JOIN tl t
  ON t.patient_id = e.patient_id AND t.ts < e.start GROUP BY 1""",
)
def _(v):
    lines = H.timeline(v.tables, ("condition",), by_patient=True)
    cuts = v.encounter.select("patient_id", "encounter_id", F.col("start").alias("cut"))
    told = H.history_before(H.own_days(cuts, lines, ("condition",)).join(H.patient_days(lines, ("condition",)), "patient_id"))
    return told.select("encounter_id", "icd_version")


@check(
    "ag07_tumor_history",
    with_views("episode_of_care")
    + f"""SELECT patient_id, 'Tumor history: ' || string_agg(concat_ws(' ', first_diagnosis_date, treatment_program), ', ' ORDER BY start)
  || {NL} || {NL} AS tumor FROM episode_of_care WHERE treatment_program IS NOT NULL GROUP BY 1""",
)
def _(v):
    return T.tumor_history(v.episode_of_care)


@check(
    "ag08_last_per_group",
    ENC
    + f"""SELECT patient_id, {ts_sql('max(start)')} AS start, max({{'s': start, 'v': v3_act_code}}) FILTER (v3_act_code IS NOT NULL).v AS v3_act_code
  FROM encounter GROUP BY 1""",
)
def _(v):
    rows = v.encounter.select("patient_id", "start", "v3_act_code")
    return R.last_non_null(rows, "patient_id", "start")


@check(
    "ag09_label_counts",
    COND + "SELECT split_part(icd_code, '.', 1) AS label, count(*) AS n FROM condition GROUP BY 1 ORDER BY n DESC, label LIMIT 20",
)
def _(v):
    stems = F.array(F.substring_index("icd_code", ".", 1))
    return S.label_counts(v.condition.select("patient_id", stems.alias("labels")))


@check(
    "ag09_mean_labels",
    COND + "SELECT round(avg(n), 6) AS mean_labels FROM (SELECT count(DISTINCT icd_code) AS n FROM condition GROUP BY patient_id)",
)
def _(v):
    return S.mean_labels(v.condition.groupBy("patient_id").agg(F.collect_set("icd_code").alias("labels")))


@check(
    "ag10_frequent_labels",
    COND
    + """SELECT icd_code, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT icd_code, count(*) AS n FROM condition GROUP BY 1)
  QUALIFY n / sum(n) OVER () > 0.005""",
)
def _(v):
    return S.frequent_labels(v.condition, "icd_code")


@check(
    "ag11_null_counts",
    COND
    + """SELECT 'patient_id' AS column_name, 'error' AS level, count_if(patient_id IS NULL) AS nulls, count(*) AS rows FROM condition
  UNION ALL SELECT 'icd_display', 'warning', count_if(icd_display IS NULL), count(*) FROM condition""",
)
def _(v):
    return V.null_counts(v.condition, (("patient_id", True), ("icd_display", False), ("absent", True)))


@check(
    "ag12_day_gap_check",
    with_views("bdp", more={
        "per_day": "SELECT ausgabe_datetime::DATE AS day, count(*) AS n FROM bdp WHERE ausgabe_type = 'AUSGABE' GROUP BY 1"
    })
    + """SELECT strftime(d.day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(min(day)::TIMESTAMP,
  max(day)::TIMESTAMP - INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM per_day) d LEFT JOIN per_day USING (day)""",
)
def _(v):
    return V.day_gap_check(R.issued_only(v.biologically_derived_product))


@check(
    "ag13_build_stats",
    ENC + "SELECT count(DISTINCT patient_id) AS patients, count(DISTINCT encounter_id) AS encounters, count(*) AS samples FROM encounter",
)
def _(v):
    return S.build_stats(v.encounter)


@check(
    "ag19_class_balance_counts",
    "SELECT count_if(quality = 1) AS positives, count_if(quality <> 1) AS negatives FROM labels",
)
def _(v):
    return S.class_balance_counts(v.raw("labels"), "quality")


@check(
    "ag20_label_to_patients",
    COND + "SELECT DISTINCT split_part(icd_code, '.', 1) AS label, patient_id FROM condition",
)
def _(v):
    stems = F.array(F.substring_index("icd_code", ".", 1))
    return S.label_to_patients(v.condition.select("patient_id", stems.alias("labels")))


@check(
    "wn01_drop_unchanged",
    TB01 + f"SELECT encounter_id, {ts_sql('cut')} AS cut, {list_sql('labels')} AS labels FROM kept",
)
def _(v):
    task = T.ds_icd()
    stays = T.valid_stays(v.encounter).where(F.col("duration") > 2)
    cuts = T.labelled_cuts(stays, task, v.tables, H.timeline(v.tables, ("condition", "procedure")))
    return cuts.select("encounter_id", "cut", "labels")


@check(
    "wn02_first_n_windows",
    TB02 + "SELECT encounter_id, count(*) AS n FROM daily GROUP BY 1",
)
def _(v):
    stays = T.valid_stays(v.encounter).where(F.col("duration") > 2)
    return stays.select("encounter_id", F.size(T.daily_cuts(30)()).alias("n"))


@check(
    "wn03_keep_last",
    ENC
    + f"""SELECT patient_id, encounter_id, {ts_sql('start')} AS start FROM encounter
  QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY start DESC, encounter_id DESC) = 1""",
)
def _(v):
    rows = v.encounter.select("patient_id", "encounter_id", "start")
    return R.first_rows(rows, ["patient_id"], ["start", "encounter_id"], last=True)


@check(
    "sp01_sort_by_time",
    ENC
    + f"""SELECT patient_id, string_agg(encounter_id, ',' ORDER BY start, encounter_id) AS stays FROM encounter GROUP BY 1""",
)
def _(v):
    ordered = F.array_sort(F.collect_list(F.struct("start", "encounter_id")))
    return v.encounter.groupBy("patient_id").agg(
        F.array_join(F.transform(ordered, lambda e: e["encounter_id"]), ",").alias("stays")
    )


@check(
    "so01_concat_first_wins",
    """SELECT id, max(kind) AS kind FROM (SELECT o_custkey AS id, 'merged' AS kind FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT c_custkey, 'alone' FROM customer) GROUP BY 1""",
)
def _(v):
    a = v.raw("orders").where("o_orderstatus = 'P'").selectExpr("o_custkey as id", "0 as pos", "'merged' as kind")
    b = v.raw("customer").selectExpr("c_custkey as id", "1 as pos", "'alone' as kind")
    return R.first_rows(a.unionByName(b), ["id"], ["pos"]).drop("pos")


@check(
    "so02_concat_timelines",
    ALL_TL + "SELECT resource, count(*) AS n, count(DISTINCT patient_id) AS patients FROM tl GROUP BY 1",
)
def _(v):
    lines = H.timeline(v.tables, tuple(LINES))
    return lines.groupBy("resource").agg(F.count("*").alias("n"), F.count_distinct("patient_id").alias("patients"))


@check(
    "so04_edge_distinct_difference",
    """WITH a AS (SELECT DISTINCT greatest(o_custkey, o_orderkey) AS src, least(o_custkey, o_orderkey) AS dst FROM orders),
  b AS (SELECT DISTINCT src, dst FROM a WHERE src % 3 > 0)
  SELECT src, dst FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def _(v):
    a = v.raw("orders").select(F.greatest("o_custkey", "o_orderkey").alias("src"), F.least("o_custkey", "o_orderkey").alias("dst")).distinct()
    b = a.where("src % 3 > 0")
    return a.exceptAll(b).unionByName(b.exceptAll(a))


@check("so05_distinct_ids", ENC + "SELECT DISTINCT patient_id FROM encounter")
def _(v):
    return S.distinct_ids(v.encounter)
