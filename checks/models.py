"""Metric, scoring and prediction record checks (AG-15..18, WN-04, UD-*, SRC-23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.tasks import TB04
from checks.views import ts_sql, with_views
from wardline.functions.scores import threshold_labels
from wardline.operators import metrics as M
from wardline.operators import risk as K
from wardline.operators import scoring as G
from wardline.plans import evaluate as E
from wardline.plans import live as L
from wardline.plans import tasks as T
from wardline.session import scratch_path

PRED = with_views("prediction")


@check(
    "ag15_binary_metrics",
    PRED
    + """, c AS (SELECT count_if(truth = 1 AND predicted = 1) AS tp, count_if(truth = 0 AND predicted = 1) AS fp,
  count_if(truth = 1 AND predicted = 0) AS fn, avg((truth = predicted)::INT) AS accuracy FROM prediction)
  SELECT round(accuracy, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
)
def _(v):
    return M.binary_metrics(v.prediction)


# Labels per document: quality and toxicity, each predicted by its own rule, and one that is only ever predicted.
MULTI = {
    "cells": """SELECT doc_id, 'good' AS label, truth AS t, predicted AS p FROM prediction UNION ALL
  SELECT doc_id, 'toxic', toxic, (doc_id % 7 = 0)::INT FROM prediction UNION ALL
  SELECT doc_id, 'spam', 0, (doc_id % 11 = 0)::INT FROM prediction""",
    "counts": "SELECT label, count_if(t = 1 AND p = 1) AS tp, count_if(t = 0 AND p = 1) AS fp, count_if(t = 1 AND p = 0) AS fn FROM cells GROUP BY 1",
    "per_class": """SELECT *, tp + fn AS support, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1
  FROM counts WHERE tp + fn + fp > 0""",
}
MULTI_OUT = """SELECT round(1 - sum(fp + fn) / (count(*) * (SELECT count(*) FROM prediction)), 6) AS accuracy, round(avg(pr), 6) AS macro_precision,
  round(avg(re), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(tp) / sum(tp + fp), 6) AS micro_precision,
  round(sum(tp) / sum(tp + fn), 6) AS micro_recall, round(2 * sum(tp) / sum(2 * tp + fp + fn), 6) AS micro_f1,
  round(sum(pr * support) / sum(support), 6) AS weighted_precision, round(sum(re * support) / sum(support), 6) AS weighted_recall,
  round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM {source}"""


def _multi(v):
    def listed(first, second, third):
        return F.array_compact(F.array(F.when(first, F.lit("good")), F.when(second, F.lit("toxic")), F.when(third, F.lit("spam"))))

    return v.prediction.select(
        "doc_id",
        listed(F.col("truth") == 1, F.col("toxic") == 1, F.lit(False)).alias("truth"),
        listed(F.col("predicted") == 1, F.col("doc_id") % 7 == 0, F.col("doc_id") % 11 == 0).alias("predicted"),
    )


@check("ag15_classification_metrics", with_views("prediction", more=MULTI) + MULTI_OUT.format(source="per_class"))
def _(v):
    return M.classification_metrics(_multi(v))


@check(
    "ag16_top_k_label_metrics",
    with_views("prediction", more={**MULTI, "top": "SELECT * FROM per_class ORDER BY support DESC, label LIMIT 1"})
    + MULTI_OUT.format(source="top"),
)
def _(v):
    return M.top_k_label_metrics(_multi(v), 1)


AUC = {
    "steps": "SELECT score, count_if(truth = 1) AS pos, count_if(truth <> 1) AS neg FROM prediction GROUP BY 1",
    "run": "SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM steps WINDOW w AS (ORDER BY score DESC)",
    "auc": """SELECT round(sum(neg * (cp - pos + pos / 2)) / (sum(pos) * sum(neg)), 6) AS auc_roc,
  round(sum(pos * cp / (cp + cn)) / sum(pos), 6) AS auc_pr FROM run""",
}


@check("ag17_ranking_metrics", with_views("prediction", more=AUC) + "SELECT * FROM auc")
def _(v):
    return M.ranking_metrics(v.prediction)


@check(
    "ag18_perplexity",
    "SELECT round(avg(p), 6) AS perplexity FROM (SELECT avg(exp(value / 100)) AS p FROM events GROUP BY user_id)",
)
def _(v):
    return M.perplexity(v.raw("events").selectExpr("user_id as batch", "value / 100 as loss"))


@check(
    "wn04_running_best",
    """WITH log AS (SELECT CASE event_type WHEN 'error' THEN 'eval_loss' ELSE event_type END AS metric, event_id AS step, value FROM events)
  SELECT metric, step, round(value, 6) AS value FROM log WINDOW w AS (PARTITION BY metric ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  QUALIFY coalesce(CASE WHEN metric LIKE '%loss%' THEN value < min(value) OVER w ELSE value > max(value) OVER w END, true)""",
)
def _(v):
    log = v.raw("events").selectExpr(
        "case event_type when 'error' then 'eval_loss' else event_type end as metric", "event_id as step", "value"
    )
    return M.running_best(log, "step", F.floor(F.col("step") / 512))


@check(
    "ud02_per_patient",
    with_views("encounter")
    + "SELECT patient_id, count(*) AS n, max(encounter_id) AS last_id FROM encounter GROUP BY 1",
)
def _(v):
    import pandas as pd

    def process(pdf):
        return pd.DataFrame(
            {"patient_id": [pdf.patient_id.iloc[0]], "n": [len(pdf)], "last_id": [pdf.encounter_id.max()]}
        )

    rows = v.encounter.select("patient_id", "encounter_id")
    return G.per_patient(rows, process, "patient_id string, n bigint, last_id string")


def length_scorer():
    """A stand-in model: two labels scored from the length of the whole text."""

    def score(texts):
        return [[("A", len(t) % 1000 / 1000), ("B", 1 - len(t) % 1000 / 1000)] for t in texts]

    return score


@check(
    "ud03_score_texts",
    """SELECT doc_id, label, round(CASE label WHEN 'A' THEN (length(text) % 1000) / 1000 ELSE 1 - (length(text) % 1000) / 1000 END, 6) AS score
  FROM documents, (SELECT unnest(['A', 'B']) AS label)""",
)
def _(v):
    scored = G.score_texts(v.raw("documents").select("doc_id", "text"), length_scorer)
    return scored.select("doc_id", F.inline("scores"))


@check(
    "ud04_threshold_labels",
    "SELECT doc_id, CASE WHEN (length(text) % 1000) / 1000 > 0.5 THEN 'A' WHEN 1 - (length(text) % 1000) / 1000 > 0.5 THEN 'B' ELSE '' END AS labels FROM documents",
)
def _(v):
    scored = G.score_texts(v.raw("documents").select("doc_id", "text"), length_scorer)
    kept = threshold_labels(F.col("scores"))
    return scored.select("doc_id", F.transform(kept, lambda s: s["label"]).alias("labels"))


NOW = "2024-06-01 00:00:00"


def _predictions(v):
    """Scored mortality-like predictions of every stay, keys missing on some."""
    return v.encounter.selectExpr(
        "case when int(encounter_id) % 11 > 0 then patient_id end as patient_id",
        "encounter_id",
        "case when int(encounter_id) % 13 > 0 then start end as sample_start",
        "concat('Patient history:\\n1990-01-01: ', type_display) as text",
        "status as prediction",
        "(int(encounter_id) % 100) / 100.0D as probability",
    )


GOOD = "encounter_id::INT % 11 > 0 AND encounter_id::INT % 13 > 0"


@check(
    "ud05_risk_assessment",
    with_views("encounter")
    + f"""SELECT 'RiskAssessment' AS "resourceType", sha256('wardline' || patient_id || 'm1' || encounter_id || strftime(start, '%Y-%m-%d %H:%M:%S')
  || '+00:00' || status || '{NOW}+00:00') AS id, 'final' AS status, 'Patient/' || patient_id AS subject, '{NOW}+00:00' AS occurred, 'm1' AS model,
  'Encounter/' || encounter_id || ',Encounter/' || sha256(patient_id || ':1990-01-01:' || type_display) AS basis,
  'Input text: Patient history:' || chr(10) || '1990-01-01: ' || type_display AS note, round((encounter_id::INT % 100) / 100.0, 6) AS probability,
  '2024-06-02 00:00:00+00:00' AS until, status AS outcome, 'Predicted Mortality Risk: ' || status AS display, 'https://host/fhir/ml/mortality' AS system
  FROM encounter WHERE {GOOD}""",
)
def _(v):
    ok, _rejected = K.publish_batch(_predictions(v))
    out = K.risk_assessment(ok, "ds_mortality", "m1", F.lit(NOW).cast("timestamp"), "https://host")
    p = F.get("prediction", F.lit(0))
    coding = F.get(p["qualitativeRisk"]["coding"], F.lit(0))
    return out.select(
        "resourceType",
        "id",
        "status",
        F.col("subject.reference").alias("subject"),
        F.col("occurrenceDateTime").alias("occurred"),
        F.get("method.coding", F.lit(0))["code"].alias("model"),
        F.transform("basis", lambda b: b["reference"]).alias("basis"),
        F.get("note", F.lit(0))["text"].alias("note"),
        p["probabilityDecimal"].alias("probability"),
        p["whenPeriod"]["end"].alias("until"),
        coding["code"].alias("outcome"),
        p["qualitativeRisk"]["text"].alias("display"),
        coding["system"].alias("system"),
    )


@check(
    "ud06_publish_batch",
    with_views("encounter")
    + f"SELECT count_if({GOOD}) AS accepted, count_if(NOT ({GOOD})) AS rejected FROM encounter",
)
def _(v):
    return K.publish_counts(_predictions(v))


@check(
    "ud07_evaluate_test_set",
    with_views("prediction", more={
        **AUC,
        "c": """SELECT count_if(truth = 1 AND predicted = 1) AS tp, count_if(truth = 0 AND predicted = 1) AS fp,
  count_if(truth = 1 AND predicted = 0) AS fn, avg((truth = predicted)::INT) AS accuracy FROM prediction"""
    })
    + """SELECT round(accuracy, 6) AS test_accuracy, round(tp / (tp + fp), 6) AS test_precision, round(tp / (tp + fn), 6) AS test_recall,
  round(2 * tp / (2 * tp + fp + fn), 6) AS test_f1, auc_roc AS test_auc_roc, auc_pr AS test_auc_pr FROM c, auc""",
)
def _(v):
    return E.evaluate_test_set(v.prediction.select("truth", "score"), "truth")


@check(
    "ud07_sample_predictions",
    PRED + "SELECT doc_id, truth, predicted FROM prediction ORDER BY doc_id LIMIT 10",
)
def _(v):
    return E.sample_predictions(v.prediction.select("doc_id", "truth", "predicted"), 10, ["doc_id"])


@check(
    "src23_write_risk_assessments",
    with_views("encounter")
    + f"""SELECT 'Patient/' || patient_id AS subject, status AS outcome, count(*) AS n FROM encounter WHERE {GOOD} GROUP BY 1, 2""",
)
def _(v):
    ok, _rejected = K.publish_batch(_predictions(v))
    path = scratch_path(v.spark, "risk")
    K.write_risk_assessments(K.risk_assessment(ok, "ds_mortality", "m1", F.lit(NOW).cast("timestamp")), path)
    back = v.spark.read.text(path).select(
        F.get_json_object("value", "$.subject.reference").alias("subject"),
        F.get_json_object("value", "$.prediction[0].qualitativeRisk.coding[0].code").alias("outcome"),
    )
    return back.groupBy("subject", "outcome").agg(F.count("*").alias("n"))


LIVE = "1997-06-15 12:00:00"
ONGOING = f"""SELECT * FROM encounter WHERE start <= TIMESTAMP '{LIVE}' AND "end" >= TIMESTAMP '{LIVE}'
  QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY start DESC, encounter_id DESC) = 1"""


@check(
    "st01_ongoing_encounters",
    with_views("encounter", more={"o": ONGOING}) + f"SELECT patient_id, encounter_id, {ts_sql('start')} AS start FROM o",
)
def _(v):
    now = F.lit(LIVE).cast("timestamp")
    return L.ongoing_encounters(v.encounter, now).select("patient_id", "encounter_id", "start")


LIVE_SQL = TB04.replace("FROM encounter e JOIN patient", "FROM current e JOIN patient").replace("stays AS (", f"current AS ({ONGOING}),\nstays AS (").replace(
    "FROM encounter n WHERE", "FROM current n WHERE"
)


@check(
    "st03_live_run",
    LIVE_SQL
    + f""", t AS (SELECT patient_id, encounter_id, length(head || 'ICD Version: ' || icd || chr(10) || chr(10) || 'Patient history:' || chr(10) || hist) AS n FROM told)
  SELECT 'Patient/' || patient_id AS subject, CASE WHEN n % 1000 > 500 THEN 'A' ELSE 'B' END AS outcome FROM t WHERE n % 1000 <> 500""",
)
def _(v):
    now = F.lit(LIVE).cast("timestamp")
    records, _rejected = L.live_run(v.tables, T.ds_readmission(), length_scorer, "m1", now)
    coding = F.get(F.get("prediction", F.lit(0))["qualitativeRisk"]["coding"], F.lit(0))
    return records.select(F.col("subject.reference").alias("subject"), coding["code"].alias("outcome"))
