"""Streaming checks (ST-*): each stream runs to the end of the available data."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.models import length_scorer
from checks.registry import check
from checks.sources import observation_resources
from checks.tasks import TB01
from checks.views import ts_sql, with_views
from wardline.operators.risk import record_schema
from wardline.plans import live as L
from wardline.plans import tasks as T
from wardline.session import scratch_path
from wardline.streaming import buckets as B
from wardline.streaming import ingest as I


def landed(v, tagged, name):
    """Resources as bundle files, one bundle per line."""
    path = scratch_path(v.spark, name)
    as_bundles(tagged).write.text(path)
    return path


def as_bundles(tagged):
    head, tail = F.lit('{"resourceType":"Bundle","entry":[{"resource":'), F.lit("}]}")
    return tagged.select(F.concat(head, "resource", tail).alias("value"))


_CHANGED = "observation_id::BIGINT % 7 = 0 AND value_unit IS NOT NULL"


@check(
    "st02_ingest_stream",
    with_views("observation")
    + f"""SELECT observation_id, patient_id, {ts_sql('effectivedatetime')} AS effectivedatetime, value_unit, 'stored' AS kind FROM observation
  UNION ALL SELECT observation_id, patient_id, {ts_sql('effectivedatetime')}, value_unit || '!', 'restated' FROM observation WHERE {_CHANGED}""",
)
def _(v):
    resources = observation_resources(v)
    # repeats and old records come in later batches, one file each; then some records with another unit
    landing = landed(v, resources.unionByName(resources).repartition(5), "landing")
    table, marks = scratch_path(v.spark, "observation"), scratch_path(v.spark, "marks")
    unit = F.regexp_replace("resource", '"unit":"([^"]*)"', '"unit":"$1!"')
    changed = resources.where(F.get_json_object("resource", "$.id").cast("long") % 7 == 0).withColumn("resource", unit)
    for more in (None, changed):
        if more is not None:
            as_bundles(more).write.mode("append").text(landing)
        stream = I.bundle_stream(v.spark, landing, files_per_trigger=2)
        I.ingest(stream, "observation", ["observation_id"], table, marks, buckets=16).awaitTermination()
    columns = ("observation_id", "patient_id", "effectivedatetime", "value_unit")
    stored = v.spark.read.parquet(table).select(*columns, F.lit("stored").alias("kind"))
    return stored.union(I.restated(v.spark, table).select(*columns, F.lit("restated")))


def steady_scorer():
    """A stand-in for an older model: always the same label."""
    return lambda texts: [[("A", 0.9)] for _ in texts]


@check(
    "st03_score_changes",
    TB01
    + """, t AS (SELECT patient_id, patient_id::INT % 3 = 0 AS again, length(head || 'Duration: ' || duration || chr(10) || 'ICD Version: ' || icd || chr(10) || chr(10)
  || 'Patient journey:' || chr(10) || hist) AS n FROM kept)
  SELECT 'Patient/' || patient_id AS subject, CASE WHEN NOT again OR n % 1000 > 500 THEN 'A' ELSE 'B' END AS outcome, count(*) AS n FROM t
  WHERE NOT (again AND n % 1000 = 500) GROUP BY 1, 2""",
)
def _(v):
    changes, tables = scratch_path(v.spark, "changes"), scratch_path(v.spark, "tables")
    out, marks = scratch_path(v.spark, "records"), scratch_path(v.spark, "marks")
    for name, df in v.tables.items():
        B.write_bucketed(df, f"{tables}/{name}", ["patient_id"], 16)
    now = F.lit("2002-01-01 00:00:00").cast("timestamp")
    owner, schema = F.regexp_replace("subject.reference", "^Patient/", ""), record_schema(v.spark)
    # all patients by one model, then a third of them, with the others' records left as they are, by the next
    for stays, load, model in ((v.encounter, steady_scorer, "m0"), (v.encounter.where("int(patient_id) % 3 = 0"), length_scorer, "m1")):

        def recompute(patients, numbers, load=load, model=model):
            own = {n: B.read_buckets(v.spark, f"{tables}/{n}", numbers).join(patients, "patient_id", "left_semi") for n in v.tables}
            return L.score_and_record(T.build_samples(own, T.ds_icd()), load, "ds_icd", model, now)[0]

        stays.write.mode("append").parquet(changes)
        stream = v.spark.readStream.schema(v.encounter.schema).parquet(changes)
        I.score_changes(stream, recompute, schema, out, marks, owner, 16).awaitTermination()
    records = I.current_records(v.spark, out, schema, 16)
    coding = F.get(F.get("prediction", F.lit(0))["qualitativeRisk"]["coding"], F.lit(0))
    rows = records.select(F.col("subject.reference").alias("subject"), coding["code"].alias("outcome"))
    return rows.groupBy("subject", "outcome").agg(F.count("*").alias("n"))


@check(
    "st04_daily_activity",
    """SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, count(*) AS n FROM events GROUP BY 1, 2""",
)
def _(v):
    batch = v.raw("events")
    landing, out, marks = (scratch_path(v.spark, n) for n in ("events", "activity", "marks"))
    batch.select("user_id", "ts").repartition(4).write.parquet(landing)
    stream = v.spark.readStream.option("maxFilesPerTrigger", 1).schema("user_id bigint, ts timestamp").parquet(landing)
    I.daily_activity(stream, out, marks, "ts", "user_id").awaitTermination()
    return I.read_activity(v.spark, out, "user_id")
