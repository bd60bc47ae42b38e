import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.session import scratch_path
from wardline.streaming import buckets as B
from wardline.streaming import ingest as I

BASE = dt.datetime(2020, 1, 1)


def land(spark, path, rows):
    lines = [
        json.dumps({"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "Observation", "id": i, "effectiveDateTime": f"{t:%Y-%m-%dT%H:%M:%S}Z"}}]})
        for i, t in rows
    ]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)


def test_restart_continues_and_repeats_are_dropped(spark):
    landing, table, marks = (scratch_path(spark, n) for n in ("landing", "obs", "marks"))

    def run():
        stream = I.bundle_stream(spark, landing)
        I.ingest(stream, "observation", ["observation_id"], table, marks).awaitTermination()
        return sorted(r.observation_id for r in spark.read.parquet(table).collect())

    land(spark, landing, [("a", BASE), ("b", BASE + dt.timedelta(days=1))])
    assert run() == ["a", "b"]
    land(spark, landing, [("b", BASE + dt.timedelta(days=1)), ("c", BASE + dt.timedelta(days=2))])
    assert run() == ["a", "b", "c"]
    land(spark, landing, [("late", BASE - dt.timedelta(days=4 * 365)), ("a", BASE)])
    assert run() == ["a", "b", "c", "late"]


def test_repeats_of_a_null_key_are_stored_once_and_changes_kept_apart(spark):
    landing, table, marks = (scratch_path(spark, n) for n in ("landing", "obs", "marks"))
    for rows in ([(None, BASE), ("a", BASE), (None, BASE)], [(None, BASE), ("b", BASE)], [(None, BASE + dt.timedelta(days=1)), ("a", BASE), ("b", BASE + dt.timedelta(days=2))]):
        land(spark, landing, rows)
        I.ingest(I.bundle_stream(spark, landing), "observation", ["observation_id"], table, marks, buckets=4).awaitTermination()
    stored = [(r.observation_id, r.effectivedatetime) for r in spark.read.parquet(table).collect()]
    assert sorted(stored, key=str) == [("a", BASE), ("b", BASE), (None, BASE)]
    assert sorted(((r.observation_id, r.effectivedatetime) for r in I.restated(spark, table).collect()), key=str) == [("b", BASE + dt.timedelta(days=2)), (None, BASE + dt.timedelta(days=1))]


def test_a_batch_reads_and_writes_its_buckets_only(spark):
    path, schema = scratch_path(spark, "store"), T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
    store = B.KeyedStore(spark, path, schema, 8)
    rows = spark.createDataFrame([(str(i), i) for i in range(40)] + [(None, -1)], schema)
    store.replace(0, rows, ["k"], B.touched(rows, ["k"], 8))
    few = spark.createDataFrame([("3", 300), (None, -2)], schema)
    numbers = B.touched(few, ["k"], 8)
    assert 0 < len(numbers) < 8
    read = store.read(numbers)
    assert {f.rsplit("bucket=", 1)[1].split("/")[0] for f in read.inputFiles()} == set(map(str, numbers))
    same = F.col("k").eqNullSafe(F.col("gone"))
    others = read.join(few.select(F.col("k").alias("gone")), same, "left_anti")
    store.replace(1, others.union(few), ["k"], numbers)
    want = {(str(i), 300 if i == 3 else i) for i in range(40)} | {(None, -2)}
    assert {tuple(r) for r in store.read().collect()} == want and store.read().count() == 41
    assert all(v == [1 if b in numbers else 0] for b, v in store.state().items())
    store.replace(2, store.read([]), ["k"], numbers)  # nothing remains in them
    assert set(store.state()).isdisjoint(numbers) and store.read(batch=1).count() == 41
    assert store.clear(keep=1) == 2 * len(numbers)
    left = store.read().count()
    for batch in range(3, 14):  # parts are merged now and then
        store.add(batch, spark.createDataFrame([("3", batch)], schema), ["k"], B.touched(few.limit(1), ["k"], 8))
    assert store.read().count() == left + 11 and max(map(len, store.state().values())) <= B.MOST_PARTS
    with pytest.raises(ValueError):
        B.KeyedStore(spark, path, schema, 9).read()


def test_bucketed_tables_are_read_by_partition_filter(spark, capsys):
    path = scratch_path(spark, "table")
    B.write_bucketed(spark.range(100).selectExpr("string(id) as patient_id", "id"), path, ["patient_id"], 8)
    read = B.read_buckets(spark, path, [1, 5])
    read.explain("formatted")
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ IN \(1,5\)", capsys.readouterr().out)
    assert read.count() == spark.range(100).where(B.bucket_of([F.col("id").cast("string")], 8).isin(1, 5)).count()


def test_recomputed_patients_keep_their_newer_records_only(spark):
    changes, out, marks = (scratch_path(spark, n) for n in ("changes", "records", "marks"))
    schema = "patient_id string, v int"
    records = T.StructType([T.StructField("subject", T.StringType()), T.StructField("run", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(number, rows, ends=0):
        def recompute(patients, numbers):
            assert numbers == B.touched(patients, ["patient_id"], 4)
            left = patients.where(f"{ends} = 0 or patient_id <> 'q'")
            return left.selectExpr("concat('P/', patient_id) as subject", f"{number} as run", f"explode(sequence(1L, {3 - number}L)) as n")

        if rows:
            spark.createDataFrame(rows, schema).write.mode("append").parquet(changes)
        stream = spark.readStream.schema(schema).parquet(changes)
        I.score_changes(stream, recompute, records, out, marks, F.substring("subject", 3, 9), 4).awaitTermination()
        return sorted((r.subject, r.run, r.n) for r in I.current_records(spark, out, records, 4).collect())

    assert run(1, [("p", 1), ("p", 2), ("q", 1)]) == [("P/p", 1, 1), ("P/p", 1, 2), ("P/q", 1, 1), ("P/q", 1, 2)]
    assert run(2, [("q", 2)]) == [("P/p", 1, 1), ("P/p", 1, 2), ("P/q", 2, 1)]
    assert run(2, [("q", 3)], ends=1) == [("P/p", 1, 1), ("P/p", 1, 2)]
    assert run(2, []) == [("P/p", 1, 1), ("P/p", 1, 2)]


def test_daily_activity_counts_late_rows(spark):
    landing, out, marks = (scratch_path(spark, n) for n in ("events", "days", "marks"))
    schema = "patient_id string, ts timestamp"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
        I.daily_activity(spark.readStream.schema(schema).parquet(landing), out, marks).awaitTermination()
        return sorted((r.patient_id, (r.day - BASE).days, r.n) for r in I.read_activity(spark, out).collect())

    day = dt.timedelta(days=1)
    assert run([("p", BASE), ("p", BASE + day / 2), ("p", BASE + 5 * day)]) == [("p", 0, 2), ("p", 5, 1)]
    assert run([("p", BASE), ("p", BASE + 9 * day)]) == [("p", 0, 3), ("p", 5, 1), ("p", 9, 1)]
