import base64
import json

from pyspark.sql import functions as F

from wardline.operators import cohort as C
from wardline.session import scratch_path
from wardline.sources import bundles as B
from wardline.sources import documents as D
from wardline.sources import flatten as X
from wardline.sources import tables as T


def tagged(spark, *resources):
    bundle = {"resourceType": "Bundle", "entry": [{"resource": r} for r in resources]}
    return B.read_bundles(spark.createDataFrame([(json.dumps(bundle),), ('{"resourceType":"Bundle"}',)], "value string"))


def test_missing_fields_become_null(spark):
    row = X.flatten_encounter(tagged(spark, {"resourceType": "Encounter", "id": "e1"})).first()
    assert row.encounter_id == "e1" and all(v is None for k, v in row.asDict().items() if k != "encounter_id")


def test_every_flattener_takes_an_empty_resource(spark):
    kinds = ["Patient", "Procedure", "Condition", "Observation", "DiagnosticReport", "EpisodeOfCare", "ServiceRequest", "BiologicallyDerivedProduct"]
    df = tagged(spark, *[{"resourceType": k, "id": "x"} for k in kinds])
    for name, flatten in X.FLATTENERS.items():
        assert flatten(df).count() == (0 if name in ("encounter", "imaging_study", "medication") else 1), name


def report(i, forms):
    return {"resourceType": "DiagnosticReport", "id": i, "presentedForm": forms}


def test_attachments(spark):
    data = base64.b64encode("Befund äöü".encode()).decode()
    df = tagged(
        spark,
        report("inline", [{"data": data, "contentType": "text/plain"}]),
        report("linked", [{"url": "u/pdf", "contentType": "application/pdf"}, {"url": "u/word", "contentType": "application/msword"}]),
        report("none", []),
    )
    out = {r.diagnostic_report_id: r for r in D.decode_attachments(X.flatten_diagnostic_report(df)).collect()}
    assert out["inline"].text == "Befund äöü" and not out["inline"].failed
    assert out["linked"].url == "u/word" and out["linked"].text is None
    assert out["none"].failed and out["none"].failure == "no attachment"
    bad = tagged(spark, report("two", [{"data": data}, {"data": data}]), report("odd", [{"data": "%%%"}]), report("fine", [{"data": data}]))
    failed = D.failed_documents(D.decode_attachments(X.flatten_diagnostic_report(bad)))
    assert {tuple(r) for r in failed.collect()} == {("two", "more than one inline attachment"), ("odd", "inline attachment is not base64")}


def test_unreadable_lines_and_entries_are_kept_with_a_reason(spark):
    good = json.dumps({"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "Patient", "id": "p"}}, {"resource": {"id": "untyped"}}, {"fullUrl": "u"}, None]})
    lines = [good, good[:-9], "no json", '["a"]', '{"resourceType":"Patient","id":"single"}', "  ", None, '{"resourceType":"Bundle"}', '{"resourceType":"Bundle","entry":{}}', '{"entry":[{"resource":{"resourceType":"Patient","id":"q"}}]}']
    path = scratch_path(spark, "landing")
    B.land_bundles(spark.createDataFrame([(x,) for x in lines], "value string"), path)
    rejects = sorted(((r.raw, r.reason) for r in B.rejected(spark, path).collect()), key=str)
    form = "not a JSON object of a bundle's form"
    assert rejects == sorted(
        [('{"id":"untyped"}', "resource without a type"), (None, "entry without a resource"), *((lines[i], form) for i in (1, 2, 3, 8)), (lines[4], "not a bundle"), (lines[9], "not a bundle"), ("  ", "empty line"), (None, "empty line")],
        key=str,
    )
    assert [r.patient_id for r in X.flatten_patient(B.landed(spark, path)).collect()] == ["p"]


def test_a_flattener_reads_its_own_folder(spark, capsys):
    path = scratch_path(spark, "landing")
    bundle = {"resourceType": "Bundle", "entry": [{"resource": {"resourceType": k, "id": "x"}} for k in ("Patient", "Condition", "Procedure")]}
    B.land_bundles(spark.createDataFrame([(json.dumps(bundle),)], "value string"), path)
    conditions = X.flatten_condition(B.landed(spark, path))
    assert conditions.count() == 1
    conditions.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters:" in plan and "= Condition)" in plan.split("PartitionFilters:")[1].split("\n")[0]


def test_product_keeps_the_right_code_system(spark):
    df = tagged(
        spark,
        {
            "resourceType": "BiologicallyDerivedProduct",
            "id": "b",
            "request": [{"reference": "ServiceRequest/s"}],
            "extension": [{"url": X.PRODUCT_USE, "valueString": "AUSGABE"}],
            "productCode": {"coding": [{"system": "x", "code": "no"}, {"system": X.PRODUCT_KIND, "code": "yes"}]},
        },
        {"resourceType": "ServiceRequest", "id": "s", "subject": {"reference": "Patient/p"}, "requester": {"extension": [{"valueString": "W"}]}},
    )
    row = X.flatten_bdp(df).first()
    assert (row.code, row.patient_id, row.ausgabe_type, row.output_to_einskurz) == ("yes", "p", "AUSGABE", None)


def test_build_or_reuse(spark):
    path = scratch_path(spark, "stage")
    assert not T.finished(spark, path)
    assert T.build_or_reuse(spark, path, lambda: spark.range(3)).count() == 3
    assert T.build_or_reuse(spark, path, lambda: spark.range(5)).count() == 3
    assert T.build_or_reuse(spark, path, lambda: spark.range(5), rerun=True).count() == 5


def test_document_store_is_partitioned_by_category(spark):
    docs = spark.createDataFrame([(str(i), f"t{i}", "a" if i % 3 else "b") for i in range(30)], "diagnostic_report_id string, text string, category_name string")
    path = scratch_path(spark, "docs")
    D.write_documents(docs, path)
    back = spark.read.parquet(path)
    assert back.count() == 30 and back.where(F.col("category") == "b").count() == 10


def test_live_cohort_keeps_the_latest_ongoing_stay(spark):
    rows = [("p", "old", "2020-01-01", "2020-03-01"), ("p", "new", "2020-02-01", "2099-01-01"), ("p", "gone", "2020-01-01", "2020-01-05"), ("q", "other", "2020-02-10", "2020-02-20")]
    enc = spark.createDataFrame(rows, "patient_id string, encounter_id string, start string, end string").selectExpr("patient_id", "encounter_id", "timestamp(start) as start", "timestamp(end) as end")
    dim = spark.createDataFrame([("p", "p,r"), ("x", "x")], "patient_id string, linked_patient_id string")
    out = C.encounter_cohort(enc, dim, F.lit("2020-02-15").cast("timestamp")).collect()
    assert [(r.patient_id, r.original_patient_id, r.encounter_id) for r in out] == [("p,r", "p", "new")]


def test_two_types_are_taken_in_one_pass(spark):
    product = {"resourceType": "BiologicallyDerivedProduct", "id": "b", "request": [{"reference": "ServiceRequest/s"}]}
    request = {"resourceType": "ServiceRequest", "id": "s", "subject": {"reference": "Patient/p"}}
    given = {"resourceType": "MedicationAdministration", "medicationReference": {"reference": "Medication/m"}}
    drug = {"resourceType": "Medication", "id": "m", "code": {"text": "d"}}
    lines = [(json.dumps({"resourceType": "Bundle", "entry": [{"resource": r}]}),) for r in (product, request, given, drug)]
    read = spark.sparkContext.accumulator(0)

    def touch(line):
        read.add(1)
        return line

    df = spark.createDataFrame(lines, "value string").select(F.udf(touch)("value").alias("value"))
    for flatten, found in ((X.flatten_bdp, ("b", "s", "p")), (X.flatten_medication, ("m", "d"))):
        read.value = 0
        rows = [{**r.asDict()} for r in flatten(B.read_bundles(df)).collect()]
        assert len(rows) == 1 and set(found) <= set(rows[0].values())
        assert read.value == len(lines)


def test_types_are_found_wherever_they_stand(spark):
    texts = [
        '{"resourceType":"A","id":"1"}', '{ "resourceType" : "B" }', '{"id":"it\'s","resourceType":"C"}', '{"resourceType":"D\\u0022"}', '{"resourceType":""}',
        '{"resourceType":null}', '{"contained":[{"resourceType":"E"}]}', json.dumps('{"resourceType":"F'), json.dumps('{"resourceType":"G"}'), '{"resourceType":"H","resourceType":"I"}',
        "'{\"resourceType\":\"J'",
    ]
    lines = ['{"resourceType":"Bundle","entry":[{"resource":%s}]}' % t for t in texts]
    rows = B.parse_bundles(spark.createDataFrame([(x,) for x in lines], "value string"))
    kind = F.get_json_object("resource", "$.resourceType")
    wrong = rows.where(~F.col("resource_type").eqNullSafe(F.coalesce(kind, F.lit(B.REJECTED))))
    assert rows.count() == len(lines) and wrong.collect() == []
