"""From FHIR bundles to samples, as shown in the README."""

import json

from wardline.operators.cohort import COHORTS, build_encounters, encounter_cohort, patient_cohort
from wardline.operators.links import cohort_patients, merge_linked_patients
from wardline.operators.validate import raise_on_errors, validate
from wardline.plans.tasks import build_samples, ds_icd, ds_readmission, pretrain_fhir
from wardline.session import cut_lineage
from wardline.sources.bundles import read_bundles
from wardline.sources.flatten import FLATTENERS, TUMOR_FIRST_DATE, TUMOR_FORM, TUMOR_ID

SUBJECT = {"reference": "Patient/old"}
STAY = {"reference": "Encounter/e1"}


def coded(code, display=None, version=None):
    return {"coding": [{k: v for k, v in (("code", code), ("display", display), ("version", version)) if v}]}


def condition(i, when, code, version):
    return {
        "resourceType": "Condition", "id": i, "subject": SUBJECT, "encounter": STAY, "recordedDate": when,
        "code": coded(code, "Tumor", version), "category": [coded("HD")],
    }


RESOURCES = [
    {"resourceType": "Patient", "id": "new", "birthDate": "1960-05-01", "gender": "female", "link": [{"other": SUBJECT}],
     "identifier": [{"type": coded("MR")}, {"type": coded("GKV")}]},
    {"resourceType": "Patient", "id": "old", "birthDate": "1960-05-01", "gender": "female",
     "identifier": [{"type": coded("MR")}, {"type": coded("GKV")}]},
    {"resourceType": "Patient", "id": "stranger", "birthDate": "1970-01-01"},
    {"resourceType": "Encounter", "id": "e1", "status": "finished", "class": {"code": "IMP"}, "type": [coded("n", "Normalstationär")],
     "subject": SUBJECT, "period": {"start": "2020-03-01T10:00:00+01:00", "end": "2020-03-05T12:00:00+01:00"}},
    {"resourceType": "Encounter", "id": "short", "subject": {"reference": "Patient/stranger"},
     "period": {"start": "2020-03-01T10:00:00Z", "end": "2020-03-02T10:00:00Z"}},
    condition("c1", "2020-02-01T08:00:00Z", "C50.1", "2019"),
    condition("c2", "2020-02-01T09:00:00Z", "C50.1", "2020"),
    condition("c3", "2020-03-04T09:00:00Z", "C50.9", "2021"),
    {"resourceType": "Observation", "id": "o1", "subject": SUBJECT, "effectiveDateTime": "2020-03-01T09:30:00Z",
     "code": coded("hb", "Hb"), "valueQuantity": {"value": 12.5, "unit": "g/dl"}},
    {"resourceType": "Procedure", "id": "p1", "status": "completed", "subject": SUBJECT, "encounter": STAY,
     "code": coded("5-870", "Excision"), "performedDateTime": "2020-03-02T08:00:00Z"},
    {"resourceType": "EpisodeOfCare", "id": "t1", "patient": SUBJECT, "period": {"start": "2020-01-01"}, "extension": [
        {"url": TUMOR_FIRST_DATE, "valueDateTime": "2019-12-01"},
        {"url": TUMOR_ID, "extension": [{"url": TUMOR_FORM, "valueString": "DCP04BASIS"}]}]},
]


def tables_of(spark):
    bundle = json.dumps({"resourceType": "Bundle", "entry": [{"resource": r} for r in RESOURCES]})
    resources = read_bundles(spark.createDataFrame([(bundle,)], "value string"))
    raw = {name: cut_lineage(flatten(resources)) for name, flatten in FLATTENERS.items()}
    stays = build_encounters(raw["encounter"])
    people = cut_lineage(cohort_patients(merge_linked_patients(raw["patient"]), stays))
    tables = {name: cut_lineage(cohort(raw[name], people)) for name, cohort in COHORTS.items()}
    tables["encounter"] = encounter_cohort(stays, people)
    tables["patient"] = patient_cohort(people)
    return tables


HEAD = (
    "Patient metadata:\nage\t59\ngender\tfemale\ninsurance_type\tgesetzlich\n\n"
    "Encounter:\nBeginn\t2020-03-01 09:00:00+00:00\nKontakt Art\tNormalstationär\nArt\tIMP\n\n"
)


def test_samples_from_bundles(spark):
    tables = tables_of(spark)
    raise_on_errors(validate(tables))
    rows = build_samples(tables, ds_icd()).orderBy("sample_start").collect()
    early = HEAD + "Duration: 4\nICD Version: 2020\n\nPatient journey:\n2020-02-01:\n2x C50.1, Tumor"
    late = early.replace("journey:\n", "journey:\n2020-03-02:\n5-870, Excision\n")
    # cuts on 2, 3 and 4 March at 09:00 (end 5 March 11:00); the third equals the second
    assert [(r.patient_id, r.sample_start.day, r.labels, r.text) for r in rows] == [("new,old", 2, ["C50"], late)]

    row = build_samples(tables, ds_readmission()).first()
    assert row.labels == 0
    assert row.text == HEAD + (
        "ICD Version: 2021\n\nPatient history:\n2020-03-04:\nC50.9, Tumor\n2020-03-02:\n5-870, Excision\n"
        "2020-03-01:\nHb, 12.5, g/dl\n2020-02-01:\n2x C50.1, Tumor\n2020-01-01:\n2019-12-01, Gynäkologische Tumoren"
    )
    row = build_samples(tables, pretrain_fhir()).first()
    assert row.text == HEAD + (
        "Duration: 4\n\nTumor history: 2019-12-01 Gynäkologische Tumoren\n\nICD Version: 2021\n\nPatient journey in stay:\n"
        "2020-03-04:\nC50.9, Tumor\n2020-03-02:\n5-870, Excision\n2020-03-01:\nHb, 12.5, g/dl"
    )
