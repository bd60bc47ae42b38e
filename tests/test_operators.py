import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import links as K
from wardline.operators import metrics as M
from wardline.operators import rows as R
from wardline.operators import splits as S
from wardline.operators import validate as V
from wardline.operators.risk import history_references
from wardline.operators.skew import hot_keys, salted_join


def test_salted_join_equals_plain_join(spark):
    rows = [("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(50)]
    left = spark.createDataFrame(rows, "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k7", 3)], "k string, v int")
    hot = hot_keys(left, ["k"], max_hot=10, min_rows=20)
    assert [(r.k, r._salts) for r in hot.collect()] == [("hot", 10)]
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = sorted(map(tuple, salted_join(left, right, ["k"], how, hot, ["i"]).collect()), key=str)
        assert got == sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
    with pytest.raises(ValueError):
        salted_join(left, right, ["k"], "right", hot, ["i"])


def person(i, links=(), birth="1950-01-01", sex="male", death=None, ins="PKV"):
    return (i, dt.date.fromisoformat(birth), sex, ins, dt.datetime.fromisoformat(death) if death else None, list(links))


SCHEMA = "patient_id string, birth_date date, sex string, insurance_type string, deceased_date timestamp, links array<string>"


def test_merge_linked_patients(spark):
    rows = [
        person("m1", ["a1", "a2"], death="2020-01-04"), person("a1", death="2020-01-01", sex="female"), person("a2", ins="GKV"),
        person("m2", ["b1"], birth="1950-01-02"), person("b1"),
        person("m3", ["c1"], death="2020-01-05"), person("c1", death="2020-01-01"),
        person("m4", ["d1"], sex="other"), person("d1", sex=None),
        person("z"),
    ]
    out = {r.patient_id: r for r in K.merge_linked_patients(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: r.linked_patient_id for k, r in out.items()} == {
        "m1": "a1,a2,m1", "a1": "a1,a2,m1", "a2": "a1,a2,m1",
        "m2": "m2", "m3": "m3", "m4": "d1,m4", "d1": "d1,m4", "z": "z",
    }
    assert out["a2"].sex == "unknown" and out["a2"].insurance_type == "GKV,PKV"
    assert out["a2"].deceased_date == dt.datetime(2020, 1, 1)
    assert out["d1"].sex == "other"


def test_first_rows_and_last_non_null(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 5, "q")], "k string, t int, v string")
    assert sorted(map(tuple, R.first_rows(df, ["k"], ["t"]).collect())) == [("a", 1, "x"), ("b", 5, "q")]
    assert sorted(map(tuple, R.first_rows(df, ["k"], ["t"], last=True).collect()), key=str) == [("a", 2, None), ("b", 5, "q")]
    assert sorted(map(tuple, R.last_non_null(df, "k", "t").collect())) == [("a", 2, "x"), ("b", 5, "q")]


def test_validation(spark):
    df = spark.createDataFrame([("p", None), ("q", "C1")], "patient_id string, icd_code string")
    report = V.validate({"condition": df})
    assert {(r.column_name, r.nulls) for r in report.collect()} == {("patient_id", 0), ("icd_code", 1)}
    with pytest.raises(ValueError, match="condition.icd_code"):
        V.raise_on_errors(report)


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(3)
    rows = [(f"p{rng.randrange(200)}", f"e{i}", [f"L{rng.randrange(15)}" for _ in range(rng.randrange(3))]) for i in range(600)]
    rows.append(("p-only", "e-only", ["rare"]))
    return spark.createDataFrame(rows, "patient_id string, encounter_id string, labels array<string>").cache()


def test_split_covers_labels_without_overlap(spark, samples):
    split = S.label_covering_split(samples)
    rows = split.collect()
    ids = [r.patient_id for r in rows]
    n = samples.select("patient_id").distinct().count()
    assert len(ids) == len(set(ids)) == n
    train = {r.patient_id for r in rows if r.split == "train"}
    assert len(train) == int(0.8 * n)
    for label, patients in S.label_to_patients(samples).groupBy("label").agg(F.collect_set("patient_id")).collect():
        assert train & set(patients), label
    S.check_split(split)
    with pytest.raises(ValueError):
        S.check_split(split.withColumn("split", F.lit("test")))


def test_single_patient_and_unlabelled_split(spark):
    one = spark.createDataFrame([("p", ["a"])], "patient_id string, labels array<string>")
    assert [tuple(r) for r in S.label_covering_split(one).collect()] == [("p", "train")]
    plain = spark.createDataFrame([(str(i),) for i in range(10)], "patient_id string")
    assert S.label_covering_split(plain).where("split = 'train'").count() == 8


def test_ranks_are_a_permutation(spark, samples):
    ids = S.distinct_ids(samples)
    ranks = sorted(r.rank for r in S.hash_rank(ids, ["patient_id"]).collect())
    assert ranks == list(range(1, len(ranks) + 1))
    slices = S.equal_slices(ids, 7, ["patient_id"]).groupBy("slice").count().collect()
    sizes = {r["slice"]: r["count"] for r in slices}
    assert set(sizes) == set(range(7)) and all(sizes[i] == len(ranks) // 7 for i in range(6))
    assert S.sample_n(ids, 5, ["patient_id"]).count() == 5


def test_folds_keep_patients_whole_and_balanced(samples):
    folds = S.stratified_group_split(samples)
    assert folds.count() == folds.select("patient_id").distinct().count()
    worst = folds.groupBy("stratum").pivot("fold", [0, 1, 2, 3, 4]).count().fillna(0).collect()
    assert all(max(r[1:]) - min(r[1:]) <= 1 for r in worst)


def test_balancing(spark):
    df = spark.createDataFrame([(i, 1 if i < 10 else 0) for i in range(100)], "i int, labels int")
    assert S.balance_1_1(df, ["i"]).groupBy("labels").count().orderBy("labels").collect() == [(0, 10), (1, 10)]
    lists = spark.createDataFrame([(i, ["x"] if i < 90 else []) for i in range(200)], "i int, labels array<string>")
    out = S.balance_weighted(lists, ["i"])
    assert out.where("size(labels) > 0").count() == 90 and out.where("size(labels) = 0").count() == 10
    only = lists.where("i < 90")
    assert S.balance_weighted(only, ["i"]).count() == 90


def test_metrics_with_missing_classes(spark):
    rows = [(["a"], ["a", "b"]), (["a", "c"], ["a"]), (["b"], []), ([], ["x"])]
    df = spark.createDataFrame(rows, "truth array<string>, predicted array<string>")
    r = M.classification_metrics(df).first()
    # a: tp 2; b: fp 1, fn 1; c: fn 1; x, which the truth never has: fp 1
    assert r.accuracy == pytest.approx(1 - 4 / 16)
    assert r.macro_precision == pytest.approx(1 / 4) and r.macro_recall == pytest.approx(1 / 4)
    assert r.micro_precision == pytest.approx(2 / 4) and r.micro_recall == pytest.approx(2 / 4)
    assert r.weighted_recall == pytest.approx(0.5)


def test_auc_agrees_with_spark_ml(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector

    rng = random.Random(5)
    rows = [(rng.randrange(2), rng.randrange(30) / 30) for _ in range(400)]
    df = spark.createDataFrame(rows, "truth int, score double")
    got = M.ranking_metrics(df, ranges=8).first()
    ml = df.select(F.col("truth").cast("double").alias("label"), array_to_vector(F.array(F.lit(1) - F.col("score"), F.col("score"))).alias("rawPrediction"))
    assert got.auc_roc == pytest.approx(BinaryClassificationEvaluator(numBins=0).evaluate(ml), abs=1e-9)
    same = M.ranking_metrics(df.where("truth = 1")).first()
    assert same.auc_roc is None and same.auc_pr == pytest.approx(1.0)


def test_running_best_over_buckets(spark):
    values = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5]
    rows = [(m, i, float(v)) for m in ("acc", "eval_loss") for i, v in enumerate(values)]
    log = spark.createDataFrame(rows, "metric string, step int, value double")
    out = M.running_best(log, "step", F.floor(F.col("step") / 3)).collect()
    got = {m: sorted((r.step, r.value) for r in out if r.metric == m) for m in ("acc", "eval_loss")}
    assert got == {"acc": [(0, 3.0), (2, 4.0), (4, 5.0), (5, 9.0)], "eval_loss": [(0, 3.0), (1, 1.0)]}


def test_rare_labels_spread_over_folds(spark):
    from wardline.operators.splits import stratified_group_split

    rows = spark.createDataFrame([(f"p{i}", [f"rare{i}"]) for i in range(100)], "patient_id string, labels array<string>")
    sizes = [r["count"] for r in stratified_group_split(rows).groupBy("fold").count().collect()]
    assert len(sizes) == 5 and min(sizes) >= 8  # 20 each, give or take three standard deviations


def test_predictions_of_unseen_labels_count(spark):
    from wardline.operators.metrics import class_counts

    rows = spark.createDataFrame([(["a"], ["a", "x"]), (["a"], ["a", "y"])], "truth array<string>, predicted array<string>")
    assert {(r.label, r.tp, r.fp, r.fn) for r in class_counts(rows).collect()} == {("a", 2, 0, 0), ("x", 0, 1, 0), ("y", 0, 1, 0)}
    known = spark.createDataFrame([("a",), ("b",)], "label string")
    assert {(r.label, r.tp, r.fp, r.fn) for r in class_counts(rows, classes=known).collect()} == {("a", 2, 0, 0), ("b", 0, 0, 0)}


def test_references_read_dated_blocks_and_lines(spark):
    text = "age\t40\n\nPatient journey:\n2020-03-01:\nlate\n2020-01-02:\n2x a, b\nc: d\n2020-01-02:\n\ne\n2020-01-01: f\nundated"
    row = spark.createDataFrame([(text, "p")], "text string, p string")
    refs = history_references(F.col("text"), F.col("p"), F.lit("2020-02-01 00:00:00+00:00"), "Condition")
    got = [r.display for r in row.select(F.inline(refs)).collect()]
    assert got == ["2x a, b on 2020-01-02", "c: d on 2020-01-02", "e on 2020-01-02", "f on 2020-01-01"]


def test_ranges_of_crowded_scores_stay_even(spark):
    crowded = spark.range(20_000).selectExpr("int(id % 3 = 0) as truth", "if(id % 100 = 0, id / 100, 1000 + id / 20000000) as score")
    steps = M.score_steps(crowded, ranges=16)
    sizes = [r["count"] for r in steps.groupBy("b").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * sum(sizes) / 16
    assert M.ranking_metrics(crowded, ranges=16).first() == M.ranking_metrics(crowded, ranges=1).first()
    assert M.ranking_metrics(crowded.withColumn("score", F.lit(None).cast("double"))).first().auc_roc is None


def test_null_predictions_are_misses_and_classes_can_be_given(spark):
    rows = [(["a"], None), (["a", "b"], ["a"]), (None, ["c"])]
    df = spark.createDataFrame(rows, "truth array<string>, predicted array<string>")
    counts = {r.label: (r.tp, r.fp, r.fn) for r in M.class_counts(df).collect()}
    assert counts == {"a": (1, 0, 1), "b": (0, 0, 1), "c": (0, 1, 0)}
    classes = spark.createDataFrame([("a",), ("d",)], "label string")
    got = M.classification_metrics(df, classes=classes).first()
    assert got.macro_recall == pytest.approx(0.25) and got.accuracy == pytest.approx(1 - 1 / 6)


def test_folds_of_label_combinations_are_even(spark):
    rng = random.Random(12)
    rows = [(f"p{i}", rng.sample("abcdefgh", rng.choice([0, 1, 1, 2, 3])) + ["common"] * (i % 3 > 0)) for i in range(900)]
    rows += [(f"p{i}", ["b"]) for i in range(0, 900, 50)]  # a second sample of some patients
    samples = spark.createDataFrame(rows, "patient_id string, labels array<string>")
    folds = {r.patient_id: (r.stratum, r.fold) for r in S.combo_group_split(samples).collect()}
    assert len(folds) == 900
    of = {p: set() for p in folds}
    for p, labels in rows:
        of[p] |= set(labels)

    def spread(patients):
        counts = [sum(folds[p][1] == f for p in patients) for f in range(5)]
        return max(counts) - min(counts)

    for combo in set(map(frozenset, of.values())):
        assert spread([p for p in of if of[p] == combo]) <= 1
    for label in "abcdefgh":
        holders = [p for p in of if label in of[p]]
        assert spread(holders) <= max(3, 0.1 * len(holders)), label
    assert spread([p for p in of if "common" in of[p]]) <= 30


def test_per_patient_converts_batches_not_patients(spark):
    import pandas as pd

    from wardline.operators.scoring import per_patient

    rows = [(str(i % 700) if i % 700 else None, str(i)) for i in range(7000)] + [("hot", str(i)) for i in range(25000)]

    def process(pdf):
        assert pdf.index.tolist() == list(range(len(pdf)))
        n = pd.Series([len(pdf)], dtype="int64") if len(pdf) > 1 else pd.Series([None], dtype="object")
        return pd.DataFrame({"patient_id": [pdf.patient_id.iloc[0]], "n": n, "last": [pdf.row.max()]})

    df = spark.createDataFrame(rows + [("one", "1")], "patient_id string, row string")
    out = per_patient(df, process, "patient_id string, n bigint, last string")
    expected = {}
    for k, x in rows:
        n, last = expected.get(k, (0, ""))
        expected[k] = (n + 1, max(last, x))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(k, *v) for k, v in expected.items()] + [("one", None, "1")], key=str)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    assert per_patient(df.selectExpr("patient_id", "int(row) as row"), lambda pdf: pdf, "patient_id string, row int").count() == len(rows) + 1
