import datetime as dt
import random
import re
from collections import Counter, defaultdict
from functools import partial

import pytest
from pyspark.sql import functions as F

from wardline.functions.texts import strip_end
from wardline.operators import history as H
from wardline.operators import labels as L
from wardline.operators.skew import hot_keys
from wardline.plans import tasks as T
from wardline.session import cut_lineage

BASE = dt.datetime(2020, 1, 1)
HOUR, DAY = dt.timedelta(hours=1), dt.timedelta(days=1)


def expected_history(events, lo, hi, hi_incl):
    """Day blocks written out one event at a time."""
    days = defaultdict(list)
    for ts, resource, line in sorted(events):
        if (lo is None or ts >= lo) and (ts <= hi if hi_incl else ts < hi):
            days[(ts.date(), resource)].append(line)
    blocks = []
    for (day, _), lines in sorted(days.items(), key=lambda x: x[0], reverse=True):
        counts = Counter(lines)
        shown = [f"{n}x {x}" if n > 1 else x for x, n in counts.items()]
        blocks.append(f"{day}:\n" + "\n".join(shown))
    return "\n".join(blocks).strip()


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(7)
    events, stays, rows = defaultdict(list), [], []
    for p in range(6):
        for i in range(40 if p else 400):
            ts = BASE + HOUR * rng.randrange(24 * 40)
            resource = rng.choice(["condition", "procedure"])
            line = rng.choice(["C50.1", "C50.9", "GB1", "D01.2"]) if resource == "condition" else rng.choice("xyz")
            events[str(p)].append((ts, resource, line))
            rows.append((str(p), ts, resource, line, f"v{i}" if resource == "condition" else None))
        for s in range(5):
            start = BASE + HOUR * rng.randrange(24 * 30)
            stays.append((str(p), f"{p}-{s}", start, start + HOUR * rng.randrange(24 * 9)))
    lines = spark.createDataFrame(rows, "patient_id string, ts timestamp, resource string, line string, icd_version string")
    encounters = spark.createDataFrame(stays, "patient_id string, encounter_id string, start timestamp, end timestamp")
    return events, stays, lines, encounters


@pytest.mark.parametrize("inclusive", [False, True])
def test_history_before_equals_plain_rendering(world, inclusive):
    events, stays, lines, encounters = world
    cuts = H.own_days(encounters.withColumn("cut", F.col("end")), lines, ("condition", "procedure"), inclusive)
    cuts = cuts.join(H.patient_days(lines, ("condition", "procedure")), "patient_id")
    got = {r.encounter_id: r.history for r in H.history_before(cuts).collect()}
    want = {e: expected_history(events[p], None, end, inclusive) for p, e, _, end in stays}
    assert got == {k: v for k, v in want.items() if v}


def test_only_records_before_the_last_cut_are_rendered(world):
    events, stays, lines, encounters = world
    some = encounters.where("encounter_id like '%-1'").withColumn("cut", F.col("end"))
    days = H.patient_days(H.lines_until(lines, some), ("condition", "procedure"))
    told = H.own_days(some, lines, ("condition", "procedure"))
    got = {r.encounter_id: r.history for r in H.history_before(told.join(days, "patient_id")).collect()}
    want = {e: expected_history(events[p], None, end, False) for p, e, _, end in stays if e.endswith("-1")}
    assert got == {k: v for k, v in want.items() if v}
    last = some.groupBy("patient_id").agg(F.to_date(F.max("cut")).alias("last"))
    each = days.select("patient_id", F.inline("_days")).join(last, "patient_id")
    assert each.where("day > last").count() == 0
    counts = {r.encounter_id: r.n for r in told.select("encounter_id", "_own.n").collect()}
    assert len(counts) == some.count()
    for p, e, _, end in stays:
        if e.endswith("-1"):
            assert (counts[e] or 0) == sum(ts.date() == end.date() and ts < end for ts, *_ in events[p])


def test_history_during_equals_plain_rendering(world):
    events, stays, lines, encounters = world
    got = {r.encounter_id: r.history for r in H.history_during(encounters, lines, ["patient_id", "encounter_id"]).collect()}
    want = {e: expected_history(events[p], start, end, True) for p, e, start, end in stays}
    assert got == {k: v for k, v in want.items() if v}


def make_tables(world, spark):
    events, stays, lines, encounters = world
    cond = lines.where("resource = 'condition'").select(
        "patient_id",
        F.expr("uuid()").alias("condition_id"),
        F.col("ts").alias("condition_date"),
        F.col("line").alias("icd_code"),
        F.lit(None).cast("string").alias("icd_display"),
        "icd_version",
    )
    proc = lines.where("resource = 'procedure'").select(
        "patient_id", F.expr("uuid()").alias("procedure_id"), F.col("ts").alias("start"), F.col("line").alias("code"),
        F.lit(None).cast("string").alias("display"),
    )
    person = encounters.select("patient_id").distinct().select(
        "patient_id", F.lit("1980-01-01").cast("date").alias("birth_date"), F.lit("female").alias("sex"),
        F.lit("privat").alias("insurance_type"), F.lit(None).cast("timestamp").alias("deceased_date"),
    )
    return {"condition": cond.cache(), "procedure": proc.cache(), "encounter": encounters, "patient": person}


def expected_icd(events, stays):
    out = set()
    for p, e, start, end in stays:
        if (end - start).days <= 2:
            continue
        previous = None
        cut = start + DAY
        while cut <= end - DAY:
            codes = {x.split(".")[0] for ts, r, x in events[p] if r == "condition" and cut <= ts <= end and not x.startswith("GB")}
            hist = expected_history(events[p], None, cut, False)
            if codes and hist and (hist, codes) != previous:
                previous = (hist, codes)
                out.add((e, cut, tuple(sorted(codes)), hist))
            cut += DAY
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_ds_icd_equals_loop_also_with_a_hot_patient(world, spark, monkeypatch, hot):
    events, stays, _, _ = world
    if hot:
        monkeypatch.setattr(T, "hot_keys", partial(hot_keys, min_rows=2))
    out = T.build_samples(make_tables(world, spark), T.ds_icd()).collect()
    got = {(r.encounter_id, r.sample_start, tuple(r.labels), r.text.split("Patient journey:\n")[1]) for r in out}
    assert got == expected_icd(events, stays)
    assert len(out) == len(got)


def test_unchanged_cuts_a_b_a(spark):
    rows = [
        ("e", i, BASE + DAY * i, labels, [2, 3])
        for i, labels in enumerate([["A"], ["A"], ["B"], ["A"], ["A"]], start=1)
    ]
    df = spark.createDataFrame(rows, "encounter_id string, _index int, cut timestamp, labels array<string>, _steps array<int>")
    df = df.withColumns({"patient_id": F.lit("p"), "_first_ts": F.lit(None).cast("timestamp")})
    assert sorted(r.cut.day for r in T.drop_unchanged(df).collect()) == [2, 4, 5]


def test_readmission_bounds(spark):
    end = BASE + DAY
    gaps = [dt.timedelta(0), dt.timedelta(seconds=1), DAY * 30, DAY * 30 + dt.timedelta(seconds=1)]
    rows = []
    for i, gap in enumerate(gaps):
        rows += [(str(i), f"a{i}", BASE, end), (str(i), f"b{i}", end + gap, end + gap + HOUR)]
    df = spark.createDataFrame(rows, "patient_id string, encounter_id string, start timestamp, end timestamp")
    got = {r.encounter_id: r.followed for r in L.followed_by(df).collect() if r.encounter_id[0] == "a"}
    assert got == {"a0": False, "a1": True, "a2": True, "a3": False}


def test_followed_by_equals_pairs(world):
    _, stays, _, encounters = world
    got = {r.encounter_id: r.followed for r in L.followed_by(encounters, 3).collect()}
    want = {e: any(q == p and end < s2 <= end + DAY * 3 for q, _, s2, _ in stays) for p, e, _, end in stays}
    assert got == want


def test_death_label(spark):
    died = [BASE - HOUR, BASE, BASE + DAY * 6, BASE + DAY * 6 + dt.timedelta(seconds=1), None]
    rows = [(i, BASE, BASE + DAY * 5, d) for i, d in enumerate(died)]
    df = spark.createDataFrame(rows, "i int, start timestamp, end timestamp, deceased_date timestamp")
    got = [r.y for r in df.select("i", L.Death().value_at(F.col("end")).alias("y")).orderBy("i").collect()]
    assert got == [0, 1, 1, 0, 0]


def test_modalities_fold_to_one_label_and_cuts_are_limited(spark):
    stays = spark.createDataFrame([("p", "e", BASE, BASE + DAY * 40)], "patient_id string, encounter_id string, start timestamp, end timestamp")
    stays = stays.withColumn("cuts", T.daily_cuts(30)())
    images = spark.createDataFrame(
        [("p", BASE + DAY * 20, m) for m in ("CT", "SR", "KO")], "patient_id string, started timestamp, modality_code string"
    )
    rule = L.modality_labels()
    out = rule.attach(stays, {"imaging_study": images}).withColumn("cut", F.explode("cuts"))
    got = out.select("cut", rule.value_at(F.col("cut")).alias("labels")).orderBy("cut").collect()
    assert len(got) == 30
    assert got[0].labels == ["CT", "OT"] and got[19].labels == ["CT", "OT"] and got[20].labels == []


def test_items_are_joined_once_for_all_views(spark):
    from checks.views import Views

    v = Views(spark, "/root/testdata/sf0.001").tables
    files = [v[n].inputFiles() for n in ("condition", "procedure", "imaging_study", "medication", "biologically_derived_product")]
    assert all(sorted(f) == sorted(files[0]) for f in files)
    assert not any("lineitem" in f for f in files[0])


def test_patient_days_are_those_of_the_day_texts(spark):
    rows = [
        ("p", "2020-01-01 08:00:00", "condition", "a", "2019"),
        ("p", "2020-01-01 08:00:00", "condition", "a", "2020"),
        ("p", "2020-01-01 07:00:00", "condition", "b", None),
        ("p", "2020-01-01 09:00:00", "procedure", "c", None),
        ("p", "2020-01-01 09:00:00", "medication", "left out", None),
        ("p", "2020-01-03 09:00:00", "procedure", "", None),
        (None, "2020-01-03 09:00:00", "procedure", "d", None),
    ]
    lines = spark.createDataFrame(rows, "patient_id string, ts string, resource string, line string, icd_version string")
    days = H.patient_days(lines.withColumn("ts", F.col("ts").cast("timestamp")), ("condition", "procedure")).collect()
    got = {r.patient_id: [(str(d.day), d.n, d.text, d.icd and d.icd.icd_version) for d in r["_days"]] for r in days}
    first = "2020-01-01:\nc\n2020-01-01:\nb\n2x a"
    assert got == {
        "p": [("2020-01-03", 1, "2020-01-03:\n", None), ("2020-01-01", 4, first, "2020")],
        None: [("2020-01-03", 1, "2020-01-03:\nd", None)],
    }


def record_tables(spark):
    """Conditions with copies and null keys, medications without a key."""
    t = "2020-01-0{} 08:00:00".format
    conditions = [
        ("p", "c1", t(2), "B", "2020"), ("p", "c1", t(1), "A", "2019"), ("p", "c1", t(1), "A", "2018"), ("q", "c1", t(3), "A", None),
        ("p", None, t(5), "N", "1"), ("p", None, t(4), "M", "2"), (None, "c9", t(1), "X", "1"), ("p", "c2", None, "Y", "1"),
    ]
    given = [("p", "m", "done", t(1)), ("p", "m", "done", t(1)), ("p", None, "done", t(1)), (None, "m", None, t(1)), ("q", "m", "done", None)]
    condition = spark.createDataFrame(conditions, "patient_id string, condition_id string, condition_date string, icd_code string, icd_version string")
    medication = spark.createDataFrame(given, "patient_id string, medication string, status string, datetime string")
    return {
        "condition": condition.withColumns({"condition_date": F.col("condition_date").cast("timestamp"), "icd_display": F.lit(None).cast("string")}),
        "medication": medication.withColumn("datetime", F.col("datetime").cast("timestamp")),
    }


def shuffle_keys(df):
    """What the rows are shuffled by, from the plan before it is run."""
    return re.findall(r"Exchange hashpartitioning\(([^()]*), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def test_timeline_by_patient_holds_the_same_records(spark):
    tables, names = record_tables(spark), ("condition", "medication")
    plain, dealt = H.timeline(tables, names), H.timeline(tables, names, by_patient=True)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(dealt.collect(), key=key) == sorted(plain.collect(), key=key)
    assert dealt.columns == plain.columns
    found = sorted((r.patient_id or "", r.line) for r in dealt.collect())
    assert found == [("", "X"), ("", "m"), ("p", "A"), ("p", "M"), ("p", "done"), ("p", "m, done"), ("p", "m, done"), ("q", "A")]


def test_records_dealt_out_by_patient_are_shuffled_once(spark):
    lines = H.timeline(record_tables(spark), ("condition", "medication"), by_patient=True)
    days = H.day_texts(lines, ["patient_id"])
    for df in (H.day_blocks(lines, ["patient_id"]), H.history_texts(days, ["patient_id"]), H.patient_days(lines, ("condition",))):
        assert [k.split("#")[0] for k in shuffle_keys(df)] == ["patient_id"]


def test_own_days_shuffle_nothing_by_day(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = H.timeline(record_tables(spark), ("condition", "medication"), by_patient=True)
        cuts = spark.createDataFrame([("p", BASE + DAY), ("p", None), (None, BASE), ("q", BASE)], "patient_id string, cut timestamp")
        told = H.own_days(cuts, lines, ("condition", "medication"))
        assert {k.split("#")[0] for k in shuffle_keys(told)} == {"patient_id"} and not any("," in k for k in shuffle_keys(told))
        got = sorted((str(r.patient_id), str(r.cut), r["_own"] and r["_own"].n) for r in told.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [("None", str(BASE), None), ("p", str(BASE + DAY), None), ("p", "None", None), ("q", str(BASE), None)]


def test_samples_shuffle_the_records_once(world, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = T.build_samples({n: cut_lineage(t) for n, t in make_tables(world, spark).items()}, T.ds_readmission())
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [x for x in plan.splitlines() if "REPARTITION_BY_COL" in x]
    assert len([x for x in dealt if "Reused" not in x]) == 1
    assert all("," not in k for k in re.findall(r"Exchange hashpartitioning\(([^()]*), \d+\)", plan))


def test_blanks_at_the_end_are_stripped(spark):
    texts = ["a ", "a \n\t", " a", "", " \r\n", "a\x0b\x0c", None, "ä "]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    got = [r.y for r in df.select("i", strip_end(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == ["a", "a", " a", "", "", "a", None, "ä "]


def test_bounds_are_counted_from_records_that_are_not_stored(spark, tmp_path, monkeypatch):
    import __spark_entry__ as entry
    from checks import relations

    stored = []
    monkeypatch.setattr(relations, "cut_lineage", lambda df: stored.append(df.columns) or cut_lineage(df))
    out = entry.queries()["jn06_history_bounds"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["encounter_id", "before_start", "until_end", "during", "after_end"]
    assert stored and not any("line" in columns for columns in stored)


@pytest.mark.parametrize("name", ["ag03_day_block", "ag04_history_text"])
def test_day_queries_shuffle_records_by_patient_only(spark, name):
    import __spark_entry__ as entry

    keys = shuffle_keys(entry.queries()[name](spark, "/root/testdata/sf0.001"))
    assert [k.split("#")[0] for k in keys] == ["patient_id"] and "," not in keys[0]


def test_history_during_of_dealt_lines_and_odd_stays(spark):
    lines = H.timeline(record_tables(spark), ("condition", "medication"), by_patient=True)
    stays = [
        ("p", "all", BASE, BASE + DAY * 60), ("p", "none", BASE + DAY * 40, BASE + DAY * 60), ("p", "back", BASE + DAY * 5, BASE),
        ("p", "open", BASE, None), (None, "nobody", BASE, BASE + DAY), ("q", "empty", BASE, BASE + HOUR), ("p", "point", BASE + HOUR * 8, BASE + HOUR * 8),
    ]
    df = spark.createDataFrame(stays, "patient_id string, encounter_id string, start timestamp, end timestamp")
    got = {r.encounter_id: (r.n_rows, r.history, r.icd_version) for r in H.history_during(df, lines, ["patient_id", "encounter_id"]).collect()}
    first = "2020-01-01:\ndone\n2x m, done\n2020-01-01:\nA"
    assert got == {"all": (5, f"2020-01-04:\nM\n{first}", "2"), "point": (4, first, "2018")}


def test_split_samples_reads_the_samples_once(spark, tmp_path):
    from wardline.plans.prepare import split_samples

    rows = [(str(p), f"{p}-{i}", ["A", "B"][p % 2 : p % 2 + 1]) for p in range(10) for i in range(3)]
    spark.createDataFrame(rows, "patient_id string, encounter_id string, labels array<string>").write.parquet(f"{tmp_path}/samples")
    samples = spark.read.parquet(f"{tmp_path}/samples")
    out = split_samples(samples)
    assert not any(str(tmp_path) in f for f in out.inputFiles())
    got = out.collect()
    assert sorted((r.patient_id, r.encounter_id) for r in got) == sorted((p, e) for p, e, _ in rows)
    assert len({(r.patient_id, r.split) for r in got}) == 10 and {r.split for r in got} == {"train", "test"}
