import datetime as dt

from pyspark.sql import functions as F

from wardline.functions import codes as C
from wardline.functions import scores as S
from wardline.functions import texts as X
from wardline.functions import times as D
from wardline.operators import rows as R


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_reduce_cardinality(spark):
    rows = spark.createDataFrame([(0, []), (1, ["B"]), (2, ["B", "A"]), (3, None)], "i int, xs array<string>")
    xs = F.col("xs")
    out = rows.select(
        "i",
        C.reduce_cardinality(xs, take_first=True).alias("a"),
        C.reduce_cardinality(xs, set_to_none=True).alias("b"),
        C.reduce_cardinality(xs).alias("c"),
        C.first_positional(xs).alias("d"),
    )
    got = [tuple(r)[1:] for r in out.orderBy("i").collect()]
    assert got == [
        (None, None, None, None),
        ("B", "B", ["B"], "B"),
        ("A", None, ["B", "A"], "B"),
        (None, None, None, None),
    ]


def test_to_utc(spark):
    texts = [
        "2020-01-02T03:04:05.0+02:00",
        "2020-01-02 03:04:05.0+00:00",
        "2020-01-02T03:04:05.123+0100",
        "2020-01-02",
        "garbage",
        None,
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = rows.select("i", D.time_text(D.to_utc(F.col("t"))).alias("t")).orderBy("i").collect()
    assert [r.t for r in out] == [
        "2020-01-02 01:04:05+00:00",
        "2020-01-02 03:04:05+00:00",
        "2020-01-02 02:04:05.123000+00:00",
        "2020-01-02 00:00:00+00:00",
        None,
        None,
    ]


def test_stay_length_rules_differ(spark):
    start = dt.datetime(2020, 1, 1, 23)
    ends = [48 * 3600, 48 * 3600 + 1, 72 * 3600 - 1, 72 * 3600, None]
    rows = [(i, start, start + dt.timedelta(seconds=s) if s else None) for i, s in enumerate(ends)]
    df = spark.createDataFrame(rows, "i int, start timestamp, end timestamp")
    assert [r.i for r in R.min_stay(df).orderBy("i").collect()] == [1, 2, 3]
    long = df.where(D.days_between(F.col("start"), F.col("end")) > 2)
    assert [r.i for r in long.collect()] == [3]


def test_label_codes(spark):
    codes = ["C50.1", "C50.9", "GB12", "GROUPBOX1", "PATSTURZ", None]
    df = spark.createDataFrame([(c,) for c in codes], "c string").where(C.is_label_code(F.col("c")))
    assert {r[0] for r in df.select(C.icd_chapter(F.col("c"))).collect()} == {"C50"}


def test_lookups(spark):
    df = spark.createDataFrame([("PKV",), ("GKV",), ("X",), (None,)], "c string")
    assert [r[0] for r in df.select(C.map_insurance(F.col("c"))).collect()] == [
        "privat",
        "gesetzlich",
        "unbekannt",
        "unbekannt",
    ]
    row = one(spark, a=C.map_tumor_type(F.lit("DCP01BASIS")), b=C.map_tumor_type(F.lit("X")))
    assert tuple(row) == ("Magen-Darm Tumoren", None)


def test_category_name(spark):
    lists = [["Radiology"], ["Lab report", "LAB"], ["Lab report"], [], None]
    df = spark.createDataFrame(list(enumerate(lists)), "i int, xs array<string>")
    got = [r.c for r in df.select("i", C.category_name(F.col("xs")).alias("c")).orderBy("i").collect()]
    assert got == ["Radiology", "LAB", "Lab_report", "unknown", "unknown"]


def test_number_text_matches_python(spark):
    values = [0.0, 5.0, 1.5, 12345678.0, 123456789.25, 0.001, 0.0005, -3.25, 1e15, 99999999.5]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    got = [r.t for r in df.select("i", X.number_text(F.col("x")).alias("t")).orderBy("i").collect()]
    assert got == [str(v) for v in values]


def test_ngrams_and_scores(spark):
    row = one(spark, g=X.word_ngrams(F.lit("a b c d"), 3), none=X.word_ngrams(F.lit("a b"), 3), empty=X.word_ngrams(F.lit(""), 3))
    assert row.g == ["a b c", "b c d"] and row.none == [] and row.empty == []
    row = one(spark, s=S.softmax(F.array(F.lit(1.0), F.lit(1.0))), m=S.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))))
    assert row.s == [0.5, 0.5] and row.m == 1


def test_encounter_text_skips_nulls(spark):
    row = one(
        spark,
        t=X.encounter_text(
            {"start": F.lit("2020-01-01 10:00:00").cast("timestamp"), "type_display": F.lit(None).cast("string"), "v3_act_code": F.lit("IMP")}
        ),
    )
    assert row.t == "Beginn\t2020-01-01 10:00:00+00:00\nArt\tIMP"


def test_number_text_prints_exponents_of_two_digits(spark):
    from wardline.functions.texts import number_text

    want = {1e-5: "1e-05", 1.5e-7: "1.5e-07", 2.5e-12: "2.5e-12", 1e16: "1e+16", 1.25e20: "1.25e+20", 0.0: "0.0", 12.5: "12.5", 2e7: "20000000.0", 5e-4: "0.0005"}
    rows = spark.createDataFrame([(v,) for v in want], "v double")
    assert {r.v: r.t for r in rows.select("v", number_text(F.col("v")).alias("t")).collect()} == want
