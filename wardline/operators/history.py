"""Patient timelines and point-in-time history texts.

A history is never assembled from all (cut, event) pairs. Whole days are
rendered once per patient; a cut takes the days before it and adds only the
part of its own day that lies before its time of day.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.texts import let, number_text, strip_end
from wardline.functions.times import in_window, time_text
from wardline.operators.rows import first_rows
from wardline.registry import RESOURCES

BUCKET_DAYS = 16


def cell_text(df: DataFrame, name: str) -> Column:
    """A cell as printed in a history line; null stays null."""
    kind = df.schema[name].dataType
    col = F.col(name)
    if isinstance(kind, T.ArrayType):
        return F.when(F.size(col) > 0, F.array_join(col, ", "))
    if isinstance(kind, T.BooleanType):
        return F.initcap(col.cast("string"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return number_text(col)
    if isinstance(kind, T.TimestampType):
        return time_text(col)
    return col.cast("string")


def _resource_rows(df: DataFrame, name: str, task: str | None = None) -> DataFrame:
    """(patient_id, unique key, ts, line, icd_version) of every dated row of one resource, copies of a record included."""
    spec = RESOURCES[name]
    line = F.concat_ws(", ", *[cell_text(df, c) for c in spec.columns(task)])
    version = F.lit(None).cast("string")
    if name == "condition" and "icd_version" in df.columns:
        version = cell_text(df, "icd_version")
    return df.where(F.col(spec.time).isNotNull()).select(
        *dict.fromkeys(("patient_id", *spec.keys)),
        F.col(spec.time).alias("ts"),
        line.alias("line"),
        version.alias("icd_version"),
    )


def resource_lines(df: DataFrame, name: str, task: str | None = None) -> DataFrame:
    """(patient_id, ts, resource, line, icd_version) rows of one resource."""
    spec = RESOURCES[name]
    rows = _resource_rows(df, name, task)
    if spec.keys:
        rows = first_rows(rows, list(spec.keys), ["ts"])
    return rows.select("patient_id", "ts", F.lit(name).alias("resource"), "line", "icd_version")


def timeline(
    tables: dict[str, DataFrame], resources: tuple[str, ...], task: str | None = None, by_patient: bool = False
) -> DataFrame:
    """All dated lines of the chosen resources, one row per record.

    With ``by_patient`` the rows are dealt out by patient, in their only
    shuffle: copies of a record are dropped there, and what is grouped by
    patient, or by patient and more, is not shuffled again.
    """
    names = [r for r in resources if r in tables]
    if not by_patient:
        return reduce(DataFrame.unionByName, [resource_lines(tables[r], r, task) for r in names])

    def rows(place: int) -> DataFrame:
        spec = RESOURCES[names[place]]
        record = F.lit(None).cast("string")
        if spec.keys:
            (key,) = (k for k in spec.keys if k != "patient_id")
            record = F.col(key).cast("string")
        found = _resource_rows(tables[spec.name], spec.name, task).withColumn("_record", record)
        return found.select("patient_id", F.lit(place).cast("byte").alias("_place"), "_record", "ts", "line", "icd_version")

    dealt = reduce(DataFrame.unionByName, [rows(i) for i in range(len(names))]).repartition("patient_id")
    copies = Window.partitionBy("patient_id", "_place", "_record").orderBy("ts", "line", "icd_version")
    keyed = F.col("_place").isin(*[i for i, name in enumerate(names) if RESOURCES[name].keys])
    first = dealt.withColumn("_copy", F.row_number().over(copies)).where(~keyed | (F.col("_copy") == 1))
    resource = F.get(F.array(*[F.lit(name) for name in names]), F.col("_place"))
    return first.select("patient_id", "ts", resource.alias("resource"), "line", "icd_version")


def _counted(n: Column, line: Column) -> Column:
    return F.when(n > 1, F.concat(n.cast("string"), F.lit("x "), line)).otherwise(line)


def _lines(rows: DataFrame, keys: list[str]) -> DataFrame:
    icd = F.when(F.col("resource") == "condition", F.struct("ts", "icd_version"))
    return (
        rows.withColumn("day", F.to_date("ts"))
        .groupBy(*keys, "day", "resource", "line")
        .agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max(icd).alias("icd"))
    )


def day_blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One text block per key, day and resource.

    Equal lines are counted before they are collected, so a block holds each
    distinct line once (``Nx line``), in the order of first appearance. Rows
    that already lie together by ``keys`` are not shuffled here.
    """
    entry = F.struct("first_ts", "line", "n")
    printed = F.transform(F.sort_array(F.collect_list(entry)), lambda e: _counted(e["n"], e["line"]))
    head = F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(":\n"))
    return (
        _lines(rows, keys)
        .groupBy(*keys, "day", "resource")
        .agg(F.sum("n").alias("n"), F.max("icd").alias("icd"), F.concat(head, F.array_join(printed, "\n")).alias("block"))
    )


def day_texts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and day: row count, text (resources descending), newest ICD version."""
    blocks = F.sort_array(F.collect_list(F.struct("resource", "block")), asc=False)
    return (
        day_blocks(rows, keys)
        .groupBy(*keys, "day")
        .agg(
            F.sum("n").alias("n"),
            F.array_join(F.transform(blocks, lambda b: b["block"]), "\n").alias("text"),
            F.max("icd").alias("icd"),
        )
    )


def history_texts(days: DataFrame, keys: list[str]) -> DataFrame:
    """Day texts of a key joined newest day first."""
    ordered = F.sort_array(F.collect_list(F.struct("day", "text")), asc=False)
    return days.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        strip_end(F.array_join(F.transform(ordered, lambda d: d["text"]), "\n")).alias("history"),
        F.coalesce(F.max("icd")["icd_version"], F.lit("unknown")).alias("icd_version"),
    )


def _bucket(ts: Column, days: int = BUCKET_DAYS) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(days * 86400))


def events_in_stays(
    stays: DataFrame,
    events: DataFrame,
    lo: Column,
    hi: Column,
    ts: str = "ts",
    lo_incl: bool = True,
    hi_incl: bool = True,
    bucket_days: int = BUCKET_DAYS,
) -> DataFrame:
    """Range join of intervals and dated rows of the same patient.

    An interval is repeated once per time bucket it touches and joined on
    (patient, bucket), so a patient with very many records is spread over
    buckets and only rows near the interval are compared.
    """
    bucket = partial(_bucket, days=bucket_days)

    spans = (
        stays.where(lo <= hi)
        .withColumns({"_lo": lo, "_hi": hi})
        .withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_lo")), bucket(F.col("_hi")))))
    )
    points = events.withColumn("_bucket", bucket(F.col(ts)))
    joined = spans.join(points, ["patient_id", "_bucket"])
    keep = in_window(F.col(ts), F.col("_lo"), F.col("_hi"), lo_incl, hi_incl)
    return joined.where(keep).drop("_lo", "_hi", "_bucket")


def history_during(stays: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """History of each stay within [start, end], one row per stay that has any.

    Lines in no time bucket that a stay of their patient touches stay where
    they lie: of lines dealt out by patient only the others are shuffled.
    """
    spans = stays.select(*keys, F.col("start").alias("_from"), F.col("end").alias("_to"))
    touched = F.explode(F.sequence(_bucket(F.col("_from")), _bucket(F.col("_to")))).alias("_bucket")
    touched = spans.where("_from <= _to").select("patient_id", touched).groupBy("patient_id").agg(F.collect_set("_bucket").alias("_touched"))
    near = lines.join(touched, "patient_id").where(F.array_contains("_touched", _bucket(F.col("ts")))).drop("_touched")
    rows = events_in_stays(spans, near, F.col("_from"), F.col("_to")).repartition(*keys)
    return history_texts(day_texts(rows, keys), keys)


def lines_until(lines: DataFrame, cuts: DataFrame) -> DataFrame:
    """The lines up to the last cut of their patient; patients without a cut drop out."""
    need = cuts.groupBy("patient_id").agg(F.max("cut").alias("_until"))
    return lines.join(need, "patient_id").where(F.col("ts") <= F.col("_until")).drop("_until")


def _day_entries(lines: DataFrame) -> DataFrame:
    """(patient_id, day, entries): the distinct lines of each day with their times."""
    day = F.to_date("ts").alias("day")
    counted = lines.groupBy("patient_id", day, "resource", "line", "ts", "icd_version").agg(F.count("*").alias("n"))
    per_line = counted.groupBy("patient_id", "day", "resource", "line").agg(
        F.array_sort(F.collect_list(F.struct("ts", "n", "icd_version"))).alias("times")
    )
    entry = F.struct("resource", F.col("times")[0]["ts"].alias("first_ts"), "line", "times")
    return per_line.groupBy("patient_id", "day").agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def _told(day: Column, entries: Column, resources: tuple[str, ...]) -> list[Column]:
    rows = F.aggregate(entries, F.lit(0).cast("bigint"), lambda acc, e: acc + _times_of(e))
    return [rows.alias("n"), render_day(day, entries, resources).alias("text"), newest_condition(entries).alias("icd")]


def patient_days(lines: DataFrame, resources: tuple[str, ...]) -> DataFrame:
    """One row per patient: ``_days``, its calendar days (day, n, text, icd), newest first, each rendered once."""
    kinds = F.array(*[F.lit(name) for name in sorted(resources, reverse=True)])
    entry = F.struct(F.array_position(kinds, F.col("resource")).alias("kind"), "first_ts", "line", "n")
    head = F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(":\n"))

    def printed(entries: Column) -> Column:
        # the first line of each resource comes after a head
        def line(e: Column, i: Column) -> Column:
            first = (i == 0) | (F.get(entries, i - 1)["kind"] != e["kind"])
            return F.concat(F.when(first, head).otherwise(F.lit("")), _counted(e["n"], e["line"]))

        return F.array_join(F.transform(entries, line), "\n")

    found = _lines(lines.where(F.col("resource").isin(*resources)), ["patient_id"])
    days = found.groupBy("patient_id", "day").agg(
        F.sum("n").alias("n"), F.sort_array(F.collect_list(entry)).alias("entries"), F.max("icd").alias("icd")
    )
    rendered = days.select("patient_id", "day", "n", let(F.col("entries"), printed).alias("text"), "icd")
    return rendered.groupBy("patient_id").agg(
        F.sort_array(F.collect_list(F.struct("day", "n", "text", "icd")), asc=False).alias("_days")
    )


def own_days(cuts: DataFrame, lines: DataFrame, resources: tuple[str, ...], inclusive: bool = False) -> DataFrame:
    """Adds to each cut ``_own``: (n, text, icd) of the part of its own day before it, null if there is none.

    Records are held against the calendar days with a cut of their patient,
    where they lie, so only those of such days are grouped. What is left, one
    row per day, meets the cuts by patient: a cut carries nothing of other
    days, and nothing is shuffled by day.
    """
    wanted = cuts.groupBy("patient_id").agg(F.collect_set(F.to_date("cut")).alias("_cut_days"))
    near = lines.join(wanted, "patient_id").where(F.array_contains("_cut_days", F.to_date("ts"))).drop("_cut_days")
    entries = _day_entries(near)
    entries = entries.select(F.col("patient_id").alias("_patient"), F.col("day").alias("_day"), F.col("entries").alias("_entries"))
    # not an equality of two columns, as that would be one more key to shuffle by
    same = (F.col("patient_id") == F.col("_patient")) & (F.datediff("cut", "_day") == 0)
    joined = cuts.join(entries, same, "left").withColumn("_before", entries_before(F.col("_entries"), F.col("cut"), inclusive))
    own = F.when(F.size("_before") > 0, F.struct(*_told(F.to_date("cut"), F.col("_before"), resources)))
    return joined.withColumn("_own", own).drop("_patient", "_day", "_entries", "_before")


def render_day(day: Column, entries: Column, resources: tuple[str, ...]) -> Column:
    """Text of one day: a headed block per resource, resource names descending."""
    head = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(":\n"))

    def block(name: str) -> Column:
        own = F.filter(entries, lambda e: e["resource"] == name)
        printed = F.array_join(F.transform(own, _print_entry), "\n")
        return F.when(F.size(own) > 0, F.concat(head, printed))

    return F.concat_ws("\n", *[block(r) for r in sorted(resources, reverse=True)])


def _times_of(entry: Column) -> Column:
    return F.aggregate(entry["times"], F.lit(0).cast("bigint"), lambda acc, t: acc + t["n"])


def _print_entry(entry: Column) -> Column:
    return _counted(_times_of(entry), entry["line"])


def newest_condition(entries: Column) -> Column:
    """struct(ts, icd_version) of the newest condition among the entries."""
    own = F.filter(entries, lambda e: e["resource"] == "condition")
    times = F.flatten(F.transform(own, lambda e: e["times"]))
    return F.array_max(
        F.transform(times, lambda t: F.struct(t["ts"].alias("ts"), t["icd_version"].alias("icd_version")))
    )


def entries_before(entries: Column, cut: Column, inclusive: bool) -> Column:
    """Entries of a day reduced to the times before a cut."""

    def reduced(e):
        times = F.filter(e["times"], lambda t: (t["ts"] <= cut) if inclusive else (t["ts"] < cut))
        return F.struct(
            e["resource"].alias("resource"), e["first_ts"].alias("first_ts"), e["line"].alias("line"), times.alias("times")
        )

    return F.filter(F.transform(entries, reduced), lambda e: F.size(e["times"]) > 0)


def history_before(cuts: DataFrame) -> DataFrame:
    """Adds ``history`` and ``icd_version`` of everything before each cut.

    ``cuts`` has a ``cut`` time, the part of its ``_own`` day before it, and
    the ``_days`` of its patient; cuts without any earlier record are dropped.
    """
    past = cuts.withColumn("_past", F.filter("_days", lambda d: d["day"] < F.to_date("cut"))).drop("_days")
    past_text = F.when(F.size("_past") > 0, F.array_join(F.transform("_past", lambda d: d["text"]), "\n"))
    told = (F.length(F.col("_own")["text"]) > 0) | (F.size("_past") > 0)
    past_icd = F.get(F.filter("_past", lambda d: d["icd"].isNotNull()), F.lit(0))["icd"]
    newest = F.coalesce(F.col("_own")["icd"], past_icd)
    return (
        past.where(F.coalesce(told, F.lit(False)))
        .withColumn("history", strip_end(F.concat_ws("\n", F.col("_own")["text"], past_text)))
        .withColumn("icd_version", F.coalesce(newest["icd_version"], F.lit("unknown")))
        .drop("_past", "_own")
    )


def history_steps(stays: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds to each stay when its history begins and between which cuts it grows.

    ``_steps`` holds i when a record lies between the i-th and the next cut
    (counted from 1), ``_first_ts`` is the first record of the patient. Both
    tell equal histories apart without building a text.
    """
    keys = ["patient_id", "encounter_id"]
    spans = stays.select(*keys, "cuts").where(F.size("cuts") > 0)
    first, last = F.get("cuts", F.lit(0)), F.element_at("cuts", -1)
    hits = events_in_stays(spans, lines.select("patient_id", "ts"), first, last, hi_incl=False)
    step = F.size(F.filter("cuts", lambda c: c <= F.col("ts")))
    steps = hits.groupBy(*keys).agg(F.collect_set(step).alias("_steps"))
    begins = lines.groupBy("patient_id").agg(F.min("ts").alias("_first_ts"))
    return stays.join(steps, keys, "left").join(begins, "patient_id")
