"""Sample builders: one declarative task, one lazy plan from tables to samples."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.texts import encounter_text, patient_text
from wardline.functions.times import days_between, plus_days
from wardline.operators.history import (
    history_before,
    history_during,
    history_steps,
    lines_until,
    own_days,
    patient_days,
    timeline,
)
from wardline.operators.labels import Death, MainCode, Readmission, icd_labels, modality_labels
from wardline.operators.rows import fetch_related, first_rows
from wardline.operators.skew import hot_keys, salted_join
from wardline.registry import resources_for
from wardline.session import cut_lineage

STAY = ["patient_id", "encounter_id"]


def daily_cuts(limit: int | None = None) -> Callable[[], Column]:
    """Every day from start + 1 day to end - 1 day, the first ``limit`` of them."""

    def cuts() -> Column:
        first, last = plus_days(F.col("start"), 1), plus_days(F.col("end"), -1)
        spine = F.sequence(first, last, F.make_dt_interval(days=F.lit(1)))
        spine = F.when(first <= last, spine).otherwise(F.array().cast("array<timestamp>"))
        return F.slice(spine, 1, limit) if limit else spine

    return cuts


def cut_after_start(days: int) -> Callable[[], Column]:
    return lambda: F.array(plus_days(F.col("start"), days))


def cut_at_end() -> Column:
    return F.array("end")


@dataclass(frozen=True)
class Task:
    """What a sample is: stays, cuts, labels, history bounds and text.

    ``cuts`` gives the list of cut times of a stay; None means one sample per
    stay with the history of the stay itself. ``labels`` is a rule with
    ``attach(stays, tables)`` and ``value_at(cut)``.
    """

    name: str
    cuts: Callable[[], Column] | None
    text: Callable[[], Column]
    labels: object | None = None
    inclusive: bool = False
    longer_than_days: int | None = None
    need_labels: bool = False
    drop_unchanged: bool = False
    need_resource: str | None = None
    tumor_line: bool = False
    first_stay_only: bool = False
    output: tuple[tuple[str, str], ...] = (
        ("patient_id", "patient_id"),
        ("encounter_id", "encounter_id"),
        ("start", "encounter_start"),
        ("cut", "sample_start"),
        ("duration", "duration"),
        ("text", "text"),
        ("labels", "labels"),
    )


def tumor_history(episodes: DataFrame) -> DataFrame:
    """Per patient ``Tumor history: date program, ...`` in order of start."""
    entry = F.concat_ws(" ", F.nullif("first_diagnosis_date", F.lit("")), F.col("treatment_program"))
    ordered = F.array_sort(F.collect_list(F.struct("start", entry.alias("entry"))))
    joined = F.array_join(F.transform(ordered, lambda e: e["entry"]), ", ")
    return (
        episodes.where(F.length("treatment_program") > 0)
        .groupBy("patient_id")
        .agg(F.concat(F.lit("Tumor history: "), joined, F.lit("\n\n")).alias("tumor"))
    )


def valid_stays(encounters: DataFrame) -> DataFrame:
    """One row per stay with readable start and end, and its whole days."""
    stays = encounters.where(F.col("start").isNotNull() & F.col("end").isNotNull())
    return first_rows(stays, STAY, ["start"]).withColumn("duration", days_between(F.col("start"), F.col("end")))


def sample_head(stays: DataFrame) -> Column:
    fields = {c: F.col(c) for c in stays.columns}
    person = patient_text(F.col("birth_date"), F.col("sex"), F.col("insurance_type"), F.col("start"))
    return F.concat(
        F.lit("Patient metadata:\n"), person, F.lit("\n\nEncounter:\n"), encounter_text(fields), F.lit("\n\n")
    )


def drop_unchanged(cuts: DataFrame) -> DataFrame:
    """Drops a cut whose history and labels equal those of the cut before it."""
    order = Window.partitionBy(*STAY).orderBy("_index")
    before = F.lag("_index").over(order)
    marked = cuts.withColumns({"_before": before, "_labels_before": F.lag("labels").over(order)})
    grown = F.exists("_steps", lambda s: (s >= F.col("_before")) & (s < F.col("_index")))
    changed = F.col("_before").isNull() | (F.col("labels") != F.col("_labels_before")) | F.coalesce(grown, F.lit(False))
    return marked.where(changed).drop("_before", "_labels_before", "_steps", "_first_ts", "_index")


def labelled_cuts(stays: DataFrame, task: Task, tables: dict[str, DataFrame], lines: DataFrame) -> DataFrame:
    """One row per stay and cut with its label, before any text is built."""
    stays = stays.withColumn("cuts", task.cuts())
    if task.labels is not None:
        stays = task.labels.attach(stays, tables)
    if task.drop_unchanged:
        stays = history_steps(stays, lines)
    cuts = stays.select("*", F.posexplode("cuts").alias("_index", "cut")).drop("cuts")
    cuts = cuts.withColumn("_index", F.col("_index") + 1)
    if task.need_labels:
        cuts = cuts.withColumn("labels", task.labels.value_at(F.col("cut"))).where(F.size("labels") > 0)
    if task.drop_unchanged:
        return drop_unchanged(cuts.where(F.col("_first_ts") < F.col("cut")))
    return cuts.drop("_index")


def build_samples(tables: dict[str, DataFrame], task: Task, use: dict[str, bool] | None = None) -> DataFrame:
    """Samples of a task from the cohort tables; ``use`` switches resources off.

    Cuts and labels are settled first; only the cuts that stay are joined,
    once and by patient, to the patient's attributes and rendered days.
    """
    resources = resources_for(task.name, use)
    stays = valid_stays(tables["encounter"]).where(F.col("patient_id").isNotNull())
    if task.longer_than_days is not None:
        stays = stays.where(F.col("duration") > task.longer_than_days)
    if task.first_stay_only:
        stays = first_rows(stays, ["patient_id"], ["start", "encounter_id"])
    if task.need_resource:
        stays = fetch_related(stays, tables[task.need_resource], "patient_id")

    person = tables["patient"]
    if task.tumor_line:
        person = person.withColumn("tumor", F.lit(""))
        if "episode_of_care" in tables:
            person = person.drop("tumor").join(tumor_history(tables["episode_of_care"]), "patient_id", "left")
            person = person.withColumn("tumor", F.coalesce("tumor", F.lit("")))

    if task.cuts is None:
        if task.labels is not None:
            stays = task.labels.attach(stays, tables)
        history = history_during(stays, timeline(tables, resources, task.name, by_patient=True), STAY)
        hot = hot_keys(tables["encounter"], ["patient_id"])
        told = salted_join(stays, person, ["patient_id"], "inner", hot, ["encounter_id"])
        samples = told.withColumn("cut", F.col("end")).join(history, STAY)
    else:
        # the timeline is shuffled once, by patient; the cuts that stay decide which records are rendered at all
        lines = timeline(tables, resources, task.name, by_patient=True)
        if task.drop_unchanged:
            stored = cut_lineage(lines)
            cuts, lines = labelled_cuts(stays, task, tables, stored), stored.repartition("patient_id")
        else:
            cuts = labelled_cuts(stays, task, tables, lines)
        cuts = cut_lineage(cuts)
        hot = hot_keys(cuts, ["patient_id"])
        person = person.join(patient_days(lines_until(lines, cuts), resources), "patient_id")
        told = own_days(cuts, lines, resources, task.inclusive)
        # without a hot patient the days stay where they were rendered
        hot = None if hot.isEmpty() else hot
        samples = history_before(salted_join(told, person, ["patient_id"], "inner", hot, ["encounter_id"]))
    if task.labels is not None and not task.need_labels:
        samples = samples.withColumn("labels", task.labels.value_at(F.col("cut")))
    samples = samples.withColumn("text", F.concat(sample_head(samples), task.text()))
    return samples.select(*[F.col(c).alias(name) for c, name in task.output])


def _duration() -> Column:
    return F.concat(F.lit("Duration: "), F.col("duration").cast("string"))


def _icd_version() -> Column:
    return F.concat(F.lit("ICD Version: "), F.col("icd_version"))


def _section(title: str) -> Column:
    return F.concat(F.lit(f"{title}:\n"), F.col("history"))


def ds_icd(first_stay_only: bool = False) -> Task:
    """Codes still to be recorded in the stay, sampled every day."""
    return Task(
        "ds_icd",
        cuts=daily_cuts(),
        text=lambda: F.concat(
            _duration(), F.lit("\n"), _icd_version(), F.lit("\n\n"), _section("Patient journey")
        ),
        labels=icd_labels(),
        longer_than_days=2,
        need_labels=True,
        drop_unchanged=True,
        first_stay_only=first_stay_only,
    )


def ds_image(max_cuts: int = 30) -> Task:
    """Modalities still to come in the stay, sampled every day."""
    return Task(
        "ds_image",
        cuts=daily_cuts(max_cuts),
        text=lambda: _section("Patient history"),
        labels=modality_labels(),
        longer_than_days=2,
        need_labels=True,
        drop_unchanged=True,
    )


def ds_image_one_day(nonull: bool = False) -> Task:
    """Modalities of the stay after its first day, one sample per stay."""
    return Task(
        "ds_image",
        cuts=cut_after_start(1),
        text=lambda: _section("Patient history"),
        labels=modality_labels(end_inclusive=False, required=nonull),
        need_labels=nonull,
        need_resource="imaging_study",
    )


def ds_readmission(days: int = 30) -> Task:
    return Task(
        "ds_readmission",
        cuts=cut_at_end,
        text=lambda: F.concat(_icd_version(), F.lit("\n\n"), _section("Patient history")),
        labels=Readmission(days),
        inclusive=True,
        output=(
            ("patient_id", "patient_id"),
            ("encounter_id", "encounter_id"),
            ("start", "encounter_start_date"),
            ("text", "text"),
            ("labels", "labels"),
        ),
    )


def ds_mortality(after_days: int = 2, grace_days: int = 1) -> Task:
    return Task(
        "ds_mortality",
        cuts=cut_after_start(after_days),
        text=lambda: _section("Patient history"),
        labels=Death(grace_days),
        output=(
            ("patient_id", "patient_id"),
            ("encounter_id", "encounter_id"),
            ("start", "encounter_start"),
            ("end", "encounter_end"),
            ("cut", "sample_start"),
            ("duration", "duration"),
            ("text", "text"),
            ("labels", "labels"),
        ),
    )


def ds_main_icd(is_main: Callable[[], Column]) -> Task:
    """The one main diagnosis of a stay that has imaging."""
    return Task(
        "ds_main_icd",
        cuts=None,
        text=lambda: F.concat(
            _duration(), F.lit("\n\n"), _icd_version(), F.lit("\n\n"), _section("Patient journey")
        ),
        labels=MainCode(is_main),
        longer_than_days=2,
        output=(
            ("patient_id", "patient_id"),
            ("encounter_id", "encounter_id"),
            ("text", "text"),
            ("labels", "label"),
        ),
    )


def pretrain_fhir() -> Task:
    """One unlabelled sample per stay with the records of the stay."""
    return Task(
        "pretrain_fhir",
        cuts=None,
        text=lambda: F.concat(
            _duration(),
            F.lit("\n\n"),
            F.col("tumor"),
            _icd_version(),
            F.lit("\n\n"),
            _section("Patient journey in stay"),
        ),
        tumor_line=True,
        output=(("patient_id", "patient_id"), ("encounter_id", "encounter_id"), ("text", "text")),
    )
