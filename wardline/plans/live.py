"""Live scoring: ongoing stays to prediction records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.scores import best_label, threshold_labels
from wardline.functions.times import plus_days
from wardline.operators.risk import publish_batch, risk_assessment
from wardline.operators.rows import first_rows, ongoing
from wardline.operators.scoring import score_texts
from wardline.plans.tasks import Task, build_samples

LOOKBACK_DAYS = 15
LOOKAHEAD_DAYS = 1


def ongoing_encounters(encounters: DataFrame, now: Column, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """The latest ongoing stay of each patient among those that touch the lookback window."""
    recent = (F.col("end") >= plus_days(now, -lookback)) & (F.col("start") <= plus_days(now, LOOKAHEAD_DAYS))
    return first_rows(ongoing(encounters.where(recent), now), ["patient_id"], ["start", "encounter_id"], last=True)


def predictions_from_scores(scored: DataFrame, cutoff: float | None = 0.5) -> DataFrame:
    """One prediction per label above the cutoff; without a cutoff the best label only."""
    if cutoff is None:
        best = F.array_max(F.transform("scores", lambda s: s["score"]))
        return scored.withColumns({"prediction": best_label(F.col("scores")), "probability": best}).drop("scores")
    kept = scored.withColumn("_s", F.explode(threshold_labels(F.col("scores"), cutoff)))
    return kept.withColumns({"prediction": F.col("_s.label"), "probability": F.col("_s.score")}).drop("_s", "scores")


def score_and_record(
    samples: DataFrame, load: Callable, task: str, model: str, now: Column, cutoff: float | None = 0.5
) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of scored samples."""
    predicted = predictions_from_scores(score_texts(samples, load), cutoff)
    accepted, rejected = publish_batch(predicted)
    return risk_assessment(accepted, task, model, now), rejected


def with_cut(task: Task) -> Task:
    """The task with its cut as ``sample_start``, which every record needs."""
    if "sample_start" in (name for _, name in task.output):
        return task
    return replace(task, output=(*task.output, ("cut", "sample_start")))


def live_run(
    tables: dict[str, DataFrame], task: Task, load: Callable, model: str, now: Column, cutoff: float | None = 0.5
) -> tuple[DataFrame, DataFrame]:
    """Samples of ongoing stays, scored and turned into records."""
    current = {**tables, "encounter": ongoing_encounters(tables["encounter"], now)}
    return score_and_record(build_samples(current, with_cut(task)), load, task.name, model, now, cutoff)
