"""Evaluation of a scored test set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.scores import threshold_labels
from wardline.operators.metrics import binary_metrics, classification_metrics, ranking_metrics


def predicted_labels(scored: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """Adds ``predicted``: the labels scored above the cutoff."""
    kept = threshold_labels(F.col("scores"), cutoff)
    return scored.withColumn("predicted", F.transform(kept, lambda s: s["label"]))


def evaluate_test_set(
    scored: DataFrame, labels: str = "labels", cutoff: float = 0.5, classes: DataFrame | None = None
) -> DataFrame:
    """Metrics prefixed ``test_`` of scored samples.

    Label lists are compared as sets, over ``classes`` if given; a 0/1 label
    is compared with its ``score`` and also ranked.
    """
    if scored.schema[labels].dataType.typeName() == "array":
        metrics = classification_metrics(predicted_labels(scored, cutoff), labels, "predicted", classes)
    else:
        hard = scored.withColumn("predicted", (F.col("score") > cutoff).cast("int"))
        ranked = ranking_metrics(scored, labels, "score")
        both = ranked.select(F.struct("*").alias("both")).scalar()
        metrics = binary_metrics(hard, labels, "predicted").withColumns({c: both[c] for c in ranked.columns})
    return metrics.select(*[F.col(c).alias(f"test_{c}") for c in metrics.columns])


def sample_predictions(scored: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """The first ``n`` predictions in key order, for display."""
    return scored.orderBy(*keys).limit(n)
