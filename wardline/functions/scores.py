"""Score arrays, label vectors and encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.texts import let


def sigmoid(logits: Column) -> Column:
    return F.transform(logits, lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


def softmax(logits: Column) -> Column:
    """Probabilities of a logit list, shifted by its maximum."""
    shifted = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))

    def shares(powers: Column) -> Column:
        total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
        return let(total, lambda t: F.transform(powers, lambda x: x / t))

    return let(shifted, shares)


def argmax(values: Column) -> Column:
    """Zero-based index of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def binarize(labels: Column, classes: Column) -> Column:
    """0/1 vector of a label list over a sorted class list."""
    return F.transform(classes, lambda c: F.array_contains(labels, c).cast("int"))


def class_index(label: Column, classes: Column) -> Column:
    """Zero-based class index, null for an unknown label."""
    position = F.array_position(classes, label)
    return F.when(position > 0, (position - 1).cast("int"))


def label_combo_id(labels: Column, classes: Column) -> Column:
    """Sum of class index x (class count x position), the stratification key."""
    terms = F.transform(
        labels,
        lambda lab, i: (F.array_position(classes, lab) - 1) * F.size(classes) * (i + 1),
    )
    return F.aggregate(terms, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def label_to_id(label: Column, classes: Column) -> Column:
    return class_index(label, classes)


def id_to_label(index: Column, classes: Column) -> Column:
    return F.get(classes, index)


def threshold_labels(scores: Column, cutoff: float = 0.5) -> Column:
    """Entries of a (label, score) list above the cutoff."""
    return F.filter(scores, lambda s: s["score"] > F.lit(cutoff))


def best_label(scores: Column) -> Column:
    """Label of the highest score; the first one wins a tie."""
    values = F.transform(scores, lambda s: s["score"])
    return F.get(scores, argmax(values))["label"]
