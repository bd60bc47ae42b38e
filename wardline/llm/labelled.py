"""Labelled rows for the classifiers: the split and a bounded sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str, folds: int = 5):
    """Documents that training never sees: crc32(id as text) mod ``folds`` = 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int, id_col: str, text_col: str, folds: int = 5) -> DataFrame:
    """(id, text, label) of at most ``sample`` labelled documents outside the held-out fold.

    The bound is the ``sample`` labels with the smallest hash of their id, so
    it does not depend on the order of rows. Null labels don't count; of
    repeated labels the larger one does.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.where(~held_out("id", folds)).groupBy("id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(known), "id")  # at most ``sample`` ids and labels
