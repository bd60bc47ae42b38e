"""Batch scoring of sample texts and per-patient plug-ins."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORES = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())]))


def score_texts(
    samples: DataFrame, load: Callable[[], Callable[[list[str]], list[list[tuple[str, float]]]]], text: str = "text"
) -> DataFrame:
    """Adds ``scores``: every label of the model with its score.

    ``load`` runs once per worker task and returns the scorer, a function from
    a batch of texts to one (label, score) list per text.
    """

    @F.pandas_udf(SCORES)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = load()
        for batch in batches:
            scored = scorer(batch.tolist())
            yield pd.Series([[{"label": str(k), "score": float(v)} for k, v in row] for row in scored])

    return samples.withColumn("scores", score(F.col(text)))


#: types whose pandas form is the same with and without nulls, so rows of many patients can be converted together
STEADY = (T.StringType, T.BinaryType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.DecimalType)


def per_patient(df: DataFrame, process: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """User function from the rows of one patient to its samples.

    An escape hatch: all rows of a patient meet in one task. The built-in
    tasks do not use it. Rows are sorted by patient and converted a batch at a
    time, as a conversion per patient takes longer than most functions; with
    columns that nulls would turn into others (integers, say) it is needed.
    """
    steady = all(isinstance(f.dataType, STEADY) for f in df.schema) and isinstance(df.schema["patient_id"].dataType, T.StringType)
    if not steady or len(inspect.signature(process).parameters) != 1:
        return df.groupBy("patient_id").applyInPandas(process, schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[pd.DataFrame] = []
        size = 0
        for rows in _patients(batches):
            out = process(rows)
            # results of other types are not mixed, as that would turn them into a common one
            if done and (len(done) >= 2000 or size + len(out) > 2000 or not out.dtypes.equals(done[0].dtypes)):
                yield pd.concat(done)
                done, size = [], 0
            done.append(out)
            size += len(out)
        if done:
            yield pd.concat(done)

    return df.repartition("patient_id").sortWithinPartitions("patient_id").mapInPandas(run, schema)


def _patients(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one patient after the other from batches sorted by patient; null is a patient."""
    parts: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        keys = batch["patient_id"].tolist()
        bounds = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for start, end in zip(bounds, bounds[1:]) if keys else ():
            if parts and keys[start] != last:
                yield pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
                parts = []
            parts.append(batch.iloc[start:end])
            last = keys[start]
    if parts:
        yield pd.concat(parts, ignore_index=True)
