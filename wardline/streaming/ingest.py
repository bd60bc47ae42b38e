"""Newly landed records as a stream."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from wardline.operators.rows import first_rows
from wardline.session import cut_lineage
from wardline.sources.bundles import read_bundles
from wardline.sources.flatten import FLATTENERS
from wardline.streaming.buckets import BUCKETS, KeyedStore, touched


def bundle_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """(resource_type, resource) of bundle files as they land, one bundle per line."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return read_bundles(reader.load(path))


def ingest(
    stream: DataFrame,
    resource: str,
    keys: list[str],
    path: str,
    checkpoint: str,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Appends the flat rows of one resource to a table, each key once, however late it comes.

    A null key is a key like others. Of rows of one key in a batch the first
    by all columns is kept. The keys stored so far, each with a hash of its
    row, lie in buckets below ``path_keys``; a batch reads those of its own
    keys. A row that differs from the one stored under its key is not lost
    but written to ``path_restated``, see ``restated``. Batches have their own
    folders, overwritten when a batch is repeated.
    """
    flat = FLATTENERS[resource](stream)

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = cut_lineage(batch.withColumn("_hash", F.xxhash64(*batch.columns)))
        known = KeyedStore(spark, f"{path}_keys", rows.select(*keys, "_hash").schema, buckets)
        numbers = touched(rows, keys, buckets)
        before = [b for b in known.batches() if b < batch_id]
        stored = known.read(numbers, before[-1]) if before else known.read([])
        same = reduce(and_, (F.col(f"n.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys))
        first = cut_lineage(first_rows(rows, keys).alias("n").join(stored.alias("s"), same, "left_anti"))
        first.select(batch.columns).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        now = stored.union(first.select(*keys, "_hash"))
        differ = rows.distinct().alias("n").join(now.alias("s"), same).where("n._hash <> s._hash").select(*(f"n.`{c}`" for c in batch.columns))
        differ.write.mode("overwrite").parquet(f"{path}_restated/batch_id={batch_id}")
        if batch_id not in known.batches():
            known.add(batch_id, first.select(*keys, "_hash"), keys, numbers)

    return flat.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def restated(spark: SparkSession, path: str) -> DataFrame:
    """Rows that came under a stored key with other content, with their ``batch_id``."""
    return spark.read.parquet(f"{path}_restated")


def daily_activity(events: DataFrame, path: str, checkpoint: str, ts: str = "ts", key: str = "patient_id") -> StreamingQuery:
    """Counts events per key and day, late ones too.

    Each batch stores its own counts (overwritten when it is repeated);
    ``read_activity`` adds them up, so no row waits for a watermark.
    """
    days = events.select(F.col(key), F.date_trunc("day", ts).alias("day"))

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(key, "day").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return days.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_activity(spark: SparkSession, path: str, key: str = "patient_id") -> DataFrame:
    """(key, day, n) over all batches so far."""
    return spark.read.parquet(path).groupBy(key, "day").agg(F.sum("n").alias("n"))


def score_changes(
    changes: DataFrame,
    recompute: Callable[[DataFrame, list[int]], DataFrame],
    schema: StructType,
    path: str,
    checkpoint: str,
    owner: Column | str = "patient_id",
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Keeps the records of changed patients up to date.

    ``recompute(patients, numbers)`` gives the records (of ``schema``) of a
    batch's distinct patients; ``numbers`` are the buckets of these patients,
    for tables written by ``write_bucketed`` under the same number of
    buckets. ``owner`` is the patient of a record. All former records of the
    patients go, also where no new ones replace them; records of others stay.
    A batch reads and writes only its buckets of the stored records, and once
    it is in the log it is not done again.
    """
    owned = F.col(owner) if isinstance(owner, str) else owner

    def apply(batch: DataFrame, batch_id: int) -> None:
        store = KeyedStore(batch.sparkSession, path, schema, buckets)
        if batch_id in store.batches():
            return
        patients = cut_lineage(batch.select("patient_id").distinct())
        numbers = touched(patients, ["patient_id"], buckets)
        gone = patients.select(F.col("patient_id").alias("_gone"))
        stored = store.read(numbers).withColumn("_owner", owned)
        others = stored.join(gone, F.col("_owner").eqNullSafe(F.col("_gone")), "left_anti").drop("_owner")
        store.replace(batch_id, others.unionByName(recompute(patients, numbers)), [owned], numbers)

    return (
        changes.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_records(spark: SparkSession, path: str, schema: StructType, buckets: int = BUCKETS) -> DataFrame:
    """The records that hold after the newest batch."""
    return KeyedStore(spark, path, schema, buckets).read()
