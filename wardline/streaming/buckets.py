"""Stored tables in hash buckets of a key, so that a batch touches its own buckets only.

A bucket is a folder; which folders a batch needs is known from its keys, so
the others are neither listed nor read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 256
#: folders of a bucket that are read together before they are merged into one
MOST_PARTS = 8


def bucket_of(keys: list[str | Column], buckets: int = BUCKETS) -> Column:
    """The bucket of a key; null is a key like any other."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def touched(df: DataFrame, keys: list[str | Column], buckets: int = BUCKETS) -> list[int]:
    """The buckets of the keys of a batch: at most ``buckets`` numbers."""
    return sorted(r.bucket for r in df.select(bucket_of(keys, buckets).alias("bucket")).distinct().collect())


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """A table with one folder per bucket of its keys."""
    df.withColumn("bucket", bucket_of(keys, buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str, numbers: list[int]) -> DataFrame:
    """The rows of some buckets of such a table, by partition filters."""
    return spark.read.parquet(path).where(F.col("bucket").isin(numbers)).drop("bucket")


class KeyedStore:
    """Rows of keys in buckets, changed batch by batch.

    A batch writes ``data/version=<batch>/bucket=<b>`` for the buckets it
    touches, and then its log: a file that names the folders of every bucket
    which are the state from now on. The log appears in one step, so a reader
    sees the state before or after a batch, and a batch that is done again
    finds its log and changes nothing. A log is as long as there are buckets,
    whatever the number of rows.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets

    def _file(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        files, path = self._file(folder)
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def batches(self) -> list[int]:
        return sorted(int(n) for n in self._names("log") if n.isdigit())

    def state(self, batch: int | None = None) -> dict[int, list[int]]:
        """Bucket to the versions that hold it after a batch, the last one if none is named."""
        batch = max(self.batches(), default=None) if batch is None else batch
        if batch is None:
            return {}
        text = "".join(r.value for r in self.spark.read.text(f"{self.path}/log/{batch}").collect())
        said = json.loads(text)
        if said["buckets"] != self.buckets:
            raise ValueError(f"the store has {said['buckets']} buckets, not {self.buckets}")
        return {int(b): v for b, v in said["state"].items()}

    def read(self, numbers: list[int] | None = None, batch: int | None = None) -> DataFrame:
        """The current rows, of some buckets or of all. Only their folders are read."""
        folders = [
            f"{self.path}/data/version={v}/bucket={b}"
            for b, versions in self.state(batch).items()
            if numbers is None or b in numbers
            for v in versions
        ]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def add(self, batch: int, rows: DataFrame, key: list[str | Column], numbers: list[int]) -> None:
        """Adds rows to their buckets; a bucket of very many parts is written anew as one."""
        state = self.state()
        full = [b for b in numbers if len(state.get(b, ())) >= MOST_PARTS]
        if full:
            rows = rows.unionByName(self.read(full))
        self._commit(batch, rows, key, {b: v for b, v in state.items() if b not in full})

    def replace(self, batch: int, rows: DataFrame, key: list[str | Column], numbers: list[int]) -> None:
        """Makes rows the whole content of the buckets, none included."""
        self._commit(batch, rows, key, {b: v for b, v in self.state().items() if b not in numbers})

    def _commit(self, batch: int, rows: DataFrame, key: list[str | Column], kept: dict[int, list[int]]) -> None:
        parted = rows.withColumn("bucket", bucket_of(key, self.buckets)).hint("rebalance", "bucket")
        parted.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={batch}")
        written = (int(n.removeprefix("bucket=")) for n in self._names(f"data/version={batch}") if n.startswith("bucket="))
        state = dict(kept)
        for b in written:
            state[b] = [*state.get(b, ()), batch]
        text = json.dumps({"buckets": self.buckets, "state": state})
        draft = f"log/_{batch}"
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{draft}")
        files, last = self._file(f"log/{batch}")
        if not files.rename(self._file(draft)[1], last):
            raise OSError(f"the log of batch {batch} cannot be put in place")

    def clear(self, keep: int = 2) -> int:
        """Removes folders that none of the last ``keep`` logs names; returns how many."""
        batches = self.batches()
        needed = {(v, b) for n in batches[-keep:] for b, versions in self.state(n).items() for v in versions}
        gone = 0
        for version in self._names("data"):
            number = int(version.removeprefix("version="))
            if not batches or number > batches[-1]:  # perhaps of a batch that is being written
                continue
            for bucket in self._names(f"data/{version}"):
                if bucket.startswith("bucket=") and (number, int(bucket.removeprefix("bucket="))) not in needed:
                    files, path = self._file(f"data/{version}/{bucket}")
                    gone += bool(files.delete(path, True))
        return gone
