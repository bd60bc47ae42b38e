"""Seeded ranks, samples, slices and splits of patients.

Random order is md5(seed|key): stable across runs and executors. A global rank
is the size of all smaller hash buckets plus the position inside the bucket,
so no single task ever sorts everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import cut_lineage

SEED = 42
PREFIX = 4


def key_hash(*keys: str, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def bucket_offsets(df: DataFrame, group: list[str], bucket: str, measures: dict[str, Column]) -> DataFrame:
    """Per group and bucket the sums of ``measures`` over all smaller buckets."""
    sums = df.groupBy(*group, bucket).agg(*[F.sum(m).alias(name) for name, m in measures.items()])
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        *group, bucket, *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name) for name in measures]
    )


def hash_rank(df: DataFrame, keys: list[str], group: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """Adds ``rank`` (from 1) of each row by the hash of its unique key, per group."""
    group = group or []
    hashed = df.withColumn("_h", key_hash(*keys, seed=seed)).withColumn("_bucket", F.substring("_h", 1, PREFIX))
    offsets = bucket_offsets(hashed, group, "_bucket", {"_before": F.lit(1).cast("bigint")})
    inside = Window.partitionBy(*group, "_bucket").orderBy("_h", *keys)
    ranked = hashed.withColumn("_in", F.row_number().over(inside)).join(offsets, [*group, "_bucket"])
    return ranked.withColumn("rank", F.col("_before") + F.col("_in")).drop("_h", "_bucket", "_before", "_in")


def distinct_ids(df: DataFrame, key: str = "patient_id") -> DataFrame:
    return df.select(key).distinct()


def halve_patients(patients: DataFrame, use_pretrain: bool = True) -> DataFrame:
    """(patient_id, cohort): the first half by hash for pretraining, the rest downstream."""
    ids = distinct_ids(patients)
    if not use_pretrain:
        return ids.withColumn("cohort", F.lit("downstream"))
    half = F.floor(ids.agg(F.count("*")).scalar() / 2)
    cohort = F.when(F.col("rank") <= half, "pretrain").otherwise("downstream")
    return hash_rank(ids, ["patient_id"]).select("patient_id", cohort.alias("cohort"))


def sample_n(df: DataFrame, n: int, keys: list[str], seed: int = SEED) -> DataFrame:
    """At most ``n`` rows, chosen by the hash of their unique key."""
    return hash_rank(df, keys, seed=seed).where(F.col("rank") <= n).drop("rank")


def equal_slices(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Adds ``slice`` 0..n-1: equal contiguous rank ranges, the last takes the rest."""
    size = F.floor(df.agg(F.count("*")).scalar() / n)
    index = F.when(size > 0, F.least(F.floor((F.col("rank") - 1) / size), F.lit(n - 1))).otherwise(F.lit(n - 1))
    return hash_rank(df, keys).withColumn("slice", index.cast("int")).drop("rank")


def first_n(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def sample_labels(samples: DataFrame) -> DataFrame:
    """(patient_id, label) pairs; a scalar label counts as one, no label as none."""
    if "labels" not in samples.columns:
        return samples.select("patient_id", F.lit(None).cast("string").alias("label")).where(F.lit(False))
    if samples.schema["labels"].dataType.typeName() == "array":
        return samples.select("patient_id", F.explode("labels").alias("label"))
    return samples.select("patient_id", F.col("labels").alias("label")).where(F.col("label").isNotNull())


def label_to_patients(samples: DataFrame) -> DataFrame:
    """Distinct (label, patient_id) pairs."""
    return sample_labels(samples).select("label", "patient_id").distinct()


def label_covering_split(samples: DataFrame, ratio: float = 0.8, other: str = "test") -> DataFrame:
    """(patient_id, split) with every label held by at least one train patient.

    The patient with the smallest hash of each label is forced into train; the
    remaining patients fill train in hash order up to ``int(ratio * patients)``.
    """
    ids = distinct_ids(samples)
    smallest = F.min(F.struct(key_hash("patient_id").alias("h"), F.col("patient_id")))
    forced = sample_labels(samples).groupBy("label").agg(smallest.alias("m")).select("m.patient_id").distinct()
    # one small row per patient, stored so that counts and ranks do not read the samples again
    patients = cut_lineage(ids.join(forced.withColumn("forced", F.lit(True)), "patient_id", "left"))
    counts = patients.agg(F.count("*").alias("n"), F.count("forced").alias("k"))
    room = counts.select(F.floor(F.lit(ratio) * F.col("n")) - F.col("k")).scalar()
    rest = hash_rank(patients.where(F.col("forced").isNull()).select("patient_id"), ["patient_id"])
    filled = rest.select("patient_id", F.when(F.col("rank") <= room, "train").otherwise(other).alias("split"))
    train = patients.where("forced").select("patient_id", F.lit("train").alias("split"))
    return train.unionByName(filled)


def check_split(split: DataFrame, ratio: float = 0.8, tolerance: float = 0.3) -> None:
    """Fails when train or the rest exceeds its share by more than the tolerance."""
    row = split.agg(F.count("*").alias("n"), F.count_if(F.col("split") == "train").alias("train")).first()
    train = row.train / row.n
    if train > ratio + tolerance or 1 - train > 1 - ratio + tolerance:
        raise ValueError(f"train share {train:.2f} is outside {ratio} +- {tolerance}")


def stratified_group_split(samples: DataFrame, folds: int = 5, seed: int = SEED) -> DataFrame:
    """(patient_id, fold): whole patients, spread evenly inside the stratum of their rarest label.

    Each stratum starts at a fold drawn from its hash, so rare labels don't
    all go to the first fold.
    """
    pairs = sample_labels(samples).withColumn("label", F.col("label").cast("string"))
    counts = pairs.groupBy("label").agg(F.count("*").alias("n"))
    rarest = pairs.distinct().join(counts, "label").groupBy("patient_id").agg(F.min(F.struct("n", "label")).alias("m"))
    stratum = F.coalesce(F.col("m.label"), F.lit(""))
    patients = distinct_ids(samples).join(rarest, "patient_id", "left").select("patient_id", stratum.alias("stratum"))
    ranked = hash_rank(patients, ["patient_id"], ["stratum"], seed)
    start = F.conv(F.substring(F.md5(F.col("stratum").cast("binary")), 1, 6), 16, 10).cast("long")
    return ranked.select("patient_id", "stratum", F.pmod(F.col("rank") - 1 + start, F.lit(folds)).cast("int").alias("fold"))


def combo_group_split(samples: DataFrame, folds: int = 5, seed: int = SEED) -> DataFrame:
    """(patient_id, stratum, fold): whole patients, with every combination of labels spread evenly.

    A stratum is the set of a patient's labels, as JSON. Of its n patients,
    in hash order, as many as fill the folds equally are dealt round; the
    n mod ``folds`` left over take the next folds of the rarest label in their
    set, which all strata with that rarest label fill in turn, the largest
    first. So the folds of a combination differ by one at most, and so do
    those of the patients left over per rarest label. Only strata, not
    patients, are numbered under a label.
    """
    pairs = sample_labels(samples).select("patient_id", F.col("label").cast("string").alias("label")).distinct()
    sets = pairs.groupBy("patient_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    labels = F.coalesce("labels", F.array().cast("array<string>")).alias("labels")
    people = distinct_ids(samples).join(sets, "patient_id", "left").select("patient_id", labels)
    people = cut_lineage(people.withColumn("stratum", F.to_json("labels")))
    strata = people.groupBy("stratum", "labels").agg(F.count("*").alias("n"))
    holders = pairs.groupBy("label").agg(F.count("*").alias("holders"))
    rarest = strata.select("stratum", F.explode("labels").alias("label")).join(holders, "label")
    rarest = rarest.groupBy("stratum").agg(F.min(F.struct("holders", "label"))["label"].alias("rarest"))
    strata = strata.join(rarest, "stratum", "left").select("stratum", "n", F.coalesce("rarest", F.lit("")).alias("rarest"))
    left = F.col("n") % folds
    before = Window.partitionBy("rarest").orderBy(F.col("n").desc(), "stratum").rowsBetween(Window.unboundedPreceding, -1)
    strata = strata.withColumn("taken", F.coalesce(F.sum(left).over(before), F.lit(0)))
    ranked = hash_rank(people.select("patient_id", "stratum"), ["patient_id"], ["stratum"], seed).join(strata, "stratum")

    def start(of: str) -> Column:
        return F.conv(F.substring(F.md5(F.col(of).cast("binary")), 1, 6), 16, 10).cast("long")

    place = F.when(F.col("rank") <= F.col("n") - left, F.col("rank") - 1 + start("stratum"))
    place = place.otherwise(start("rarest") + F.col("taken") + F.col("rank") - 1 - (F.col("n") - left))
    return ranked.select("patient_id", "stratum", F.pmod(place, F.lit(folds)).cast("int").alias("fold"))


def balance_1_1(df: DataFrame, keys: list[str], label: str = "labels") -> DataFrame:
    """As many positives (label 1) as negatives, alternating by rank."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    both = counts.agg(F.when(F.count("*") > 1, F.min("n")).otherwise(0)).scalar()
    return hash_rank(df, keys, [label]).where(F.col("rank") <= both)


def balance_weighted(
    df: DataFrame, keys: list[str], labels: str = "labels", p_labelled: float = 0.9
) -> DataFrame:
    """Labelled and unlabelled rows in the ratio p : 1-p until one class ends.

    Unchanged when a class is empty.
    """
    marked = df.withColumn("_has", (F.size(labels) > 0).cast("int"))
    n_pos, n_neg = (marked.agg(F.count_if(F.col("_has") == v)).scalar() for v in (1, 0))
    draws = F.least(n_pos / p_labelled, n_neg / (1 - p_labelled))
    cap = F.floor(F.when(F.col("_has") == 1, draws * p_labelled).otherwise(draws * (1 - p_labelled)) + 1e-9)
    one_class = (n_pos == 0) | (n_neg == 0)
    return hash_rank(marked, keys, ["_has"]).where(one_class | (F.col("rank") <= cap)).drop("rank", "_has")


def class_balance_counts(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Positives and negatives; for label lists rows with and without labels."""
    positive = F.size(labels) > 0 if df.schema[labels].dataType.typeName() == "array" else F.col(labels) == 1
    return df.agg(F.count_if(positive).alias("positives"), F.count_if(~positive).alias("negatives"))


def label_counts(samples: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent labels, ties by label."""
    counts = sample_labels(samples).groupBy("label").agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "label").limit(top)


def mean_labels(samples: DataFrame) -> DataFrame:
    return samples.agg(F.avg(F.size("labels")).alias("mean_labels"))


def frequent_labels(df: DataFrame, col: str, cutoff: float = 0.005) -> DataFrame:
    """Values whose share of the non-null rows is above the cutoff."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    share = F.col("n") / counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", share).where(F.col("share") > cutoff)


def build_stats(samples: DataFrame) -> DataFrame:
    return samples.agg(
        F.count_distinct("patient_id").alias("patients"),
        F.count_distinct("encounter_id").alias("encounters"),
        F.count("*").alias("samples"),
    )
