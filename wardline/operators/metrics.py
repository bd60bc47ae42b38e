"""Classification metrics on prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.splits import bucket_offsets
from wardline.session import cut_lineage


def _ratio(top: Column, bottom: Column) -> Column:
    """Quotient, 0 when there is nothing to divide by."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def class_counts(df: DataFrame, truth: str = "truth", predicted: str = "predicted", classes: DataFrame | None = None) -> DataFrame:
    """(label, tp, fp, fn) of two label-list columns.

    Classes are the labels of ``classes`` (one column, label), or all that
    occur in the truth or in a prediction, so no false positive is left out.
    A null list is an empty one.
    """
    t, p = (F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)) for c in (truth, predicted))

    def tagged(labels: Column, kind: str) -> Column:
        return F.transform(labels, lambda x: F.struct(x.alias("label"), F.lit(kind).alias("kind")))

    marks = F.concat(
        tagged(F.array_intersect(t, p), "tp"),
        tagged(F.array_except(p, t), "fp"),
        tagged(F.array_except(t, p), "fn"),
    )
    rows = df.select(F.inline(marks))
    counts = rows.groupBy("label").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")])
    if classes is None:
        return counts
    return classes.select("label").distinct().join(counts, "label", "left").na.fill(0, ["tp", "fp", "fn"])


def metrics_from_counts(counts: DataFrame, rows: Column | int) -> DataFrame:
    """One row: accuracy over all (row, class) cells, macro, micro and weighted scores."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    per_class = counts.withColumns(
        {
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
            "support": tp + fn,
        }
    )
    names = ("precision", "recall", "f1")
    sums = per_class.agg(
        F.count("*").alias("classes"),
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "support")],
        *[F.avg(m).alias(f"macro_{m}") for m in names],
        *[F.sum(F.col(m) * F.col("support")).alias(f"w_{m}") for m in names],
    )
    micro = {
        "micro_precision": _ratio(tp, tp + fp),
        "micro_recall": _ratio(tp, tp + fn),
        "micro_f1": _ratio(2 * tp, 2 * tp + fp + fn),
    }
    cells = (rows if isinstance(rows, Column) else F.lit(rows)) * F.col("classes")
    return sums.select(
        (F.lit(1.0) - (fp + fn) / cells).alias("accuracy"),
        *[F.col(f"macro_{m}") for m in names],
        *[c.alias(n) for n, c in micro.items()],
        *[_ratio(F.col(f"w_{m}"), F.col("support")).alias(f"weighted_{m}") for m in names],
    )


def classification_metrics(df: DataFrame, truth: str = "truth", predicted: str = "predicted", classes: DataFrame | None = None) -> DataFrame:
    """Multi-label metrics of two label-list columns, over ``classes`` (say, those of the training set) if given."""
    return metrics_from_counts(class_counts(df, truth, predicted, classes), df.agg(F.count("*")).scalar())


def top_k_label_metrics(
    df: DataFrame, k: int = 10, truth: str = "truth", predicted: str = "predicted", classes: DataFrame | None = None
) -> DataFrame:
    """The same on the ``k`` most frequent labels of the truth."""
    counts = class_counts(df, truth, predicted, classes)
    top = counts.orderBy((F.col("tp") + F.col("fn")).desc(), "label").limit(k)
    return metrics_from_counts(top, df.agg(F.count("*")).scalar())


def binary_metrics(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class of two 0/1 columns."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    sums = df.agg(
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.avg((t == p).cast("int")).alias("accuracy"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(
        "accuracy",
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def score_steps(df: DataFrame, truth: str = "truth", score: str = "score", ranges: int | None = None) -> DataFrame:
    """(s, pos, neg, b): a stored row per score with its range, the highest scores first.

    The bounds of the ranges come from a sample of the scores, so ranges hold
    about the same number of steps however the scores crowd.
    """
    steps = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg")
    )
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(steps.repartitionByRange(ranges, F.col("s").desc()).withColumn("b", F.spark_partition_id()))


def ranking_metrics(df: DataFrame, truth: str = "truth", score: str = "score", ranges: int | None = None) -> DataFrame:
    """(auc_roc, auc_pr) of a 0/1 column and a score; ties form one step, null scores are left out.

    Running sums are the totals of the higher score ranges plus a running sum
    inside the range; both are read from one stored table of steps.
    """
    placed = score_steps(df, truth, score, ranges)
    offsets = bucket_offsets(placed, [], "b", {"pos_off": F.col("pos"), "neg_off": F.col("neg")})
    inside = Window.partitionBy("b").orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = placed.join(F.broadcast(offsets), "b").select(  # a row per range
        "pos",
        "neg",
        (F.sum("pos").over(inside) + F.col("pos_off")).alias("cum_pos"),
        (F.sum("neg").over(inside) + F.col("neg_off")).alias("cum_neg"),
    )
    pos_above = F.col("cum_pos") - F.col("pos")
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    sums = run.agg(
        F.sum(F.col("neg") * (pos_above + F.col("pos") / 2)).alias("area"),
        F.sum(F.col("pos") * precision).alias("ap"),
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
    )
    roc = F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("area") / (F.col("p") * F.col("n")))
    return sums.select(roc.alias("auc_roc"), _ratio(F.col("ap"), F.col("p")).alias("auc_pr"))


def perplexity(losses: DataFrame, batch: str = "batch", loss: str = "loss") -> DataFrame:
    """Mean of exp(loss) per batch, averaged over batches."""
    per_batch = losses.groupBy(batch).agg(F.avg(F.exp(loss)).alias("p"))
    return per_batch.agg(F.avg("p").alias("perplexity"))


def running_best(log: DataFrame, step: str, bucket: Column) -> DataFrame:
    """Rows of a (metric, step, value) log that set a new best value.

    Best is the largest value, or the smallest for metrics named after a loss.
    ``bucket`` is a non-decreasing function of the step that cuts long logs
    into ranges; the best of earlier ranges is carried in.
    """
    gain = F.when(F.contains(F.col("metric"), F.lit("loss")), -F.col("value")).otherwise(F.col("value"))
    placed = log.withColumns({"_gain": gain, "_b": bucket})
    tops = placed.groupBy("metric", "_b").agg(F.max("_gain").alias("_top"))
    earlier = Window.partitionBy("metric").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select("metric", "_b", F.max("_top").over(earlier).alias("_carried"))
    inside = Window.partitionBy("metric", "_b").orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    best = F.greatest(F.max("_gain").over(inside), F.col("_carried"))
    marked = placed.join(carried, ["metric", "_b"]).withColumn("_best", best)
    new = F.col("_best").isNull() | (F.col("_gain") > F.col("_best"))
    return marked.where(new).drop("_gain", "_b", "_carried", "_best")
