"""Quality scores: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.batches import slices
from wardline.llm.labelled import held_out, training_rows
from wardline.llm.lines import LETTER, SEPARATOR, UPPER, Judged, _count, _table

STATISTICS = (
    "words", "word_length", "symbols", "upper", "digits", "punctuation", "wide", "repeated_lines", "repeated_words", "lines",
    "failed_lines", "closed_lines", "separators", "distinct_words", "most_frequent_word", "equal_neighbours", "shouts",
)
SAMPLE = 20_000
_DIGIT, _POINT = _table(b"0123456789"), _table(b".,;:!?'\"()-")


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per text, over the whole text."""
    j = Judged(column)
    words, lines, n = j.words, j.lines, len(j.words.count)
    data, lo, hi = words.data, words.offsets[:-1], words.offsets[1:]
    count = np.maximum(words.count, 1)
    chars = np.maximum(j.word_chars, 1)
    letters = np.maximum(_count(LETTER[data], lo, hi), 1)
    line_count = np.bincount(lines.text, minlength=n)
    per_line = np.maximum(line_count, 1)
    h = words.hashes()
    text = np.repeat(np.arange(n), words.count)
    order = np.lexsort((h, text))
    head = np.ones(len(order), dtype=bool)
    head[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    starts = np.flatnonzero(head)
    distinct = np.bincount(text[order][starts], minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, text[order][starts], np.diff(np.append(starts, len(order))))
    equal = np.zeros(len(h), dtype=bool)
    equal[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    first, last = words.first[:-1], words.first[1:]
    single = (words.end - words.start == 1) & SEPARATOR[data[words.start]] if len(words.start) else np.zeros(0, dtype=bool)
    columns = (
        np.log1p(words.count), j.word_chars / count, j.n_symbols / chars, _count(UPPER[data], lo, hi) / letters, _count(_DIGIT[data], lo, hi) / chars,
        _count(_POINT[data], lo, hi) / chars, _count(data >= 0xC0, lo, hi) / chars, j.n_dup_lines / per_line, j.n_repeat_words / count, np.log1p(line_count),
        np.bincount(lines.text[j.failed], minlength=n) / per_line, np.bincount(lines.text[j.closed], minlength=n) / per_line,
        _count(single, first, last) / count, distinct / count, most / count, _count(equal, first, last) / count, _count(data == 0x21, lo, hi) / count,
    )
    return np.stack(columns, axis=1).astype(np.float64)


@dataclass
class Forest:
    """Complete trees in arrays: inner nodes by level, then leaves. ``base`` is the log-odds of the labels."""

    base: float
    feature: np.ndarray  # trees x (2^depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2^depth

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while inner and node[:1].size and node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0) -> Forest:
    """Boosts trees on the logistic loss; splits are searched over quantile histograms.

    With one class, or no rows, the score is the smoothed share of label 1.
    """
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    inner = 2**depth - 1
    if not len(y) or y.min() == y.max():
        return Forest(base, np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    total = np.full(len(y), base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            width, below = 2**level, 2**level - 1
            best, split = np.full(width, 1e-9), np.full((width, 2), -1)
            for f, e in enumerate(edges):
                cell = (node - below) * (bins + 1) + binned[:, f]
                g, h = (np.bincount(cell, weights=w, minlength=width * (bins + 1)).reshape(width, -1).cumsum(axis=1) for w in (grad, hess))
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
                gain[:, len(e) :] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better], split[better, 0], split[better, 1] = top[better], f, at[better]
            for k in np.flatnonzero(split[:, 0] >= 0):
                feature[below + k], threshold[below + k] = split[k, 0], edges[split[k, 0]][split[k, 1]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        g, h = (np.bincount(node - inner, weights=w, minlength=inner + 1) for w in (grad, hess))
        leaf = -rate * g / (h + ridge)
        total += leaf[node - inner]
        features.append(feature), thresholds.append(threshold), leaves.append(leaf)
    return Forest(base, np.array(features), np.array(thresholds), np.array(leaves))


def quality_model(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """Trees fitted on the statistics of at most ``sample`` labelled texts outside the held-out fold."""

    def run(batches):
        for batch in slices(batches, "text"):
            x = statistics(batch.column("text"))
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), rows], names=["id", "label", "x"])

    rows = training_rows(docs, labels, label, sample, id_col, text_col).mapInArrow(run, "id long, label int, x array<double>")
    table = rows.toArrow()  # at most ``sample`` rows of statistics, a few MB (repeated ids aside)
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS)) if table.num_rows else np.zeros((0, len(STATISTICS)))
    order = np.lexsort((*x.T, table.column("id").to_numpy())) if table.num_rows else []
    return fit(x[order], table.column("label").to_numpy()[order].astype(np.float64))


def quality_scores(docs: DataFrame, model: Forest, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every whole text.

    The score is the probability of label 1. Null and empty texts have the
    statistics of a text without words and get a score too; null and repeated
    ids keep their rows; an empty table gives an empty result; further
    columns are ignored.
    """

    def run(batches):
        for batch in slices(batches, "text"):
            score = model.score(statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(score), pa.array((score >= cut).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("held_out", held_out("id"))
    scored = texts.select("id", "held_out", "text").mapInArrow(run, "id long, held_out boolean, score double, predicted int")
    return scored.withColumnRenamed("id", id_col)
