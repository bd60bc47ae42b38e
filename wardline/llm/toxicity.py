"""Toxicity scores: FTRL-proximal logistic regression over hashed n-grams and skip-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.batches import LOWER, SPACE, Words, mix, prefix_sums, slices, span_hashes
from wardline.llm.labelled import held_out, training_rows
from wardline.session import cut_lineage

SAMPLE, SHARD_ROWS, EPOCHS = 24_000, 12_000, 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.1
#: share of the classes' log odds by which the bias is centred: toxic texts are the rarer class
CENTRE = 0.7
#: features are counted in so many bins before they are numbered
COUNTERS = 1 << 23
#: features are hashed to so many bits; the model holds only those with a weight, at most so many
BITS = 40
MOST_WEIGHTS = 200_000
_U = np.uint64
_CLEAN = LOWER.copy()
_CLEAN[[b for b in range(128) if not (chr(b).isalnum() or SPACE[b])]] = 0x20


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all words, word pairs and pairs over one skipped word.

    Words are lower-cased (A-Z) and cut at all ASCII characters but letters
    and digits.
    """
    words = Words(column, recode=_CLEAN)
    h = words.hashes()
    text = np.repeat(np.arange(len(words.count)), words.count)
    texts, hashes = [text], [h]
    for gap, seed in ((1, 0x9E37), (2, 0x79B9)):
        if len(h) > gap:
            same = text[gap:] == text[:-gap]
            texts.append(text[gap:][same])
            hashes.append(mix(h[:-gap][same] * _U(0x9E3779B97F4A7C15) + h[gap:][same] + _U(seed)))
    return np.concatenate(texts), np.concatenate(hashes) >> _U(64 - BITS)


def _sets(column: pa.Array) -> list[np.ndarray]:
    """The distinct feature hashes of each text."""
    text, h = grams(column)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return np.split(h[new], np.searchsorted(text[new], np.arange(1, len(column))))


@dataclass
class Weights:
    """Hashes with a weight, ascending, and the bias; at most ``MOST_WEIGHTS`` of them."""

    key: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        n = len(column)
        total = np.full(n, self.bias)
        if len(self.key):
            text, h = grams(column)
            filter_ = np.zeros(1 << 20, dtype=bool)
            filter_[(self.key & _U((1 << 20) - 1)).astype(np.int64)] = True
            some = np.flatnonzero(filter_[(h & _U((1 << 20) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.key, h[some]), len(self.key) - 1)
            hit = self.key[at] == h[some]
            pair = np.unique(np.stack([text[some][hit], at[hit]]), axis=1)  # each feature once a text
            np.add.at(total, pair[0], self.weight[pair[1]])
        return 1 / (1 + np.exp(-total))


def ftrl(rows: list[np.ndarray], y: np.ndarray, features: int, epochs: int = EPOCHS, l1: float = L1) -> tuple[np.ndarray, float]:
    """Weights and bias by FTRL-proximal steps over the rows; a row is the array of its feature numbers.

    Each coordinate has its own rate, ALPHA / (BETA + root of its summed
    squared gradients); ``l1`` keeps a coordinate at zero until its evidence
    exceeds it. The bias is not penalised.
    """
    z, n = np.zeros(features), np.zeros(features)
    bias_z = bias_n = 0.0

    def weight(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def bias():
        return -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)

    for _ in range(epochs):
        for index, label in zip(rows, y, strict=True):
            zi, ni = z[index], n[index]
            w = weight(zi, ni)
            b = bias()
            g = 1 / (1 + np.exp(-max(min(b + w.sum(), 35.0), -35.0))) - label
            step = g * g
            z[index] = zi + g - (np.sqrt(ni + step) - np.sqrt(ni)) / ALPHA * w
            n[index] = ni + step
            bias_z += g - (np.sqrt(bias_n + step) - np.sqrt(bias_n)) / ALPHA * b
            bias_n += step
    return weight(z, n), float(bias())


def least_texts(l1: float, epochs: int) -> int:
    """Texts below which a feature can have no weight: a step adds at most 1 to its evidence, and more than ``l1`` is needed."""
    return int(l1 // epochs) + 1


def sparse_ftrl(rows: list[np.ndarray], y: np.ndarray, features: int, most: int) -> tuple[np.ndarray, float]:
    """``ftrl`` with the standard L1, or raised by quarters until it leaves at most ``most`` weights.

    The bias is centred towards equal classes by ``CENTRE`` of their log odds.
    """
    l1 = L1
    while True:
        w, bias = ftrl(rows, y, features, l1=l1)
        if np.count_nonzero(w) <= most:
            break
        l1 *= 1.25
    toxic = y.mean()
    return w, bias + CENTRE * float(np.log((1 - toxic) / toxic)) if 0 < toxic < 1 else bias


def toxicity_model(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> Weights:
    """Weights learned from at most ``sample`` labelled texts outside the held-out fold.

    The sample is cut into shards of about ``shard_rows`` texts by the hash of
    the ids. Each shard runs FTRL in a task of its own; the model is the mean
    of their sparse weights. Without labelled rows the score is about 0. A
    shard whose text is so rich that its share of ``MOST_WEIGHTS`` weights
    does not hold it learns again with a stronger L1.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("order").to_numpy(), kind="stable")))
        texts = np.zeros(COUNTERS, dtype=np.int32)
        for part in slices(table.to_batches(), "text"):
            for h in _sets(part.column("text")):
                texts[(h % _U(COUNTERS)).astype(np.int64)] += 1
        often = [
            np.unique(np.concatenate([h[texts[(h % _U(COUNTERS)).astype(np.int64)] >= least_texts(L1, EPOCHS)] for h in _sets(part.column("text"))]))
            for part in slices(table.to_batches(), "text")
        ]
        seen = np.unique(np.concatenate(often))
        rows = []  # feature numbers of 4 bytes
        for part in slices(table.to_batches(), "text"):
            for h in _sets(part.column("text")):
                at = np.searchsorted(seen, h)
                known = at < len(seen)
                rows.append(at[known][seen[at[known]] == h[known]].astype(np.int32))
        w, bias = sparse_ftrl(rows, table.column("label").to_numpy().astype(np.float64), len(seen), MOST_WEIGHTS // shards)
        some = w != 0
        return pa.table({"key": pa.array(np.append(seen.view(np.int64)[some], -1)), "weight": pa.array(np.append(w[some], bias))})

    rows = cut_lineage(training_rows(docs, labels, label, sample, id_col, text_col))
    shards = max(1, -(-rows.count() // shard_rows))
    rows = rows.withColumn("order", F.xxhash64(F.lit(1), "id")).withColumn("shard", F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(shards)))
    found = cut_lineage(rows.groupBy("shard").applyInArrow(run, "key long, weight double"))
    biases = found.where("key = -1").agg(F.sum("weight"), F.count("*")).first()
    trained = biases[1]
    if not trained:
        return Weights(np.zeros(0, dtype=_U), np.zeros(0), -35.0)
    sums = found.where("key != -1").groupBy("key").agg(F.sum("weight").alias("weight"))
    got = sums.toArrow()  # MOST_WEIGHTS rows of 16 bytes at most
    key, weight = (got.column(c).to_numpy() for c in ("key", "weight"))
    order = np.argsort(key)
    return Weights(key[order].view(_U), weight[order] / trained, float(biases[0]) / trained)


def toxicity_scores(docs: DataFrame, model: Weights, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every whole text.

    A text's features count once each, wherever they stand, so one insult in a
    long text weighs as much as in a short one. Null and empty texts have no
    features and get the bias's score; null and repeated ids keep their rows;
    an empty table gives an empty result; further columns are ignored.
    """

    def run(batches):
        for batch in slices(batches, "text"):
            score = model.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(score), pa.array((score >= cut).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("held_out", held_out("id"))
    scored = texts.select("id", "held_out", "text").mapInArrow(run, "id long, held_out boolean, score double, predicted int")
    return scored.withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, model: Weights, cut: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below ``cut``, with all their columns."""

    def run(batches):
        for batch in slices(batches, text_col):
            yield batch.filter(pa.array(model.score(batch.column(text_col)) < cut))

    return docs.mapInArrow(run, docs.schema)
