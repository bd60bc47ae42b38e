import math
import random

import numpy as np
import pytest

from wardline.llm import toxicity


def test_a_model_that_is_too_large_is_learned_again(spark, make, monkeypatch):
    rng = random.Random(7)
    # signs of different strength, apart from each other
    signs = [[w for i, w in enumerate(words) if rng.random() < 0.9 - 0.2 * i] for k in range(1500) for words in [("bad", "worse", "awful") if k % 2 else ("good", "better", "fine")]]
    rows = [(k, " ".join(f"{w} x{rng.randrange(10**6)}" for w in [*own, "y", "y", "y"])) for k, own in enumerate(signs)]
    docs, labels = make(rows), spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, toxic int")
    model = toxicity.toxicity_model(docs, labels)
    assert len(model.key) > 1 and (np.diff(model.key.view(np.int64)) > 0).all()
    monkeypatch.setattr(toxicity, "MOST_WEIGHTS", len(model.key) - 1)
    smaller = toxicity.toxicity_model(docs, labels)
    assert 0 < len(smaller.key) < len(model.key)
    got = toxicity.toxicity_scores(docs, smaller).collect()
    assert sum(r.predicted == r.doc_id % 2 for r in got) >= 0.8 * len(got)


def ftrl_by_hand(rows, y, features, epochs, l1):
    """FTRL-proximal as published, one coordinate after the other."""
    z, n, bias_z, bias_n = [0.0] * features, [0.0] * features, 0.0, 0.0

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    def bias():
        return -bias_z / ((toxicity.BETA + math.sqrt(bias_n)) / toxicity.ALPHA)

    for _ in range(epochs):
        for row, label in zip(rows, y):
            w, b = {i: weight(i) for i in row}, bias()
            g = 1 / (1 + math.exp(-(b + sum(w.values())))) - label
            for i in row:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
            sigma = (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / toxicity.ALPHA
            bias_z += g - sigma * b
            bias_n += g * g
    return [weight(i) for i in range(features)], bias()


@pytest.mark.parametrize("l1", [0.5, 3.0])
def test_steps_equal_the_published_ones(l1):
    rng = np.random.default_rng(4)
    y = (rng.random(200) < 0.3).astype(float)
    rows = [np.unique(np.append(rng.integers(0, 30, rng.integers(1, 9)), [28] * int(t) + [29] * int(1 - t))) for t in y]
    w, bias = toxicity.ftrl(rows, y, 30, epochs=3, l1=l1)
    want, want_bias = ftrl_by_hand([r.tolist() for r in rows], y.tolist(), 30, 3, l1)
    assert w == pytest.approx(want) and bias == pytest.approx(want_bias) and np.count_nonzero(w) >= 2


def test_rare_features_have_no_weight_anyway():
    y = np.array([1.0, 0.0] * 50)
    least = toxicity.least_texts(toxicity.L1, toxicity.EPOCHS)
    rows = [np.array([1 + k]) if k < 2 * (least - 1) and k % 2 == 0 else np.array([0]) for k in range(100)]
    rows = [np.array([1]) if len(r) and r[0] > 1 else r for r in rows]  # one feature in ``least - 1`` toxic texts
    w, _ = toxicity.ftrl(rows, y, 2)
    assert sum(1 in r for r in rows) == least - 1 and w[1] == 0


def test_toxic_documents_of_the_tables_are_found(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    scores = toxicity.toxicity_scores(docs, toxicity.toxicity_model(docs, labels)).where("held_out")
    counts = {(r.toxic, r.predicted): r["count"] for r in scores.join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()}
    toxic, clean = (counts.get((t, 0), 0) + counts.get((t, 1), 0) for t in (1, 0))
    assert counts[1, 1] >= 0.9 * toxic and counts[0, 0] >= 0.99 * clean
