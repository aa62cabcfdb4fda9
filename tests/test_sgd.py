"""Machines trained by stochastic gradient against plain steps and the batch solver."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from reviewloom.operators import bayes, classify, sgd
from reviewloom.operators.centers import Rows


def test_a_walk_equals_plain_steps():
    rng = np.random.default_rng(1)
    n, width, classes, alphas = 60, 7, 3, np.array([0.1, 0.01])
    x = rng.normal(size=(n, width)) * (rng.random((n, width)) < 0.5)
    labels = rng.integers(0, classes, n)
    begin = np.concatenate([[0], np.cumsum((x != 0).sum(1))])
    rows = Rows(begin, np.nonzero(x)[1], x[x != 0])
    weights, scale = np.zeros((width + 1, 2 * classes)), np.ones(2 * classes)
    losses = sgd.walk(rows, labels, np.arange(n), weights, scale, alphas, classes, 5)
    for a, alpha in enumerate(alphas):
        for c in range(classes):
            w, b, loss = np.zeros(width), 0.0, 0.0
            for i in range(n):
                y, rate = (1 if labels[i] == c else -1), 1 / (alpha * (6 + i + 1 / alpha))
                margin = y * (x[i] @ w + b)
                w *= 1 - rate * alpha
                if margin < 1:
                    loss += 1 - margin
                    w, b = w + rate * y * x[i], b + 0.1 * rate * y
            at = a * classes + c
            assert np.allclose(weights[:-1, at] * scale[at], w) and np.isclose(weights[-1, at], b)
            losses[a] -= loss
    assert np.allclose(losses, 0)


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        label = int(rng.integers(0, 4))
        words = np.unique(np.concatenate([rng.integers(0, 40, 6), 40 + 10 * label + rng.integers(0, 10, 2)]))
        rows.append((i, f"l{label}", Vectors.sparse(80, words.tolist(), np.ones(len(words)).tolist())))
    rows += [(900, None, Vectors.sparse(80, [], [])), (901, "l1", None)]
    return spark.createDataFrame(rows, ["id", "lang", "features"]
                                 ).repartition(3, "id").persist()


def test_as_good_as_the_batch_solver(spark, texts):
    known = texts.where("lang IS NOT NULL AND features IS NOT NULL")
    train, test = known.where("id % 4 > 0"), known.where("id % 4 = 0")
    models = sgd.fit_hinge(texts.where("id % 4 > 0 OR id >= 900"), "features", "lang", 80, [1e-2, 1e-3])
    batch = bayes.accuracy(classify.svm_on_vectors(train.coalesce(1), test, "lang", 4, iterations=10), "lang").first()["accuracy"]
    own = [bayes.accuracy(m.predict(test), "lang").first()["accuracy"] for m in models]
    assert [m.labels for m in models] == [["l0", "l1", "l2", "l3"]] * 2
    assert max(own) >= batch - 0.01 and min(own) >= 0.9


def test_two_runs_give_the_same_model(texts):
    a, b = (sgd.fit_hinge(texts, "features", "lang", 80, [1e-3], epochs=3)[0] for _ in range(2))
    assert np.allclose(a.weights, b.weights) and a.epochs <= 3


def test_without_labelled_rows(texts):
    with pytest.raises(ValueError):
        sgd.fit_hinge(texts.where("lang IS NULL"), "features", "lang", 80)
