"""Fits held against their objectives: gradients that vanish, splits that no other split beats, means of folds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import datasets, models, training
from tidemark.plans.learning_queries import FOLDS
from tidemark.plans.roles import role

NAMES = ["x1", "x2"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    made = [(i, None if rng.random() < 0.1 else float(rng.randrange(30)), float(rng.randrange(20)) / 2) for i in range(600)]
    made = [(i, a, b, (0.3 if a is None else a / 30) - b / 12 + (0.5 if (a or 0) > 20 and b < 4 else 0) + rng.gauss(0, 0.3)) for i, a, b in made]
    return spark.createDataFrame(made, "id int, x1 double, x2 double, y double").withColumn("up", (F.col("y") > 0).cast("double")).cache()


def arrays(rows, saved, target):
    found = rows.orderBy("id").collect()
    x = np.array([[(i["median"] if r[i["feature"]] is None else r[i["feature"]]) for i in saved["inputs"]] for r in found])
    return (x - [i["mean"] for i in saved["inputs"]]) / [i["scale"] for i in saved["inputs"]], np.array([r[target] for r in found])


def predictions(rows, saved):
    return np.array([r.p for r in rows.select("id", models.expression(saved).alias("p")).orderBy("id").collect()])


def test_gradient_of_the_logistic_fit_vanishes(rows):
    saved = models.parameters(rows, NAMES, "up", "logistic", "classification")
    x, y = arrays(rows, saved, "up")
    w, n = np.array(saved["weights"]), len(y)
    p = 1 / (1 + np.exp(-(x @ w + saved["intercept"])))
    assert np.abs(x.T @ (p - y) / n + w / (models.C * n)).max() < 1e-6 and abs((p - y).mean()) < 1e-6
    assert np.allclose(predictions(rows, saved), p, atol=1e-12)


def test_gradient_of_the_ridge_fit_vanishes(rows):
    saved = models.parameters(rows, NAMES, "y", "ridge", "regression")
    x, y = arrays(rows, saved, "y")
    rest = x @ np.array(saved["weights"]) + saved["intercept"] - y
    assert np.abs(x.T @ rest + models.ALPHA * np.array(saved["weights"])).max() < 1e-6 and abs(rest.sum()) < 1e-6


def gain(y, left, task):
    spread = (lambda v: 2 * v.mean() * (1 - v.mean())) if task == "classification" else np.var
    n, k = len(y), left.sum()
    return spread(y) - (k * spread(y[left]) + (n - k) * spread(y[~left])) / n


@pytest.mark.parametrize(("target", "task"), [("y", "regression"), ("up", "classification")])
def test_no_other_split_beats_those_of_the_tree(rows, target, task):
    saved = models.parameters(rows, NAMES, target, "tree", task)
    x, y = arrays(rows, saved, target)
    splits = []

    def check(node, at, depth):
        if not isinstance(node, list):
            assert abs(node - y[at].mean()) < 1e-9
            return
        feature, threshold, left, right = node
        inside = x[at, feature] <= threshold
        assert min(inside.sum(), (~inside).sum()) >= models.LEAF
        best = 0.0
        for f in range(x.shape[1]):
            for t in np.unique(x[at, f])[:-1]:
                other = x[at, f] <= t
                if min(other.sum(), (~other).sum()) >= models.LEAF:
                    best = max(best, gain(y[at], other, task))
        assert gain(y[at], inside, task) > best - 1e-9
        splits.append(depth)
        for side, mask in ((left, inside), (right, ~inside)):
            check(side, at[mask], depth + 1)

    check(saved["tree"], np.arange(len(y)), 0)
    assert len(splits) >= 3 and max(splits) < models.DEPTH
    walked = predictions(rows, saved)
    assert len(np.unique(walked)) <= 2**models.DEPTH and abs(walked.mean() - y.mean()) < 1e-9


def test_runs_learn_the_means_of_their_folds(spark, sf):
    pairs = role(spark, sf, "pairs").withColumn("intended_exit_at", F.col("label_available_at"))
    assigned = datasets.assign(pairs, datasets.fold_plans(pairs, kind="expanding", **FOLDS)).cache()
    found = training.run(assigned, NAMES, [("regression", "mean")])
    assert found and {r["fold"] for r in found} == {r.fold for r in assigned.select("fold").distinct().collect()}
    for r in found:
        own = assigned.where((F.col("fold") == r["fold"]) & (F.col("partition") == "train") & (F.size("reasons") == 0))
        taught = training.training_rows(own, NAMES, F.col("training_asof")).where("reason is null").select("target").collect()
        if r["parameters"]:
            assert abs(r["parameters"]["value"] - np.mean([t.target for t in taught])) < 1e-12
        else:
            assert r["reason"]
