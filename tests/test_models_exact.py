"""Efron ties and exact Shapley values against their definitions."""

import math
from itertools import combinations

import numpy as np
import pytest

from lapsekit.operators import survival as V


def cox_frame(spark, t, e, x):
    return spark.createDataFrame([(int(a), int(b), *map(float, c)) for a, b, c in zip(t, e, x)], "t int, e int, x0 double, x1 double")


def standardised(x):
    sd = x.std(axis=0, ddof=1)
    return (x - x.mean(axis=0)) / sd, sd


def efron_score(beta, t, e, z, penalizer):
    w, score = np.exp(z @ beta), -len(t) * penalizer * beta
    for at in np.unique(t[e == 1]):
        tied, risk = np.flatnonzero((t == at) & (e == 1)), t >= at
        for k in range(len(tied)):
            share = k / len(tied)
            s0 = w[risk].sum() - share * w[tied].sum()
            s1 = (w[risk, None] * z[risk]).sum(axis=0) - share * (w[tied, None] * z[tied]).sum(axis=0)
            score = score + z[tied[k]] - s1 / s0
    return score


def fitted(spark, t, e, x, **how):
    rows = V.cox_fit(cox_frame(spark, t, e, x), "t", "e", ["x0", "x1"], **how).collect()
    return np.array([r["coef"] for r in rows]), np.array([r["se"] for r in rows])


@pytest.mark.parametrize("most", [6, 30])
def test_efron_score_equation_is_zero(spark, most):
    rng = np.random.default_rng(most)
    x, t, e = rng.normal(size=(150, 2)), rng.integers(1, most, 150), rng.integers(0, 2, 150)
    z, sd = standardised(x)
    coef, se = fitted(spark, t, e, x, penalizer=0.05)
    beta = coef * sd
    assert np.abs(efron_score(beta, t, e, z, 0.05)).max() < 1e-6
    step = 1e-5  # the standard errors come from the score's derivative
    hess = np.stack([(efron_score(beta - step * u, t, e, z, 0.05) - efron_score(beta + step * u, t, e, z, 0.05)) / (2 * step) for u in np.eye(2)])
    assert np.sqrt(np.diag(np.linalg.inv(hess))) / sd == pytest.approx(se, rel=1e-5)


def test_without_ties_both_rules_agree(spark):
    rng = np.random.default_rng(3)
    x, t, e = rng.normal(size=(80, 2)), rng.permutation(80) + 1, rng.integers(0, 2, 80)
    a, b = (fitted(spark, t, e, x, ties=k)[0] for k in ("efron", "breslow"))
    assert a == pytest.approx(b, abs=1e-9)
    with pytest.raises(ValueError):
        V.cox_fit(cox_frame(spark, t, e, x), "t", "e", ["x0"], ties="exact")


def test_tied_sums_in_pieces():
    whole, cut = V._tied(1000, 7.0, 3.0), V._tied(1000, 7.0, 3.0, chunk=37)
    assert cut == pytest.approx(whole, rel=1e-12)


# --- Shapley values

def random_tree(rng, n_features, depth):
    tree = {k: [] for k in ("feature", "threshold", "categories", "left", "right", "value", "cover")}

    def grow(level, cover):
        node = len(tree["feature"])
        for k in tree:
            tree[k].append(None)
        tree["value"][node], tree["cover"][node] = float(rng.normal()), float(cover)
        if level == depth or cover < 2 or rng.random() < 0.15:
            tree["feature"][node], tree["left"][node], tree["right"][node] = -1, -1, -1
            return node
        tree["feature"][node] = f = int(rng.integers(n_features))
        if f == 0:
            tree["categories"][node] = set(map(float, rng.choice(4, 2, replace=False)))
        else:
            tree["threshold"][node] = float(rng.normal())
        part = int(rng.integers(1, cover))
        tree["left"][node], tree["right"][node] = grow(level + 1, part), grow(level + 1, cover - part)
        return node

    grow(0, 200)
    return tree


def worth(tree, row, known, node=0):
    f = tree["feature"][node]
    if f < 0:
        return tree["value"][node]
    left, right = tree["left"][node], tree["right"][node]
    if f in known:
        goes = row[f] in tree["categories"][node] if tree["categories"][node] is not None else row[f] <= tree["threshold"][node]
        return worth(tree, row, known, left if goes else right)
    covers = tree["cover"][left], tree["cover"][right]
    return (covers[0] * worth(tree, row, known, left) + covers[1] * worth(tree, row, known, right)) / sum(covers)


def enumerated(trees, row, n):
    value = lambda known: sum(t["weight"] * worth(t, row, known) for t in trees)
    out = np.zeros(n)
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        for k in range(n):
            for known in combinations(rest, k):
                weight = math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
                out[i] += weight * (value({*known, i}) - value(set(known)))
    return out


@pytest.mark.parametrize("seed,n,depth", [(0, 3, 4), (1, 6, 5), (2, 8, 6), (3, 2, 7)])
def test_shapley_values_are_those_of_all_subsets(seed, n, depth):
    from lapsekit.ml.models import leaf_paths, shapley_rows
    rng = np.random.default_rng(seed)
    trees = [random_tree(rng, n, depth) | {"weight": w} for w in (1.0, 0.3, 0.3)]
    x = rng.normal(size=(7, n))
    x[:, 0] = rng.integers(0, 5, 7)  # one value that no split names
    x[0, 1] = np.nan
    phi, base, margin = shapley_rows(x, leaf_paths(trees), n)
    for row, own, m in zip(x, phi, margin):
        assert own == pytest.approx(enumerated(trees, row, n), abs=1e-9)
        assert own.sum() + base == pytest.approx(m, abs=1e-9)
        assert m == pytest.approx(sum(t["weight"] * worth(t, row, set(range(n))) for t in trees), abs=1e-9)


def test_shapley_of_a_path_with_many_features():
    from lapsekit.ml.models import _shapley_of_patterns
    rng = np.random.default_rng(8)
    passes, shares = rng.integers(0, 2, (5, 20)).astype(float), rng.random(20)
    got = _shapley_of_patterns(passes, shares)
    assert got.sum(axis=1) == pytest.approx(passes.prod(axis=1) - shares.prod(), abs=1e-9)


# --- perceptron and search

def net_rows(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    return x, (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=n) > 0).astype(float), rng.uniform(0.5, 3, n)


def test_perceptron_gradient_is_that_of_finite_differences():
    from lapsekit.ml.perceptron import loss_and_gradient, start
    x, y, w = net_rows(40)
    layers = [4, 6, 5, 1]
    theta = start(layers, 3) + 0.05 * np.random.default_rng(1).normal(size=len(start(layers, 3)))
    got = loss_and_gradient(theta, layers, x, y, w)
    step = 1e-6
    for i in np.random.default_rng(2).choice(len(theta), 25, replace=False):
        u = np.eye(1, len(theta), i)[0] * step
        slope = (loss_and_gradient(theta + u, layers, x, y, w)[1] - loss_and_gradient(theta - u, layers, x, y, w)[1]) / (2 * step)
        assert got[2 + i] == pytest.approx(slope, rel=1e-4, abs=1e-5)
    assert got[0] == pytest.approx(w.sum())


def test_weights_equal_repeated_rows_however_they_are_partitioned(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from lapsekit.ml.perceptron import Objective, fit_perceptron, start
    x, y, _ = net_rows(60)
    d = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "v array<double>, label int").withColumn("features", array_to_vector("v"))
    twice = d.unionByName(d.filter("label = 1")).unionByName(d.filter("label = 1"))
    a = fit_perceptron(d, "features", "label", [5], pos_weight=3.0, steps=15)
    b = fit_perceptron(twice, "features", "label", [5], steps=15)
    assert a.history == pytest.approx(b.history, rel=1e-6) and a.history[-1] < 0.6 * a.history[0]
    rows = d.select(F.col("v").alias("x"), F.col("label").cast("double").alias("y"), F.lit(1.0).alias("w"))
    theta = start([4, 5, 1], 1)
    one, many = Objective(rows.coalesce(1), [4, 5, 1], 0.1)(theta), Objective(rows.repartition(70), [4, 5, 1], 0.1)(theta)
    assert one[0] == pytest.approx(many[0]) and one[1] == pytest.approx(many[1])
    p = {tuple(r.v): r.churn_probability for r in a.score(d).collect()}
    assert np.mean([(p[tuple(v)] > 0.5) == bool(t) for v, t in zip(x.tolist(), y)]) > 0.7


def test_least_validation_loss_is_kept(spark):
    from lapsekit.ml.perceptron import Patience, minimise
    f = lambda t: (float((t - 3) @ (t - 3)), 2 * (t - 3))
    other = lambda t: (float((t - 1) @ (t - 1)), None)
    watch = Patience(other, np.zeros(1), 2)
    seen = []
    minimise(f, np.zeros(1), 50, go_on=lambda t: (seen.append(t[0]), watch(t))[1])
    assert watch.best[0] == min([0.0, *seen], key=lambda t: (t - 1) ** 2)


def test_halving_keeps_the_best_on_growing_samples(spark):
    from lapsekit.ml.models import halving_search
    rng = np.random.default_rng(5)
    rows = [(f"c{i}", "train" if i % 4 else "valid", float(a), float(b), int(a + 0.5 * rng.normal() > 0))
            for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    table = spark.createDataFrame(rows, "customer_id string, split string, x double, z double, is_churn int")
    space = {"maxDepth": (1, 3, "int"), "stepSize": (0.05, 0.3, "log")}
    out = halving_search(table, "gbt", ["x", "z"], [], space, n_trials=4, sample=200, rounds=6, rungs=2, keep=2).collect()
    first, second, last = ([r for r in out if r.rung == k] for k in (0, 1, -1))
    assert [len(first), len(second), len(last)] == [4, 2, 1]
    assert {r.rows for r in first} == {100} and {r.rows for r in second} == {200} and last[0].rows == 300
    best = sorted(first, key=lambda r: (-r.valid_auc, r.trial))[:2]
    assert {r.trial for r in second} == {r.trial for r in best}
    assert last[0].trial == max(second, key=lambda r: (r.valid_auc, -r.trial)).trial and last[0].valid_auc > 0.7
