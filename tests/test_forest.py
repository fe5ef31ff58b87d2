"""The forest against Spark's learner, whose rules it follows, and against itself however its work is dealt."""

import numpy as np
import pytest

from lapsekit.ml import forest as T
from lapsekit.ml import models as M
from lapsekit.session import checkpoint_dir, cut_lineage

FEATURES = ["g", "z", "h", "k"]


def rows(spark, n=2000, names=20, seed=1):
    rng = np.random.default_rng(seed)
    g, z, h, k = np.minimum(rng.geometric(2.4 / names, n), names), rng.normal(size=n), rng.integers(0, 3, n), rng.integers(0, 9, n)
    y = (np.sin(g * 7.3) + .7 * z * (h - 1) + 1.5 * rng.normal(size=n)) > 0.3
    data = [(f"c{i}", "train" if i % 4 else "valid", f"k{a}", float(b) if b > -.8 else 0.0, f"m{c}", float(d), int(e))
            for i, (a, b, c, d, e) in enumerate(zip(g, z, h, k, y))]
    checkpoint_dir(spark)
    return spark.createDataFrame(data, "customer_id string, split string, g string, z double, h string, k double, is_churn int")


def scores(df):
    return np.array([r[0] for r in df.select("churn_probability").collect()])


@pytest.mark.parametrize("weight,most_rows,names", [(1.0, 1 << 20, 20), (2.5, 300, 20), (1.0, 40, 20), (2.5, 1 << 20, 300)])
def test_a_tree_of_all_rows_and_features_is_that_of_spark(spark, weight, most_rows, names):
    d = rows(spark, names=names)  # 300 names need several words of bits, and bins of two bytes
    prep = M.preprocessing("rf", FEATURES, ["g", "h"]).fit(d)
    data = prep.transform(d)
    clf = M.learner("rf", prep, FEATURES, params={"numTrees": 1, "maxDepth": 7, "minInstancesPerNode": 15})
    clf = clf.copy({clf.bootstrap: False})
    weighted = clf.copy()
    weighted.setWeightCol("weight")
    want = weighted.fit(M.with_weights(data, "is_churn", weight))
    got = T.fit_forest(data, clf, weight, most_rows)
    assert got.n_nodes == want.totalNumNodes > 30
    assert scores(got.score(data)) == pytest.approx(scores(M.probability(want.transform(data))), abs=1e-12)


def test_the_forest_is_the_same_however_trees_are_dealt_to_tasks(spark, monkeypatch):
    d = cut_lineage(rows(spark).repartition(3, "customer_id"))
    how = {"numTrees": 12, "maxDepth": 6, "minInstancesPerNode": 10}
    one, scored = M.fit_and_score(d, "rf", FEATURES, ["g", "h"], params=how, balanced=True)
    monkeypatch.setattr(T, "TASKS", 1)
    two, _ = M.fit_and_score(d, "rf", FEATURES, ["g", "h"], params=how, balanced=True)
    assert isinstance(one, T.Forest) and len(one.trees) == 12 and scored.count() == d.count()
    assert all(np.array_equal(x, y) for a, b in zip(one.trees, two.trees) for x, y in zip(a, b))
    assert len({t[3].tobytes() for t in one.trees}) == 12  # every tree has a bag and features of its own
    from lapsekit.operators import metrics as E
    auc = {r.split: r.auc for r in E.evaluate(scored, "churn_probability", "is_churn").collect()}
    assert auc["train"] > auc["valid"] > 0.6


def test_a_forest_has_as_many_nodes_as_spark_s(spark):
    d = rows(spark)
    prep = M.preprocessing("rf", FEATURES, ["g", "h"]).fit(d)
    data = cut_lineage(prep.transform(d))
    clf = M.learner("rf", prep, FEATURES, params={"numTrees": 100, "maxDepth": 8, "minInstancesPerNode": 10})
    clf = clf.copy({clf.featureSubsetStrategy: "sqrt"})
    model, forest = clf.fit(data), T.fit_forest(data, clf)
    sizes = [np.array([t.numNodes for t in model.trees]), np.array([len(t[0]) for t in forest.trees])]
    error = np.sqrt(sum(s.var() / 100 for s in sizes))
    assert abs(sizes[0].mean() - sizes[1].mean()) < 5 * error
    assert scores(forest.score(data)) == pytest.approx(scores(M.probability(model.transform(data))), abs=0.12)


def test_missing_numbers_lie_above_all_thresholds():
    edges = T.thresholds(np.array([1.0, np.nan, 2.0, 4.0]), np.ones(4), 31)
    p = T.Rules(1, 2, 1, 1, 0, False, 1.0, [edges], np.zeros(1, int))
    assert edges.tolist() == [1.5, 3.0] and p.binned(np.array([[1.5], [1.6], [np.nan], [-np.inf]])).ravel().tolist() == [0, 1, 2, 0]


def test_no_rows_and_other_labels_are_errors(spark):
    d = rows(spark, 50)
    prep = M.preprocessing("rf", FEATURES, ["g", "h"]).fit(d)
    clf = M.learner("rf", prep, FEATURES, params={"numTrees": 2})
    with pytest.raises(ValueError):
        T.fit_forest(prep.transform(d.filter("false")), clf)
    with pytest.raises(Exception, match="labels other than 0 and 1"):
        T.fit_forest(prep.transform(d.selectExpr("* except (is_churn)", "2 as is_churn")), clf)
