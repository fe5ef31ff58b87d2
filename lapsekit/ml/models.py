"""Spark ML jobs: learners, weights, search, importance, attributions, scoring
(L1-L7, I1-I2, K1-K2).

The reference's boosters/forests/MLP are re-aimed to Spark ML learners; their
scores are therefore not bit-comparable, but the evaluation (E*) uses the same
exact metric operators.  Feature order is a contract: it is stored with the
model and checked against the scoring frame before any row is read.
"""

from __future__ import annotations

import json
import math
import random
import uuid
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import (OneHotEncoder, OneHotEncoderModel, StandardScaler, StringIndexer, StringIndexerModel,
                                VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsekit.ml.forest import fit_forest
from lapsekit.ml.perceptron import fit_perceptron
from lapsekit.operators.features import sample_rows
from lapsekit.operators.metrics import roc_auc, score_distribution
from lapsekit.session import checkpoint_dir, cut_lineage
from lapsekit.sources.tables import read_text, write_text


def class_weight(df: DataFrame, label: str = "is_churn") -> DataFrame:
    """n_neg / n_pos and its square root (one aggregate)."""
    return df.agg((F.count_if(F.col(label) == 0) / F.count_if(F.col(label) == 1)).alias("__w")) \
        .select(F.bround("__w", 6).alias("pos_weight"), F.bround(F.sqrt("__w"), 6).alias("pos_weight_sqrt"))


def with_weights(df: DataFrame, label: str, pos_weight: float, col: str = "weight") -> DataFrame:
    return df.withColumn(col, F.when(F.col(label) == 1, F.lit(float(pos_weight))).otherwise(F.lit(1.0)))


def preprocessing(kind: str, features: Sequence[str], categorical: Sequence[str] = ()) -> Pipeline:
    """Fitted on the train split only. Trees take category indices (unseen category -> extra index, K2); LR and
    MLP take one-hot columns (unseen -> all zero) and standardised numbers. ``features`` order is the contract."""
    cat = [c for c in features if c in categorical]
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep") for c in cat]
    linear = kind in ("lr", "mlp")
    if linear and cat:
        # the index past the vocabulary, for unseen values, is the one that dropLast leaves out
        stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in cat], outputCols=[f"{c}__hot" for c in cat], dropLast=True))
    end = "hot" if linear else "idx"
    stages.append(VectorAssembler(inputCols=[f"{c}__{end}" if c in cat else c for c in features], outputCol="features_raw", handleInvalid="keep"))
    if linear:
        stages.append(StandardScaler(inputCol="features_raw", outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=stages)


def slots(prep: PipelineModel, features: Sequence[str]) -> list[tuple[str, int]]:
    """(feature, number of vector slots) in vector order."""
    hot = any(isinstance(s, OneHotEncoderModel) for s in prep.stages)
    sizes = {s.getInputCol(): len(s.labels) for s in prep.stages if isinstance(s, StringIndexerModel)} if hot else {}
    return [(f, sizes.get(f, 1)) for f in features]


def learner(kind: str, prep: PipelineModel, features: Sequence[str], label: str = "is_churn", params: dict | None = None,
            weight_col: str | None = None):
    """The learner over a fitted preprocessing. Trees get as many bins as the largest vocabulary needs."""
    p = dict(params or {})
    vocabulary = [len(s.labels) + 1 for s in prep.stages if isinstance(s, StringIndexerModel)]
    bins = max([p.get("maxBins", 32), *vocabulary])
    if kind == "gbt":
        clf = GBTClassifier(featuresCol="features_raw", labelCol=label, maxIter=p.get("maxIter", 100), maxDepth=p.get("maxDepth", 5),
                            stepSize=p.get("stepSize", 0.1), subsamplingRate=p.get("subsamplingRate", 1.0),
                            minInstancesPerNode=p.get("minInstancesPerNode", 1),
                            featureSubsetStrategy=str(p.get("featureSubsetStrategy", "all")), maxBins=bins, seed=p.get("seed", 42))
        if p.get("validationIndicatorCol"):
            clf.setValidationIndicatorCol(p["validationIndicatorCol"])
            clf = clf.copy({clf.validationTol: p.get("validationTol", 0.01)})
    elif kind == "rf":
        # rows keep their node in each tree, so that no pass walks the trees from their roots; the trees stay the same
        clf = RandomForestClassifier(featuresCol="features_raw", labelCol=label, numTrees=p.get("numTrees", 300), cacheNodeIds=True,
                                     maxDepth=p.get("maxDepth", 14), minInstancesPerNode=p.get("minInstancesPerNode", 50),
                                     maxBins=bins, seed=p.get("seed", 42))
    elif kind == "lr":
        clf = LogisticRegression(featuresCol="features", labelCol=label, regParam=p.get("regParam", 0.0), maxIter=p.get("maxIter", 100))
    elif kind == "mlp":
        width = sum(k for _, k in slots(prep, features))
        return MultilayerPerceptronClassifier(featuresCol="features", labelCol=label,
                                              layers=[width] + list(p.get("hidden", [128, 64])) + [2],
                                              maxIter=p.get("maxIter", 100), seed=p.get("seed", 42))
    else:
        raise ValueError(f"unknown learner {kind}")
    if weight_col:
        clf.setWeightCol(weight_col)
    return clf


def resample(df: DataFrame, label: str, weight: float, key: str = "customer_id", seed: int = 42) -> DataFrame:
    """Class weight by repetition, for a learner without weights: a positive row is taken floor(weight) times, and
    once more with the remaining probability (by a hash of its key)."""
    whole = int(weight)
    more = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)) / float(1 << 20) < weight - whole).cast("int")
    times = F.when(F.col(label) == 1, F.lit(whole) + more).otherwise(F.lit(1))
    return df.withColumn("__copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))).drop("__copy")


def probability(pred: DataFrame, out: str = "churn_probability") -> DataFrame:
    """Positive-class probability as a double column (vector -> array, JVM side)."""
    return pred.withColumn(out, vector_to_array("probability").getItem(1))


def fit_and_score(table: DataFrame, kind: str, features: Sequence[str], categorical: Sequence[str] = (),
                  label: str = "is_churn", params: dict | None = None, balanced: bool = False):
    """Fit on the train split (GBT: stop early by the valid split, which teaches nothing else), score every row.
    Returns (PipelineModel, predictions). A perceptron with ``params["class_weight"]`` weighs positives in its loss (L5)
    and is returned as a ``perceptron.Perceptron`` in the model's place; so is a random forest, as a ``forest.Forest``."""
    d = table
    w, wcol = 1.0, None
    p = dict(params or {})
    train = F.col("split") == "train"
    if balanced:
        w = class_weight(table.filter(train), label).first()["pos_weight"]
        d = with_weights(d, label, w)
        wcol = "weight"
    prep = preprocessing(kind, features, categorical).fit(d.filter(train))
    fit_rows = d.filter(train)
    if kind == "gbt" and p.pop("early_stopping", True):
        p["validationIndicatorCol"] = "__is_valid"
        fit_rows = d.filter(F.col("split").isin("train", "valid")).withColumn("__is_valid", F.col("split") == "valid")
    if kind == "mlp" and p.get("class_weight"):
        net = fit_perceptron(prep.transform(fit_rows), "features", label, p.get("hidden", [128, 64]), float(p["class_weight"]),
                             steps=p.get("maxIter", 60), seed=p.get("seed", 42), valid=prep.transform(d.filter(F.col("split") == "valid")))
        return net, net.score(prep.transform(d))
    if kind == "rf":
        forest = fit_forest(prep.transform(fit_rows), learner(kind, prep, features, label, p), w)
        return forest, forest.score(prep.transform(d))
    last = learner(kind, prep, features, label, p, wcol).fit(prep.transform(fit_rows))
    model = PipelineModel(stages=[*prep.stages, last])
    return model, probability(model.transform(d))


def feature_importance(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Tree ``featureImportances`` mapped back to the ordered feature names."""
    from pyspark.sql import Window

    imp = model.stages[-1].featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    rows = [(f, float(v)) for f, v in zip(features, imp)]
    df = spark.createDataFrame(rows, "feature string, importance double")  # one row per feature
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), F.col("feature"))))


def linear_attributions(model: PipelineModel, scored: DataFrame, features: Sequence[str], key: str = "customer_id") -> DataFrame:
    """I2 (linear job): per-row attributions phi_j = coef_j * (z_j - mean(z_j)) on
    the scaled features (a category's is the sum over its columns), plus base
    value and margin; sum(phi) + base = margin."""
    lr = model.stages[-1]
    coef = lr.coefficients.toArray().tolist()
    d = scored.select(key, vector_to_array("features").alias("__z"))
    means = d.select([F.avg(F.col("__z").getItem(i)).alias(f"m{i}") for i in range(len(coef))]).first()
    mean = [means[f"m{i}"] or 0.0 for i in range(len(coef))]
    base = float(lr.intercept) + sum(c * m for c, m in zip(coef, mean))
    phis, at = [], 0
    for f, k in slots(model, features):
        parts = [F.lit(coef[i]) * (F.col("__z").getItem(i) - F.lit(mean[i])) for i in range(at, at + k)]
        phis.append(sum(parts[1:], parts[0]).alias(f) if parts else F.lit(0.0).alias(f))
        at += k
    margin = F.lit(float(lr.intercept)) + sum(F.lit(coef[i]) * F.col("__z").getItem(i) for i in range(len(coef)))
    return d.select(key, *phis, F.lit(base).alias("base_value"), margin.alias("margin"))


def tree_nodes(model: PipelineModel) -> list[dict]:
    """Trees of a boosted model as arrays (feature, threshold, categories, left, right, value, cover, weight), from the
    model as it is saved; cover is the weighted number of training rows of a node; their size is bounded by rounds and depth."""
    spark = SparkSession.getActiveSession()
    path = f"{checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    gbt = model.stages[-1]
    gbt.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    out = []
    for tree, weight in enumerate(gbt.treeWeights):
        nodes = sorted((r for r in rows if r["treeID"] == tree), key=lambda r: r["id"])
        split = [r["split"] for r in nodes]
        out.append({"feature": [s["featureIndex"] for s in split],
                    "threshold": [s["leftCategoriesOrThreshold"][0] if s["featureIndex"] >= 0 and s["numCategories"] == -1 else 0.0 for s in split],
                    "categories": [set(s["leftCategoriesOrThreshold"]) if s["numCategories"] != -1 else None for s in split],
                    "left": [r["leftChild"] for r in nodes], "right": [r["rightChild"] for r in nodes],
                    "value": [r["prediction"] for r in nodes], "cover": [r["impurityStats"][0] for r in nodes], "weight": weight})
    return out


def leaf_paths(trees: list[dict]) -> list[dict]:
    """One entry per leaf: its value, the features on its path, the condition on each (an interval or a set of
    categories), and for each the share of training rows that its splits let through."""
    out = []
    for t in trees:
        todo = [(0, {})]
        while todo:
            node, path = todo.pop()
            f = t["feature"][node]
            if f < 0:
                out.append({"value": t["weight"] * t["value"][node], "features": list(path), "tests": list(path.values())})
                continue
            left, right = t["left"][node], t["right"][node]
            cover = t["cover"][left] + t["cover"][right]
            for child, is_left in ((left, True), (right, False)):
                old = path.get(f, {"low": -math.inf, "high": math.inf, "sets": (), "share": 1.0})
                new = dict(old, share=old["share"] * t["cover"][child] / cover)
                if t["categories"][node] is not None:
                    new["sets"] = (*old["sets"], (tuple(sorted(t["categories"][node])), is_left))
                elif is_left:
                    new["high"] = min(old["high"], t["threshold"][node])
                else:
                    new["low"] = max(old["low"], t["threshold"][node])
                todo.append((child, {**path, f: new}))
    return out


def _passes(x, test):
    """Rows whose value of the feature meets all splits on it of a path; a missing number goes right, as it is above no threshold."""
    import numpy as np

    ok = np.ones(len(x), bool)
    if test["high"] < math.inf:
        ok &= x <= test["high"]
    if test["low"] > -math.inf:
        ok &= ~(x <= test["low"])
    for values, inside in test["sets"]:
        ok &= np.isin(x, values) == inside
    return ok


def _shapley_of_patterns(passes, shares):
    """Shapley values (patterns x features) of a leaf worth 1: a coalition's worth is the product of ``passes`` over its
    features and of ``shares`` over the others.

    Coalitions are summed by size: the product of (share + pass * y) over the other features is a polynomial in y,
    and the coefficient of y^k gets the Shapley weight k! (m - k - 1)! / m!.
    """
    import numpy as np

    n, m = passes.shape
    weights = np.array([math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)])
    out = np.zeros((n, m))
    for i in range(m):
        poly = np.zeros((n, m))
        poly[:, 0] = 1.0
        for j in range(m):
            if j != i:
                grown = poly * shares[j]
                grown[:, 1:] += poly[:, :-1] * passes[:, j:j + 1]
                poly = grown
        out[:, i] = (passes[:, i] - shares[i]) * (poly @ weights)
    return out


def shapley_rows(x, paths: list[dict], n_features: int):
    """Shapley values (rows x features), expected margin and margins of a boosted model given by its ``leaf_paths``.

    A leaf's game has its path's features only, and rows differ in it by which conditions they meet, so values are
    worked out once per pattern of met conditions.
    """
    import numpy as np

    phi, margin, base = np.zeros((len(x), n_features)), np.zeros(len(x)), 0.0
    for leaf in paths:
        m = len(leaf["features"])
        shares = np.array([t["share"] for t in leaf["tests"]])
        base += leaf["value"] * shares.prod()
        if not m:
            margin += leaf["value"]
            continue
        met = np.stack([_passes(x[:, f], t) for f, t in zip(leaf["features"], leaf["tests"])], axis=1)
        patterns, own = np.unique(met, axis=0, return_inverse=True) if m > 16 else _patterns(met)
        phi[:, leaf["features"]] += leaf["value"] * _shapley_of_patterns(patterns.astype(float), shares)[own]
        margin += leaf["value"] * met.all(axis=1)
    return phi, base, margin


def _patterns(met):
    import numpy as np

    code = met @ (1 << np.arange(met.shape[1]))
    found, own = np.unique(code, return_inverse=True)
    return (found[:, None] >> np.arange(met.shape[1]) & 1).astype(bool), own


def _path_rows(x, trees: list[dict], n_features: int):
    """Path attributions: at every node on a row's path the change of the node's mean goes to the feature split on."""
    import numpy as np

    phi, margin = np.zeros((len(x), n_features)), np.zeros(len(x))
    base = sum(t["weight"] * t["value"][0] for t in trees)
    for t in trees:
        value, todo = np.array(t["value"]), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            f = t["feature"][node]
            if f < 0 or not len(rows):
                margin[rows] += t["weight"] * value[node]
                continue
            seen = x[rows, f]
            left = np.isin(seen, list(t["categories"][node])) if t["categories"][node] is not None else seen <= t["threshold"][node]
            for child, part in ((t["left"][node], rows[left]), (t["right"][node], rows[~left])):
                phi[part, f] += t["weight"] * (value[child] - value[node])
                todo.append((child, part))
    return phi, base, margin


def tree_attributions(model: PipelineModel, scored: DataFrame, features: Sequence[str], key: str = "customer_id",
                      method: str = "shapley") -> DataFrame:
    """I2 (tree job): per-row attributions of a boosted model; sum(phi) + base = margin.

    ``method="shapley"``: exact Shapley values of the game in which a node whose feature is unknown sends a row to both
    children in proportion to their training rows (cover); base is the expected margin. ``"path"``: changes of node
    means along the row's path, cheaper. Both are computed from the trees, whose size is bounded by rounds and
    depth, in Arrow batches inside tasks.
    """
    trees = tree_nodes(model)
    names = list(features)
    shared = scored.sparkSession.sparkContext.broadcast(leaf_paths(trees) if method == "shapley" else trees)
    explain = {"shapley": shapley_rows, "path": _path_rows}[method]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, len(names)))
            phi, base, margin = explain(x, shared.value, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(phi[:, i]) for i in range(len(names))],
                                              pa.array(np.full(n, base)), pa.array(margin)], names=[key, *names, "base_value", "margin"])

    schema = f"{key} {scored.schema[key].dataType.simpleString()}, " + ", ".join(f"`{f}` double" for f in names) + ", base_value double, margin double"
    return scored.select(key, vector_to_array("features_raw").alias("__x")).mapInArrow(run, schema)


def draw_params(space: dict[str, tuple], n: int, seed: int) -> list[dict]:
    """``n`` seeded draws from ``space`` (name -> (low, high, 'int'|'float'|'log'))."""
    rng = random.Random(seed)
    draws = []
    for _ in range(n):
        params = {}
        for name, (lo, hi, kind_) in space.items():
            if kind_ == "int":
                params[name] = rng.randint(int(lo), int(hi))
            elif kind_ == "log":
                params[name] = math.exp(rng.uniform(math.log(lo), math.log(hi)))
            else:
                params[name] = rng.uniform(lo, hi)
        draws.append(params)
    return draws


def _valid_auc(rows: DataFrame, kind: str, features, categorical, label: str, params: dict) -> float:
    _, pred = fit_and_score(rows, kind, features, categorical, label, params)
    v = pred.filter(F.col("split") == "valid")
    return float(roc_auc(score_distribution(v, "churn_probability", label)).first()["auc"])


def random_search(table: DataFrame, kind: str, features: Sequence[str], categorical: Sequence[str],
                  space: dict[str, tuple], n_trials: int = 10, seed: int = 42, label: str = "is_churn",
                  sample: int | None = 50_000, parallelism: int = 4, key: str = "customer_id") -> DataFrame:
    """Seeded random draws from ``space`` (see ``draw_params``), each fitted on a sample of train (``sample`` rows,
    all if None) and scored by exact valid AUC, ``parallelism`` trials at a time; the best is fitted again on
    all of train.  One row per trial, and one with ``refit`` set."""
    from multiprocessing.pool import ThreadPool

    draws = draw_params(space, n_trials, seed)
    part = table
    if sample:
        drawn = sample_rows(table.filter("split = 'train'"), sample, seed, key)
        part = cut_lineage(drawn.unionByName(table.filter("split = 'valid'")))
    auc = lambda params, rows: _valid_auc(rows, kind, features, categorical, label, {**params, "early_stopping": False})
    with ThreadPool(parallelism) as pool:
        scores = pool.map(lambda params: auc(params, part), draws)
    best = max(range(n_trials), key=lambda t: (scores[t], -t))
    rows = [(t, json.dumps(p, sort_keys=True), s, False) for t, (p, s) in enumerate(zip(draws, scores))]
    rows.append((best, json.dumps(draws[best], sort_keys=True), auc(draws[best], table), True))
    return table.sparkSession.createDataFrame(rows, "trial int, params string, valid_auc double, refit boolean")


def halving_search(table: DataFrame, kind: str, features: Sequence[str], categorical: Sequence[str], space: dict[str, tuple],
                   n_trials: int = 25, seed: int = 42, label: str = "is_churn", sample: int = 300_000, rounds: int = 800,
                   rungs: int = 4, keep: int = 3, parallelism: int = 4, key: str = "customer_id") -> DataFrame:
    """L7 by successive halving: ``n_trials`` draws start on a small sample with few boosting rounds; of each rung the best
    1 in ``keep`` go on with ``keep`` times the sample and rounds. The last rung has ``sample`` rows of train and
    up to ``rounds`` rounds, the winner is fitted on all of train. Every fit stops early by the valid split.

    Samples are nested (the first rows by a hash of the key), so a trial is compared on what it has seen and more. Returns one
    row per trial and rung (rung -1: the winner on all of train): trial, rung, rows, rounds, params, valid_auc, seconds.
    """
    import time
    from multiprocessing.pool import ThreadPool

    draws = draw_params(space, n_trials, seed)
    valid, train = table.filter("split = 'valid'"), table.filter("split = 'train'")
    out, alive, n_train = [], list(range(n_trials)), train.count()

    def fit(trial: int, rows: DataFrame, most: int) -> tuple[float, float]:
        began = time.time()
        return _valid_auc(rows, kind, features, categorical, label, {**draws[trial], "maxIter": most}), time.time() - began

    for rung in range(rungs):
        share = keep ** (rungs - 1 - rung)
        n, most = min(n_train, max(1, sample // share)), max(1, rounds // share)
        part = cut_lineage(sample_rows(train, n, seed, key).unionByName(valid))
        with ThreadPool(parallelism) as pool:
            got = pool.map(lambda t, part=part, most=most: fit(t, part, most), alive)
        out += [(t, rung, n, most, json.dumps(draws[t], sort_keys=True), auc, s) for t, (auc, s) in zip(alive, got)]
        order = sorted(range(len(alive)), key=lambda i: (-got[i][0], alive[i]))
        alive = [alive[i] for i in order[:max(1, -(-len(alive) // keep))]]
    auc, s = fit(alive[0], table, rounds)
    out.append((alive[0], -1, n_train, rounds, json.dumps(draws[alive[0]], sort_keys=True), auc, s))
    return table.sparkSession.createDataFrame(out, "trial int, rung int, rows long, rounds int, params string, valid_auc double, seconds double")


def save_model(model: PipelineModel, path: str, features: Sequence[str], meta: dict | None = None) -> None:
    """Model + JSON sidecar with the ordered feature contract."""
    model.write().overwrite().save(path)
    write_text(SparkSession.getActiveSession(), f"{path}/feature_contract.json", json.dumps({"feature_cols": list(features), **(meta or {})}))


def score_customers(path: str, df: DataFrame) -> DataFrame:
    """K1: load the saved pipeline, check the feature contract against the
    frame's columns (before reading rows), then score (task-parallel)."""
    contract = json.loads(read_text(df.sparkSession, f"{path}/feature_contract.json"))
    missing = [c for c in contract["feature_cols"] if c not in df.columns]
    if missing:
        raise ValueError(f"scoring frame lacks model features: {missing}")
    return probability(PipelineModel.load(path).transform(df))
