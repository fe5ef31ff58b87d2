"""Exact model metrics from one shared score distribution.

The row-level predictions are reduced ONCE to a distinct-score frame
``(groups, score, pos, neg)`` (a distributed groupBy: a hot score becomes one
row, so no skew survives it) with running sums from P0, which is written
once.  AUC, AP, log loss, the F1-optimal threshold and the confusion counts
are aggregates over that frame; rows are not read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsekit.operators.ordering import null_safe_join, rank_rows, sorted_prefix
from lapsekit.session import cut_lineage

EPS = 2.220446049250313e-16   # float64 machine epsilon (log-loss clip)
F1_GUARD = 1e-12


def score_distribution(df: DataFrame, score: str, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """Distinct scores with positive/negative counts and, in descending score
    order, the cumulative TP/FP at "predict positive if score >= s", plus the
    negatives strictly below s (for AUC)."""
    groups = list(groups)
    d = df.groupBy(*groups, score).agg(
        F.sum(F.col(label)).cast("long").alias("pos"),
        F.sum(1 - F.col(label)).cast("long").alias("neg"))
    d = sorted_prefix(d, [F.col(score).desc_nulls_last()], {"tp": F.col("pos"), "fp": F.col("neg")}, groups, totals=True)
    d = d.withColumnsRenamed({"tp_total": "pos_total", "fp_total": "neg_total"})
    # negatives strictly below s = N - fp (fp counts negatives with score >= s)
    return cut_lineage(d.withColumn("neg_below", F.col("neg_total") - F.col("fp")))


def _auc() -> Column:
    return F.bround(F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg")))
                   / (F.first("pos_total") * F.first("neg_total")), 6)


def _ap() -> Column:
    return F.bround(F.sum(F.col("pos") / F.col("pos_total") * F.col("tp") / (F.col("tp") + F.col("fp"))), 6)


def _best_threshold(score: str) -> tuple[Column, Column]:
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    rec = F.col("tp") / F.col("pos_total")
    f1 = F.bround(2 * prec * rec / (prec + rec + F1_GUARD), 12)
    return F.max_by(F.col(score), F.struct(f1, -F.col(score))), F.bround(F.max(f1), 6)


def _rates() -> dict[str, Column]:
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp").cast("double"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return {"precision": F.bround(prec, 6), "recall": F.bround(rec, 6), "f1": F.bround(f1, 6)}


def roc_auc(dist: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Exact ROC-AUC (Mann-Whitney, ties count 1/2)."""
    return dist.groupBy(*groups).agg(_auc().alias("auc"))


def average_precision(dist: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """AP as the step sum  sum_s (pos_s / P) * precision(s)."""
    return dist.groupBy(*groups).agg(_ap().alias("ap"))


def log_loss(df: DataFrame, score: str, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """Mean binary cross-entropy, p clipped to [eps, 1-eps]."""
    p = F.least(F.greatest(F.col(score), F.lit(EPS)), F.lit(1 - EPS))
    y = F.col(label)
    return df.groupBy(*groups).agg(F.bround(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))), 6).alias("logloss"))


def threshold_metrics(df: DataFrame, score: str, label: str, threshold, groups: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and precision/recall/F1 at ``score >= threshold``
    (zero division -> 0).  ``threshold`` may be a literal or a column."""
    t = threshold if not isinstance(threshold, (int, float)) else F.lit(float(threshold))
    pred = F.col(score) >= t
    y = F.col(label) == 1
    g = df.groupBy(*groups).agg(
        F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"),
        F.count_if(~pred & y).alias("fn"), F.count_if(~pred & ~y).alias("tn"))
    return g.withColumns(_rates())


def best_f1_threshold(dist: DataFrame, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """E5: F1-optimal threshold over distinct scores; ties go to the lowest threshold."""
    thr, best = _best_threshold(score)
    return dist.groupBy(*groups).agg(thr.alias("threshold"), best.alias("best_f1"))


def top_fraction_metrics(df: DataFrame, score: str, label: str, key: str, frac: float,
                         groups: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, lift of the exact top k = max(1, floor(n*frac)) rows
    (score desc, ties by key)."""
    r = rank_rows(df, score, key, descending=True, groups=groups)
    k = F.greatest(F.floor(F.col("n") * F.lit(frac)), F.lit(1))
    sel = r.withColumn("__sel", F.col("rank") <= k)
    g = sel.groupBy(*groups).agg(
        F.count_if("__sel").alias("selected_count"),
        F.sum(F.when(F.col("__sel"), F.col(label)).otherwise(0)).alias("__tp"),
        F.sum(label).alias("__P"), F.count(F.lit(1)).alias("__n"))
    prec = F.col("__tp") / F.col("selected_count")
    return g.select(*groups, F.lit(frac).alias("fraction"), "selected_count",
                    F.bround(prec, 6).alias("precision"),
                    F.bround(F.try_divide(F.col("__tp").cast("double"), F.col("__P")), 6).alias("recall"),
                    F.bround(F.try_divide(prec, F.col("__P") / F.col("__n")), 6).alias("lift"))


def selection_at_threshold(df: DataFrame, score: str, label: str, threshold: float,
                           groups: Sequence[str] = ()) -> DataFrame:
    """Share of rows selected at the threshold and the lift of the selection."""
    sel = F.col(score) >= threshold
    g = df.groupBy(*groups).agg(F.count_if(sel).alias("__s"), F.count(F.lit(1)).alias("__n"),
                                F.sum(F.when(sel, F.col(label)).otherwise(0)).alias("__tp"),
                                F.sum(label).alias("__P"))
    return g.select(*groups, F.bround(F.col("__s") / F.col("__n"), 6).alias("selection_rate"),
                    F.bround(F.try_divide(F.try_divide(F.col("__tp").cast("double"), F.col("__s")),
                                         F.col("__P") / F.col("__n")), 6).alias("lift"))


def evaluate(df: DataFrame, score: str, label: str, split: str = "split",
             threshold_from: str = "valid", groups: Sequence[str] = ()) -> DataFrame:
    """E8 for one or many models (``groups``, e.g. ``["model"]``): AUC, AP and
    log loss per (group, split), plus precision/recall/F1 at the F1-optimal
    threshold chosen on ``threshold_from`` and applied to every split.

    Two aggregates over one written score distribution: AUC, AP, log loss and
    the threshold in the first, the confusion counts in the second."""
    g = list(groups)
    gs = g + [split]
    dist = score_distribution(df, score, label, gs)
    p = F.least(F.greatest(F.col(score), F.lit(EPS)), F.lit(1 - EPS))
    loss = F.sum(-(F.col("pos") * F.log(p) + F.col("neg") * F.log(1 - p))) / F.sum(F.col("pos") + F.col("neg"))
    first = cut_lineage(dist.groupBy(*gs).agg(_auc().alias("auc"), _ap().alias("ap"), F.bround(loss, 6).alias("logloss"),
                                              _best_threshold(score)[0].alias("threshold")))  # a row per group
    thr = first.filter(F.col(split) == threshold_from).select(*g, "threshold")
    hit = F.col(score) >= F.col("threshold")
    tm = null_safe_join(dist, thr, g, "inner", check=True).groupBy(*gs).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("fn"), F.sum(F.when(hit, 0).otherwise(F.col("neg"))).alias("tn"),
        F.bround(F.first("threshold"), 6).alias("threshold"))
    return null_safe_join(first.drop("threshold"), tm.withColumns(_rates()), gs, "inner", check=True)


def compare_models(df: DataFrame, scores: Sequence[str], label: str, split: str = "split") -> DataFrame:
    """One row per (model, split); ``overfit_gap`` = train AUC - this split's AUC.

    The models are stacked into one long frame (model, split, score, label)
    so every metric is a single grouped pass, not one pass per model."""
    long = df.select(split, label, F.explode(F.array(*[
        F.struct(F.lit(s).alias("model"), F.col(s).cast("double").alias("__score")) for s in scores])).alias("__m")) \
        .select(split, label, "__m.model", "__m.__score")
    out = evaluate(long, "__score", label, split, groups=["model"])
    out = cut_lineage(out)  # a row per model and split
    tr = out.filter(F.col(split) == "train").select("model", F.col("auc").alias("__tr"))
    return out.join(tr, "model").withColumn("overfit_gap", F.bround(F.col("__tr") - F.col("auc"), 6)).drop("__tr")


def model_stats_export(stats: DataFrame, champion: DataFrame, key: str = "model",
                       cols: Sequence[str] = ("auc", "ap", "logloss", "precision", "recall", "f1")) -> DataFrame:
    """Exported model stats where the champion's recorded metrics override
    the computed ones (left join + coalesce), plus champion-only models
    (anti join + union)."""
    c = champion.select(key, *[F.col(x).alias(f"__c_{x}") for x in cols])
    over = stats.join(c, key, "left").select(key, *[F.coalesce(F.col(f"__c_{x}"), F.col(x)).alias(x) for x in cols],
                                             F.col(f"__c_{cols[0]}").isNotNull().alias("champion_override"))
    only = champion.join(stats.select(key), key, "left_anti").select(key, *cols, F.lit(True).alias("champion_override"))
    return over.unionByName(only)
