"""Data-quality and profiling operators.

Each profile is ONE wide aggregate over the table (a single pass with a
partial/final aggregate), unpivoted to long form afterwards on a 1-row frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsekit.operators.ordering import exact_quantiles, sorted_prefix


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column null count and percent (one pass)."""
    cols = list(cols or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot(["__n"], cols, "column", "nulls")
    return long.select("column", F.col("nulls").cast("long").alias("nulls"),
                       F.bround(F.col("nulls") / F.col("__n") * 100, 6).alias("null_pct"))


def distinct_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct non-null values per column."""
    wide = df.agg(*[F.count_distinct(c).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column", "distinct_values")


def duplicate_profile(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Q2: rows, distinct rows, duplicate rows, keys with more than one row, extra rows on keys."""
    keys = [key] if isinstance(key, str) else list(key)
    a = df.agg(F.count(F.lit(1)).alias("rows"))
    b = df.distinct().agg(F.count(F.lit(1)).alias("distinct_rows"))
    k = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c")).agg(
        F.count_if(F.col("__c") > 1).alias("duplicated_keys"),
        F.coalesce(F.sum(F.when(F.col("__c") > 1, F.col("__c") - 1)), F.lit(0)).alias("extra_key_rows"))
    return a.crossJoin(b).crossJoin(k).withColumn("duplicate_rows", F.col("rows") - F.col("distinct_rows"))


def describe_exact(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Q3: count, mean, sample std, min, exact quartiles, max per column."""
    base = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])).alias("kv")) \
        .select("kv.*").groupBy("column").agg(
            F.count("v").alias("count"), F.bround(F.avg("v"), 6).alias("mean"),
            F.bround(F.stddev_samp("v"), 6).alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    qw = q.groupBy("column").pivot("p", [0.25, 0.5, 0.75]).agg(F.first("value"))
    qw = qw.select("column", *[F.bround(F.col(f"`{p}`"), 6).alias(n) for p, n in
                               ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    return base.join(qw, "column", "left")


def moments(df: DataFrame, col_ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Q4: count/mean/population std/min/max over the valid range of each column."""
    parts = []
    for c, (lo, hi) in col_ranges.items():
        v = F.when(F.col(c).between(lo, hi), F.col(c))
        parts += [F.count(v).alias(f"{c}__n"), F.avg(v).alias(f"{c}__mean"), F.stddev_pop(v).alias(f"{c}__std"),
                  F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max")]
    wide = df.agg(*parts)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("count"),
                     F.bround(F.col(f"{c}__mean"), 6).alias("mean"), F.bround(F.col(f"{c}__std"), 6).alias("std"),
                     F.col(f"{c}__min").cast("double").alias("min"), F.col(f"{c}__max").cast("double").alias("max"))
            for c in col_ranges]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Q5: fixed-width bins on [lo, hi]; values above ``hi`` land in the last
    bin (clipped tail, right-closed); values below ``lo`` or NULL are dropped."""
    w = (hi - lo) / bins
    x = F.least(F.col(col).cast("double"), F.lit(float(hi)))
    b = F.least(F.floor((x - lo) / w), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(col) >= lo).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count")) \
        .withColumn("bin_start", F.bround(F.lit(float(lo)) + F.col("bin") * w, 6))


def monthly_volume(df: DataFrame, date_col: str, dense: bool = True) -> DataFrame:
    """Rows per calendar month; with ``dense`` every month between the
    first and last month is present (0 when empty), via a month spine."""
    m = df.select(F.trunc(F.col(date_col), "month").alias("month")).filter(F.col("month").isNotNull())
    cnt = m.groupBy("month").agg(F.count(F.lit(1)).alias("rows"))
    if not dense:
        return cnt
    rng = cnt.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    spine = rng.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return spine.join(cnt, "month", "left").select("month", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def count_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Conditional counts in one pass, one column per rule."""
    return df.agg(*[F.count_if(pred).alias(name) for name, pred in rules.items()])


def compare(left: DataFrame, right: DataFrame, key: str, cols: Sequence[str], tol: float = 1e-6) -> DataFrame:
    """Q9: per column match rate (|diff| < tol, NULL = NULL counts as match)
    and mean absolute error over rows where both sides are present."""
    l = left.select(key, *[F.col(c).alias(f"__l_{c}") for c in cols])
    r = right.select(key, *[F.col(c).alias(f"__r_{c}") for c in cols])
    j = l.join(r, key, "inner")
    rows = []
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in cols:
        a, b = F.col(f"__l_{c}").cast("double"), F.col(f"__r_{c}").cast("double")
        same = F.when(a.isNull() & b.isNull(), True).otherwise(F.coalesce(F.abs(a - b) < tol, F.lit(False)))
        aggs += [F.avg(same.cast("double")).alias(f"{c}__m"), F.avg(F.abs(a - b)).alias(f"{c}__e")]
        rows.append(F.struct(F.lit(c).alias("column"), F.bround(F.col(f"{c}__m"), 6).alias("match_rate"),
                             F.bround(F.col(f"{c}__e"), 6).alias("mean_abs_error")))
    return j.agg(*aggs).select("__n", F.explode(F.array(*rows)).alias("r")) \
        .select(F.col("__n").alias("compared_rows"), "r.*")


def expectations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Q10: one aggregate returning one boolean per rule (rule = aggregate predicate)."""
    return df.agg(*[pred.alias(name) for name, pred in rules.items()])


def value_counts(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """Counts per value with the normalised share, largest first (ties by value)."""
    cnt = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    tot = df.agg(F.count(F.lit(1)).alias("__t"))
    out = cnt.crossJoin(F.broadcast(tot)).withColumn("share", F.bround(F.col("count") / F.col("__t"), 6)).drop("__t")
    if top:
        out = out.orderBy(F.col("count").desc(), F.col(col).asc_nulls_first()).limit(top)
    return out


def group_rate(df: DataFrame, group: Column | str, label: str, value: str | None = None) -> DataFrame:
    """G9 helper: customers, churn rate, min/max of ``value`` and share of total per group."""
    g = F.col(group) if isinstance(group, str) else group
    aggs = [F.count(F.lit(1)).alias("customers"), F.bround(F.avg(label), 6).alias("churn_rate")]
    if value:
        aggs += [F.min(value).alias("min_value"), F.max(value).alias("max_value")]
    out = df.groupBy(g.alias("group")).agg(*aggs)
    tot = df.agg(F.count(F.lit(1)).alias("__t"))
    return out.crossJoin(F.broadcast(tot)).withColumn(
        "customer_pct", F.bround(F.col("customers") / F.col("__t") * 100, 6)).drop("__t")


def univariate_auc(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Q12: ROC-AUC of each raw feature against the label (NULLs dropped),
    directional AUC = max(a, 1-a) and the direction.

    Unpivot to (feature, value, label), count per distinct (feature, value),
    then running negatives per feature with P0 partitioned by feature.
    """
    long = df.select(F.col(label).alias("__y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features])).alias("kv")) \
        .select("kv.*", "__y").filter(F.col("v").isNotNull())
    d = long.groupBy("feature", "v").agg(F.sum("__y").alias("pos"), F.sum(1 - F.col("__y")).alias("neg"))
    d = sorted_prefix(d, [F.col("v").asc()], {"neg_below": F.col("neg")}, ["feature"], inclusive=False)
    a = d.groupBy("feature").agg(
        (F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg")))
         / (F.sum("pos") * F.sum("neg"))).alias("__a"))
    return a.select("feature", F.bround("__a", 6).alias("auc"),
                    F.bround(F.greatest(F.col("__a"), 1 - F.col("__a")), 6).alias("directional_auc"),
                    F.when(F.col("__a") >= 0.5, "higher_churns").otherwise("lower_churns").alias("direction"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Q13: class counts, positive rate and the majority-class baseline accuracy."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(label).cast("long").alias("positives"),
                  F.bround(F.avg(label), 6).alias("positive_rate"),
                  F.bround(F.greatest(F.avg(label), 1 - F.avg(label)), 6).alias("majority_accuracy"))


def per_key_distribution(df: DataFrame, key: str) -> DataFrame:
    """Q8: rows per key, then how many keys have each row count."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows_per_key")) \
        .groupBy("rows_per_key").agg(F.count(F.lit(1)).alias("keys"))


def ratio_of_means(df: DataFrame, num: Sequence[str], den: Sequence[str], name: str = "ratio") -> DataFrame:
    """Grand-total ratio of column means (two-step aggregate)."""
    a = df.agg(*[F.avg(c).alias(f"__n{i}") for i, c in enumerate(num)],
               *[F.avg(c).alias(f"__d{i}") for i, c in enumerate(den)])
    n = sum(F.col(f"__n{i}") for i in range(len(num)))
    d = sum(F.col(f"__d{i}") for i in range(len(den)))
    return a.select(F.bround(n / d, 6).alias(name))


def mean_abs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean absolute value per column, long form, largest first."""
    wide = df.agg(*[F.avg(F.abs(F.col(c))).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "feature", "mean_abs").withColumn("mean_abs", F.bround("mean_abs", 6))
