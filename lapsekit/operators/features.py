"""Point-in-time customer features.

Every feature operator takes an ``ObservationSpec``; rows dated after
``spec.cutoff`` are filtered before any aggregate, on the raw YYYYMMDD column
so the predicate reaches the Parquet scan.  Each operator is one shuffle on
the customer key (plus the F2 dedupe shuffle for transactions).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsekit.functions import r6, safe_div, ymd_to_date
from lapsekit.operators.cleaning import as_of, clipped_days, dedupe, fill_category, null_before
from lapsekit.operators.ordering import null_safe_join, ordered_prefix
from lapsekit.spec import ObservationSpec

# Bd validity range, missing-category sentinel, fill lists.
BD_MIN, BD_MAX = 1, 100
MISSING_CATEGORY = -999
ZERO_FILL_COLS = [
    "txn_count", "payment_method_nunique", "plan_days_nunique", "cancel_count", "total_amount_paid",
    "d7_active_days", "d30_active_days", "d90_active_days", "full_active_days",
]
BUCKET_NAMES = ["b0_6", "b7_14", "b15_29", "b30_89", "b90_plus"]
LOG_METRICS = ["logdays", "num_unq_sum", "total_plays_sum", "num_100_sum", "secs_sum", "secs_n"]
PLAY_COLS = ["num_25", "num_50", "num_75", "num_985", "num_100"]


# --------------------------------------------------------------------- X2
def member_features(members: DataFrame, spec: ObservationSpec) -> DataFrame:
    """Bd masked to [1,100] with a missing flag (NULL bd -> flag 1), gender
    filled, tenure days to the cutoff clipped at 0."""
    k = spec.key
    ok = F.col("bd").between(BD_MIN, BD_MAX)
    reg = ymd_to_date("registration_init_time")
    return members.select(
        k, "city", "registered_via",
        F.when(ok, F.col("bd")).alias("bd_clean"),
        F.when(ok, F.lit(0)).otherwise(F.lit(1)).cast("int").alias("bd_is_missing"),
        fill_category("gender").alias("gender"),
        clipped_days(spec.cutoff, reg).alias("tenure_days"),
    )


# --------------------------------------------------------------------- X3
def clean_transactions(txn: DataFrame, spec: ObservationSpec) -> DataFrame:
    """F1 + F2 + F9 + F4 on raw transactions."""
    t = dedupe(as_of(txn, "transaction_date", spec.cutoff_int))
    return t.withColumns({
        "txn_date": ymd_to_date("transaction_date"),
        "expire_date": null_before(ymd_to_date("membership_expire_date"), spec.min_valid_date),
        "discount": F.col("plan_list_price") - F.col("actual_amount_paid"),
    })


def transaction_features(txn: DataFrame, spec: ObservationSpec) -> DataFrame:
    """X3 = G1 aggregates + W1 last-row features in ONE groupBy on the key.

    Distinct counts of low-cardinality codes use ``size(collect_set)`` so the
    aggregate stays a single partial/final pair (no Expand, no 2nd shuffle).
    The last transaction is ``max_by`` over a struct ordered by
    (date, expiry NULL-smallest, paid, then the remaining columns), i.e. SQL
    ``ORDER BY ... DESC NULLS LAST`` with a total order.
    """
    k = spec.key
    t = clean_transactions(txn, spec)
    last = F.max_by(
        F.struct("payment_plan_days", "plan_list_price", "actual_amount_paid", "is_auto_renew", "txn_date",
                 "expire_date"),
        F.struct("txn_date", "expire_date", "actual_amount_paid", "payment_plan_days", "plan_list_price",
                 "is_auto_renew", "is_cancel", "payment_method_id"),
    ).alias("__last")
    g = t.groupBy(k).agg(
        F.count(F.lit(1)).alias("txn_count"),
        F.size(F.collect_set("payment_method_id")).cast("long").alias("payment_method_nunique"),
        F.size(F.collect_set("payment_plan_days")).cast("long").alias("plan_days_nunique"),
        F.sum("is_auto_renew").alias("__ar"),
        F.sum("is_cancel").cast("long").alias("cancel_count"),
        F.sum("actual_amount_paid").alias("__paid"),
        F.sum("discount").alias("__disc"),
        last,
    )
    return g.select(
        k, "txn_count", "payment_method_nunique", "plan_days_nunique",
        r6(F.col("__ar") / F.col("txn_count")).alias("auto_renew_rate"),
        "cancel_count",
        r6(F.col("cancel_count") / F.col("txn_count")).alias("cancel_rate"),
        F.col("__paid").cast("double").alias("total_amount_paid"),
        r6(F.col("__disc").cast("double") / F.col("txn_count")).alias("avg_discount"),
        F.col("__last.payment_plan_days").alias("last_payment_plan_days"),
        F.col("__last.plan_list_price").cast("double").alias("last_plan_list_price"),
        F.col("__last.actual_amount_paid").cast("double").alias("last_actual_amount_paid"),
        F.col("__last.is_auto_renew").alias("last_is_auto_renew"),
        F.datediff(F.lit(spec.cutoff), F.col("__last.txn_date")).alias("days_since_last_txn"),
        F.datediff(F.col("__last.expire_date"), F.lit(spec.cutoff)).alias("days_to_expire"),
    )


# --------------------------------------------------------------------- X4
def log_bucket(days_before: Column, spec: ObservationSpec) -> Column:
    """Recency bucket index 0..len(edges) from days before the cutoff."""
    e = None
    for i, edge in enumerate(spec.bucket_edges):
        e = F.when(days_before <= edge, F.lit(i)) if e is None else e.when(days_before <= edge, F.lit(i))
    return e.otherwise(F.lit(len(spec.bucket_edges)))


def log_partials(logs: DataFrame, spec: ObservationSpec, last_log: bool = False) -> DataFrame:
    """Six additive metrics per (customer, recency bucket), as ONE groupBy
    with conditional sums: ``<metric>_<bucket>`` columns, no pivot.

    The partials are sums/counts only, so they can be merged across chunks
    or micro-batches (T1) by adding; with ``last_log`` the last date (G6) comes
    out of the same aggregate, to be merged by taking the later one.
    """
    k = spec.key
    d = as_of(logs, "date", spec.cutoff_int)
    days_before = F.datediff(F.lit(spec.cutoff), ymd_to_date("date"))
    secs_ok = F.col("total_secs").between(0, spec.secs_cap)
    d = d.select(k, log_bucket(days_before, spec).alias("__b"), "num_unq", "num_100",
                 sum(F.col(c) for c in PLAY_COLS).alias("__plays"),
                 F.when(secs_ok, F.col("total_secs")).alias("__secs"), *["date"] * last_log)
    aggs = [F.max("date").alias("last_log")] * last_log
    for i, b in enumerate(BUCKET_NAMES):
        inb = F.col("__b") == i
        aggs += [
            F.count_if(inb).alias(f"logdays_{b}"),
            F.sum(F.when(inb, F.col("num_unq"))).alias(f"num_unq_sum_{b}"),
            F.sum(F.when(inb, F.col("__plays"))).alias(f"total_plays_sum_{b}"),
            F.sum(F.when(inb, F.col("num_100"))).alias(f"num_100_sum_{b}"),
            F.sum(F.when(inb, F.col("__secs"))).alias(f"secs_sum_{b}"),
            F.count(F.when(inb, F.col("__secs"))).alias(f"secs_n_{b}"),
        ]
    return d.groupBy(k).agg(*aggs)


def _wsum(metric: str, buckets: Sequence[str]) -> Column:
    return sum(F.coalesce(F.col(f"{metric}_{b}"), F.lit(0)) for b in buckets)


def log_features_from_partials(p: DataFrame, spec: ObservationSpec) -> DataFrame:
    """G3 + G4: window features (d7/d30/d90/full) and the 15-vs-15-day secs trend."""
    k = spec.key
    out = [F.col(k)]
    for win, nb in spec.windows:
        bs = BUCKET_NAMES[:nb]
        logdays = _wsum("logdays", bs)
        out += [
            logdays.cast("long").alias(f"{win}_active_days"),
            r6(safe_div(_wsum("num_unq_sum", bs), logdays)).alias(f"{win}_avg_num_unq"),
            r6(safe_div(_wsum("secs_sum", bs), _wsum("secs_n", bs))).alias(f"{win}_avg_total_secs"),
            r6(safe_div(_wsum("num_100_sum", bs), _wsum("total_plays_sum", bs))).alias(f"{win}_completion_rate"),
        ]
    recent = safe_div(_wsum("secs_sum", BUCKET_NAMES[:2]), _wsum("secs_n", BUCKET_NAMES[:2]))
    prior = safe_div(_wsum("secs_sum", BUCKET_NAMES[2:3]), _wsum("secs_n", BUCKET_NAMES[2:3]))
    prior = F.when(prior != 0, prior)
    out.append(r6(safe_div(recent - prior, prior)).alias("trend_secs_recent15_vs_prior15"))
    return p.select(*out, *[c for c in p.columns if c == "last_log"])


def log_features(logs: DataFrame, spec: ObservationSpec, last_log: bool = False) -> DataFrame:
    """17 log features (and the last log date), one shuffle on the key."""
    return log_features_from_partials(log_partials(logs, spec, last_log), spec)


def days_since_last_log(col: str, spec: ObservationSpec) -> Column:
    """Whole days from the last log date (YYYYMMDD) to the cutoff; the no-log value if there is none."""
    return F.coalesce(F.datediff(F.lit(spec.cutoff), ymd_to_date(col)), F.lit(spec.no_log_days)).cast("int")


# --------------------------------------------------------------------- G6
def log_recency(logs: DataFrame, population: DataFrame, spec: ObservationSpec) -> DataFrame:
    """Last log date before the cutoff per customer of ``population``;
    ``days_since_last_log`` = 999 when none, and a presence flag.

    The log scan is reduced to the population with a left-semi join first
    (runtime bloom filter / broadcast when the population is small)."""
    k = spec.key
    pop = population.select(k)
    last = (as_of(logs, "date", spec.cutoff_int).join(pop, k, "left_semi")
            .groupBy(k).agg(F.max("date").alias("__last")))
    d = ymd_to_date("__last")
    return pop.join(last, k, "left").select(
        k,
        F.date_format(d, "yyyy-MM-dd").alias("last_log_date"),
        days_since_last_log("__last", spec).alias("days_since_last_log"),
        d.isNotNull().cast("int").alias("has_log_before_cutoff"),
    )


# --------------------------------------------------------------------- X1
def stratified_split(labels: DataFrame, key: str = "customer_id", label: str = "is_churn",
                     fracs: Sequence[float] = (0.70, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """Exact per-class split sizes: order by md5(key:seed) within class and
    cut at floor(f1*n), floor((f1+f2)*n).

    md5 hex prefixes give 4096 equal-mass buckets, so the per-class rank is
    P0 over those buckets: no single-partition window, no hot bucket.
    """
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    d = labels.select(key, label).withColumn("__h", h).withColumn("__b", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"))
    d = ordered_prefix(d, [F.col("__h").asc(), F.col(key).asc()], {"__r": F.lit(1)}, "__b", [label])
    n = labels.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    d = null_safe_join(d, n, [label], check=True)  # one row per class value; a NULL label is a class
    c1 = F.floor(F.col("__n") * F.lit(round(fracs[0], 10)))
    c2 = F.floor(F.col("__n") * F.lit(round(fracs[0] + fracs[1], 10)))
    split = F.when(F.col("__r") <= c1, "train").when(F.col("__r") <= c2, "valid").otherwise("test")
    return d.select(key, label, split.alias("split"))


# --------------------------------------------------------------------- X5-X9
def assemble(labels: DataFrame, split: DataFrame, *features: DataFrame, key: str = "customer_id") -> DataFrame:
    """Labels x split x feature tables, left joins on the key.

    All inputs are keyed 1:1 on ``key``; each is hash-partitioned once on the
    key and the sort-merge joins chain without re-shuffling.
    """
    df = labels.join(split.drop("is_churn"), key, "left")
    for f in features:
        df = df.join(f, key, "left")
    return df


def assemble_bucketed(labels: DataFrame, split: DataFrame, *features: DataFrame, key: str = "customer_id") -> DataFrame:
    """X5/J1 over inputs that are bucketed by ``key`` into one number of buckets (``sources.tables.write_bucketed``), or
    aggregated by ``key`` from such tables: merge joins bucket by bucket, without an exchange."""
    df = labels.join(split.drop("is_churn").hint("merge"), key, "left")
    for f in features:
        df = df.join(f.hint("merge"), key, "left")
    return df


def coverage(df: DataFrame, marker_cols: dict[str, str]) -> DataFrame:
    """X5 coverage rates: share of rows whose marker column is present."""
    return df.agg(*[F.bround(F.avg(F.col(c).isNotNull().cast("double")), 6).alias(n) for n, c in marker_cols.items()])


def presence_flags(df: DataFrame) -> DataFrame:
    """X6."""
    return df.withColumns({
        "has_member_record": F.col("city").isNotNull().cast("int"),
        "has_transaction_record": F.col("txn_count").isNotNull().cast("int"),
        "has_log_activity": F.col("full_active_days").isNotNull().cast("int"),
    })


def zero_fill(df: DataFrame, cols: Sequence[str] = tuple(ZERO_FILL_COLS)) -> DataFrame:
    """X7."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in cols if c in df.columns})


def sentinel_fill(df: DataFrame) -> DataFrame:
    """City -999, registered_via '-999', gender 'unknown', bd_is_missing 1."""
    return df.withColumns({
        "city": F.coalesce(F.col("city"), F.lit(MISSING_CATEGORY)),
        "registered_via": F.coalesce(F.col("registered_via"), F.lit(str(MISSING_CATEGORY))),
        "gender": F.coalesce(F.col("gender"), F.lit("unknown")),
        "bd_is_missing": F.coalesce(F.col("bd_is_missing"), F.lit(1)),
    })


def impute_fit(df: DataFrame, cols: Sequence[str], split_col: str = "split", fit_on: str = "train") -> DataFrame:
    """X9 fit: exact medians of ``cols`` over the training rows only.

    Returns a one-row frame (column -> median), computed distributed
    (``exact_quantiles``), never by collecting values.
    """
    from lapsekit.operators.ordering import exact_quantiles

    q = exact_quantiles(df.filter(F.col(split_col) == fit_on), cols, [0.5])
    q = q.withColumn("value", F.bround("value", 6))
    return q.groupBy().pivot("column", list(cols)).agg(F.first("value"))


def impute_apply(df: DataFrame, medians: DataFrame, cols: Sequence[str]) -> DataFrame:
    """X9 apply: fill NULLs with the fitted medians (1-row frame, broadcast)."""
    m = medians.select([F.col(c).alias(f"__m_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(m))
    return j.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__m_{c}")) for c in cols}) \
            .drop(*[f"__m_{c}" for c in cols])


# --------------------------------------------------------------------- X10
def derived_features(df: DataFrame) -> DataFrame:
    """16 derived columns in one projection."""
    c = F.col
    ar7, ar30, ar90 = c("d7_active_days") / 7, c("d30_active_days") / 30, c("d90_active_days") / 90
    gap = c("days_to_expire") + c("days_since_last_txn") - c("last_payment_plan_days")
    return df.withColumns({
        "active_rate_7": r6(ar7),
        "active_rate_30": r6(ar30),
        "active_rate_90": r6(ar90),
        "activity_change_7_30": r6(ar7 - ar30),
        "activity_change_30_90": r6(ar30 - ar90),
        "secs_ratio_7_30": r6(safe_div(c("d7_avg_total_secs"), c("d30_avg_total_secs") + 1)),
        "unq_ratio_7_30": r6(safe_div(c("d7_avg_num_unq"), c("d30_avg_num_unq") + 1)),
        "completion_change_7_30": r6(c("d7_completion_rate") - c("d30_completion_rate")),
        "avg_amount_per_txn": r6(c("total_amount_paid") / F.greatest(c("txn_count"), F.lit(1))),
        "last_discount_rate": r6((c("last_plan_list_price") - c("last_actual_amount_paid"))
                                 / F.greatest(c("last_plan_list_price"), F.lit(1.0))),
        "expiry_alignment_gap": gap,
        "expiry_alignment_abs_gap": F.abs(gap),
        "remaining_plan_ratio": r6(c("days_to_expire") / F.greatest(c("last_payment_plan_days"), F.lit(1))),
        "txn_per_tenure_month": r6(c("txn_count") / (c("tenure_days") / 30 + 1)),
        "auto_renew_change": r6(c("last_is_auto_renew") - c("auto_renew_rate")),
        "auto_cancel_interaction": r6(c("last_is_auto_renew") * c("cancel_rate")),
    })


DERIVED_COLS = ["active_rate_7", "active_rate_30", "active_rate_90", "activity_change_7_30",
                "activity_change_30_90", "secs_ratio_7_30", "unq_ratio_7_30", "completion_change_7_30",
                "avg_amount_per_txn", "last_discount_rate", "expiry_alignment_gap", "expiry_alignment_abs_gap",
                "remaining_plan_ratio", "txn_per_tenure_month", "auto_renew_change", "auto_cancel_interaction"]


# --------------------------------------------------------------------- X11
def add_recency(table: DataFrame, recency: DataFrame, key: str = "customer_id") -> DataFrame:
    """X11: attach ``days_since_last_log`` (v2 feature); helper columns dropped."""
    return table.join(recency.select(key, "days_since_last_log"), key, "left")


def recency_mismatch(table: DataFrame, recency: DataFrame, key: str = "customer_id") -> DataFrame:
    """X11 audit: rows compared, rows whose two log flags differ, and keys that break the one-to-one join."""
    twice = recency.groupBy(key).count().filter("count > 1").agg(F.count(F.lit(1)).alias("duplicate_keys"))
    j = table.select(key, "has_log_activity").join(recency.select(key, "has_log_before_cutoff"), key, "left")
    return j.agg(F.count(F.lit(1)).alias("rows"),
                 F.count_if(~F.col("has_log_activity").eqNullSafe(F.col("has_log_before_cutoff"))).alias("flag_mismatches")).crossJoin(twice)


# --------------------------------------------------------------------- X12/X13
def sample_rows(df: DataFrame, n: int, seed: int = 42, key: str = "customer_id",
                strata: str | None = None) -> DataFrame:
    """Exactly ``n`` rows (per stratum when ``strata``) by md5 order.

    Deterministic and exact (unlike ``sample``/``sampleBy``).  The limit is
    the feature here; the ranking is P0 over md5-prefix buckets.
    """
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    d = df.withColumn("__h", h).withColumn("__b", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"))
    groups = [strata] if strata else []
    d = ordered_prefix(d, [F.col("__h").asc(), F.col(key).asc()], {"__r": F.lit(1)}, "__b", groups)
    return d.filter(F.col("__r") <= n).drop("__h", "__b", "__r")
