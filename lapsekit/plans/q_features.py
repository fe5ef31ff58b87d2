"""Registered queries: sources, cleaning, joins and the feature path."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapsekit.operators import cleaning as C
from lapsekit.operators import features as X
from lapsekit.operators.analytics import lifecycle
from lapsekit.plans import model_table as MT
from lapsekit.plans.catalog import query
from lapsekit.plans.oracle_views import sql
from lapsekit.sources import testdata as TD
from lapsekit.session import cut_lineage
from lapsekit.spec import TESTDATA_SPEC as SPEC

LIFECYCLE_SQL = """CASE WHEN days_to_expire IS NULL THEN 'unknown' WHEN days_to_expire > 0 THEN 'active'
                        WHEN days_to_expire BETWEEN -30 AND 0 THEN 'grace' ELSE 'lapsed' END"""


@query("lifecycle_counts", sql(["txn_feat"], f"""
    SELECT {LIFECYCLE_SQL} AS lifecycle_status, count(*) AS customers
    FROM txn_feat GROUP BY 1"""))
def lifecycle_counts(spark, sf):
    """Flagship (minimum slice): adapter -> X3 -> W1 -> C8 counts."""
    t = X.transaction_features(TD.transactions(spark, sf), SPEC)
    return lifecycle(t).groupBy("lifecycle_status").agg(F.count(F.lit(1)).alias("customers"))


@query("member_features", sql(["member_feat"], "SELECT * FROM member_feat"))
def q_member_features(spark, sf):
    return X.member_features(TD.members(spark, sf), SPEC)


@query("transaction_features", sql(["txn_feat"], "SELECT * FROM txn_feat"))
def q_transaction_features(spark, sf):
    return X.transaction_features(TD.transactions(spark, sf), SPEC)


@query("log_partials", sql(["log_part"], "SELECT * FROM log_part"))
def q_log_partials(spark, sf):
    return X.log_partials(TD.user_logs(spark, sf), SPEC)


@query("log_features", sql(["log_feat"], "SELECT * FROM log_feat"))
def q_log_features(spark, sf):
    return X.log_features(TD.user_logs(spark, sf), SPEC)


# ------------------------------------------------------------------ oracle views of the feature path
from lapsekit.plans import oracle_views as OV  # noqa: E402

OV.VIEWS["split"] = (["churn_labels"], """
    SELECT customer_id, is_churn,
           CASE WHEN r <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
                WHEN r <= floor(n * CAST(0.85 AS DOUBLE)) THEN 'valid' ELSE 'test' END AS split
    FROM (SELECT customer_id, is_churn,
                 row_number() OVER (PARTITION BY is_churn
                                    ORDER BY md5(CAST(customer_id AS VARCHAR) || ':42'), customer_id) AS r,
                 count(*) OVER (PARTITION BY is_churn) AS n
          FROM churn_labels) s""")
OV.VIEWS["asm"] = (["churn_labels", "split", "member_feat", "txn_feat", "log_feat"], """
    SELECT l.customer_id, l.is_churn, s.split, m.* EXCLUDE (customer_id), t.* EXCLUDE (customer_id),
           g.* EXCLUDE (customer_id)
    FROM churn_labels l
    LEFT JOIN split s ON l.customer_id = s.customer_id
    LEFT JOIN member_feat m ON l.customer_id = m.customer_id
    LEFT JOIN txn_feat t ON l.customer_id = t.customer_id
    LEFT JOIN log_feat g ON l.customer_id = g.customer_id""")
_ZERO = X.ZERO_FILL_COLS
OV.VIEWS["filled0"] = (["asm"], f"""
    SELECT * REPLACE ({", ".join(f"COALESCE({c}, 0) AS {c}" for c in _ZERO)},
                      COALESCE(city, -999) AS city, COALESCE(registered_via, '-999') AS registered_via,
                      COALESCE(gender, 'unknown') AS gender, COALESCE(bd_is_missing, 1) AS bd_is_missing),
           CAST(city IS NOT NULL AS INTEGER) AS has_member_record,
           CAST(txn_count IS NOT NULL AS INTEGER) AS has_transaction_record,
           CAST(full_active_days IS NOT NULL AS INTEGER) AS has_log_activity
    FROM asm""")
_MED = MT.MEDIAN_CANDIDATES
OV.VIEWS["medians"] = (["filled0"], "SELECT " + ", ".join(
    f"round_even(quantile_cont({c}, 0.5), 6) AS {c}" for c in _MED) + " FROM filled0 WHERE split = 'train'")
OV.VIEWS["filled"] = (["filled0", "medians"], "SELECT f.* REPLACE (" + ", ".join(
    f"COALESCE(CAST(f.{c} AS DOUBLE), m.{c}) AS {c}" for c in _MED) + ") FROM filled0 f CROSS JOIN medians m")


def _r6(e):
    return f"round_even({e}, 6)"


OV.VIEWS["derived"] = (["filled"], "SELECT *, " + ", ".join([
    _r6("d7_active_days / 7") + " AS active_rate_7",
    _r6("d30_active_days / 30") + " AS active_rate_30",
    _r6("d90_active_days / 90") + " AS active_rate_90",
    _r6("d7_active_days / 7 - d30_active_days / 30") + " AS activity_change_7_30",
    _r6("d30_active_days / 30 - d90_active_days / 90") + " AS activity_change_30_90",
    _r6("d7_avg_total_secs / NULLIF(d30_avg_total_secs + 1, 0)") + " AS secs_ratio_7_30",
    _r6("d7_avg_num_unq / NULLIF(d30_avg_num_unq + 1, 0)") + " AS unq_ratio_7_30",
    _r6("d7_completion_rate - d30_completion_rate") + " AS completion_change_7_30",
    _r6("total_amount_paid / GREATEST(txn_count, 1)") + " AS avg_amount_per_txn",
    _r6("(last_plan_list_price - last_actual_amount_paid) / GREATEST(last_plan_list_price, 1.0)") + " AS last_discount_rate",
    "days_to_expire + days_since_last_txn - last_payment_plan_days AS expiry_alignment_gap",
    "abs(days_to_expire + days_since_last_txn - last_payment_plan_days) AS expiry_alignment_abs_gap",
    _r6("days_to_expire / GREATEST(last_payment_plan_days, 1)") + " AS remaining_plan_ratio",
    _r6("txn_count / (tenure_days / 30 + 1)") + " AS txn_per_tenure_month",
    _r6("last_is_auto_renew - auto_renew_rate") + " AS auto_renew_change",
    _r6("last_is_auto_renew * cancel_rate") + " AS auto_cancel_interaction",
]) + " FROM filled")
OV.VIEWS["recency"] = (["churn_labels", "user_logs"], f"""
    SELECT p.customer_id, strftime(d, '%Y-%m-%d') AS last_log_date,
           CAST(COALESCE(date_diff('day', d, {OV.CUTOFF}), 999) AS INTEGER) AS days_since_last_log,
           CAST(d IS NOT NULL AS INTEGER) AS has_log_before_cutoff
    FROM churn_labels p
    LEFT JOIN (SELECT customer_id, CAST(try_strptime(CAST(max(date) AS VARCHAR), '%Y%m%d') AS DATE) AS d
               FROM user_logs WHERE date <= {OV.CUTOFF_INT} GROUP BY customer_id) x
      ON p.customer_id = x.customer_id""")
OV.VIEWS["model_v2"] = (["derived", "recency"], """
    SELECT d.*, r.days_since_last_log FROM derived d LEFT JOIN recency r ON d.customer_id = r.customer_id""")


def _split(spark, sf):
    return X.stratified_split(TD.labels(spark, sf), SPEC.key, SPEC.label)


@query("stratified_split", sql(["split"], "SELECT * FROM split"))
def q_split(spark, sf):
    """Exact per-class 70/15/15 split."""
    return _split(spark, sf)


@query("split_summary", sql(["split"], """
    SELECT split, count(*) AS customers, CAST(sum(is_churn) AS BIGINT) AS churners,
           round_even(avg(is_churn), 6) AS churn_rate FROM split GROUP BY split"""))
def q_split_summary(spark, sf):
    """Per-split rows and churn rate."""
    return _split(spark, sf).groupBy("split").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("is_churn").cast("long").alias("churners"),
        F.bround(F.avg("is_churn"), 6).alias("churn_rate"))


@query("split_disjoint", sql(["split"], """
    SELECT count(*) AS keys_in_many_splits FROM (
      SELECT customer_id FROM split GROUP BY customer_id HAVING count(DISTINCT split) > 1) x"""))
def q_split_disjoint(spark, sf):
    """R2: keys present in more than one split (must be 0)."""
    s = _split(spark, sf)
    return s.groupBy("customer_id").agg(F.count_distinct("split").alias("k")).filter("k > 1") \
        .agg(F.count(F.lit(1)).alias("keys_in_many_splits"))


@query("assembled", sql(["asm"], "SELECT * FROM asm"))
def q_assembled(spark, sf):
    """Labels x split x members x transactions x logs."""
    return MT.assembled(spark, sf, SPEC)


@query("assembled_bucketed", sql(["asm"], "SELECT * FROM asm"))
def q_assembled_bucketed(spark, sf):
    """X5/J1 over tables bucketed by customer: the aggregations and the five joins need no exchange."""
    import uuid

    from lapsekit.session import checkpoint_dir
    root = f"{checkpoint_dir(spark).rstrip('/')}/buckets-{uuid.uuid4().hex}"
    return MT.assembled_bucketed(MT.bucketed_tables(spark, sf, root, SPEC), SPEC)


@query("coverage", sql(["asm"], """
    SELECT round_even(avg(CAST(city IS NOT NULL AS DOUBLE)), 6) AS member_coverage,
           round_even(avg(CAST(txn_count IS NOT NULL AS DOUBLE)), 6) AS transaction_coverage,
           round_even(avg(CAST(full_active_days IS NOT NULL AS DOUBLE)), 6) AS log_coverage FROM asm"""))
def q_coverage(spark, sf):
    """X5 coverage rates."""
    return X.coverage(MT.assembled(spark, sf, SPEC), {
        "member_coverage": "city", "transaction_coverage": "txn_count", "log_coverage": "full_active_days"})


@query("impute_medians", sql(["medians"], "SELECT * FROM medians"))
def q_impute_medians(spark, sf):
    """X9 fit: exact train-only medians."""
    d = X.sentinel_fill(X.zero_fill(X.presence_flags(MT.assembled(spark, sf, SPEC))))
    return X.impute_fit(d, MT.MEDIAN_CANDIDATES)


@query("sketch_medians", sql(["asm"], """
    SELECT unnest([0.25, 0.5, 0.9]) AS p, TRUE AS within_bound FROM (SELECT 1) x"""))
def q_sketch_medians(spark, sf):
    """G17 by mergeable sketches: the rank error of every feature's quantiles, against the exact ranks, is within twice the
    bound of a single one (there are many)."""
    from lapsekit.operators.ordering import quantile_rank_errors, sketch_quantiles
    d = X.sentinel_fill(X.zero_fill(X.presence_flags(MT.assembled(spark, sf, SPEC)))).select(*MT.MEDIAN_CANDIDATES)
    d = cut_lineage(d)
    probs = [0.25, 0.5, 0.9]
    errors = quantile_rank_errors(d, sketch_quantiles(d, MT.MEDIAN_CANDIDATES, probs))
    return errors.groupBy("p").agg(F.min(F.col("rank_error") <= 2 * F.col("bound")).alias("within_bound"))


@query("filled_table", sql(["filled"], "SELECT * FROM filled"))
def q_filled(spark, sf):
    """Flags, zero fill, sentinels, train-median fill."""
    return MT.filled(spark, sf, SPEC)


@query("log_recency", sql(["recency"], "SELECT * FROM recency"))
def q_log_recency(spark, sf):
    """Last log date, days since (999 if none), presence flag."""
    t = MT.domain_tables(spark, sf)
    return X.log_recency(t["user_logs"], t["labels"], SPEC)


@query("model_table_v2", sql(["model_v2"], "SELECT * FROM model_v2"))
def q_model_table(spark, sf):
    """X10 + X11: the 57-feature model table."""
    return MT.build_model_table(spark, sf, SPEC)


@query("sample_rows", sql(["churn_labels"], """
    SELECT customer_id, is_churn FROM churn_labels
    ORDER BY md5(CAST(customer_id AS VARCHAR) || ':7'), customer_id LIMIT 100"""))
def q_sample_rows(spark, sf):
    """Exact n=100 random rows by md5 order (the limit is the feature)."""
    return X.sample_rows(TD.labels(spark, sf), 100, seed=7)


@query("sample_stratified", sql(["churn_labels"], """
    SELECT customer_id, is_churn FROM (
      SELECT *, row_number() OVER (PARTITION BY is_churn
                                   ORDER BY md5(CAST(customer_id AS VARCHAR) || ':7'), customer_id) AS r
      FROM churn_labels) x WHERE r <= 50"""))
def q_sample_stratified(spark, sf):
    """Exact 50 rows per class."""
    return X.sample_rows(TD.labels(spark, sf), 50, seed=7, strata="is_churn")


@query("semi_join_targets", sql(["transactions", "churn_labels"], """
    SELECT t.customer_id, count(*) AS txns FROM transactions t
    WHERE t.customer_id IN (SELECT customer_id FROM churn_labels WHERE is_churn = 1)
    GROUP BY t.customer_id"""))
def q_semi(spark, sf):
    """Restrict transactions to target users (left semi) before aggregating."""
    lab = TD.labels(spark, sf).filter("is_churn = 1")
    return C.semi_keep(TD.transactions(spark, sf), lab, "customer_id") \
        .groupBy("customer_id").agg(F.count(F.lit(1)).alias("txns"))


@query("join_1to1", sql(["member_feat", "txn_feat"], """
    SELECT m.customer_id, m.tenure_days, t.txn_count FROM member_feat m
    LEFT JOIN txn_feat t ON m.customer_id = t.customer_id"""))
def q_join_1to1(spark, sf):
    """Join with a checked one-to-one contract."""
    m = X.member_features(TD.members(spark, sf), SPEC).select("customer_id", "tenure_days")
    t = X.transaction_features(TD.transactions(spark, sf), SPEC).select("customer_id", "txn_count")
    return C.join_1to1(m, t, "customer_id", "left")


@query("dedupe_transactions", sql(["transactions"], f"""
    SELECT count(*) AS raw_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM transactions) d) AS distinct_rows,
           count_if(transaction_date > {OV.CUTOFF_INT}) AS after_cutoff_rows FROM transactions"""))
def q_dedupe(spark, sf):
    """F1/F2 audit: raw rows, distinct rows, rows dropped by the cutoff."""
    t = TD.transactions(spark, sf)
    a = t.agg(F.count(F.lit(1)).alias("raw_rows"),
              F.count_if(F.col("transaction_date") > SPEC.cutoff_int).alias("after_cutoff_rows"))
    b = t.distinct().agg(F.count(F.lit(1)).alias("distinct_rows"))
    return a.crossJoin(b).select("raw_rows", "distinct_rows", "after_cutoff_rows")


@query("recency_mismatch", sql(["filled0", "recency"], """
    SELECT count(*) AS rows, count_if(f.has_log_activity IS DISTINCT FROM r.has_log_before_cutoff) AS flag_mismatches,
           (SELECT count(*) FROM (SELECT customer_id FROM recency GROUP BY 1 HAVING count(*) > 1) d) AS duplicate_keys
    FROM filled0 f LEFT JOIN recency r ON f.customer_id = r.customer_id"""))
def q_recency_mismatch(spark, sf):
    """X11: log-presence flag of the table against the recency flag, and the one-to-one check."""
    t = X.presence_flags(MT.assembled(spark, sf, SPEC))
    return X.recency_mismatch(t, X.log_recency(TD.user_logs(spark, sf), TD.labels(spark, sf), SPEC))


@query("incremental_log_features", sql(["log_feat"], "SELECT * FROM log_feat"))
def q_incremental(spark, sf):
    """Structured Streaming (availableNow, update mode, foreachBatch) over the
    log files; equals the batch log features.  Source/state/output folders live under the shared checkpoint dir."""
    import os
    import uuid

    from lapsekit.session import checkpoint_dir
    from lapsekit.streaming.incremental import incremental_log_features

    base = os.path.join(checkpoint_dir(spark), f"t1-{uuid.uuid4().hex[:8]}")
    TD.user_logs(spark, sf).write.mode("overwrite").parquet(os.path.join(base, "src"))
    return incremental_log_features(spark, os.path.join(base, "src"), os.path.join(base, "state"),
                                    os.path.join(base, "out"), SPEC)
