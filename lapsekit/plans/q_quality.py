"""Registered queries: data quality and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapsekit.functions import ymd_to_date
from lapsekit.operators import features as X
from lapsekit.operators import quality as Q
from lapsekit.operators.cleaning import latest_by_row_number
from lapsekit.plans import model_table as MT
from lapsekit.plans.catalog import query
from lapsekit.plans.oracle_views import sql
from lapsekit.sources import testdata as TD
from lapsekit.spec import TESTDATA_SPEC as SPEC

_MEMBER_COLS = ["customer_id", "city", "bd", "gender", "registered_via", "registration_init_time"]


@query("null_profile_members", sql(["members"], " UNION ALL ".join(
    f"SELECT '{c}' AS column, count_if({c} IS NULL) AS nulls, round_even(count_if({c} IS NULL) / count(*) * 100, 6) AS null_pct FROM members"
    for c in _MEMBER_COLS)))
def q_null_profile(spark, sf):
    """Q1: null count and percent per column (one pass + unpivot)."""
    return Q.null_profile(TD.members(spark, sf), _MEMBER_COLS)


@query("distinct_profile_members", sql(["members"], " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(DISTINCT {c}) AS distinct_values FROM members" for c in _MEMBER_COLS[1:])))
def q_distinct_profile(spark, sf):
    """Distinct values per column."""
    return Q.distinct_profile(TD.members(spark, sf), _MEMBER_COLS[1:])


@query("duplicate_profile_transactions", sql(["transactions"], """
    SELECT (SELECT count(*) FROM transactions) AS rows,
           (SELECT count(*) FROM (SELECT DISTINCT * FROM transactions) d) AS distinct_rows,
           count_if(c > 1) AS duplicated_keys, COALESCE(sum(CASE WHEN c > 1 THEN c - 1 END), 0) AS extra_key_rows,
           (SELECT count(*) FROM transactions) - (SELECT count(*) FROM (SELECT DISTINCT * FROM transactions) d) AS duplicate_rows
    FROM (SELECT customer_id, transaction_date, count(*) AS c FROM transactions GROUP BY 1, 2) k"""))
def q_dup(spark, sf):
    """Q2: duplicate rows and duplicate (customer, day) keys."""
    return Q.duplicate_profile(TD.transactions(spark, sf), ["customer_id", "transaction_date"]) \
        .withColumn("extra_key_rows", F.col("extra_key_rows").cast("long"))


_DESC = ["txn_count", "payment_method_nunique", "plan_days_nunique", "auto_renew_rate", "cancel_count", "cancel_rate",
         "total_amount_paid", "avg_discount", "last_payment_plan_days", "last_plan_list_price", "last_actual_amount_paid",
         "last_is_auto_renew", "days_since_last_txn", "days_to_expire"]


@query("describe_transactions", sql(["txn_feat"], " UNION ALL ".join(
    f"""SELECT '{c}' AS column, count({c}) AS count, round_even(avg({c}), 6) AS mean, round_even(stddev_samp({c}), 6) AS std,
               CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
               round_even(quantile_cont({c}, 0.25), 6) AS q25, round_even(quantile_cont({c}, 0.5), 6) AS q50,
               round_even(quantile_cont({c}, 0.75), 6) AS q75 FROM txn_feat""" for c in _DESC)))
def q_describe(spark, sf):
    """Q3: exact describe (sample std, exact interpolated quartiles)."""
    return Q.describe_exact(X.transaction_features(TD.transactions(spark, sf), SPEC), _DESC)


@query("moments_logs", sql(["user_logs"], " UNION ALL ".join(
    f"""SELECT '{c}' AS column, count(v) AS count, round_even(avg(v), 6) AS mean, round_even(stddev_pop(v), 6) AS std,
               CAST(min(v) AS DOUBLE) AS min, CAST(max(v) AS DOUBLE) AS max
        FROM (SELECT CASE WHEN {c} BETWEEN {lo} AND {hi} THEN {c} END AS v FROM user_logs) x"""
    for c, lo, hi in (("total_secs", 0, 172800), ("num_unq", 0, 1000000)))))
def q_moments(spark, sf):
    """Q4: moments over the validity range (population std)."""
    return Q.moments(TD.user_logs(spark, sf), {"total_secs": (0, 172800), "num_unq": (0, 1000000)})


@query("histogram_secs", sql(["user_logs"], """
    SELECT CAST(least(floor((least(total_secs, 1000.0) - 0) / 40.0), 24) AS INTEGER) AS bin, count(*) AS count,
           round_even(0 + least(floor((least(total_secs, 1000.0) - 0) / 40.0), 24) * 40.0, 6) AS bin_start
    FROM user_logs WHERE total_secs >= 0 GROUP BY 1, 3"""))
def q_hist(spark, sf):
    """Q5: 25 fixed bins on [0, 1000] seconds, clipped upper tail."""
    return Q.histogram(TD.user_logs(spark, sf), "total_secs", 0.0, 1000.0, 25)


@query("monthly_volume_transactions", sql(["transactions"], """
    WITH c AS (SELECT date_trunc('month', CAST(try_strptime(CAST(transaction_date AS VARCHAR), '%Y%m%d') AS DATE)) AS month,
                      count(*) AS rows FROM transactions GROUP BY 1),
    s AS (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM c)
    SELECT s.month, CAST(COALESCE(c.rows, 0) AS BIGINT) AS rows FROM s LEFT JOIN c ON s.month = c.month"""))
def q_monthly(spark, sf):
    """Dense monthly volume (month spine, empty months = 0)."""
    t = TD.transactions(spark, sf).select(ymd_to_date("transaction_date").alias("d"))
    return Q.monthly_volume(t, "d")


@query("corruption_counters", sql(["transactions", "user_logs"], """
    SELECT (SELECT count_if(total_secs < 0) FROM user_logs) AS negative_secs,
           (SELECT count_if(total_secs > 172800) FROM user_logs) AS secs_over_cap,
           count_if(membership_expire_date < 19900101) AS placeholder_expiry,
           count_if(actual_amount_paid = 0) AS free_payments,
           count_if(actual_amount_paid < plan_list_price) AS discounted_payments,
           count_if(transaction_date > 20010131) AS after_cutoff
    FROM transactions"""))
def q_corruption(spark, sf):
    """Q7: corruption counters in one pass per table."""
    t = TD.transactions(spark, sf)
    lg = Q.count_rules(TD.user_logs(spark, sf), {
        "negative_secs": F.col("total_secs") < 0, "secs_over_cap": F.col("total_secs") > SPEC.secs_cap})
    tr = Q.count_rules(t, {
        "placeholder_expiry": F.col("membership_expire_date") < SPEC.min_valid_int,
        "free_payments": F.col("actual_amount_paid") == 0,
        "discounted_payments": F.col("actual_amount_paid") < F.col("plan_list_price"),
        "after_cutoff": F.col("transaction_date") > SPEC.cutoff_int})
    return lg.crossJoin(tr)


@query("events_per_user", sql(["transactions"], """
    SELECT rows_per_key, count(*) AS keys FROM (SELECT customer_id, count(*) AS rows_per_key FROM transactions GROUP BY 1) x
    GROUP BY 1"""))
def q_events_per_user(spark, sf):
    """Q8: distribution of transactions per customer."""
    return Q.per_key_distribution(TD.transactions(spark, sf), "customer_id")


@query("compare_last_txn", sql(["txn_feat"], """
    SELECT count(*) AS compared_rows, c AS column, 1.0 AS match_rate, 0.0 AS mean_abs_error
    FROM txn_feat, (VALUES ('days_to_expire'), ('days_since_last_txn'), ('last_actual_amount_paid')) v(c)
    GROUP BY c"""))
def q_compare(spark, sf):
    """Q9: two implementations of the last transaction (max_by aggregate vs
    row_number window) compared column by column (NULL = NULL is a match)."""
    t = X.clean_transactions(TD.transactions(spark, sf), SPEC)
    a = X.transaction_features(TD.transactions(spark, sf), SPEC)
    b = latest_by_row_number(t, "customer_id", [
        F.col("txn_date").desc(), F.col("expire_date").desc_nulls_last(), F.col("actual_amount_paid").desc(),
        F.col("payment_plan_days").desc(), F.col("plan_list_price").desc(), F.col("is_auto_renew").desc(),
        F.col("is_cancel").desc(), F.col("payment_method_id").desc()]).select(
        "customer_id", F.datediff(F.col("expire_date"), F.lit(SPEC.cutoff)).alias("days_to_expire"),
        F.datediff(F.lit(SPEC.cutoff), F.col("txn_date")).alias("days_since_last_txn"),
        F.col("actual_amount_paid").cast("double").alias("last_actual_amount_paid"))
    return Q.compare(a, b, "customer_id", ["days_to_expire", "days_since_last_txn", "last_actual_amount_paid"])


@query("expectations_model_table", sql(["model_v2"], """
    SELECT count(*) = count(DISTINCT customer_id) AS unique_key,
           count_if(days_since_last_log < 0) = 0 AS non_negative_recency,
           count_if(txn_count IS NULL OR full_active_days IS NULL OR city IS NULL) = 0 AS no_null_fills,
           count_if(split IS NULL) = 0 AS every_row_split,
           count(*) = (SELECT count(*) FROM churn_labels) AS row_count_matches_labels
    FROM model_v2"""))
def q_expect(spark, sf):
    """Q10: stage assertions as one aggregate of booleans."""
    m = MT.build_model_table(spark, sf, SPEC)
    n = TD.labels(spark, sf).agg(F.count(F.lit(1)).alias("__labels"))
    e = Q.expectations(m, {
        "unique_key": F.count(F.lit(1)) == F.count_distinct("customer_id"),
        "non_negative_recency": F.count_if(F.col("days_since_last_log") < 0) == 0,
        "no_null_fills": F.count_if(F.col("txn_count").isNull() | F.col("full_active_days").isNull()
                                    | F.col("city").isNull()) == 0,
        "every_row_split": F.count_if(F.col("split").isNull()) == 0,
        "__rows": F.count(F.lit(1)),
    })
    return e.crossJoin(n).withColumn("row_count_matches_labels", F.col("__rows") == F.col("__labels")) \
        .drop("__rows", "__labels")


EXPIRY_STATUS = """CASE WHEN days_to_expire < 1 THEN 'expired_or_today' WHEN days_to_expire BETWEEN 1 AND 28 THEN 'next_month'
                        WHEN days_to_expire > 28 THEN 'later' ELSE 'other' END"""


@query("expiry_audit", sql(["asm"], f"""
    SELECT {EXPIRY_STATUS} AS "group", count(*) AS customers, round_even(avg(is_churn), 6) AS churn_rate,
           min(days_to_expire) AS min_value, max(days_to_expire) AS max_value,
           round_even(count(*) / (SELECT count(*) FROM asm) * 100, 6) AS customer_pct
    FROM asm GROUP BY 1"""))
def q_expiry(spark, sf):
    """Expiry horizon buckets with churn rate and share of total."""
    a = MT.assembled(spark, sf, SPEC)
    d = F.col("days_to_expire")
    status = F.when(d < 1, "expired_or_today").when(d.between(1, 28), "next_month").when(d > 28, "later") \
        .otherwise("other")
    return Q.group_rate(a, status, "is_churn", "days_to_expire")


# every numeric feature of the assembled table (codes of categories are not numbers)
_UNI = [f for f in MT.FEATURE_COLS_V2[:MT.FEATURE_COLS_V2.index("has_member_record")] if f not in MT.CATEGORICAL_COLS]


@query("univariate_auc", sql(["asm"], " UNION ALL ".join(f"""
    SELECT '{c}' AS feature, round_even(a, 6) AS auc, round_even(greatest(a, 1 - a), 6) AS directional_auc,
           CASE WHEN a >= 0.5 THEN 'higher_churns' ELSE 'lower_churns' END AS direction
    FROM (SELECT sum(pos * (COALESCE(nb, 0) + 0.5 * neg)) / (sum(pos) * sum(neg)) AS a
          FROM (SELECT *, sum(neg) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb
                FROM (SELECT CAST({c} AS DOUBLE) AS v, CAST(sum(is_churn) AS DOUBLE) AS pos,
                             CAST(sum(1 - is_churn) AS DOUBLE) AS neg
                      FROM asm WHERE {c} IS NOT NULL GROUP BY 1) d) c) x""" for c in _UNI)))
def q_uni_auc(spark, sf):
    """Q12: leak audit by univariate AUC per feature."""
    return Q.univariate_auc(MT.assembled(spark, sf, SPEC), "is_churn", _UNI)


@query("class_balance", sql(["churn_labels"], """
    SELECT count(*) AS rows, CAST(sum(is_churn) AS BIGINT) AS positives, round_even(avg(is_churn), 6) AS positive_rate,
           round_even(greatest(avg(is_churn), 1 - avg(is_churn)), 6) AS majority_accuracy FROM churn_labels"""))
def q_balance(spark, sf):
    """Q13: class balance and majority-class baseline."""
    return Q.class_balance(TD.labels(spark, sf), "is_churn")


@query("category_cardinality", sql(["members"], """
    SELECT city, count(*) AS count, round_even(count(*) / (SELECT count(*) FROM members), 6) AS share
    FROM members GROUP BY city ORDER BY count DESC, city LIMIT 15"""))
def q_cardinality(spark, sf):
    """Q14: top 15 observed city codes (the limit is the feature)."""
    return Q.value_counts(TD.members(spark, sf), "city", top=15)


@query("plan_value_counts", sql(["transactions"], """
    SELECT payment_plan_days, count(*) AS count, round_even(count(*) / (SELECT count(*) FROM transactions), 6) AS share
    FROM transactions GROUP BY 1"""))
def q_value_counts(spark, sf):
    """Value counts with normalised share."""
    return Q.value_counts(TD.transactions(spark, sf), "payment_plan_days")


@query("completion_composition", sql(["user_logs"], """
    SELECT round_even(avg(num_100) / (avg(num_25) + avg(num_50) + avg(num_75) + avg(num_985) + avg(num_100)), 6) AS ratio
    FROM user_logs"""))
def q_ratio(spark, sf):
    """Grand-total ratio of column means (full plays / all plays)."""
    return Q.ratio_of_means(TD.user_logs(spark, sf), ["num_100"], X.PLAY_COLS)
