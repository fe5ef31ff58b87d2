"""End-to-end composition: raw domain tables -> model table v2.

Each source is read and shuffled once on the customer key: the log aggregate
carries the last log date along (G6), and the assembled table is written once
because the median fit and the fill both read it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lapsekit.operators import features as X
from lapsekit.session import cut_lineage
from lapsekit.sources import testdata
from lapsekit.sources.tables import write_bucketed
from lapsekit.spec import TESTDATA_SPEC, ObservationSpec


def domain_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "labels": testdata.labels(spark, sf_dir),
        "members": testdata.members(spark, sf_dir),
        "transactions": testdata.transactions(spark, sf_dir, until_cutoff=True),
        "user_logs": testdata.user_logs(spark, sf_dir, until_cutoff=True),
    }


def assembled(spark: SparkSession, sf_dir: str, spec: ObservationSpec = TESTDATA_SPEC, last_log: bool = False) -> DataFrame:
    """Labels x split x members x transactions x logs (before any fill); with
    ``last_log`` also the last log date as ``last_log``."""
    t = domain_tables(spark, sf_dir)
    split = X.stratified_split(t["labels"], spec.key, spec.label)
    return X.assemble(t["labels"], split,
                      X.member_features(t["members"], spec),
                      X.transaction_features(t["transactions"], spec),
                      X.log_features(t["user_logs"], spec, last_log), key=spec.key)


def bucketed_tables(spark: SparkSession, sf_dir: str, root: str, spec: ObservationSpec = TESTDATA_SPEC, buckets: int = 8) -> dict[str, DataFrame]:
    """The domain tables and the split under ``root``, bucketed by customer: one shuffle each, paid when data arrive."""
    t = domain_tables(spark, sf_dir)
    t["split"] = X.stratified_split(t["labels"], spec.key, spec.label)
    return {name: write_bucketed(df, f"{root.rstrip('/')}/{name}", spec.key, buckets) for name, df in t.items()}


def assembled_bucketed(t: dict[str, DataFrame], spec: ObservationSpec = TESTDATA_SPEC, last_log: bool = False) -> DataFrame:
    """``assembled`` over ``bucketed_tables``: aggregations and joins stay within buckets, no row moves."""
    return X.assemble_bucketed(t["labels"], t["split"], X.member_features(t["members"], spec), X.transaction_features(t["transactions"], spec),
                               X.log_features(t["user_logs"], spec, last_log), key=spec.key)


# Names of the features that the training medians fill.
MEDIAN_CANDIDATES = [
    "bd_clean", "tenure_days", "auto_renew_rate", "cancel_rate", "avg_discount", "last_payment_plan_days",
    "last_plan_list_price", "last_actual_amount_paid", "last_is_auto_renew", "days_since_last_txn",
    "days_to_expire", "d7_avg_num_unq", "d7_avg_total_secs", "d7_completion_rate", "d30_avg_num_unq",
    "d30_avg_total_secs", "d30_completion_rate", "d90_avg_num_unq", "d90_avg_total_secs",
    "d90_completion_rate", "full_avg_num_unq", "full_avg_total_secs", "full_completion_rate",
    "trend_secs_recent15_vs_prior15",
]


def filled(spark: SparkSession, sf_dir: str, spec: ObservationSpec = TESTDATA_SPEC, last_log: bool = False) -> DataFrame:
    """Presence flags, zero fill, sentinel fill, train-median fill."""
    d = X.sentinel_fill(X.zero_fill(X.presence_flags(assembled(spark, sf_dir, spec, last_log))))
    # Stage boundary: the assembled table feeds both the median fit and the
    # fill; a reliable checkpoint (shared checkpoint dir) keeps one lineage.
    d = cut_lineage(d)
    med = X.impute_fit(d, MEDIAN_CANDIDATES)
    return X.impute_apply(d, med, MEDIAN_CANDIDATES)


def build_model_table(spark: SparkSession, sf_dir: str, spec: ObservationSpec = TESTDATA_SPEC) -> DataFrame:
    """X10 + X11: v2 table (derived features + days_since_last_log)."""
    d = X.derived_features(filled(spark, sf_dir, spec, last_log=True))
    return d.withColumn("days_since_last_log", X.days_since_last_log("last_log", spec)).drop("last_log")


# The feature contract, in its published order.
FEATURE_COLS_V2 = [
    "city", "registered_via", "bd_clean", "bd_is_missing", "gender", "tenure_days",
    "txn_count", "payment_method_nunique", "plan_days_nunique", "auto_renew_rate", "cancel_count",
    "cancel_rate", "total_amount_paid", "avg_discount", "last_payment_plan_days", "last_plan_list_price",
    "last_actual_amount_paid", "last_is_auto_renew", "days_since_last_txn", "days_to_expire",
    "d7_active_days", "d7_avg_num_unq", "d7_avg_total_secs", "d7_completion_rate",
    "d30_active_days", "d30_avg_num_unq", "d30_avg_total_secs", "d30_completion_rate",
    "d90_active_days", "d90_avg_num_unq", "d90_avg_total_secs", "d90_completion_rate",
    "full_active_days", "full_avg_num_unq", "full_avg_total_secs", "full_completion_rate",
    "trend_secs_recent15_vs_prior15", "has_member_record", "has_transaction_record", "has_log_activity",
] + X.DERIVED_COLS + ["days_since_last_log"]

CATEGORICAL_COLS = ["city", "gender", "registered_via"]
