"""Observation spec and fixed schemas of the domain tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class ObservationSpec:
    """Point-in-time contract shared by every feature operator.

    ``cutoff``: last observable day; rows dated after it never reach an aggregate.
    ``min_valid_date``: expiry dates before this are sentinels and become NULL.
    ``secs_cap``: valid listening seconds per day are ``0 <= secs <= secs_cap``.
    ``bucket_edges``: upper edges (days before cutoff, inclusive) of the recency
    buckets; the last bucket is open ended.
    ``windows``: window name -> number of leading buckets it sums.
    """

    cutoff: dt.date = dt.date(2017, 1, 31)
    key: str = "customer_id"
    label: str = "is_churn"
    min_valid_date: dt.date = dt.date(2010, 1, 1)
    secs_cap: float = 172800.0
    bucket_edges: tuple = (6, 14, 29, 89)
    windows: tuple = (("d7", 1), ("d30", 3), ("d90", 4), ("full", 5))
    no_log_days: int = 999

    @property
    def cutoff_int(self) -> int:
        return int(self.cutoff.strftime("%Y%m%d"))

    @property
    def min_valid_int(self) -> int:
        return int(self.min_valid_date.strftime("%Y%m%d"))


# Fixed values of the reference's observation contract.
DEFAULT_SPEC = ObservationSpec()

# The driver tables end in 2001-08; the adapter (sources/testdata.py) maps them
# so that the cutoff is 2001-01-31 and expiry sentinels are checked at 1990-01-01.
TESTDATA_SPEC = ObservationSpec(cutoff=dt.date(2001, 1, 31), min_valid_date=dt.date(1990, 1, 1))


LABELS_SCHEMA = T.StructType([
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("is_churn", T.IntegerType(), False),
])

MEMBERS_SCHEMA = T.StructType([
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("city", T.IntegerType(), True),
    T.StructField("bd", T.IntegerType(), True),
    T.StructField("gender", T.StringType(), True),
    T.StructField("registered_via", T.StringType(), True),
    T.StructField("registration_init_time", T.IntegerType(), True),
])

TRANSACTIONS_SCHEMA = T.StructType([
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("payment_method_id", T.IntegerType(), True),
    T.StructField("payment_plan_days", T.IntegerType(), True),
    T.StructField("plan_list_price", T.DecimalType(12, 2), True),
    T.StructField("actual_amount_paid", T.DecimalType(12, 2), True),
    T.StructField("is_auto_renew", T.IntegerType(), True),
    T.StructField("transaction_date", T.IntegerType(), True),
    T.StructField("membership_expire_date", T.IntegerType(), True),
    T.StructField("is_cancel", T.IntegerType(), True),
])

USER_LOGS_SCHEMA = T.StructType([
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("date", T.IntegerType(), True),
    T.StructField("num_25", T.LongType(), True),
    T.StructField("num_50", T.LongType(), True),
    T.StructField("num_75", T.LongType(), True),
    T.StructField("num_985", T.LongType(), True),
    T.StructField("num_100", T.LongType(), True),
    T.StructField("num_unq", T.LongType(), True),
    T.StructField("total_secs", T.DoubleType(), True),
])

LEDGER_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("campaign_id", T.LongType(), True),
    T.StructField("action_type", T.StringType(), False),
    T.StructField("is_read", T.BooleanType(), False),
    T.StructField("benefit_key", T.StringType(), True),
    T.StructField("sent_by", T.StringType(), True),
    T.StructField("sent_at", T.TimestampType(), False),
])

# Serving table column order (15 columns) and types.
SCORES_SCHEMA = T.StructType([
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("churn_proba", T.DecimalType(6, 5), True),
    T.StructField("risk_tier", T.StringType(), True),
    T.StructField("ltv_tier", T.StringType(), True),
    T.StructField("segment", T.StringType(), True),
    T.StructField("avg_monthly_revenue", T.DecimalType(10, 2), True),
    T.StructField("expected_lifetime_months", T.DecimalType(6, 2), True),
    T.StructField("ltv_approx", T.DecimalType(12, 2), True),
    T.StructField("days_to_expire", T.IntegerType(), True),
    T.StructField("days_since_last_txn", T.IntegerType(), True),
    T.StructField("lifecycle_status", T.StringType(), True),
    T.StructField("last_payment_plan_days", T.IntegerType(), True),
    T.StructField("last_plan_list_price", T.DecimalType(10, 2), True),
    T.StructField("last_is_auto_renew", T.BooleanType(), True),
    T.StructField("scored_at", T.DateType(), True),
])
