"""Adapter: driver tables (TPC-H-like + events) -> the churn domain model.

This is adapter code, not an operator.  The same mapping is written as SQL in
``lapsekit/plans/oracle_views.py`` so the DuckDB oracle sees identical inputs.

Mapping (scale-free, every table grows with the sf):
- members      <- customer (+ first order date as registration)
- transactions <- orders (+ per-order average line discount)
- user_logs    <- events aggregated to (customer, day), one event day -> 5 days
- labels       <- "no order in (cutoff, label_end]"
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsekit.functions import date_to_ymd

# Fixed values of the adapter.
CUTOFF = dt.date(2001, 1, 31)
LABEL_END = dt.date(2001, 8, 1)
EVENT_ANCHOR = dt.date(2024, 1, 24)      # event day mapped onto the cutoff
EVENT_STRETCH = 5                        # one event day -> five log days
SENTINEL_MOD = 97                        # o_orderkey % 97 = 0 -> expiry 19700101
SENTINEL_YMD = 19700101
PLAN_DAYS = {"1-URGENT": 7, "2-HIGH": 30, "3-MEDIUM": 90, "4-NOT SPECIFIED": 180, "5-LOW": 365}
PLAY_BUCKETS = {"num_25": "click", "num_50": "view", "num_75": "signup", "num_985": "error", "num_100": "purchase"}
GENDER_BY_MOD3 = {0: None, 1: "male", 2: "female"}
AGE_DIVISOR = 90


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def customer_key(col: str):
    """Customer keys of the domain are strings; the adapter's are ``c<number>``."""
    return F.concat(F.lit("c"), F.col(col).cast("string"))


def _plan_days(c):
    e = None
    for k, v in PLAN_DAYS.items():
        e = F.when(c == k, F.lit(v)) if e is None else e.when(c == k, F.lit(v))
    return e


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    first = (_t(spark, sf_dir, "orders").groupBy("o_custkey")
             .agg(F.min("o_orderdate").alias("first_order")))
    g = F.col("c_custkey") % 3
    return (cust.join(first, cust.c_custkey == first.o_custkey, "left")
            .select(customer_key("c_custkey").alias("customer_id"),
                    F.col("c_nationkey").cast("int").alias("city"),
                    F.floor(F.col("c_acctbal") / AGE_DIVISOR).cast("int").alias("bd"),
                    F.when(g == 1, "male").when(g == 2, "female").alias("gender"),
                    F.col("c_mktsegment").alias("registered_via"),
                    date_to_ymd("first_order").alias("registration_init_time")))


def transactions(spark: SparkSession, sf_dir: str, until_cutoff: bool = False) -> DataFrame:
    """``until_cutoff`` leaves out later orders at the scan: the filter is on the stored column, so it is pushed down."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                           "o_orderdate", "o_orderpriority")
    if until_cutoff:
        o = o.filter(F.col("o_orderdate") < F.lit(CUTOFF + dt.timedelta(days=1)))
    # Per-order discount in whole percent points; integer math keeps it exact.
    li = (_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount")
          .groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).alias("n_lines"),
               F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("disc_pts")))
    j = o.join(li, o.o_orderkey == li.l_orderkey, "left")
    plan = _plan_days(F.col("o_orderpriority"))
    list_cents = F.round(F.col("o_totalprice") * 100).cast("long")
    # paid = list * (1 - mean discount), floored to whole cents.
    paid_cents = F.when(F.col("n_lines").isNull(), list_cents).otherwise(
        F.expr("(CAST(round(o_totalprice * 100) AS BIGINT) * (n_lines * 100 - disc_pts)) div (n_lines * 100)"))
    return j.select(
        customer_key("o_custkey").alias("customer_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("payment_method_id"),
        plan.alias("payment_plan_days"),
        (list_cents / 100).cast("decimal(12,2)").alias("plan_list_price"),
        (paid_cents / 100).cast("decimal(12,2)").alias("actual_amount_paid"),
        (F.col("o_orderstatus") == "O").cast("int").alias("is_auto_renew"),
        date_to_ymd("o_orderdate").alias("transaction_date"),
        F.when(F.col("o_orderkey") % SENTINEL_MOD == 0, F.lit(SENTINEL_YMD))
         .otherwise(date_to_ymd(F.date_add(F.to_date("o_orderdate"), plan))).alias("membership_expire_date"),
        (F.col("o_orderstatus") == "P").cast("int").alias("is_cancel"),
    )


def user_logs(spark: SparkSession, sf_dir: str, until_cutoff: bool = False) -> DataFrame:
    """``until_cutoff`` leaves out events after the day that is mapped onto the cutoff, at the scan."""
    ev = _t(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value", "props")
    if until_cutoff:
        ev = ev.filter(F.col("ts") < F.lit(dt.datetime.combine(EVENT_ANCHOR + dt.timedelta(days=1), dt.time())))
    day = F.date_add(F.lit(CUTOFF), F.datediff(F.to_date("ts"), F.lit(EVENT_ANCHOR)) * EVENT_STRETCH)
    aggs = [F.count_if(F.col("event_type") == et).cast("long").alias(name) for name, et in PLAY_BUCKETS.items()]
    return (ev.withColumn("log_day", day)
            .groupBy(customer_key("user_id").alias("customer_id"), "log_day")
            .agg(*aggs,
                 F.count_distinct("props").cast("long").alias("num_unq"),
                 F.bround(F.sum("value"), 2).alias("total_secs"))
            .select("customer_id", date_to_ymd("log_day").alias("date"),
                    *PLAY_BUCKETS.keys(), "num_unq", "total_secs"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = _t(spark, sf_dir, "customer").select("c_custkey")
    later = (_t(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
             .filter((F.to_date("o_orderdate") > F.lit(CUTOFF)) & (F.to_date("o_orderdate") <= F.lit(LABEL_END)))
             .select("o_custkey").distinct())
    return (cust.join(later, cust.c_custkey == later.o_custkey, "left")
            .select(customer_key("c_custkey").alias("customer_id"),
                    F.when(F.col("o_custkey").isNull(), 1).otherwise(0).cast("int").alias("is_churn")))


def fixed_probability(key_col: str = "customer_id", factor: int = 7919):
    """Deterministic stand-in model score from the key's number: ((number * factor) % 10007) / 10007."""
    return ((F.substring(key_col, 2, 20).cast("long") * factor) % 10007) / F.lit(10007.0)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact ledger derived from events: click -> reminder, purchase -> discount_offer."""
    ev = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return (ev.filter(F.col("event_type").isin("click", "purchase"))
            .select(F.col("event_id").alias("id"),
                    customer_key("user_id").alias("customer_id"),
                    F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyyMMdd").cast("long") * 10
                           + F.when(F.col("event_type") == "click", 1).otherwise(2)).alias("campaign_id"),
                    F.when(F.col("event_type") == "click", "reminder").otherwise("discount_offer").alias("action_type"),
                    (F.col("event_id") % 2 == 0).alias("is_read"),
                    F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 5 == 0),
                           F.concat(F.lit("coupon_"), (F.col("event_id") % 3).cast("string"))).alias("benefit_key"),
                    F.lit("system").alias("sent_by"),
                    F.col("ts").alias("sent_at")))
