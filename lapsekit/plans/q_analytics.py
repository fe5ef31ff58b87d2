"""Registered queries: analytics reports, scoring table, survival (C*, K3/K4, V*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapsekit.operators import analytics as A
from lapsekit.operators import features as X
from lapsekit.operators import survival as V
from lapsekit.operators.cleaning import latest_by_row_number
from lapsekit.operators.ordering import avg_percentile, risk_grade
from lapsekit.plans import model_table as MT
from lapsekit.plans.catalog import query
from lapsekit.plans.oracle_views import VIEWS, sql
from lapsekit.plans.q_features import LIFECYCLE_SQL
from lapsekit.plans.q_models import preds
from lapsekit.sources import testdata as TD
from lapsekit.session import cut_lineage
from lapsekit.spec import TESTDATA_SPEC as SPEC

THRESHOLD = 0.75
PROBA_SQL = "CAST((CAST(substr(customer_id, 2) AS BIGINT) * 7919) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE)"

# ---------------------------------------------------------------- cohorts
VIEWS["cohorts"] = (["transactions"], """
    SELECT cohort_month, month_offset, active_users, cohort_size,
           round_even(active_users / cohort_size * 100, 6) AS retention_pct
    FROM (SELECT c.cohort_month, CAST(date_diff('month', c.cohort_month, t.m) AS INTEGER) AS month_offset,
                 count(*) AS active_users
          FROM (SELECT DISTINCT customer_id, CAST(date_trunc('month', CAST(try_strptime(CAST(transaction_date AS VARCHAR), '%Y%m%d') AS DATE)) AS DATE) AS m
                FROM transactions WHERE transaction_date <= 20010131) t
          JOIN (SELECT customer_id, min(CAST(date_trunc('month', CAST(try_strptime(CAST(transaction_date AS VARCHAR), '%Y%m%d') AS DATE)) AS DATE)) AS cohort_month
                FROM transactions WHERE transaction_date <= 20010131 GROUP BY 1) c USING (customer_id)
          WHERE date_diff('month', c.cohort_month, t.m) BETWEEN 0 AND 11
          GROUP BY 1, 2) g
    JOIN (SELECT cohort_month AS cm, active_users AS cohort_size FROM (
            SELECT c.cohort_month, count(*) AS active_users FROM (
              SELECT customer_id, min(CAST(date_trunc('month', CAST(try_strptime(CAST(transaction_date AS VARCHAR), '%Y%m%d') AS DATE)) AS DATE)) AS cohort_month
              FROM transactions WHERE transaction_date <= 20010131 GROUP BY 1) c GROUP BY 1) s0) s
      ON g.cohort_month = s.cm""")


def _cohorts(spark, sf):
    return A.cohort_activity(TD.transactions(spark, sf), SPEC)


@query("cohort_retention", sql(["cohorts"], "SELECT * FROM cohorts"))
def q_cohorts(spark, sf):
    """Cohort x month-offset active users and retention %."""
    return _cohorts(spark, sf)


@query("complete_cohorts", sql(["cohorts"], """
    SELECT * FROM cohorts WHERE cohort_month <= DATE '2000-02-01'"""))
def q_complete(spark, sf):
    """Only cohorts observable for all 12 offsets (cutoff month - 11)."""
    return A.complete_cohorts(_cohorts(spark, sf), SPEC)


@query("retention_curve", sql(["cohorts"], """
    SELECT month_offset, round_even(avg(retention_pct), 6) AS avg_retention_pct, count(*) AS cohorts
    FROM cohorts WHERE cohort_month <= DATE '2000-02-01'
      AND cohort_month > (SELECT min(cohort_month) FROM cohorts WHERE cohort_month <= DATE '2000-02-01')
    GROUP BY 1"""))
def q_curve(spark, sf):
    """Unweighted average retention curve, left-censored first cohort excluded."""
    return A.retention_curve(A.complete_cohorts(_cohorts(spark, sf), SPEC))


@query("cohort_matrix", sql(["cohorts"], "SELECT cohort_month, " + ", ".join(
    f"max(CASE WHEN month_offset = {i} THEN retention_pct END) AS \"{i}\"" for i in range(12))
    + " FROM cohorts GROUP BY cohort_month"))
def q_matrix(spark, sf):
    """Wide cohort x offset matrix (fixed pivot values)."""
    return A.cohort_matrix(_cohorts(spark, sf))


# ---------------------------------------------------------------- funnels
def _funnel_sql(stages, first_den=True):
    cum = []
    sel = []
    for i, (_, p) in enumerate(stages):
        cum.append(f"({p})")
        sel.append(f"count_if({' AND '.join(cum)}) AS s{i}")
    rows = []
    for i, (name, _) in enumerate(stages):
        den = "s0" if i == 0 else f"s{i - 1}"
        if i == 0 and not first_den:
            den = "CAST(NULL AS BIGINT)"
        rows.append(f"SELECT {i + 1} AS stage_no, '{name}' AS stage, s{i} AS count, {den} AS denominator, s0 AS base FROM w")
    return ("WITH w AS (SELECT " + ", ".join(sel) + " FROM {src}) "
            "SELECT stage_no, stage, count, denominator, round_even(count * 100 / denominator, 6) AS stage_conversion_pct, "
            "round_even(count * 100 / base, 6) AS overall_pct FROM (" + " UNION ALL ".join(rows) + ") r")


_F4 = [("cohort", "TRUE"), ("has_transaction", "txn_count IS NOT NULL"), ("log_activity", "full_active_days IS NOT NULL"),
       ("repeat_usage", "COALESCE(full_active_days >= 7, FALSE)"), ("auto_renew", "COALESCE(auto_renew_rate > 0, FALSE)"),
       ("renewed", "is_churn = 0")]


@query("funnel_cohort", sql(["asm"], _funnel_sql(_F4).replace("{src}", "asm")))
def q_funnel(spark, sf):
    """C4: six nested stages within the label cohort, one scan."""
    a = MT.assembled(spark, sf, SPEC)
    c = F.col
    return A.funnel(a, [("cohort", F.lit(True)), ("has_transaction", c("txn_count").isNotNull()),
                        ("log_activity", c("full_active_days").isNotNull()),
                        ("repeat_usage", c("full_active_days") >= 7), ("auto_renew", c("auto_renew_rate") > 0),
                        ("renewed", c("is_churn") == 0)])


VIEWS["funnel_base"] = (["members", "txn_feat", "log_feat", "churn_labels"], """
    SELECT m.customer_id, t.customer_id IS NOT NULL AS has_txn, t.auto_renew_rate, g.customer_id IS NOT NULL AS has_log,
           g.full_active_days, l.is_churn
    FROM members m LEFT JOIN txn_feat t ON m.customer_id = t.customer_id
    LEFT JOIN log_feat g ON m.customer_id = g.customer_id LEFT JOIN churn_labels l ON m.customer_id = l.customer_id""")
@query("funnel_members", sql(["funnel_base"], """
    WITH k AS (SELECT count(*) AS a, count_if(has_txn) AS b, count_if(has_txn AND has_log) AS c,
                      count_if(has_txn AND has_log AND full_active_days >= 7) AS d,
                      count_if(has_txn AND has_log AND full_active_days >= 7 AND auto_renew_rate > 0) AS e,
                      count_if(has_txn AND has_log AND full_active_days >= 7 AND auto_renew_rate > 0 AND is_churn IS NOT NULL) AS l,
                      count_if(has_txn AND has_log AND full_active_days >= 7 AND auto_renew_rate > 0 AND is_churn = 0) AS f
               FROM funnel_base),
    r AS (SELECT 1 AS stage_no, 'signup' AS stage, a AS count, CAST(NULL AS BIGINT) AS denominator, a FROM k
          UNION ALL SELECT 2, 'first_payment', b, a, a FROM k UNION ALL SELECT 3, 'usage', c, b, a FROM k
          UNION ALL SELECT 4, 'repeat_usage', d, c, a FROM k UNION ALL SELECT 5, 'auto_renew', e, d, a FROM k
          UNION ALL SELECT 6, 'renewed', f, l, a FROM k)
    SELECT stage_no, stage, count, denominator, round_even(count * 100 / NULLIF(denominator, 0), 6) AS stage_conversion_pct,
           round_even(count * 100 / a, 6) AS overall_pct FROM r"""))
def q_funnel_all(spark, sf):
    """Six stages over all members via presence-flag left joins; NULL first
    denominator; the renewal stage counts within labelled customers."""
    t = MT.domain_tables(spark, sf)
    m = t["members"].select("customer_id")
    tf = X.transaction_features(t["transactions"], SPEC).select("customer_id", "auto_renew_rate", F.lit(True).alias("has_txn"))
    lf = X.log_features(t["user_logs"], SPEC).select("customer_id", "full_active_days", F.lit(True).alias("has_log"))
    base = m.join(tf, "customer_id", "left").join(lf, "customer_id", "left").join(t["labels"], "customer_id", "left")
    c = F.col
    return A.funnel(base, [("signup", F.lit(True)), ("first_payment", c("has_txn").isNotNull()),
                           ("usage", c("has_log").isNotNull()), ("repeat_usage", c("full_active_days") >= 7),
                           ("auto_renew", c("auto_renew_rate") > 0), ("renewed", c("is_churn") == 0)],
                    first_denominator=False, last_within=c("is_churn").isNotNull())


# ---------------------------------------------------------------- scoring table
VIEWS["scored_base"] = (["churn_labels", "txn_feat"], f"""
    SELECT s.customer_id, s.churn_proba, t.txn_count, t.total_amount_paid, t.last_payment_plan_days,
           t.last_plan_list_price, t.last_is_auto_renew, t.days_to_expire, t.days_since_last_txn
    FROM (SELECT customer_id, {PROBA_SQL} AS churn_proba FROM churn_labels) s
    JOIN txn_feat t ON s.customer_id = t.customer_id""")
VIEWS["valued"] = (["scored_base"], """
    SELECT *, round_even(rev_txn, 6) AS avg_revenue_per_txn, round_even(monthly, 6) AS avg_monthly_revenue,
           round_even(life, 6) AS expected_lifetime_months, round_even(monthly * life, 6) AS ltv_approx
    FROM (SELECT *, total_amount_paid / GREATEST(txn_count, 1) AS rev_txn,
                 total_amount_paid / GREATEST(txn_count, 1) / (CAST(GREATEST(last_payment_plan_days, 7) AS DOUBLE) / CAST(30 AS DOUBLE)) AS monthly,
                 least(CAST(1 AS DOUBLE) / greatest(churn_proba, 0.01), CAST(60 AS DOUBLE)) AS life
          FROM scored_base) x""")
VIEWS["scoring"] = (["valued"], f"""
    SELECT customer_id, churn_proba,
           CASE WHEN churn_proba >= {THRESHOLD} THEN 'high_risk' ELSE 'low_risk' END AS risk_tier,
           CASE WHEN avg_monthly_revenue >= (SELECT quantile_cont(avg_monthly_revenue, 0.5) FROM valued) THEN 'high_value' ELSE 'low_value' END AS ltv_tier,
           (CASE WHEN churn_proba >= {THRESHOLD} THEN 'high_risk' ELSE 'low_risk' END) || '/' ||
           (CASE WHEN avg_monthly_revenue >= (SELECT quantile_cont(avg_monthly_revenue, 0.5) FROM valued) THEN 'high_value' ELSE 'low_value' END) AS segment,
           avg_monthly_revenue, expected_lifetime_months, ltv_approx, days_to_expire, days_since_last_txn,
           {LIFECYCLE_SQL} AS lifecycle_status, last_payment_plan_days, last_plan_list_price,
           last_is_auto_renew, DATE '2001-01-31' AS scored_at
    FROM valued""")

SCORE_COLS = ["customer_id", "churn_proba", "risk_tier", "ltv_tier", "segment", "avg_monthly_revenue",
              "expected_lifetime_months", "ltv_approx", "days_to_expire", "days_since_last_txn", "lifecycle_status",
              "last_payment_plan_days", "last_plan_list_price", "last_is_auto_renew", "scored_at"]


def scoring_table(spark, sf):
    """K3 end to end: latest snapshot per key (W2), inner join transaction
    features (J3), value (C6), segments (C7), lifecycle (C8), scored_at = cutoff."""
    s = TD.labels(spark, sf).select("customer_id", TD.fixed_probability().alias("churn_proba"),
                                    F.lit(SPEC.cutoff).alias("snapshot"))
    s = latest_by_row_number(s, "customer_id", [F.col("snapshot").desc()])
    t = X.transaction_features(TD.transactions(spark, sf), SPEC)
    j = s.join(t, "customer_id", "inner")
    v = A.value_features(j, "churn_proba")
    g = A.segments(v, THRESHOLD, "churn_proba")
    return A.lifecycle(g).withColumn("scored_at", F.lit(SPEC.cutoff)).select(*SCORE_COLS)


@query("scoring_table", sql(["scoring"], "SELECT * FROM scoring"))
def q_scoring(spark, sf):
    """K3 + C6-C8: the 15-column serving table on the fixed probability."""
    return scoring_table(spark, sf)


@query("published_scores", sql(["scoring"], """
    SELECT customer_id, CAST(CAST(churn_proba AS DECIMAL(24,8)) AS DECIMAL(6,5)) AS churn_proba, risk_tier, ltv_tier, segment,
           CAST(CAST(avg_monthly_revenue AS DECIMAL(24,8)) AS DECIMAL(10,2)) AS avg_monthly_revenue, CAST(CAST(expected_lifetime_months AS DECIMAL(24,8)) AS DECIMAL(6,2)) AS expected_lifetime_months,
           CAST(CAST(ltv_approx AS DECIMAL(24,8)) AS DECIMAL(12,2)) AS ltv_approx, days_to_expire, days_since_last_txn, lifecycle_status,
           CAST(last_payment_plan_days AS INTEGER) AS last_payment_plan_days,
           CAST(CAST(last_plan_list_price AS DECIMAL(24,8)) AS DECIMAL(10,2)) AS last_plan_list_price, last_is_auto_renew = 1 AS last_is_auto_renew, scored_at
    FROM scoring"""))
def q_published(spark, sf):
    """The scoring table cast to the serving types, published as a version, and read back through the pointer."""
    import uuid
    from lapsekit.session import checkpoint_dir
    from lapsekit.sources.tables import publish, read_published
    from lapsekit.spec import SCORES_SCHEMA
    root = f"{checkpoint_dir(spark).rstrip('/')}/serving-{uuid.uuid4().hex[:8]}"
    publish({"customer_churn_scores": scoring_table(spark, sf)}, root, {"customer_churn_scores": SCORES_SCHEMA})
    return read_published(spark, root, "customer_churn_scores")


@query("stage_read_back", sql(["transactions"], "SELECT * FROM transactions"))
def q_stage(spark, sf):
    """The transactions written as a stage table and read with their fixed schema."""
    import uuid
    from lapsekit.session import checkpoint_dir
    from lapsekit.sources.tables import read_table, write_stage
    path = f"{checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex[:8]}"
    return read_table(spark, "transactions", write_stage(TD.transactions(spark, sf), path))


@query("segment_counts", sql(["scoring"], """
    SELECT segment, count(*) AS customers, round_even(avg(ltv_approx), 6) AS avg_ltv FROM scoring GROUP BY 1"""))
def q_segments(spark, sf):
    """2x2 risk/value segment sizes."""
    return scoring_table(spark, sf).groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"), F.bround(F.avg("ltv_approx"), 6).alias("avg_ltv"))


@query("value_default_plan", sql(["churn_labels", "txn_feat"], f"""
    SELECT customer_id, round_even(monthly, 6) AS avg_monthly_revenue FROM (
      SELECT l.customer_id, COALESCE(t.total_amount_paid, 0) / GREATEST(COALESCE(t.txn_count, 0), 1)
             / (CAST(GREATEST(COALESCE(t.last_payment_plan_days, 30), 7) AS DOUBLE) / CAST(30 AS DOUBLE)) AS monthly
      FROM churn_labels l LEFT JOIN txn_feat t ON l.customer_id = t.customer_id) x"""))
def q_value_default(spark, sf):
    """Left join with default plan days 30 (customers without transactions keep a row)."""
    l = TD.labels(spark, sf).select("customer_id", TD.fixed_probability().alias("churn_proba"))
    t = X.transaction_features(TD.transactions(spark, sf), SPEC)
    j = X.zero_fill(l.join(t, "customer_id", "left"), ["txn_count", "total_amount_paid"])
    return A.value_features(j, "churn_proba", default_plan=30).select("customer_id", "avg_monthly_revenue")


def _valued(spark, sf):
    s = TD.labels(spark, sf).select("customer_id", TD.fixed_probability().alias("churn_proba"))
    t = X.transaction_features(TD.transactions(spark, sf), SPEC)
    return cut_lineage(A.value_features(s.join(t, "customer_id", "inner"), "churn_proba").select("customer_id", "ltv_approx"))


@query("ltv_concentration", sql(["valued"], """
    SELECT round_even(quantile_cont(ltv_approx, 0.5), 6) AS ltv_median, round_even(quantile_cont(ltv_approx, 0.9), 6) AS ltv_p90,
           round_even(quantile_cont(ltv_approx, 0.99), 6) AS ltv_p99,
           round_even(sum(CASE WHEN rk <= greatest(floor(n * CAST(0.1 AS DOUBLE)), 1) THEN ltv_approx ELSE 0 END) / sum(ltv_approx) * 100, 6) AS top_share_pct,
           count(*) AS customers
    FROM (SELECT ltv_approx, row_number() OVER (ORDER BY ltv_approx DESC, customer_id) AS rk, count(*) OVER () AS n
          FROM valued WHERE ltv_approx >= 0) x"""))
def q_ltv(spark, sf):
    """LTV median/p90/p99 and top-10 % share."""
    return A.ltv_concentration(_valued(spark, sf))


@query("ltv_curve", sql(["valued"], """
    SELECT CAST(ceil(rk * 100 / n) AS INTEGER) AS point, max(rk) AS customers, round_even(max(rk) * 100 / max(n), 6) AS customer_pct,
           round_even(max(c) * 100 / max(t), 6) AS ltv_share_pct
    FROM (SELECT row_number() OVER w AS rk, count(*) OVER () AS n, sum(ltv_approx) OVER (ORDER BY ltv_approx DESC, customer_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c, sum(ltv_approx) OVER () AS t
          FROM valued WHERE ltv_approx >= 0 WINDOW w AS (ORDER BY ltv_approx DESC, customer_id)) x GROUP BY 1"""))
def q_ltv_curve(spark, sf):
    """Cumulative concentration of LTV over 100 customer shares."""
    return A.ltv_curve(_valued(spark, sf))


@query("ltv_clipped", sql(["valued"], """
    SELECT customer_id, ltv_approx, least(ltv_approx, (SELECT quantile_cont(ltv_approx, 0.99) FROM valued WHERE ltv_approx >= 0)) AS ltv_approx_clipped
    FROM valued WHERE ltv_approx >= 0"""))
def q_ltv_clipped(spark, sf):
    """LTV clipped at its 99th percentile."""
    return A.ltv_clipped(_valued(spark, sf)).select("customer_id", "ltv_approx", "ltv_approx_clipped")


@query("lifecycle_by_segment", sql(["scoring"], """
    SELECT lifecycle_status, risk_tier, count(*) AS customers FROM scoring GROUP BY 1, 2"""))
def q_lifecycle_seg(spark, sf):
    """C8 x C7 cross tab."""
    return scoring_table(spark, sf).groupBy("lifecycle_status", "risk_tier").agg(F.count(F.lit(1)).alias("customers"))


# ---------------------------------------------------------------- predictions export (K4)
@query("prediction_export", sql(["preds"], """
    SELECT customer_id, split, is_churn, churn_probability,
           CAST(CAST(churn_probability >= 0.75 AS INTEGER) = is_churn AS INTEGER) AS is_correct, percentile,
           CASE WHEN percentile >= 95 THEN 'critical' WHEN percentile >= 85 THEN 'high'
                WHEN percentile >= 70 THEN 'medium' ELSE 'low' END AS risk_grade
    FROM (SELECT *, round_even(((rank() OVER w) + (count(*) OVER (PARTITION BY churn_probability) - 1) / 2.0)
                          / (count(*) OVER ()) * 100, 2) AS percentile
          FROM preds WINDOW w AS (ORDER BY churn_probability)) x"""))
def q_export(spark, sf):
    """K4 + W5/W6: correctness flag, average percentile rank, risk grade."""
    p = preds(spark, sf).select("customer_id", "split", "is_churn", "churn_probability")
    p = avg_percentile(p, "churn_probability")
    return p.withColumns({
        "is_correct": ((F.col("churn_probability") >= THRESHOLD).cast("int") == F.col("is_churn")).cast("int"),
        "risk_grade": risk_grade(F.col("percentile"))})


# ---------------------------------------------------------------- marketing
@query("risk_deciles", sql(["preds"], """
    SELECT risk_decile, customers, churners, round_even(rate, 6) AS churn_rate, round_even(risk, 6) AS avg_predicted_risk,
           round_even(rate / base, 6) AS lift, round_even(churners / pos * 100, 6) AS churn_capture_pct,
           round_even(sum(churners / pos * 100) OVER (ORDER BY risk_decile ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cumulative_capture_pct
    FROM (SELECT bin AS risk_decile, count(*) AS customers, CAST(sum(is_churn) AS BIGINT) AS churners,
                 avg(is_churn) AS rate, avg(churn_probability) AS risk,
                 (SELECT avg(is_churn) FROM preds) AS base, (SELECT sum(is_churn) FROM preds) AS pos
          FROM (SELECT *, CAST(CASE WHEN n <= 1 THEN 1 ELSE greatest(1, ceil((rk - 1) * 10 / (n - 1))) END AS INTEGER) AS bin
                FROM (SELECT *, row_number() OVER (ORDER BY churn_probability DESC, customer_id) AS rk,
                             count(*) OVER () AS n FROM preds) r) b
          GROUP BY 1) g"""))
def q_deciles(spark, sf):
    """Risk deciles with lift and cumulative capture."""
    p = preds(spark, sf)
    return A.risk_deciles(p, "churn_probability", "is_churn")


VIEWS["marketing"] = (["model_v2", "valued"], f"""
    SELECT m.customer_id, m.is_churn, {PROBA_SQL.replace('customer_id', 'm.customer_id')} AS p,
           m.last_is_auto_renew, m.expiry_alignment_abs_gap, m.has_log_activity, m.days_since_last_log,
           m.activity_change_7_30, COALESCE(v.avg_monthly_revenue, 0) AS avg_monthly_revenue
    FROM model_v2 m LEFT JOIN valued v ON m.customer_id = v.customer_id""")
_RULES_SQL = [
    ("top5pct", "rk <= greatest(floor(n * CAST(0.05 AS DOUBLE)), 1)"),
    ("top10pct", "rk <= greatest(floor(n * CAST(0.1 AS DOUBLE)), 1)"),
    ("above_threshold", f"p >= {THRESHOLD}"),
    ("high_risk_auto_renew_off", f"p >= {THRESHOLD} AND last_is_auto_renew = 0"),
    ("high_risk_expiry_gap_gt7", f"p >= {THRESHOLD} AND expiry_alignment_abs_gap > 7"),
    ("high_risk_log_gap_gt30", f"p >= {THRESHOLD} AND has_log_activity = 1 AND days_since_last_log > 30"),
    ("high_risk_activity_drop", f"p >= {THRESHOLD} AND activity_change_7_30 <= -0.2"),
    ("high_risk_high_value", f"p >= {THRESHOLD} AND avg_monthly_revenue >= (SELECT quantile_cont(avg_monthly_revenue, 0.5) FROM marketing)"),
]
VIEWS["targets"] = (["marketing"], """
    SELECT r.rule_no, r.strategy, COALESCE(g.c, 0) AS customers, round_even(COALESCE(g.c, 0) / t.n * 100, 6) AS customer_pct,
           CAST(COALESCE(g.p, 0) AS BIGINT) AS churners, round_even(g.p / g.c, 6) AS churn_rate,
           round_even((g.p / g.c) / (t.pp / t.n), 6) AS lift, round_even(COALESCE(g.p, 0) / t.pp, 6) AS recall,
           round_even(g.r, 6) AS avg_monthly_revenue
    FROM (VALUES """ + ", ".join(f"({i + 1}, '{n}')" for i, (n, _) in enumerate(_RULES_SQL)) + """) r(rule_no, strategy)
    LEFT JOIN (""" + " UNION ALL ".join(
    f"SELECT '{n}' AS strategy, count(*) AS c, sum(is_churn) AS p, avg(avg_monthly_revenue) AS r FROM ranked WHERE {cond}"
    for n, cond in _RULES_SQL).replace("FROM ranked", "FROM (SELECT *, row_number() OVER (ORDER BY p DESC, customer_id) AS rk, count(*) OVER () AS n FROM marketing) ranked") + """) g
      ON r.strategy = g.strategy AND g.c > 0
    CROSS JOIN (SELECT count(*) AS n, sum(is_churn) AS pp FROM marketing) t""")


def _marketing(spark, sf):
    m = cut_lineage(MT.build_model_table(spark, sf, SPEC))
    v = A.value_features(m.withColumn("churn_proba", TD.fixed_probability()), "churn_proba")
    paid = F.when(F.col("has_transaction_record") == 1, F.col("avg_monthly_revenue")).otherwise(F.lit(0.0))
    return v.select("customer_id", "is_churn", "last_is_auto_renew", "expiry_alignment_abs_gap", "has_log_activity",
                    "days_since_last_log", "activity_change_7_30", paid.alias("avg_monthly_revenue"), F.col("churn_proba").alias("p"))


def _rules(base):
    from lapsekit.operators.ordering import exact_quantiles, rank_rows

    r = rank_rows(base, "p", "customer_id", descending=True)
    med = exact_quantiles(base, ["avg_monthly_revenue"], [0.5]).select(F.col("value").alias("__med"))
    r = r.crossJoin(F.broadcast(med))  # one row
    c = F.col
    hi = c("p") >= THRESHOLD
    rules = [
        ("top5pct", c("rank") <= F.greatest(F.floor(c("n") * 0.05), F.lit(1))),
        ("top10pct", c("rank") <= F.greatest(F.floor(c("n") * 0.1), F.lit(1))),
        ("above_threshold", hi),
        ("high_risk_auto_renew_off", hi & (c("last_is_auto_renew") == 0)),
        ("high_risk_expiry_gap_gt7", hi & (c("expiry_alignment_abs_gap") > 7)),
        ("high_risk_log_gap_gt30", hi & (c("has_log_activity") == 1) & (c("days_since_last_log") > 30)),
        ("high_risk_activity_drop", hi & (c("activity_change_7_30") <= -0.2)),
        ("high_risk_high_value", hi & (c("avg_monthly_revenue") >= c("__med"))),
    ]
    return r, rules


@query("target_candidates", sql(["targets"], "SELECT * FROM targets"))
def q_targets(spark, sf):
    """C11: eight overlapping audience rules in one scan."""
    r, rules = _rules(_marketing(spark, sf))
    return A.target_candidates(r, rules, "is_churn")


@query("roi_scenarios", sql(["targets"], """
    SELECT strategy, e AS assumed_prevented_churn_rate, customers AS selected_customers, churners AS historical_churners,
           round_even(churners * e, 6) AS assumed_saved_customers, round_even(customers * 2.0 + customers * 0.2 * 30.0, 6) AS campaign_cost,
           round_even(churners * e * (avg_monthly_revenue * 3 * 0.7), 6) AS assumed_gross_value,
           round_even(churners * e * (avg_monthly_revenue * 3 * 0.7) - (customers * 2.0 + customers * 0.2 * 30.0), 6) AS assumed_net_value,
           round_even(CASE WHEN churners > 0 AND avg_monthly_revenue * 3 * 0.7 > 0
                      THEN (customers * 2.0 + customers * 0.2 * 30.0) / (churners * (avg_monthly_revenue * 3 * 0.7)) END, 6) AS break_even_prevented_rate
    FROM targets CROSS JOIN (VALUES (CAST(0.05 AS DOUBLE)), (CAST(0.1 AS DOUBLE)), (CAST(0.15 AS DOUBLE))) e(e)"""))
def q_roi(spark, sf):
    """Cost / break-even / gross / net per strategy and assumed effect."""
    r, rules = _rules(_marketing(spark, sf))
    return A.roi_scenarios(A.target_candidates(r, rules, "is_churn"))


@query("recency_retention", sql(["txn_feat", "churn_labels"], """
    SELECT c.cutoff, round_even(COALESCE(sum(CASE WHEN d.days_since_last_txn >= c.cutoff THEN 1 ELSE 0 END), 0) / (SELECT count(*) FROM txn_feat t JOIN churn_labels l USING (customer_id)) * 100, 6) AS user_share_pct,
           round_even((1 - sum(CASE WHEN d.days_since_last_txn >= c.cutoff THEN d.is_churn END) / sum(CASE WHEN d.days_since_last_txn >= c.cutoff THEN 1 END)) * 100, 6) AS retention_pct
    FROM (SELECT unnest(range(10, 150, 10)) AS cutoff) c
    CROSS JOIN (SELECT t.days_since_last_txn, l.is_churn FROM txn_feat t JOIN churn_labels l USING (customer_id)) d
    GROUP BY c.cutoff"""))
def q_recency_ret(spark, sf):
    """Retention by recency cutoff 10..140 days."""
    t = X.transaction_features(TD.transactions(spark, sf), SPEC).select("customer_id", "days_since_last_txn")
    d = t.join(TD.labels(spark, sf), "customer_id")
    return A.recency_retention(d, "days_since_last_txn", "is_churn").withColumn("cutoff", F.col("cutoff").cast("bigint"))


# ---------------------------------------------------------------- experiment design (C14-C17)
_DESIGN_SQL = [
    ("auto_renew_off", "last_is_auto_renew = 0"),
    ("expiry_gap_gt7", "expiry_alignment_abs_gap > 7"),
    ("log_gap_gt30", "has_log_activity = 1 AND days_since_last_log > 30"),
    ("high_value_high_risk", f"p >= {THRESHOLD} AND avg_monthly_revenue >= (SELECT quantile_cont(avg_monthly_revenue, 0.5) FROM marketing)"),
    ("low_value_high_risk", f"p >= {THRESHOLD} AND avg_monthly_revenue < (SELECT quantile_cont(avg_monthly_revenue, 0.5) FROM marketing)"),
]
_MDES = [0.03, 0.05, 0.10]
VIEWS["design"] = (["marketing"], " UNION ALL ".join(
    f"SELECT '{n}' AS segment, count(*) AS customers, avg(is_churn) AS baseline_rate FROM marketing WHERE {c}"
    for n, c in _DESIGN_SQL))


def _design(spark, sf):
    base = _marketing(spark, sf)
    from lapsekit.operators.ordering import exact_quantiles
    med = exact_quantiles(base, ["avg_monthly_revenue"], [0.5]).select(F.col("value").alias("__med"))
    b = base.crossJoin(F.broadcast(med))
    c = F.col
    hi = c("p") >= THRESHOLD
    rules = [("auto_renew_off", c("last_is_auto_renew") == 0), ("expiry_gap_gt7", c("expiry_alignment_abs_gap") > 7),
             ("log_gap_gt30", (c("has_log_activity") == 1) & (c("days_since_last_log") > 30)),
             ("high_value_high_risk", hi & (c("avg_monthly_revenue") >= c("__med"))),
             ("low_value_high_risk", hi & (c("avg_monthly_revenue") < c("__med")))]
    hits = F.filter(F.array(*[F.when(p, F.lit(n)) for n, p in rules]), lambda x: x.isNotNull())
    return b.select(F.explode(hits).alias("segment"), "is_churn").groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"), F.avg("is_churn").alias("baseline_rate"))


@query("design_candidates", sql(["design"], "SELECT segment, customers, round_even(baseline_rate, 6) AS baseline_rate FROM design WHERE customers > 0"))
def q_design(spark, sf):
    """C17: candidate experiment segments and their baseline churn."""
    return _design(spark, sf).withColumn("baseline_rate", F.bround("baseline_rate", 6))


_Z = A.z_value(1 - 0.05 / len(_DESIGN_SQL) / 2) + A.z_value(0.8)


@query("power_table", sql(["design"], f"""
    SELECT segment, round_even(baseline_rate, 6) AS baseline_rate, mde, {0.05 / len(_DESIGN_SQL)!r} AS alpha,
           CAST(ceil({_Z * _Z!r} * (baseline_rate * (1 - baseline_rate) + (baseline_rate + mde) * (1 - (baseline_rate + mde)))
                / (((baseline_rate + mde) - baseline_rate) * ((baseline_rate + mde) - baseline_rate))) AS BIGINT) AS n_per_arm
    FROM design CROSS JOIN (VALUES {", ".join(f"(CAST({m} AS DOUBLE))" for m in _MDES)}) g(mde) WHERE customers > 0"""))
def q_power(spark, sf):
    """C14: required n per arm (two proportions, unpooled, Bonferroni over segments)."""
    d = _design(spark, sf)
    g = d.select("segment").crossJoin(spark.createDataFrame([(float(m),) for m in _MDES], "mde double"))
    return A.power_table(d.select("segment", "baseline_rate"), g, alpha=0.05, comparisons=len(_DESIGN_SQL))


VIEWS["arms"] = (["scoring"], """
    SELECT customer_id, risk_tier, ltv_tier,
           CASE (r - 1) % 2 WHEN 0 THEN 'control' ELSE 'treatment' END AS arm
    FROM (SELECT *, row_number() OVER (PARTITION BY risk_tier, ltv_tier
                                       ORDER BY md5(CAST(customer_id AS VARCHAR) || ':7'), customer_id) AS r
          FROM scoring) x""")


def _arms(spark, sf):
    s = scoring_table(spark, sf).select("customer_id", "risk_tier", "ltv_tier")
    return A.assign_arms(s, "customer_id", ["risk_tier", "ltv_tier"], ["control", "treatment"])


@query("experiment_assignment", sql(["arms"], "SELECT * FROM arms"))
def q_arms(spark, sf):
    """Stratified 1:1 assignment of one population (md5 order within stratum)."""
    return _arms(spark, sf)


_BLOCK = 4  # two places for each of two arms
_STRATUM = "coalesce(risk_tier, '') || '|' || coalesce(ltv_tier, '')"


def _dealt_sql(source: str, before: str | None) -> str:
    """Newcomers of ``source`` after the assignments ``before``: places by md5 order, arms by permuted blocks."""
    have = f"SELECT risk_tier, ltv_tier, max(position) AS last FROM {before} GROUP BY ALL" if before else \
        "SELECT NULL::VARCHAR AS risk_tier, NULL::VARCHAR AS ltv_tier, 0::BIGINT AS last WHERE FALSE"
    new = f"WHERE customer_id NOT IN (SELECT customer_id FROM {before})" if before else ""
    return f"""
    SELECT customer_id, risk_tier, ltv_tier, position,
           ['control', 'treatment'][list_sort(list_transform(range({_BLOCK}), lambda i: {{'h': md5('7:' || {_STRATUM} || ':' ||
               ((position - 1) // {_BLOCK})::VARCHAR || ':' || i::VARCHAR), 'i': i}}))[(position - 1) % {_BLOCK} + 1].i % 2 + 1] AS arm
    FROM (SELECT n.*, coalesce(h.last, 0) + row_number() OVER (PARTITION BY n.risk_tier, n.ltv_tier ORDER BY md5(customer_id || ':7'), customer_id) AS position
          FROM (SELECT * FROM {source} {new}) n LEFT JOIN ({have}) h
               ON n.risk_tier IS NOT DISTINCT FROM h.risk_tier AND n.ltv_tier IS NOT DISTINCT FROM h.ltv_tier) x"""


VIEWS["wave1"] = (["scoring"], "SELECT customer_id, risk_tier, ltv_tier FROM scoring WHERE lifecycle_status <> 'lapsed'")
VIEWS["wave2"] = (["scoring"], """SELECT customer_id, CASE WHEN lifecycle_status = 'grace' THEN 'high_risk' ELSE risk_tier END AS risk_tier,
                                         ltv_tier FROM scoring""")
VIEWS["dealt1"] = (["wave1"], _dealt_sql("wave1", None))
VIEWS["dealt2"] = (["wave2", "dealt1"], _dealt_sql("wave2", "dealt1"))


@query("sticky_assignment", sql(["dealt1", "dealt2"], "SELECT * FROM dealt1 UNION ALL SELECT * FROM dealt2"))
def q_sticky(spark, sf):
    """An experiment starts with all customers that haven't lapsed; later the lapsed ones come in and those in grace
    have another risk tier. Nobody's arm changes, and the newcomers go on in the open blocks."""
    import uuid

    from lapsekit.session import checkpoint_dir, cut_lineage
    from lapsekit.sources.store import TableStore

    s = cut_lineage(scoring_table(spark, sf).select("customer_id", "risk_tier", "ltv_tier", "lifecycle_status"))
    store = TableStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/experiment-{uuid.uuid4().hex}")
    strata, arms = ["risk_tier", "ltv_tier"], ["control", "treatment"]
    A.assign_committed(store, "renewal", s.filter("lifecycle_status <> 'lapsed'"), "customer_id", strata, arms)
    moved = s.withColumn("risk_tier", F.when(F.col("lifecycle_status") == "grace", "high_risk").otherwise(F.col("risk_tier")))
    return A.assign_committed(store, "renewal", moved, "customer_id", strata, arms)


@query("experiment_readout", sql(["arms", "churn_labels"], f"""
    WITH g AS (SELECT arm, count(*) AS n, CAST(sum(1 - l.is_churn) AS BIGINT) AS successes, sum(1 - l.is_churn) / count(*) AS rate
               FROM arms a JOIN churn_labels l USING (customer_id) GROUP BY arm),
    c AS (SELECT n AS n0, rate AS r0 FROM g WHERE arm = 'control')
    SELECT arm, n, successes, round_even(rate, 6) AS rate, round_even(rate - r0, 6) AS diff_vs_control,
           round_even(rate - r0 - {A.z_value(0.975)!r} * sqrt(rate * (1 - rate) / n + r0 * (1 - r0) / n0), 6) AS ci_low,
           round_even(rate - r0 + {A.z_value(0.975)!r} * sqrt(rate * (1 - rate) / n + r0 * (1 - r0) / n0), 6) AS ci_high,
           round_even((rate - r0) / NULLIF(r0, 0), 6) AS relative_lift, 0.05 AS alpha,
           abs(rate - r0) > {A.z_value(0.975)!r} * sqrt(rate * (1 - rate) / n + r0 * (1 - r0) / n0) AS significant
    FROM g CROSS JOIN c"""))
def q_readout(spark, sf):
    """ITT readout (retention = 1 - churn) per arm vs control."""
    a = _arms(spark, sf).join(TD.labels(spark, sf), "customer_id").withColumn("retained", 1 - F.col("is_churn"))
    return A.experiment_readout(a, "arm", "retained")


# ---------------------------------------------------------------- survival (V1-V5)
VIEWS["surv_base"] = (["member_feat", "churn_labels"], """
    SELECT m.customer_id, m.tenure_days AS duration, l.is_churn AS event
    FROM member_feat m JOIN churn_labels l ON m.customer_id = l.customer_id WHERE m.tenure_days IS NOT NULL""")
VIEWS["km"] = (["surv_base"], """
    SELECT duration, at_risk, events, removed - events AS censored,
           round_even(CASE WHEN sum(CASE WHEN events >= at_risk THEN 1 ELSE 0 END) OVER w > 0 THEN 0.0
                      ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE 0 END) OVER w) END, 6) AS survival,
           round_even(sum(events / at_risk) OVER w, 6) AS cumulative_hazard
    FROM (SELECT *, CAST(sum(removed) OVER () - COALESCE(sum(removed) OVER (ORDER BY duration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_risk
          FROM (SELECT duration, CAST(sum(event) AS BIGINT) AS events, count(*) AS removed FROM surv_base GROUP BY 1) d) r
    WINDOW w AS (ORDER BY duration ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")


def _surv(spark, sf):
    m = X.member_features(TD.members(spark, sf), SPEC).select("customer_id", "tenure_days")
    return m.join(TD.labels(spark, sf), "customer_id").filter(F.col("tenure_days").isNotNull()) \
        .select("customer_id", F.col("tenure_days").alias("duration"), F.col("is_churn").alias("event"))


@query("km_curve", sql(["km"], "SELECT * FROM km"))
def q_km(spark, sf):
    """V1/V5: Kaplan-Meier survival and Nelson-Aalen cumulative hazard by tenure."""
    return V.km_curve(_surv(spark, sf), "duration", "event")


@query("rmst", sql(["km"], """
    SELECT round_even(sum(survival * (least(COALESCE(nx, 4722), 4722) - duration)) + least(greatest(min(duration), 0), 4722), 6) AS rmst,
           CAST(4722 AS DOUBLE) AS horizon
    FROM (SELECT *, lead(duration) OVER (ORDER BY duration) AS nx FROM km) k WHERE duration < 4722"""))
def q_rmst(spark, sf):
    """V2: restricted mean survival time to t = 4722 days."""
    return V.rmst(V.km_curve(_surv(spark, sf), "duration", "event"), 4722)


@query("km_subgroup", sql(["surv_base", "txn_feat"], """
    SELECT duration, at_risk, events, removed - events AS censored,
           round_even(CASE WHEN sum(CASE WHEN events >= at_risk THEN 1 ELSE 0 END) OVER w > 0 THEN 0.0
                      ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE 0 END) OVER w) END, 6) AS survival,
           round_even(sum(events / at_risk) OVER w, 6) AS cumulative_hazard
    FROM (SELECT *, CAST(sum(removed) OVER () - COALESCE(sum(removed) OVER (ORDER BY duration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_risk
          FROM (SELECT duration, CAST(sum(event) AS BIGINT) AS events, count(*) AS removed
                FROM surv_base s JOIN txn_feat t ON s.customer_id = t.customer_id
                WHERE t.auto_renew_rate >= 0.9 GROUP BY 1) d) r
    WINDOW w AS (ORDER BY duration ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def q_km_sub(spark, sf):
    """V3: KM for the subgroup auto_renew_rate >= 0.9 (J5 inner join)."""
    t = X.transaction_features(TD.transactions(spark, sf), SPEC).select("customer_id", "auto_renew_rate")
    s = _surv(spark, sf).join(t, "customer_id").filter(F.col("auto_renew_rate") >= 0.9)
    return V.km_curve(s, "duration", "event")


@query("smoothed_hazard", sql(["km"], """
    SELECT p.duration, round_even(COALESCE(sum(CASE WHEN abs(p.duration - e.duration) <= 30
             THEN 0.75 * (1 - ((p.duration - e.duration) / 30.0) * ((p.duration - e.duration) / 30.0)) * (e.events / e.at_risk) END) / 30.0, 0), 6) AS smoothed_hazard
    FROM km p LEFT JOIN (SELECT * FROM km WHERE events > 0) e ON abs(p.duration - e.duration) <= 30
    GROUP BY p.duration"""))
def q_hazard(spark, sf):
    """V5: 30-day Epanechnikov-smoothed hazard (band join on buckets)."""
    return V.smoothed_hazard(V.km_curve(_surv(spark, sf), "duration", "event"), 30.0)


@query("km_exponential", sql(["km", "surv_base"], """
    SELECT duration, survival, round_even(exp(-(SELECT sum(event) * 365 / sum(duration) FROM surv_base) / 365 * duration), 6) AS exponential_survival
    FROM km"""))
def q_km_exp(spark, sf):
    """V1: the KM curve beside the exponential curve of the yearly churn rate."""
    s = cut_lineage(_surv(spark, sf))
    rate = s.agg((F.sum("event") * 365 / F.sum("duration")).alias("__rate"))
    curve = V.km_curve(s, "duration", "event").crossJoin(F.broadcast(rate))  # one row
    return V.exponential_reference(curve, F.col("__rate")).select("duration", "survival", "exponential_survival")


_GENDERS = ("male", "female")  # 'unknown' is the reference level
_CITIES = tuple(range(1, 25))  # code 0 is the reference level


@query("cox_model")
def q_cox(spark, sf):
    """V6: ridge Cox PH (penalty 0.1) on age, discount, auto-renewal, cancellation, gender and city, and the same
    without the cancel rate."""
    t = X.transaction_features(TD.transactions(spark, sf), SPEC).select("customer_id", "auto_renew_rate", "cancel_rate", "avg_discount")
    m = X.member_features(TD.members(spark, sf), SPEC).filter(F.col("bd_clean").isNotNull()).select(
        "customer_id", "bd_clean", *[(F.col("gender") == g).cast("double").alias(f"gender_{g}") for g in _GENDERS],
        *[F.coalesce(F.col("city") == c, F.lit(False)).cast("double").alias(f"city_{c}") for c in _CITIES])
    s = cut_lineage(_surv(spark, sf).join(t, "customer_id").join(m, "customer_id"))
    cov = ["bd_clean", "avg_discount", "auto_renew_rate", "cancel_rate", *[f"gender_{g}" for g in _GENDERS], *[f"city_{c}" for c in _CITIES]]
    fits = [V.cox_fit(s, "duration", "event", use, penalizer=0.1).withColumn("fit", F.lit(name))
            for name, use in (("all", cov), ("without_cancel_rate", [c for c in cov if c != "cancel_rate"]))]
    return fits[0].unionByName(fits[1])
