"""The adapter of ``sources/testdata.py`` written as ANSI SQL CTEs (DuckDB dialect).

Oracle texts are ``WITH <views needed> , <own ctes> SELECT ...``.  The raw
driver tables (customer, orders, lineitem, events) are pre-registered views.
"""

from __future__ import annotations

# Fixed values (same as sources/testdata.py).
CUTOFF = "DATE '2001-01-31'"
CUTOFF_INT = 20010131
MIN_VALID_INT = 19900101

_PLAN = ("CASE o_orderpriority WHEN '1-URGENT' THEN 7 WHEN '2-HIGH' THEN 30 WHEN '3-MEDIUM' THEN 90 "
         "WHEN '4-NOT SPECIFIED' THEN 180 WHEN '5-LOW' THEN 365 END")

VIEWS: dict[str, tuple[list[str], str]] = {
    "members": ([], """
        SELECT 'c' || c.c_custkey AS customer_id, CAST(c.c_nationkey AS INTEGER) AS city,
               CAST(floor(c.c_acctbal / 90) AS INTEGER) AS bd,
               CASE c.c_custkey % 3 WHEN 1 THEN 'male' WHEN 2 THEN 'female' END AS gender,
               c.c_mktsegment AS registered_via,
               CAST(strftime(f.first_order, '%Y%m%d') AS INTEGER) AS registration_init_time
        FROM customer c
        LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY o_custkey) f
          ON c.c_custkey = f.o_custkey"""),
    "transactions": ([], f"""
        SELECT 'c' || o.o_custkey AS customer_id,
               CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS payment_method_id,
               {_PLAN} AS payment_plan_days,
               CAST(CAST(round(o.o_totalprice * 100) AS BIGINT) / 100 AS DECIMAL(12,2)) AS plan_list_price,
               CAST(CASE WHEN li.n_lines IS NULL THEN CAST(round(o.o_totalprice * 100) AS BIGINT)
                         ELSE (CAST(round(o.o_totalprice * 100) AS BIGINT) * (li.n_lines * 100 - li.disc_pts)) // (li.n_lines * 100)
                    END / 100 AS DECIMAL(12,2)) AS actual_amount_paid,
               CAST(o.o_orderstatus = 'O' AS INTEGER) AS is_auto_renew,
               CAST(strftime(o.o_orderdate, '%Y%m%d') AS INTEGER) AS transaction_date,
               CASE WHEN o.o_orderkey % 97 = 0 THEN 19700101
                    ELSE CAST(strftime(CAST(o.o_orderdate AS DATE) + {_PLAN}, '%Y%m%d') AS INTEGER)
               END AS membership_expire_date,
               CAST(o.o_orderstatus = 'P' AS INTEGER) AS is_cancel
        FROM orders o
        LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines,
                          sum(CAST(round(l_discount * 100) AS BIGINT)) AS disc_pts
                   FROM lineitem GROUP BY l_orderkey) li
          ON o.o_orderkey = li.l_orderkey"""),
    "user_logs": ([], """
        SELECT customer_id, CAST(strftime(log_day, '%Y%m%d') AS INTEGER) AS date,
               num_25, num_50, num_75, num_985, num_100, num_unq, total_secs
        FROM (SELECT 'c' || user_id AS customer_id,
                     DATE '2001-01-31' + CAST(5 * date_diff('day', DATE '2024-01-24', CAST(ts AS DATE)) AS INTEGER) AS log_day,
                     count_if(event_type = 'click') AS num_25, count_if(event_type = 'view') AS num_50,
                     count_if(event_type = 'signup') AS num_75, count_if(event_type = 'error') AS num_985,
                     count_if(event_type = 'purchase') AS num_100,
                     count(DISTINCT props) AS num_unq, round_even(sum(value), 2) AS total_secs
              FROM events GROUP BY 1, 2) x"""),
    "churn_labels": ([], """
        SELECT 'c' || c.c_custkey AS customer_id, CAST(CASE WHEN l.o_custkey IS NULL THEN 1 ELSE 0 END AS INTEGER) AS is_churn
        FROM customer c
        LEFT JOIN (SELECT DISTINCT o_custkey FROM orders
                   WHERE CAST(o_orderdate AS DATE) > DATE '2001-01-31'
                     AND CAST(o_orderdate AS DATE) <= DATE '2001-08-01') l
          ON c.c_custkey = l.o_custkey"""),
    "ledger": ([], """
        SELECT event_id AS id, 'c' || user_id AS customer_id,
               CASE WHEN event_id % 3 = 0 THEN CAST(strftime(CAST(ts AS DATE), '%Y%m%d') AS BIGINT) * 10
                    + CASE WHEN event_type = 'click' THEN 1 ELSE 2 END END AS campaign_id,
               CASE WHEN event_type = 'click' THEN 'reminder' ELSE 'discount_offer' END AS action_type,
               (event_id % 2 = 0) AS is_read,
               CASE WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'coupon_' || event_id % 3 END AS benefit_key,
               'system' AS sent_by, ts AS sent_at
        FROM events WHERE event_type IN ('click', 'purchase')"""),
    # ---- features ----
    "member_feat": (["members"], f"""
        SELECT customer_id, city, registered_via,
               CASE WHEN bd BETWEEN 1 AND 100 THEN bd END AS bd_clean,
               CAST(CASE WHEN bd BETWEEN 1 AND 100 THEN 0 ELSE 1 END AS INTEGER) AS bd_is_missing,
               COALESCE(gender, 'unknown') AS gender,
               CAST(CASE WHEN registration_init_time IS NULL THEN NULL ELSE
                 GREATEST(date_diff('day', CAST(try_strptime(CAST(registration_init_time AS VARCHAR), '%Y%m%d') AS DATE),
                          {CUTOFF}), 0) END AS INTEGER) AS tenure_days
        FROM members"""),
    "txn_clean": (["transactions"], f"""
        SELECT *, CAST(try_strptime(CAST(transaction_date AS VARCHAR), '%Y%m%d') AS DATE) AS txn_date,
               CASE WHEN CAST(try_strptime(CAST(membership_expire_date AS VARCHAR), '%Y%m%d') AS DATE) >= DATE '1990-01-01'
                    THEN CAST(try_strptime(CAST(membership_expire_date AS VARCHAR), '%Y%m%d') AS DATE) END AS expire_date,
               plan_list_price - actual_amount_paid AS discount
        FROM (SELECT DISTINCT * FROM transactions WHERE transaction_date <= {CUTOFF_INT}) d"""),
    "txn_feat": (["txn_clean"], f"""
        SELECT a.*, l.last_payment_plan_days, l.last_plan_list_price, l.last_actual_amount_paid,
               l.last_is_auto_renew, l.days_since_last_txn, l.days_to_expire
        FROM (SELECT customer_id, count(*) AS txn_count,
                     count(DISTINCT payment_method_id) AS payment_method_nunique,
                     count(DISTINCT payment_plan_days) AS plan_days_nunique,
                     round_even(sum(is_auto_renew) / count(*), 6) AS auto_renew_rate,
                     CAST(sum(is_cancel) AS BIGINT) AS cancel_count,
                     round_even(sum(is_cancel) / count(*), 6) AS cancel_rate,
                     CAST(sum(actual_amount_paid) AS DOUBLE) AS total_amount_paid,
                     round_even(CAST(sum(discount) AS DOUBLE) / count(*), 6) AS avg_discount
              FROM txn_clean GROUP BY customer_id) a
        JOIN (SELECT customer_id, payment_plan_days AS last_payment_plan_days,
                     CAST(plan_list_price AS DOUBLE) AS last_plan_list_price,
                     CAST(actual_amount_paid AS DOUBLE) AS last_actual_amount_paid,
                     is_auto_renew AS last_is_auto_renew,
                     CAST(date_diff('day', txn_date, {CUTOFF}) AS INTEGER) AS days_since_last_txn,
                     CAST(date_diff('day', {CUTOFF}, expire_date) AS INTEGER) AS days_to_expire
              FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY txn_date DESC,
                        expire_date DESC NULLS LAST, actual_amount_paid DESC, payment_plan_days DESC,
                        plan_list_price DESC, is_auto_renew DESC, is_cancel DESC, payment_method_id DESC) AS rn
                    FROM txn_clean) r WHERE rn = 1) l
          ON a.customer_id = l.customer_id"""),
    "log_part": (["user_logs"], f"""
        SELECT customer_id,
               {", ".join(
                   f"count_if(b = {i}) AS logdays_{n}, sum(CASE WHEN b = {i} THEN num_unq END) AS num_unq_sum_{n}, "
                   f"sum(CASE WHEN b = {i} THEN plays END) AS total_plays_sum_{n}, "
                   f"sum(CASE WHEN b = {i} THEN num_100 END) AS num_100_sum_{n}, "
                   f"sum(CASE WHEN b = {i} THEN secs END) AS secs_sum_{n}, "
                   f"count(CASE WHEN b = {i} THEN secs END) AS secs_n_{n}"
                   for i, n in enumerate(["b0_6", "b7_14", "b15_29", "b30_89", "b90_plus"]))}
        FROM (SELECT customer_id, num_unq, num_100, num_25 + num_50 + num_75 + num_985 + num_100 AS plays,
                     CASE WHEN total_secs BETWEEN 0 AND 172800 THEN total_secs END AS secs,
                     CASE WHEN dbf <= 6 THEN 0 WHEN dbf <= 14 THEN 1 WHEN dbf <= 29 THEN 2 WHEN dbf <= 89 THEN 3 ELSE 4 END AS b
              FROM (SELECT *, date_diff('day', CAST(try_strptime(CAST(date AS VARCHAR), '%Y%m%d') AS DATE), {CUTOFF}) AS dbf
                    FROM user_logs WHERE date <= {CUTOFF_INT}) x) y
        GROUP BY customer_id"""),
}


def _wsum(metric: str, n: int) -> str:
    names = ["b0_6", "b7_14", "b15_29", "b30_89", "b90_plus"][:n]
    return "(" + " + ".join(f"COALESCE({metric}_{b}, 0)" for b in names) + ")"


def _wsum_range(metric: str, names) -> str:
    return "(" + " + ".join(f"COALESCE({metric}_{b}, 0)" for b in names) + ")"


def _div(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0)"


def _log_feat_sql() -> str:
    cols = ["customer_id"]
    for win, nb in (("d7", 1), ("d30", 3), ("d90", 4), ("full", 5)):
        ld = _wsum("logdays", nb)
        cols += [
            f"CAST({ld} AS BIGINT) AS {win}_active_days",
            f"round_even({_div(_wsum('num_unq_sum', nb), ld)}, 6) AS {win}_avg_num_unq",
            f"round_even({_div(_wsum('secs_sum', nb), _wsum('secs_n', nb))}, 6) AS {win}_avg_total_secs",
            f"round_even({_div(_wsum('num_100_sum', nb), _wsum('total_plays_sum', nb))}, 6) AS {win}_completion_rate",
        ]
    rec = _div(_wsum_range("secs_sum", ["b0_6", "b7_14"]), _wsum_range("secs_n", ["b0_6", "b7_14"]))
    pri = f"NULLIF({_div(_wsum_range('secs_sum', ['b15_29']), _wsum_range('secs_n', ['b15_29']))}, 0)"
    cols.append(f"round_even(({rec} - {pri}) / {pri}, 6) AS trend_secs_recent15_vs_prior15")
    return "SELECT " + ",\n".join(cols) + " FROM log_part"


VIEWS["log_feat"] = (["log_part"], _log_feat_sql())


def _resolve(names, out, seen):
    for n in names:
        if n in seen:
            continue
        deps, _ = VIEWS[n]
        _resolve(deps, out, seen)
        seen.add(n)
        out.append(n)


def sql(views: list[str], body: str, ctes: list[tuple[str, str]] = ()) -> str:
    """Compose ``WITH`` adapter views (+dependencies) and own CTEs, then ``body``."""
    order: list[str] = []
    _resolve(views, order, set())
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in order] + [f"{n} AS ({s})" for n, s in ctes]
    b = body.lstrip()
    if parts and b[:5].upper() == "WITH ":
        # the body's own WITH list continues the adapter's
        return "WITH " + ",\n".join(parts) + ",\n" + b[5:]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
