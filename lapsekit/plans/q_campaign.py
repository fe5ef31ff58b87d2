"""Registered queries: campaign audience, launch and ledger operations.

Scores are the scoring table on the fixed probability; the ledger is derived
from ``events`` (click -> reminder, purchase -> discount_offer); requests,
claims and manual id lists are derived from events too, so every query's
work grows with the tables.  ``as_of`` = 2024-01-31 00:00 (end of the events).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lapsekit.operators import campaign as B
from lapsekit.plans.catalog import query
from lapsekit.plans.oracle_views import VIEWS, sql
from lapsekit.plans.q_analytics import scoring_table
from lapsekit.sources import testdata as TD

AS_OF = dt.datetime(2024, 1, 31)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
SPEC = B.AudienceSpec(purpose="winback", action_type="reminder", exclude_recent_days=7,
                      selection_mode="top_n", audience_limit=100)

VIEWS["aud"] = (["scoring", "ledger"], f"""
    SELECT s.*, r.customer_id IS NOT NULL AS recent FROM scoring s
    LEFT JOIN (SELECT DISTINCT customer_id FROM ledger WHERE action_type = 'reminder'
               AND sent_at >= {AS_OF_SQL} - INTERVAL 7 DAY) r ON s.customer_id = r.customer_id
    WHERE s.lifecycle_status = 'lapsed'""")
VIEWS["campaigns"] = (["ledger"], """
    SELECT CAST(strftime(CAST(sent_at AS DATE), '%Y%m%d') AS BIGINT) * 10 + CASE WHEN action_type = 'reminder' THEN 1 ELSE 2 END AS id,
           action_type || ' ' || strftime(CAST(sent_at AS DATE), '%Y-%m-%d') AS name,
           action_type || ':' || strftime(CAST(sent_at AS DATE), '%Y-%m-%d') AS request_key,
           action_type, count(*) AS recipient_count, min(sent_at) AS created_at
    FROM ledger GROUP BY 1, 2, 3, 4""")


def _scores(spark, sf):
    return scoring_table(spark, sf)


def _ledger(spark, sf):
    return TD.ledger(spark, sf)


def campaigns(spark, sf):
    l = _ledger(spark, sf)
    d = F.to_date("sent_at")
    return l.groupBy(
        (F.date_format(d, "yyyyMMdd").cast("long") * 10 + F.when(F.col("action_type") == "reminder", 1).otherwise(2)).alias("id"),
        F.concat_ws(" ", "action_type", F.date_format(d, "yyyy-MM-dd")).alias("name"),
        F.concat_ws(":", "action_type", F.date_format(d, "yyyy-MM-dd")).alias("request_key"),
        "action_type").agg(F.count(F.lit(1)).alias("recipient_count"), F.min("sent_at").alias("created_at"))


def _flagged(spark, sf, spec=SPEC):
    return B.audience(_scores(spark, sf), _ledger(spark, sf), spec, AS_OF)


@query("audience_flags", sql(["aud"], "SELECT customer_id, recent FROM aud"))
def q_audience(spark, sf):
    """B1/B2: lapsed customers flagged when a reminder went out in the last 7 days."""
    return _flagged(spark, sf).select("customer_id", "recent")


@query("campaign_preview", sql(["aud"], """
    SELECT count(*) AS requested_count, count(*) AS matched_count, CAST(0 AS BIGINT) AS excluded_condition_count,
           count(*) - count_if(NOT recent) AS excluded_recent_count, count_if(NOT recent) AS eligible_count,
           least(count_if(NOT recent), 100) AS selected_count,
           least(count_if(NOT recent), 100) > 0 AS launchable,
           CASE WHEN least(count_if(NOT recent), 100) = 0 THEN 'no_eligible_customers' END AS warning
    FROM aud"""))
def q_preview(spark, sf):
    """Preview counts for a top-100 win-back reminder."""
    return B.preview(_flagged(spark, sf), SPEC)


@query("preview_sample", sql(["aud"], """
    SELECT customer_id, churn_proba, segment FROM aud WHERE NOT recent ORDER BY churn_proba DESC, customer_id LIMIT 10"""))
def q_sample(spark, sf):
    """Preview sample, top 10 eligible by risk."""
    return B.preview_sample(_flagged(spark, sf), SPEC).select("customer_id", "churn_proba", "segment")


@query("launch_recipients", sql(["aud"], """
    SELECT customer_id, 'treatment' AS group_type, churn_proba AS churn_proba_at_send, segment AS segment_at_send,
           lifecycle_status AS lifecycle_at_send
    FROM aud WHERE NOT recent ORDER BY churn_proba DESC, customer_id LIMIT 100"""))
def q_launch(spark, sf):
    """Top-100 selection snapshot written at launch (new request key)."""
    return _launched(spark, sf)["campaign_recipients"].drop("campaign_id")


def _launched(spark, sf, request_key="winback-2024-01-31"):
    flagged = _flagged(spark, sf)
    return B.launch(B.select_recipients(flagged, SPEC), campaigns(spark, sf), SPEC, request_key, "winback reminder", AS_OF,
                    counts=B.preview(flagged, SPEC))


_CID = "CAST('0x' || substr(md5('winback-2024-01-31'), 1, 12) AS BIGINT)"


@query("customer_actions", sql(["aud"], f"""
    SELECT {_CID} AS campaign_id, customer_id, 'reminder' AS action_type, FALSE AS is_read, 'staff' AS sent_by, {AS_OF_SQL} AS sent_at,
           1 AS rows_with_id
    FROM aud WHERE NOT recent ORDER BY churn_proba DESC, customer_id LIMIT 100"""))
def q_actions(spark, sf):
    """The ledger rows of a launch; every row has an id of its own."""
    from pyspark.sql import Window
    out = _launched(spark, sf)["customer_actions"]
    own = F.count(F.lit(1)).over(Window.partitionBy("id")).cast("int")
    return out.withColumn("rows_with_id", own).select("campaign_id", "customer_id", "action_type", "is_read", "sent_by", "sent_at", "rows_with_id")


@query("launched_campaign", sql(["aud"], f"""
    SELECT {_CID} AS id, 'winback reminder' AS name, 'winback' AS purpose, 'lapsed' AS lifecycle_status, 'top_n' AS selection_mode,
           100 AS audience_limit, 7 AS exclude_recent_days, count(*) AS matched_count, count_if(recent) AS excluded_count,
           least(count_if(NOT recent), 100) AS recipient_count, 'completed' AS status FROM aud"""))
def q_campaign_row(spark, sf):
    """The campaign row with its filters and counts."""
    return _launched(spark, sf)["campaigns"].select("id", "name", "purpose", "lifecycle_status", "selection_mode", "audience_limit",
                                                    "exclude_recent_days", "matched_count", "excluded_count", "recipient_count", "status")


@query("launch_idempotent", sql(["campaigns"], """
    SELECT count(*) AS campaigns, count(DISTINCT request_key) AS request_keys, CAST(0 AS BIGINT) AS recipients_second_launch
    FROM campaigns"""))
def q_idem(spark, sf):
    """A launch with the key of an existing campaign adds neither a campaign nor recipients."""
    have = campaigns(spark, sf)
    key = have.agg(F.min("request_key")).first()[0]
    out = _launched(spark, sf, key)
    both = have.select("request_key").unionByName(out["campaigns"].select("request_key"))
    return both.agg(F.count(F.lit(1)).alias("campaigns"), F.count_distinct("request_key").alias("request_keys")).crossJoin(
        out["campaign_recipients"].agg(F.count(F.lit(1)).alias("recipients_second_launch")))


def _store(spark, sf):
    """A store whose ledger is the adapter's."""
    import uuid

    from lapsekit.session import checkpoint_dir
    from lapsekit.sources.store import Change, Snapshot, TableStore

    store = TableStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}")
    ledger = _ledger(spark, sf).select(*[c.split(" ")[0] for c in B.ACTION_SCHEMA.split(", ")])
    first = ledger.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]
    store.commit(Snapshot(), Change(add={"customer_actions": B._as(ledger, B.ACTION_SCHEMA)}, properties={"next_action_id": first}))
    return store


@query("launch_committed", sql(["aud", "ledger"], f"""
    WITH r AS (SELECT customer_id FROM aud WHERE NOT recent ORDER BY churn_proba DESC, customer_id LIMIT 100)
    SELECT CAST(1 AS BIGINT) AS campaigns, (SELECT count(*) FROM r) AS recipients, l.id + row_number() OVER (ORDER BY customer_id) AS id,
           customer_id, CAST(1 AS BIGINT) AS campaign_id, 'reminder' AS action_type, 'staff' AS sent_by, {AS_OF_SQL} AS sent_at
    FROM r CROSS JOIN (SELECT coalesce(max(id), 0) AS id FROM ledger) l"""))
def q_launch_committed(spark, sf):
    """Three launches with one request key at the same time; campaign, recipients and ledger rows of the one that
    was committed."""
    from concurrent.futures import ThreadPoolExecutor

    from lapsekit.session import cut_lineage

    store, scores = _store(spark, sf), cut_lineage(_scores(spark, sf))
    with ThreadPoolExecutor(3) as pool:
        done = [pool.submit(B.launch_committed, store, scores, SPEC, "winback-2024-01-31", "winback reminder", AS_OF) for _ in range(3)]
        version = max((d.result() for d in done), key=lambda s: s.version)
    read = lambda t, schema: store.read(t, schema, version)
    one = read("campaigns", B.CAMPAIGN_SCHEMA).agg(F.count(F.lit(1)).alias("campaigns")).crossJoin(
        read("campaign_recipients", B.RECIPIENT_SCHEMA).agg(F.count(F.lit(1)).alias("recipients")))
    new = read("customer_actions", B.ACTION_SCHEMA).filter(F.col("campaign_id") == 1)
    return new.crossJoin(F.broadcast(one)).select("campaigns", "recipients", "id", "customer_id", "campaign_id", "action_type", "sent_by", "sent_at")


VIEWS["manual_ids"] = (["churn_labels"], """
    SELECT trim(raw_id) AS id, min(pos) AS pos FROM (
      SELECT '  c' || CAST(user_id AS VARCHAR) || ' ' AS raw_id, event_id AS pos FROM events WHERE event_type = 'signup'
      UNION ALL SELECT 'zz', -2 UNION ALL SELECT '', -1) x
    WHERE trim(raw_id) <> '' GROUP BY 1""")


def _manual(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").filter("event_type = 'signup'")
    odd = spark.createDataFrame([("zz", -2), ("", -1)], "raw_id string, pos long")  # unknown and empty
    raw = ev.select(F.concat(F.lit("  "), TD.customer_key("user_id"), F.lit(" ")).alias("raw_id"),
                    F.col("event_id").alias("pos")).unionByName(odd)
    return B.normalize_ids(raw)


@query("manual_preview", sql(["scoring", "ledger", "manual_ids"], f"""
    WITH m AS (SELECT s.*, r.customer_id IS NOT NULL AS recent FROM scoring s
               LEFT JOIN (SELECT DISTINCT customer_id FROM ledger WHERE action_type = 'discount_offer'
                          AND sent_at >= {AS_OF_SQL} - INTERVAL 14 DAY) r ON s.customer_id = r.customer_id
               WHERE s.lifecycle_status = 'active' AND s.customer_id IN (SELECT id FROM manual_ids))
    SELECT (SELECT count(*) FROM manual_ids) AS requested_count, count(*) AS matched_count,
           greatest((SELECT count(*) FROM manual_ids) - count(*), 0) AS excluded_condition_count,
           count(*) - count_if(NOT recent) AS excluded_recent_count, count_if(NOT recent) AS eligible_count,
           count_if(NOT recent) AS selected_count,
           count_if(NOT recent) > 0 AS launchable,
           CASE WHEN count_if(NOT recent) = 0 THEN 'no_eligible_customers' END AS warning
    FROM m"""))
def q_manual(spark, sf):
    """B1/B3 manual mode: trimmed, de-duplicated id list (J10), retention purpose."""
    spec = B.AudienceSpec(purpose="retention", action_type="discount_offer", exclude_recent_days=14,
                          selection_mode="manual")
    ids = _manual(spark, sf)
    f = B.audience(_scores(spark, sf), _ledger(spark, sf), spec, AS_OF, manual=ids)
    return B.preview(f, spec, requested=ids)


@query("customer_search", sql(["scoring"], """
    SELECT customer_id, churn_proba, lifecycle_status FROM scoring WHERE contains(CAST(customer_id AS VARCHAR), '12')
    ORDER BY churn_proba DESC, customer_id LIMIT 20 OFFSET 20"""))
def q_search(spark, sf):
    """Id substring search (overrides filters), page 2 of 20."""
    page, _ = B.search(_scores(spark, sf), " 12 ", {"risk_tier": "high_risk"}, 2, 20)
    return page.select("customer_id", "churn_proba", "lifecycle_status")


@query("search_total", sql(["scoring"], """
    SELECT count(*) AS total FROM scoring WHERE risk_tier = 'high_risk' AND lifecycle_status = 'lapsed'"""))
def q_search_total(spark, sf):
    """Filtered search total (no id substring)."""
    _, total = B.search(_scores(spark, sf), None, {"risk_tier": "high_risk", "lifecycle_status": "lapsed"}, 1, 20)
    return total


@query("overview", sql(["scoring", "ledger", "campaigns"], """
    SELECT count(*) AS customers, count_if(risk_tier = 'high_risk') AS high_risk,
           count_if(lifecycle_status = 'active') AS active, count_if(lifecycle_status = 'grace') AS grace,
           count_if(lifecycle_status = 'lapsed') AS lapsed, round_even(avg(churn_proba), 6) AS avg_churn_proba,
           (SELECT count(*) FROM ledger) AS actions, (SELECT count(DISTINCT customer_id) FROM ledger) AS contacted_customers,
           (SELECT count(*) FROM campaigns) AS campaigns
    FROM scoring"""))
def q_overview(spark, sf):
    """One-row KPI overview."""
    return B.overview(_scores(spark, sf), _ledger(spark, sf), campaigns(spark, sf))


def _contacts(spark, sf):
    return B.contact_summary(_ledger(spark, sf), _scores(spark, sf), campaigns(spark, sf))


@query("contacts_total", sql(["ledger"], "SELECT count(*) AS total FROM ledger"))
def q_contacts_total(spark, sf):
    """Ledger rows."""
    return _contacts(spark, sf)["total"]


@query("contacts_by_type", sql(["ledger"], "SELECT action_type, count(*) AS actions FROM ledger GROUP BY 1"))
def q_by_type(spark, sf):
    """Actions by type."""
    return _contacts(spark, sf)["by_type"]


@query("contacts_by_segment", sql(["ledger", "scoring"], """
    SELECT s.segment, count(*) AS actions FROM ledger l JOIN scoring s ON l.customer_id = s.customer_id GROUP BY 1"""))
def q_by_segment(spark, sf):
    """Actions by segment (ledger x scores inner join)."""
    return _contacts(spark, sf)["by_segment"]


@query("latest_contacts", sql(["ledger", "scoring", "campaigns"], """
    SELECT l.id, l.customer_id, l.action_type, l.sent_by, l.sent_at, l.campaign_id, c.name AS campaign_name, s.segment
    FROM ledger l JOIN scoring s ON l.customer_id = s.customer_id LEFT JOIN campaigns c ON l.campaign_id = c.id
    ORDER BY l.sent_at DESC, l.id DESC LIMIT 10"""))
def q_latest(spark, sf):
    """Ten latest ledger rows of scored customers, with campaign name and segment."""
    return _contacts(spark, sf)["latest"].select("id", "customer_id", "action_type", "sent_by", "sent_at", "campaign_id",
                                                 "campaign_name", "segment")


@query("campaign_history", sql(["campaigns"], """
    SELECT id, name, recipient_count, created_at FROM campaigns ORDER BY created_at DESC, id DESC LIMIT 10"""))
def q_history(spark, sf):
    """Newest campaigns first."""
    return campaigns(spark, sf).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(10) \
        .select("id", "name", "recipient_count", "created_at")


@query("inbox_latest3", sql(["ledger"], """
    SELECT id, customer_id, action_type, is_read, sent_at FROM (
      SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY sent_at DESC, id DESC) AS rn FROM ledger) x WHERE rn <= 3"""))
def q_inbox(spark, sf):
    """Newest 3 messages per customer."""
    return B.inbox(_ledger(spark, sf), 3).select("id", "customer_id", "action_type", "is_read", "sent_at")


def _reads(l):
    """Read-all requests of customers c...5, single reads by the owner (id % 7 = 0) and by a stranger (id % 11 = 0)."""
    return l.filter(F.col("customer_id").endswith("5")).select("customer_id", F.lit(None).cast("long").alias("id")).distinct() \
        .unionByName(l.filter(F.col("id") % 7 == 0).select("customer_id", "id")) \
        .unionByName(l.filter(F.col("id") % 11 == 0).select(F.concat("customer_id", F.lit("x")).alias("customer_id"), "id"))


@query("apply_reads", sql(["ledger"], """
    SELECT count_if(NOT is_read AND (customer_id LIKE '%5' OR id % 7 = 0)) AS updated FROM ledger"""))
def q_reads(spark, sf):
    """Number of messages that bulk read marks change."""
    l = _ledger(spark, sf)
    return B.apply_reads(l, _reads(l))[1]


@query("ledger_after_reads", sql(["ledger"], """
    SELECT id, customer_id, is_read OR customer_id LIKE '%5' OR id % 7 = 0 AS is_read, sent_at FROM ledger"""))
def q_ledger_after_reads(spark, sf):
    """The new ledger; a stranger's read request changes nothing."""
    l = _ledger(spark, sf)
    return B.apply_reads(l, _reads(l))[0].select("id", "customer_id", "is_read", "sent_at")


@query("claim_benefits", sql(["ledger"], """
    SELECT event_id AS id, customer_id, benefit_key, TRUE AS is_read,
           'self:' || CASE benefit_key WHEN 'renewal_reward' THEN 'renewal reward' ELSE benefit_key END AS sent_by, ts AS sent_at FROM (
      SELECT *, row_number() OVER (PARTITION BY customer_id, benefit_key ORDER BY ts, event_id) AS rn
      FROM (SELECT event_id, 'c' || user_id AS customer_id, ts,
                   CASE event_id % 4 WHEN 3 THEN 'renewal_reward' ELSE 'coupon_' || event_id % 4 END AS benefit_key
            FROM events WHERE event_type IN ('purchase', 'view')) e) x
    WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM ledger l WHERE l.customer_id = x.customer_id AND l.benefit_key = x.benefit_key)"""))
def q_claims(spark, sf):
    """One claim per (customer, benefit), earliest wins, none that the ledger holds; self-claimed rows."""
    ev = spark.read.parquet(f"{sf}/events.parquet").filter("event_type in ('purchase', 'view')")
    kind = F.col("event_id") % 4
    claims = ev.select(F.col("event_id").alias("claim_id"), TD.customer_key("user_id").alias("customer_id"),
                       F.when(kind == 3, "renewal_reward").otherwise(F.concat(F.lit("coupon_"), kind.cast("string"))).alias("benefit_key"),
                       F.col("ts").alias("claimed_at"))
    return B.claim_benefits(_ledger(spark, sf), claims).select("id", "customer_id", "benefit_key", "is_read", "sent_by", "sent_at")


@query("score_lookup", sql(["scoring"], "SELECT * FROM scoring WHERE customer_id = 'c7'"))
def q_lookup(spark, sf):
    """One customer's score row."""
    return _scores(spark, sf).filter(F.col("customer_id") == "c7")


@query("single_actions", sql(["scoring"], f"""
    SELECT event_id AS id, 'c' || user_id AS customer_id, 'reminder' AS action_type, {AS_OF_SQL} AS sent_at
    FROM events WHERE event_type = 'view' AND 'c' || user_id IN (SELECT customer_id FROM scoring)"""))
def q_single(spark, sf):
    """Action rows only for existing scored customers (semi join)."""
    ev = spark.read.parquet(f"{sf}/events.parquet").filter("event_type = 'view'")
    req = ev.select(F.col("event_id").alias("request_id"), TD.customer_key("user_id").alias("customer_id"),
                    F.lit("reminder").alias("action_type"))
    return B.single_actions(req, _scores(spark, sf), AS_OF).select("id", "customer_id", "action_type", "sent_at")


@query("ledger_evolution", sql(["ledger"], """
    SELECT id, customer_id, action_type, COALESCE(is_read, FALSE) AS is_read, COALESCE(benefit_key, 'none') AS benefit_key
    FROM (SELECT id, customer_id, action_type, CAST(NULL AS BOOLEAN) AS is_read, CAST(NULL AS VARCHAR) AS benefit_key
          FROM ledger WHERE id % 2 = 0
          UNION ALL SELECT id, customer_id, action_type, is_read, benefit_key FROM ledger WHERE id % 2 = 1) u"""))
def q_evolve(spark, sf):
    """Old rows without the new columns + new rows, defaults filled."""
    l = _ledger(spark, sf)
    old = l.filter(F.col("id") % 2 == 0).select("id", "customer_id", "action_type")
    new = l.filter(F.col("id") % 2 == 1).select("id", "customer_id", "action_type", "is_read", "benefit_key")
    return B.evolve(old, new, {"is_read": False, "benefit_key": "none"})


@query("kpi_reference_cohorts", sql(["cohorts"], """
    SELECT strftime(cohort_month, '%Y-%m') AS cohort, month_offset, retention_pct FROM cohorts
    WHERE cohort_month <= DATE '2000-02-01' ORDER BY cohort_month, month_offset"""))
def q_kpi_cohorts(spark, sf):
    """KPI bundle reference table (retention cohort), ordered for serving."""
    from lapsekit.operators import analytics as A
    from lapsekit.spec import TESTDATA_SPEC
    c = A.complete_cohorts(A.cohort_activity(TD.transactions(spark, sf), TESTDATA_SPEC), TESTDATA_SPEC)
    return c.orderBy("cohort_month", "month_offset").select(
        F.date_format("cohort_month", "yyyy-MM").alias("cohort"), "month_offset", "retention_pct")


def kpi_bundle(spark, sf):
    """The five reference tables of the KPI page, each in its serving order. Importance and drivers read one model
    table, which is built and written once."""
    from lapsekit.plans import q_analytics as QA
    from lapsekit.plans import q_models as QM
    table = QM._table(spark, sf)
    return {
        "model_stats": QM.q_model_stats(spark, sf).orderBy("model"),
        "importance": QM.q_attr(spark, sf, table).orderBy(F.desc("mean_abs"), "feature"),
        "funnel": QA.q_funnel_all(spark, sf).orderBy("stage_no"),
        "drivers": QM.q_driver_summary(spark, sf, table).orderBy(F.desc("pct"), "driver"),
        "cohorts": q_kpi_cohorts(spark, sf),
    }


@query("kpi_bundle_rows", sql(["cohorts", "drivers"], """
    SELECT 'model_stats' AS reference_table, 2 AS rows UNION ALL SELECT 'importance', 57 UNION ALL SELECT 'funnel', 6
    UNION ALL SELECT 'drivers', (SELECT count(DISTINCT driver) FROM drivers)
    UNION ALL SELECT 'cohorts', (SELECT count(*) FROM cohorts WHERE cohort_month <= DATE '2000-02-01')"""))
def q_kpi_bundle(spark, sf):
    """Row counts of the KPI page's five reference tables."""
    out = None
    for name, df in kpi_bundle(spark, sf).items():
        n = df.agg(F.lit(name).alias("reference_table"), F.count(F.lit(1)).alias("rows"))
        out = n if out is None else out.unionByName(n)
    return out


@query("kpi_reference_drivers", sql(["drivers"], """
    SELECT driver, count(*) AS customers, round_even(count(*) / (SELECT count(*) FROM drivers) * 100, 6) AS pct
    FROM drivers GROUP BY driver ORDER BY pct DESC, driver"""))
def q_kpi_drivers(spark, sf):
    """Top drivers by share, ordered for serving."""
    from lapsekit.plans import q_models as QM
    return QM.q_driver_summary(spark, sf).select("driver", "customers", "pct").orderBy(F.desc("pct"), "driver")
