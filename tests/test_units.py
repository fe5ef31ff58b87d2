"""Hand-made frames with expected values (FIXTURES.md section 3)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from lapsekit.operators import analytics as A
from lapsekit.operators import campaign as B
from lapsekit.operators import features as X
from lapsekit.operators import metrics as E
from lapsekit.operators import ordering as O
from lapsekit.operators import survival as V
from lapsekit.spec import LEDGER_SCHEMA, TRANSACTIONS_SCHEMA, USER_LOGS_SCHEMA, ObservationSpec

SPEC = ObservationSpec()  # cutoff 2017-01-31


def ymd(d):
    return int(d.strftime("%Y%m%d"))


def key(x):
    return x if isinstance(x, str) else f"c{x}"


def logs_frame(spark, rows):
    return spark.createDataFrame([(key(r[0]), *r[1:]) for r in rows], USER_LOGS_SCHEMA)


def test_u1_buckets_and_windows(spark):
    c = SPEC.cutoff
    days = [0, 6, 7, 14, 15, 29, 30, 89, 90, -1]
    rows = [(1, ymd(c - dt.timedelta(days=d)), 1, 0, 0, 0, 1, 1, 100.0) for d in days]
    p = X.log_partials(logs_frame(spark, rows), SPEC).first()
    assert [p[f"logdays_{b}"] for b in X.BUCKET_NAMES] == [2, 2, 2, 2, 1]
    f = X.log_features(logs_frame(spark, rows), SPEC).first()
    assert (f["d7_active_days"], f["d30_active_days"], f["d90_active_days"], f["full_active_days"]) == (2, 6, 8, 9)


def test_u2_u4_secs_range_and_zero_plays(spark):
    c = SPEC.cutoff
    rows = [(1, ymd(c - dt.timedelta(days=i)), 0, 0, 0, 0, 0, 1, s) for i, s in enumerate([-1.0, 0.0, 172800.0, 172801.0])]
    f = X.log_features(logs_frame(spark, rows), SPEC).first()
    assert f["d7_avg_total_secs"] == 86400.0
    assert f["d7_active_days"] == 4
    assert f["d7_completion_rate"] is None


def test_u3_trend_zero_prior(spark):
    c = SPEC.cutoff
    rows = [(1, ymd(c - dt.timedelta(days=1)), 0, 0, 0, 0, 1, 1, 10.0),
            (1, ymd(c - dt.timedelta(days=20)), 0, 0, 0, 0, 1, 1, 0.0)]
    assert X.log_features(logs_frame(spark, rows), SPEC).first()["trend_secs_recent15_vs_prior15"] is None


def txn_frame(spark, rows):
    from decimal import Decimal
    return spark.createDataFrame([(key(r[0]), r[1], r[2], Decimal(r[3]), Decimal(r[4]), r[5], r[6], r[7], r[8]) for r in rows],
                                 TRANSACTIONS_SCHEMA)


def test_u5_u6_u7_u8_transactions(spark):
    rows = [
        (1, 1, 30, "149", "149", 1, 20170110, 20170210, 0),
        (1, 1, 30, "149", "149", 1, 20170110, 20170210, 0),     # exact duplicate (U5)
        (2, 1, 30, "149", "149", 1, 20170115, 19700101, 0),     # NULL expiry vs dated on same day (U6)
        (2, 1, 30, "149", "149", 1, 20170115, 20170201, 0),
        (3, 1, 30, "149", "99", 1, 20170120, 20170220, 0),      # same day & expiry, 99 vs 149 (U7)
        (3, 1, 30, "149", "149", 1, 20170120, 20170220, 0),
        (4, 1, 30, "149", "149", 1, 20170101, 20091231, 0),     # U8
        (5, 1, 30, "149", "149", 1, 20170101, 20100101, 0),
        (1, 1, 30, "149", "149", 1, 20170205, 20170305, 0),     # after cutoff, ignored
    ]
    f = {int(r["customer_id"][1:]): r for r in X.transaction_features(txn_frame(spark, rows), SPEC).collect()}
    assert f[1]["txn_count"] == 1
    assert f[2]["days_to_expire"] == 1
    assert f[3]["last_actual_amount_paid"] == 149.0
    assert f[4]["days_to_expire"] is None
    assert f[5]["days_to_expire"] == (dt.date(2010, 1, 1) - SPEC.cutoff).days


def test_u9_u10_members(spark):
    rows = [(i, 1, bd, None, "a", reg) for i, (bd, reg) in enumerate(
        [(None, 20100101), (0, 20100101), (1, 20100101), (100, 20100101), (101, 20170210)])]
    m = X.member_features(spark.createDataFrame(rows, "customer_id long, city int, bd int, gender string, registered_via string, registration_init_time int"), SPEC)
    r = sorted(m.collect(), key=lambda x: x["customer_id"])
    assert [x["bd_is_missing"] for x in r] == [1, 1, 0, 0, 1]
    assert [x["bd_clean"] for x in r] == [None, None, 1, 100, None]
    assert r[4]["tenure_days"] == 0 and r[0]["gender"] == "unknown"


def test_u11_lifecycle(spark):
    d = spark.createDataFrame([(None,), (1,), (0,), (-30,), (-31,)], "days_to_expire int")
    assert [r[0] for r in A.lifecycle(d).select("lifecycle_status").collect()] == ["unknown", "active", "grace", "grace", "lapsed"]


def test_u12_u13_value(spark):
    d = spark.createDataFrame([(1000.0, 10, 30, 0.005), (1000.0, 10, 0, 0.005)],
                              "total_amount_paid double, txn_count long, last_payment_plan_days int, churn_proba double")
    r = A.value_features(d, "churn_proba").collect()
    assert (r[0]["avg_monthly_revenue"], r[0]["expected_lifetime_months"], r[0]["ltv_approx"]) == (100.0, 60.0, 6000.0)
    assert r[1]["avg_monthly_revenue"] == pytest.approx(428.571429)


def preds_frame(spark):
    return spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 0), (3, 0.8, 1), (4, 0.3, 0)], "customer_id long, p double, y int")


def test_u14_metrics(spark):
    dist = E.score_distribution(preds_frame(spark), "p", "y")
    assert E.roc_auc(dist).first()["auc"] == 0.875
    assert E.average_precision(dist).first()["ap"] == pytest.approx(0.833333)
    b = E.best_f1_threshold(dist, "p").first()
    assert (b["threshold"], b["best_f1"]) == (0.8, 0.8)


def test_u15_percentiles(spark):
    r = O.avg_percentile(preds_frame(spark), "p").orderBy("customer_id").collect()
    assert [x["percentile"] for x in r] == [100.0, 62.5, 62.5, 25.0]
    g = [x[0] for x in O.avg_percentile(preds_frame(spark), "p").orderBy("customer_id")
         .select(O.risk_grade(F.col("percentile"))).collect()]
    assert g == ["critical", "low", "low", "low"]


def test_u16_equal_bins(spark):
    d = spark.createDataFrame([(i, float(i)) for i in range(11)], "customer_id long, p double")
    b = O.equal_bins(d, "p", "customer_id", 10).groupBy("bin").count().orderBy("bin").collect()
    assert [r["count"] for r in b] == [2, 1, 1, 1, 1, 1, 1, 1, 1, 1]


def test_u17_km_rmst_na(spark):
    d = spark.createDataFrame([(5, 1), (6, 0), (6, 1), (8, 1)], "duration int, event int")
    c = {r["duration"]: r for r in V.km_curve(d, "duration", "event").collect()}
    assert (c[5]["survival"], c[6]["survival"], c[8]["survival"]) == (0.75, 0.5, 0.0)
    assert (c[5]["cumulative_hazard"], c[6]["cumulative_hazard"], c[8]["cumulative_hazard"]) == (0.25, 0.583333, 1.583333)
    assert V.rmst(V.km_curve(d, "duration", "event"), 10).first()["rmst"] == 6.75


def test_u18_roi(spark):
    t = spark.createDataFrame([("s", 100, 50, 100.0)], "strategy string, customers long, churners long, avg_monthly_revenue double")
    r = {x["assumed_prevented_churn_rate"]: x for x in A.roi_scenarios(t).collect()}
    x = r[0.10]
    assert x["campaign_cost"] == 800.0 and x["break_even_prevented_rate"] == pytest.approx(0.07619, abs=1e-5)
    assert (x["assumed_saved_customers"], x["assumed_gross_value"], x["assumed_net_value"]) == (5.0, 1050.0, 250.0)


def test_u19_power(spark):
    cases = [(0.5099, [0.03, 0.05, 0.10], 0.025, [5263, 1887, 464]), (0.2347, [0.05, 0.10, 0.15], 0.05, [1204, 316, 146]),
             (0.1113, [0.10], 0.05, [209])]
    for p1, mdes, alpha, expected in cases:
        c = spark.createDataFrame([("s", p1)], "segment string, baseline_rate double")
        g = spark.createDataFrame([("s", m) for m in mdes], "segment string, mde double")
        got = [r["n_per_arm"] for r in A.power_table(c, g, alpha=alpha).orderBy("mde").collect()]
        assert got == expected


def ledger_frame(spark, rows):
    return spark.createDataFrame([(r[0], key(r[1]), *r[2:]) for r in rows], LEDGER_SCHEMA)


def scores_frame(spark, ids):
    return spark.createDataFrame([(key(i), 0.9, "high_risk", "high_risk/high_value", "lapsed", 100.0) for i in ids],
                                 "customer_id string, churn_proba double, risk_tier string, segment string, lifecycle_status string, ltv_approx double")


def test_u20_recent_exclusion(spark):
    now = dt.datetime(2024, 1, 31)
    led = ledger_frame(spark, [(1, 1, None, "reminder", False, None, "s", now - dt.timedelta(days=3)),
                               (2, 2, None, "discount_offer", False, None, "s", now - dt.timedelta(days=1))])
    s = scores_frame(spark, [1, 2, 3])
    p = B.preview(B.audience(s, led, B.AudienceSpec("winback", "reminder", exclude_recent_days=7), now),
                  B.AudienceSpec("winback", "reminder", exclude_recent_days=7)).first()
    assert (p["matched_count"], p["excluded_recent_count"], p["eligible_count"]) == (3, 1, 2)
    spec0 = B.AudienceSpec("winback", "reminder", exclude_recent_days=0)
    assert B.preview(B.audience(s, led, spec0, now), spec0).first()["eligible_count"] == 3


def test_u21_manual_ids(spark):
    raw = spark.createDataFrame([(" a", 0), ("a", 1), ("", 2), ("zz", 3)], "raw_id string, pos int")
    ids = B.normalize_ids(raw)
    spec = B.AudienceSpec("winback", "reminder", selection_mode="manual")
    led = ledger_frame(spark, [])
    p = B.preview(B.audience(scores_frame(spark, ["a", "b"]), led, spec, dt.datetime(2024, 1, 31), manual=ids), spec, ids).first()
    assert (p["requested_count"], p["matched_count"], p["excluded_condition_count"]) == (2, 1, 1)


def test_u22_idempotent_launch(spark):
    spec = B.AudienceSpec("winback", "reminder")
    rec = scores_frame(spark, [1, 2])
    camps = spark.createDataFrame([("k1",)], "request_key string")
    out = B.launch(rec, camps, spec, "k1", "n", dt.datetime(2024, 1, 31))
    assert out["campaign_recipients"].count() == 0 and out["campaigns"].count() == 0
    out2 = B.launch(rec, camps, spec, "k2", "n", dt.datetime(2024, 1, 31))
    assert out2["campaign_recipients"].count() == 2 and out2["campaigns"].first()["recipient_count"] == 2


def test_u21_long_manual_list_is_kept_whole(spark):
    raw = spark.range(1500).selectExpr("concat('c', id) AS raw_id", "cast(id AS int) AS pos")
    assert B.normalize_ids(raw).count() == 1500


def test_launch_writes_ledger_rows(spark):
    spec = B.AudienceSpec("winback", "reminder")
    out = B.launch(scores_frame(spark, ["a", "b"]), spark.createDataFrame([], "request_key string"), spec, "k", "n", dt.datetime(2024, 1, 31))
    rows = out["customer_actions"].collect()
    assert {r["customer_id"] for r in rows} == {"a", "b"} and len({r["id"] for r in rows}) == 2
    capped = B.AudienceSpec("winback", "reminder", max_recipients=1)
    with pytest.raises(ValueError):
        B.launch(scores_frame(spark, ["a", "b"]), spark.createDataFrame([], "request_key string"), capped, "k", "n", dt.datetime(2024, 1, 31))


def test_top_n_needs_a_limit():
    with pytest.raises(ValueError):
        B.AudienceSpec("winback", "reminder", selection_mode="top_n")


def test_reads_are_the_owners(spark):
    now = dt.datetime(2024, 1, 1)
    led = ledger_frame(spark, [(10, 1, None, "reminder", False, None, "s", now), (11, 2, None, "reminder", False, None, "s", now)])
    reads = spark.createDataFrame([("c2", 10), ("c2", 11)], "customer_id string, id long")  # 10 is not c2's
    new, n = B.apply_reads(led, reads)
    assert {r["id"]: r["is_read"] for r in new.collect()} == {10: False, 11: True} and n.first()["updated"] == 1


def test_u23_claim_once(spark):
    now = dt.datetime(2024, 1, 1)
    led = ledger_frame(spark, [(1, 2, None, "discount_offer", True, "b", "self:b", now)])  # c2 has it already
    claims = spark.createDataFrame([(10, "c1", "b", dt.datetime(2024, 1, 2)), (11, "c1", "b", now), (12, "c2", "b", now),
                                    (13, "c2", "renewal_reward", now)],
                                   "claim_id long, customer_id string, benefit_key string, claimed_at timestamp")
    r = {x["id"]: x for x in B.claim_benefits(led, claims).collect()}
    assert set(r) == {11, 13} and r[11]["sent_by"] == "self:b" and r[13]["sent_by"] == "self:renewal reward"
    assert all(x["is_read"] for x in r.values())


def test_u24_impute_train_only(spark):
    rows = [(1, "train", 4.0), (2, "train", 5.0), (3, "train", 6.0), (4, "valid", None), (5, "test", 1000.0)]
    d = spark.createDataFrame(rows, "customer_id long, split string, x double")
    med = X.impute_fit(d, ["x"])
    assert med.first()["x"] == 5.0
    assert X.impute_apply(d, med, ["x"]).filter("customer_id = 4").first()["x"] == 5.0


def test_u25_stratified_split_sizes(spark):
    d = spark.createDataFrame([(i, 1 if i < 64 else 0) for i in range(1000)], "customer_id long, is_churn int")
    c = {(r["split"], r["is_churn"]): r["count"] for r in X.stratified_split(d).groupBy("split", "is_churn").count().collect()}
    assert (c[("train", 0)], c[("train", 1)]) == (655, 44)
    assert (c[("valid", 0)], c[("valid", 1)]) == (140, 10)
    assert (c[("test", 0)], c[("test", 1)]) == (141, 10)


def test_u26_dense_months(spark):
    from lapsekit.operators.quality import monthly_volume
    d = spark.createDataFrame([(dt.date(2015, 1, 5),), (dt.date(2015, 3, 7),)], "d date")
    r = {x["month"]: x["rows"] for x in monthly_volume(d, "d").collect()}
    assert r[dt.date(2015, 2, 1)] == 0 and len(r) == 3


def test_exact_quantiles_interpolate(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "x double")
    assert O.exact_quantiles(d, ["x"], [0.5]).first()["value"] == 3.0


SHAPES = {
    "outlier": lambda i: 9.2e15 if i == 7 else float(i % 1000),
    "steep": lambda i: ((i * 7919 % 10007) / 10007) ** 8,
    "hot": lambda i: 0.5 if i % 3 == 0 else i / 30000.0,
}


@pytest.mark.parametrize("shape", list(SHAPES))
@pytest.mark.parametrize("keys", ["long", "string"])
def test_rank_rows_is_exact_and_even(spark, shape, keys):
    """Ranks follow (score, key) whatever the scores look like, and no partition gets much more than its share."""
    name = (lambda i: f"c{i}") if keys == "string" else (lambda i: i)
    rows = [(name(i), SHAPES[shape](i)) for i in range(6000)]
    d = spark.createDataFrame(rows, f"customer_id {keys}, p double").repartition(4)
    r = O.rank_rows(d, "p", "customer_id").orderBy("rank").collect()
    exp = sorted(rows, key=lambda t: (-t[1], t[0]))
    assert [x["customer_id"] for x in r] == [t[0] for t in exp]
    assert [x["rank"] for x in r] == list(range(1, 6001)) and r[0]["n"] == 6000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        share = O.place(d, [F.col("p").desc(), F.col("customer_id").asc()]).groupBy(O.PART).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(x["count"] for x in share) < 2 * 6000 / len(share) and len(share) == 4


def test_rank_rows_null_scores_come_last(spark):
    d = spark.createDataFrame([("a", None), ("b", 1.0), ("c", 2.0), ("d", None)], "customer_id string, p double")
    assert [x["customer_id"] for x in O.rank_rows(d, "p", "customer_id").orderBy("rank").collect()] == ["c", "b", "a", "d"]


def test_null_label_is_a_class(spark):
    d = spark.createDataFrame([(f"c{i}", None if i % 7 == 0 else i % 2) for i in range(70)], "customer_id string, is_churn int")
    assert X.stratified_split(d).count() == 70
    assert X.sample_rows(d, 3, strata="is_churn").count() == 9


def test_metrics_from_the_distribution(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    rows = [("train" if i % 2 else "valid", float(round(rng.random(), 2)), int(rng.random() < 0.3)) for i in range(400)]
    got = {r["split"]: r for r in E.evaluate(spark.createDataFrame(rows, "split string, p double, y int"), "p", "y").collect()}
    for split in ("train", "valid"):
        p, y = (np.array(x) for x in zip(*[(r[1], r[2]) for r in rows if r[0] == split]))
        pos, neg = p[y == 1], p[y == 0]
        auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        hit = p >= got[split]["threshold"]
        assert got[split]["auc"] == pytest.approx(auc, abs=1e-6)
        assert (got[split]["tp"], got[split]["fp"]) == ((hit & (y == 1)).sum(), (hit & (y == 0)).sum())


def test_one_hot_categories_are_not_numbers(spark):
    """A churn rate that isn't monotone in any order of the codes: one-hot columns separate it, indices can't."""
    from lapsekit.ml.models import fit_and_score
    rows = [(f"c{i}", "train" if i % 4 else "valid", "abcde"[i % 5], float(i % 3), int(i % 5 in (1, 3))) for i in range(600)]
    d = spark.createDataFrame(rows, "customer_id string, split string, kind string, x double, is_churn int")
    _, pred = fit_and_score(d, "lr", ["kind", "x"], ["kind"])
    assert E.roc_auc(E.score_distribution(pred, "churn_probability", "is_churn")).first()["auc"] == 1.0
    unseen = pred.limit(1).select("customer_id", "split", F.lit("z").alias("kind"), "x", "is_churn")
    model, _ = fit_and_score(d, "lr", ["kind", "x"], ["kind"])
    assert model.transform(unseen).count() == 1


def test_attributions_add_up(spark):
    from lapsekit.ml.models import fit_and_score, linear_attributions, tree_attributions
    rows = [(f"c{i}", "train" if i % 4 else "valid", "abcdefgh"[i % 8], float(i % 13), int(i % 8 in (1, 3) or i % 13 > 9)) for i in range(400)]
    d = spark.createDataFrame(rows, "customer_id string, split string, kind string, x double, is_churn int")
    for kind, explain in (("gbt", tree_attributions), ("lr", linear_attributions)):
        model, pred = fit_and_score(d, kind, ["kind", "x"], ["kind"], params={"maxIter": 8})
        a = explain(model, pred, ["kind", "x"]).join(pred.select("customer_id", "rawPrediction"), "customer_id").collect()
        for r in a:
            assert r["kind"] + r["x"] + r["base_value"] == pytest.approx(r["margin"], abs=1e-9)
            assert r["margin"] == pytest.approx(r["rawPrediction"][1], abs=1e-6)


def test_class_weight_by_repetition(spark):
    from lapsekit.ml.models import resample
    d = spark.createDataFrame([(f"c{i}", i % 4 == 0) for i in range(4000)], "customer_id string, y boolean").withColumn("y", F.col("y").cast("int"))
    n = {r["y"]: r["count"] for r in resample(d, "y", 2.5).groupBy("y").count().collect()}
    assert n[0] == 3000 and abs(n[1] - 2500) < 80


def test_cox_score_equation_is_zero(spark):
    """At the fit, the penalised score of the partial likelihood (Breslow ties) vanishes."""
    import numpy as np
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 2))
    t, e = rng.integers(1, 30, 120), rng.integers(0, 2, 120)
    df = spark.createDataFrame([(int(a), int(b), float(c), float(d)) for a, b, (c, d) in zip(t, e, x)], "t int, e int, x0 double, x1 double")
    coef = {r["covariate"]: r["coef"] for r in V.cox_fit(df, "t", "e", ["x0", "x1"], penalizer=0.1, ties="breslow").collect()}
    sd = x.std(axis=0, ddof=1)
    z = (x - x.mean(axis=0)) / sd
    beta = np.array([coef["x0"], coef["x1"]]) * sd
    w = np.exp(z @ beta)
    score = -120 * 0.1 * beta
    for i in np.flatnonzero(e):
        risk = t >= t[i]
        score += z[i] - (w[risk, None] * z[risk]).sum(axis=0) / w[risk].sum()
    assert np.abs(score).max() < 1e-6


def test_ltv_curve_and_clip(spark):
    d = spark.createDataFrame([(f"c{i}", float(i)) for i in range(1, 101)], "customer_id string, ltv_approx double")
    c = {r["point"]: r for r in A.ltv_curve(d).collect()}
    assert c[1]["ltv_share_pct"] == pytest.approx(100 * 100 / 5050, abs=1e-6) and c[100]["ltv_share_pct"] == 100.0
    assert A.ltv_clipped(d).agg(F.max("ltv_approx_clipped")).first()[0] == pytest.approx(99.01)


def test_cox_direction(spark):
    rows = [(d, 1 if d < 50 else 0, 1.0 if d < 50 else 0.0) for d in range(1, 101)]
    df = spark.createDataFrame(rows, "duration int, event int, x double")
    c = V.cox_fit(df, "duration", "event", ["x"], penalizer=0.0).first()
    assert c["coef"] > 0 and math.isfinite(c["se"])
