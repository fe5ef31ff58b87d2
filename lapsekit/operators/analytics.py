"""Customer analytics reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lapsekit.functions import month_index, r6, safe_div, ymd_to_date
from lapsekit.operators.cleaning import as_of, label_when
from lapsekit.spec import ObservationSpec

# Lifecycle grace window, LTV normalisation, English label constants.
GRACE_DAYS = 30
MIN_PLAN_DAYS = 7
PROBA_FLOOR = 0.01
MAX_LIFETIME_MONTHS = 60
RISK_LABELS = ("high_risk", "low_risk")
VALUE_LABELS = ("high_value", "low_value")


# --------------------------------------------------------------------- C8
def lifecycle_status(days_to_expire: Column) -> Column:
    """Unknown (NULL) / active (>0) / grace (-30..0) / lapsed (< -30)."""
    return label_when([
        (days_to_expire.isNull(), "unknown"),
        (days_to_expire > 0, "active"),
        (days_to_expire.between(-GRACE_DAYS, 0), "grace"),
    ], default="lapsed")


def lifecycle(df: DataFrame, col: str = "days_to_expire") -> DataFrame:
    return df.withColumn("lifecycle_status", lifecycle_status(F.col(col)))


# --------------------------------------------------------------------- C6
def value_features(df: DataFrame, proba: str = "churn_proba", default_plan: int | None = None) -> DataFrame:
    """Revenue per txn, 30-day normalised monthly revenue (plan floored at 7
    days), expected lifetime min(1/max(p,.01), 60) months, ltv."""
    plan = F.col("last_payment_plan_days")
    if default_plan is not None:
        plan = F.coalesce(plan, F.lit(default_plan))
    per_txn = F.col("total_amount_paid") / F.greatest(F.col("txn_count"), F.lit(1))
    monthly = per_txn / (F.greatest(plan, F.lit(MIN_PLAN_DAYS)) / 30.0)
    life = F.least(1.0 / F.greatest(F.col(proba), F.lit(PROBA_FLOOR)), F.lit(float(MAX_LIFETIME_MONTHS)))
    return df.withColumns({
        "avg_revenue_per_txn": r6(per_txn),
        "avg_monthly_revenue": r6(monthly),
        "expected_lifetime_months": r6(life),
        "ltv_approx": r6(monthly * life),
    })


# --------------------------------------------------------------------- C7
def segments(df: DataFrame, threshold: float, proba: str = "churn_proba",
             value_col: str = "avg_monthly_revenue") -> DataFrame:
    """Risk by threshold, value by the exact median of ``value_col`` (one
    distributed quantile, a 1-row broadcast), 2x2 segment label."""
    from lapsekit.operators.ordering import exact_quantiles

    med = exact_quantiles(df, [value_col], [0.5]).select(F.col("value").alias("__med"))
    j = df.crossJoin(F.broadcast(med))  # exactly one row
    risk = F.when(F.col(proba) >= threshold, RISK_LABELS[0]).otherwise(RISK_LABELS[1])
    val = F.when(F.col(value_col) >= F.col("__med"), VALUE_LABELS[0]).otherwise(VALUE_LABELS[1])
    return j.withColumns({"risk_tier": risk, "ltv_tier": val}) \
            .withColumn("segment", F.concat_ws("/", "risk_tier", "ltv_tier")).drop("__med")


# --------------------------------------------------------------------- C1-C3
def cohort_activity(txns: DataFrame, spec: ObservationSpec, max_offset: int = 11) -> DataFrame:
    """cohort = first active month; active users per (cohort, month offset).

    One shuffle on the key: ``collect_set`` of active months per customer
    (bounded by the number of calendar months, partial-aggregated so a hot
    customer never travels whole), then ``array_min`` gives the cohort (no
    self-join, no window) and ``explode`` the offsets; the final groupBy is tiny.
    """
    k = spec.key
    months = as_of(txns, "transaction_date", spec.cutoff_int) \
        .select(k, F.trunc(ymd_to_date("transaction_date"), "month").alias("m"))
    per = months.groupBy(k).agg(F.collect_set("m").alias("ms"))
    ex = per.select(F.array_min("ms").alias("cohort_month"), F.explode("ms").alias("txn_month"))
    off = (month_index("txn_month") - month_index("cohort_month")).alias("month_offset")
    g = ex.select("cohort_month", off).filter(F.col("month_offset").between(0, max_offset)) \
        .groupBy("cohort_month", "month_offset").agg(F.count(F.lit(1)).alias("active_users"))
    size = g.filter("month_offset = 0").select("cohort_month", F.col("active_users").alias("cohort_size"))
    return g.join(size, "cohort_month", "left").withColumn(
        "retention_pct", r6(F.col("active_users") / F.col("cohort_size") * 100))


def complete_cohorts(cohorts: DataFrame, spec: ObservationSpec, max_offset: int = 11) -> DataFrame:
    """Keep cohorts whose full ``max_offset`` months are observable."""
    last = F.add_months(F.trunc(F.lit(spec.cutoff), "month"), -max_offset)
    return cohorts.filter(F.col("cohort_month") <= last)


def retention_curve(cohorts: DataFrame, exclude_first: bool = True) -> DataFrame:
    """Unweighted mean retention per offset over cohorts; the first
    (left-censored) cohort is excluded."""
    c = cohorts
    if exclude_first:
        first = cohorts.agg(F.min("cohort_month").alias("__first"))
        c = cohorts.crossJoin(F.broadcast(first)).filter(F.col("cohort_month") > F.col("__first")).drop("__first")
    return c.groupBy("month_offset").agg(r6(F.avg("retention_pct")).alias("avg_retention_pct"),
                                         F.count(F.lit(1)).alias("cohorts"))


def cohort_matrix(cohorts: DataFrame, max_offset: int = 11) -> DataFrame:
    """Pivot long -> wide (cohort x offset), fixed pivot values (no extra pass)."""
    return cohorts.groupBy("cohort_month").pivot("month_offset", list(range(max_offset + 1))) \
        .agg(F.first("retention_pct"))


# --------------------------------------------------------------------- C4/C5
def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]], first_denominator: bool = True,
           last_within: Column | None = None) -> DataFrame:
    """Nested stages (each stage ANDs the previous ones), counted in ONE
    scan with ``count_if``; stage and overall conversion.  With
    ``first_denominator=False`` the first stage has a NULL denominator; the last
    stage and its denominator count only rows for which ``last_within`` holds (C5)."""
    cum = None
    aggs = []
    for i, (_, pred) in enumerate(stages):
        if last_within is not None and i == len(stages) - 1:
            cum = cum & last_within
            aggs.append(F.count_if(F.coalesce(cum, F.lit(False))).alias("within"))
        cum = pred if cum is None else (cum & pred)
        aggs.append(F.count_if(F.coalesce(cum, F.lit(False))).alias(f"s{i}"))
    wide = df.agg(*aggs)
    rows = []
    for i, (name, _) in enumerate(stages):
        den = F.col("s0") if i == 0 else F.col(f"s{i - 1}")
        if i == 0 and not first_denominator:
            den = F.lit(None).cast("long")
        if last_within is not None and i == len(stages) - 1:
            den = F.col("within")
        rows.append(F.struct(F.lit(i + 1).alias("stage_no"), F.lit(name).alias("stage"), F.col(f"s{i}").alias("count"),
                             den.alias("denominator")))
    long = wide.select(F.explode(F.array(*rows)).alias("r"), F.col("s0").alias("__base")).select("r.*", "__base")
    return long.select("stage_no", "stage", "count", "denominator",
                       r6(safe_div(F.col("count") * 100, F.col("denominator"))).alias("stage_conversion_pct"),
                       r6(F.col("count") * 100 / F.col("__base")).alias("overall_pct"))


# --------------------------------------------------------------------- C9
def ltv_concentration(df: DataFrame, ltv: str = "ltv_approx", key: str = "customer_id",
                      top_frac: float = 0.10) -> DataFrame:
    """Median / p90 / p99 of valid LTV, and the share of total LTV held by
    the top max(int(n*frac), 1) customers (exact rank through P0)."""
    from lapsekit.operators.ordering import exact_quantiles, rank_rows

    v = _valid_ltv(df, ltv)
    q = exact_quantiles(v, [ltv], [0.5, 0.9, 0.99]).groupBy().pivot("p", [0.5, 0.9, 0.99]).agg(F.first("value"))
    q = q.select(*[r6(F.col(f"`{p}`")).alias(n) for p, n in ((0.5, "ltv_median"), (0.9, "ltv_p90"), (0.99, "ltv_p99"))])
    r = rank_rows(v.select(key, ltv), ltv, key, descending=True)
    k = F.greatest(F.floor(F.col("n") * F.lit(top_frac)), F.lit(1))
    share = r.agg(r6(F.sum(F.when(F.col("rank") <= k, F.col(ltv)).otherwise(0)) / F.sum(ltv) * 100)
                  .alias("top_share_pct"), F.count(F.lit(1)).alias("customers"))
    return q.crossJoin(share)


def _valid_ltv(df: DataFrame, ltv: str) -> DataFrame:
    return df.filter(F.col(ltv).isNotNull() & (F.col(ltv) >= 0) & ~F.isnan(F.col(ltv)))


def ltv_curve(df: DataFrame, ltv: str = "ltv_approx", key: str = "customer_id", points: int = 100) -> DataFrame:
    """Cumulative concentration curve: the share of total LTV held by the
    top 1/points, 2/points, ... of customers (largest LTV first)."""
    from lapsekit.operators.ordering import sorted_prefix

    v = _valid_ltv(df, ltv).select(key, F.col(ltv).cast("double").alias("__v"))
    r = sorted_prefix(v, [F.col("__v").desc(), F.col(key).asc()], {"__r": F.lit(1), "__c": F.col("__v")}, totals=True)
    at = F.ceil(F.col("__r") * points / F.col("__r_total"))
    g = r.groupBy(at.cast("int").alias("point")).agg(F.max("__r").alias("customers"), F.max("__c").alias("__m"), F.first("__c_total").alias("__t"),
                                                     F.first("__r_total").alias("__n"))
    return g.select("point", "customers", r6(F.col("customers") * 100 / F.col("__n")).alias("customer_pct"),
                    r6(F.col("__m") * 100 / F.col("__t")).alias("ltv_share_pct"))


def ltv_clipped(df: DataFrame, ltv: str = "ltv_approx", p: float = 0.99) -> DataFrame:
    """Valid LTV clipped at its ``p`` quantile (a heavy tail would hide the distribution)."""
    from lapsekit.operators.ordering import exact_quantiles

    v = _valid_ltv(df, ltv)
    cap = exact_quantiles(v, [ltv], [p]).select(F.col("value").alias("__cap"))
    return v.crossJoin(F.broadcast(cap)).withColumn(f"{ltv}_clipped", F.least(F.col(ltv), F.col("__cap"))).drop("__cap")


# --------------------------------------------------------------------- C10
def risk_deciles(df: DataFrame, score: str, label: str, key: str = "customer_id", n_bins: int = 10) -> DataFrame:
    """Equal-size risk deciles (1 = riskiest), churn rate, lift, capture
    and cumulative capture (running sum over the 10-row result)."""
    from lapsekit.operators.ordering import equal_bins

    b = equal_bins(df, score, key, n_bins, "risk_decile")
    g = b.groupBy("risk_decile").agg(
        F.count(F.lit(1)).alias("customers"), F.sum(label).cast("long").alias("churners"),
        F.avg(label).alias("__rate"), F.avg(score).alias("__risk"))
    tot = df.agg(F.avg(label).alias("__base"), F.sum(label).alias("__pos"))
    w = Window.orderBy("risk_decile").rowsBetween(Window.unboundedPreceding, 0)  # 10 rows only
    return g.crossJoin(F.broadcast(tot)).select(
        "risk_decile", "customers", "churners", r6("__rate").alias("churn_rate"),
        r6("__risk").alias("avg_predicted_risk"),
        r6(F.col("__rate") / F.col("__base")).alias("lift"),
        r6(F.col("churners") / F.col("__pos") * 100).alias("churn_capture_pct"),
        r6(F.sum(F.col("churners") / F.col("__pos") * 100).over(w)).alias("cumulative_capture_pct"))


# --------------------------------------------------------------------- C11/C17
def target_candidates(df: DataFrame, rules: Sequence[tuple[str, Column]], label: str,
                      revenue: str = "avg_monthly_revenue") -> DataFrame:
    """C11: overlapping audience rules evaluated in ONE scan: each row carries
    the array of rules it satisfies, explode, groupBy(rule).  Rules that match
    nobody still get a row (0 customers)."""
    names = [n for n, _ in rules]
    hits = F.filter(F.array(*[F.when(p, F.lit(n)) for n, p in rules]), lambda x: x.isNotNull())
    ex = df.select(F.explode(hits).alias("strategy"), F.col(label).alias("__y"), F.col(revenue).alias("__rev"))
    g = ex.groupBy("strategy").agg(F.count(F.lit(1)).alias("__c"), F.sum("__y").alias("__p"), F.avg("__rev").alias("__r"))
    tot = df.agg(F.count(F.lit(1)).alias("__n"), F.sum(label).alias("__ptot"))
    spark = df.sparkSession
    order = spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "rule_no int, strategy string")
    j = order.join(g, "strategy", "left").crossJoin(F.broadcast(tot))
    c = F.coalesce(F.col("__c"), F.lit(0)).cast("long")
    p = F.coalesce(F.col("__p"), F.lit(0)).cast("long")
    rate = safe_div(p, c)
    return j.select("rule_no", "strategy", c.alias("customers"), r6(c / F.col("__n") * 100).alias("customer_pct"),
                    p.alias("churners"), r6(rate).alias("churn_rate"),
                    r6(rate / (F.col("__ptot") / F.col("__n"))).alias("lift"),
                    r6(p / F.col("__ptot")).alias("recall"), r6("__r").alias("avg_monthly_revenue"))


# --------------------------------------------------------------------- C12
# Campaign cost assumptions of the reference scenario table.
CONTACT_COST = 2.0
INCENTIVE_COST = 30.0
REDEMPTION_RATE = 0.20
RETAINED_MONTHS = 3
GROSS_MARGIN = 0.70
EFFECTS = (0.05, 0.10, 0.15)


def roi_scenarios(targets: DataFrame, effects: Sequence[float] = EFFECTS) -> DataFrame:
    """Campaign cost, break-even prevented-churn rate, gross/net value per
    (strategy x assumed effect); break-even NULL without churners/value."""
    spark = targets.sparkSession
    eff = spark.createDataFrame([(float(e),) for e in effects], "assumed_prevented_churn_rate double")
    cost = F.col("customers") * CONTACT_COST + F.col("customers") * REDEMPTION_RATE * INCENTIVE_COST
    value = F.col("avg_monthly_revenue") * RETAINED_MONTHS * GROSS_MARGIN
    be = F.when((F.col("churners") > 0) & (value > 0), cost / (F.col("churners") * value))
    saved = F.col("churners") * F.col("assumed_prevented_churn_rate")
    return targets.crossJoin(F.broadcast(eff)).select(
        "strategy", "assumed_prevented_churn_rate", F.col("customers").alias("selected_customers"),
        F.col("churners").alias("historical_churners"), r6(saved).alias("assumed_saved_customers"),
        r6(cost).alias("campaign_cost"), r6(saved * value).alias("assumed_gross_value"),
        r6(saved * value - cost).alias("assumed_net_value"), r6(be).alias("break_even_prevented_rate"))


# --------------------------------------------------------------------- C13
def recency_retention(df: DataFrame, recency: str, label: str, cutoffs: Sequence[int] = tuple(range(10, 150, 10))) -> DataFrame:
    """For each cutoff, share of customers with recency >= cutoff and their retention."""
    spark = df.sparkSession
    cuts = spark.createDataFrame([(int(c),) for c in cutoffs], "cutoff int")
    tot = df.agg(F.count(F.lit(1)).alias("__n"))
    # bucketed suffix sums: per distinct recency value, then a small join with the cut list
    per = df.groupBy(recency).agg(F.count(F.lit(1)).alias("__c"), F.sum(label).alias("__p"))
    j = per.join(F.broadcast(cuts), F.col(recency) >= F.col("cutoff"))  # cut list is fixed-size
    g = j.groupBy("cutoff").agg(F.sum("__c").alias("__c"), F.sum("__p").alias("__p"))
    return cuts.join(g, "cutoff", "left").crossJoin(F.broadcast(tot)).select(
        "cutoff", r6(F.coalesce("__c", F.lit(0)) / F.col("__n") * 100).alias("user_share_pct"),
        r6((1 - safe_div("__p", "__c")) * 100).alias("retention_pct"))


# --------------------------------------------------------------------- C14-C16
def z_value(p: float) -> float:
    from statistics import NormalDist
    return NormalDist().inv_cdf(p)


def power_table(candidates: DataFrame, mdes: DataFrame, alpha: float = 0.05, power: float = 0.8,
                comparisons: int = 1) -> DataFrame:
    """C14: per-arm n for two proportions (unpooled):
    ceil((z(1-a/2m) + z(power))^2 (p1q1 + p2q2) / (p2-p1)^2).
    ``candidates``: (segment, baseline_rate); ``mdes``: (segment, mde) grid."""
    z = z_value(1 - alpha / comparisons / 2) + z_value(power)
    p1 = F.col("baseline_rate")
    p2 = p1 + F.col("mde")
    n = F.ceil(F.lit(z * z) * (p1 * (1 - p1) + p2 * (1 - p2)) / ((p2 - p1) * (p2 - p1)))
    return candidates.join(mdes, "segment").select("segment", r6(p1).alias("baseline_rate"), "mde",
                                                    F.lit(alpha / comparisons).alias("alpha"),
                                                    n.cast("long").alias("n_per_arm"))


def assign_arms(df: DataFrame, key: str, strata: Sequence[str], arms: Sequence[str], seed: int = 7) -> DataFrame:
    """C15, one population at once: md5(key:seed) order inside each stratum, arm = position mod #arms (balanced
    to +-1 per stratum). The per-stratum position is P0 over md5-prefix buckets (no hot stratum task). Arms depend on
    the population: use ``sticky_arms`` where customers come in later."""
    d = _stratum_positions(df, key, strata, seed)
    arm = F.element_at(F.array(*[F.lit(a) for a in arms]), ((F.col("__r") - 1) % len(arms) + 1).cast("int"))
    return d.withColumn("arm", arm).drop("__r")


def _stratum_positions(df: DataFrame, key: str, strata: Sequence[str], seed: int) -> DataFrame:
    """``__r``: place of a row in its stratum, from 1, in the order of md5(key:seed)."""
    from lapsekit.operators.ordering import ordered_prefix

    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    d = df.withColumn("__h", h).withColumn("__b", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"))
    return ordered_prefix(d, [F.col("__h").asc(), F.col(key).asc()], {"__r": F.lit(1)}, "__b", list(strata)).drop("__h", "__b")


def sticky_arms(population: DataFrame, assigned: DataFrame, key: str, strata: Sequence[str], arms: Sequence[str],
                seed: int = 7, per_arm: int = 2) -> DataFrame:
    """Assignments of customers that have none yet, by permuted blocks; the others keep theirs.

    ``assigned`` has (key, strata, position, arm) of all earlier calls; strata are those at assignment, so a customer
    that moves to another stratum keeps arm and place. A stratum's newcomers go on where its last block
    stopped, in the order of md5(key:seed). Every block holds each arm ``per_arm`` times in an order drawn by hash,
    so two arms of a stratum never differ by more than ``per_arm``. Returns the new rows of ``assigned``; an empty
    population gives none, a NULL stratum is a stratum, and keys must be unique and not NULL (others raise or are left out).
    """
    from lapsekit.operators.ordering import null_safe_join

    strata = list(strata)
    new = population.select(key, *strata).filter(F.col(key).isNotNull()).join(assigned.select(key), key, "left_anti")
    if not new.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError(f"{key} must be unique in the population")
    last = assigned.groupBy(*strata).agg(F.max("position").alias("__last"))
    placed = null_safe_join(_stratum_positions(new, key, strata, seed), last, strata, check=True)
    placed = placed.withColumn("position", F.coalesce("__last", F.lit(0)).cast("long") + F.col("__r").cast("long"))
    size = per_arm * len(arms)
    stratum = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in strata])
    block = F.floor((F.col("position") - 1) / size).cast("string")
    draw = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.struct(
        F.md5(F.concat_ws(":", F.lit(str(seed)), stratum, block, i.cast("string"))).alias("h"), i.alias("i"))))
    slot = F.element_at(draw, (F.pmod(F.col("position") - 1, F.lit(size)) + 1).cast("int")).i
    arm = F.element_at(F.array(*[F.lit(a) for a in arms]), (slot % len(arms) + 1).cast("int"))
    return placed.select(key, *strata, "position", arm.alias("arm"))


def assign_committed(store, experiment: str, population: DataFrame, key: str, strata: Sequence[str], arms: Sequence[str],
                     seed: int = 7, per_arm: int = 2) -> DataFrame:
    """C15 with a ``TableStore``: deal out the customers of ``population`` that the experiment doesn't have yet, commit
    them, and return key and arm of the whole population. Writers that run at once deal nobody out twice: the one
    whose version was taken starts again from the other's assignments."""
    from lapsekit.session import cut_lineage
    from lapsekit.sources.store import Change

    table = f"assignments-{experiment}"
    types = dict(population.dtypes)
    schema = ", ".join([f"{key} {types[key]}", *[f"{c} {types[c]}" for c in strata], "position long", "arm string"])

    def build(base):
        new = cut_lineage(sticky_arms(population, store.read(table, schema, base), key, strata, arms, seed, per_arm))
        return None if new.isEmpty() else Change(add={table: new})

    have = store.read(table, schema, store.transact(build))
    return population.select(key).join(have, key).select(key, *strata, "position", "arm")


def experiment_readout(df: DataFrame, arm: str, outcome: str, control: str = "control",
                       comparisons: int = 1) -> DataFrame:
    """ITT rate per arm, difference vs control, 95 % CI (unpooled SE),
    relative lift, Bonferroni-adjusted alpha and significance."""
    g = df.groupBy(arm).agg(F.count(F.lit(1)).alias("n"), F.sum(outcome).cast("long").alias("successes"))
    g = g.withColumn("rate", F.col("successes") / F.col("n"))
    c = g.filter(F.col(arm) == control).select(F.col("n").alias("__n0"), F.col("rate").alias("__r0"))
    z = z_value(1 - 0.05 / comparisons / 2)
    diff = F.col("rate") - F.col("__r0")
    se = F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n") + F.col("__r0") * (1 - F.col("__r0")) / F.col("__n0"))
    return g.crossJoin(F.broadcast(c)).select(
        arm, "n", "successes", r6("rate").alias("rate"), r6(diff).alias("diff_vs_control"),
        r6(diff - z * se).alias("ci_low"), r6(diff + z * se).alias("ci_high"),
        r6(safe_div(diff, F.col("__r0"))).alias("relative_lift"),
        F.lit(0.05 / comparisons).alias("alpha"),
        (F.abs(diff) > z * se).alias("significant"))
